"""Whole feature rows, the dataset, ranked candidates and search over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.functions import expressions as x
from almagest.operators import features as f
from almagest.operators import ranking as rk
from almagest.plans import snapshots as sn
from almagest.sources.runtime import materialise, table
from almagest.sources.tables import SNAPSHOTS, snapshots, visible

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


_KEY = list(f.KEY)
#: Feature groups of a row by name of their query, in the order of their columns.
GROUPS = ("snapshot_activity", "snapshot_dynamics", "snapshot_decline", "source_entropy_hhi", "snapshot_participants", "snapshot_convergence", "snapshot_credibility", "claim_conflict", "maturity_progress", "snapshot_quality", "relation_targets_pivot")
PERCENTILES = ("document_count", "mention_count", "organization_count", "mention_growth_12m", "source_type_diversity")
LEAST_DOCUMENTS = 2
#: Names of all predictors, those that may be missing among them.
PREDICTORS = (
    "age_days document_count mention_count documents_last_year publication_growth mention_growth_3m mention_growth_6m mention_growth_12m mention_growth_24m growth_acceleration burst_score growth_persistence active_month_ratio days_since_last_signal decline_rate"
    " organization_count organization_entropy organization_hhi top_organization_share country_count country_entropy country_hhi top_country_share new_organization_rate returning_organization_rate organization_user_balance"
    " source_type_diversity recent_source_convergence n_to_r_lag_days n_to_a_lag_days evidence_chain_length source_entropy reliability_weighted_mentions accepted_mention_ratio speculative_claim_ratio negated_claim_ratio independent_evidence_family_count claim_to_evidence_gap mean_extraction_confidence"
    " comparable_claim_slot_count corroborated_claim_slot_count mixed_origin_group_count independent_claim_conflict_strength independent_refutation_share max_maturity_rank maturity_growth time_to_pilot_days time_in_prototype_stage_days implementation_count fulltext_coverage provisional_resolution_ratio"
    " A N R new_relation_count growth_plateau_score"
).split()


def _sql_name(c: str) -> str:
    return f'"{c}"' if c in ("A", "N", "R") else c


def _pct(c: str) -> str:
    n = _sql_name(c)
    whole = f"count({n}) OVER (PARTITION BY snapshot)"
    return f"CASE WHEN {n} IS NOT NULL THEN round((rank() OVER (PARTITION BY snapshot ORDER BY {n} NULLS LAST) - 1 + 0.5 * count(*) OVER (PARTITION BY snapshot, {n})) / {whole}, 6) END AS {c}_snapshot_pct"


_MISSING = " + ".join(f"(CASE WHEN {_sql_name(c)} IS NULL THEN 1 ELSE 0 END)" for c in PREDICTORS)
_ROWS = (
    "WITH " + ", ".join(f"g{i} AS ({sn.ORACLE_SQL[name]})" for i, name in enumerate(GROUPS)) + f""", gn AS ({sn.ORACLE_SQL['new_relation_count']}),
j AS (SELECT *, round((1 - least(1.0, abs(mention_growth_12m))) * least(1.0, ln(1 + mention_count) / ln(101.0)), 6) AS growth_plateau_score FROM (SELECT g0.*, """
    + ", ".join(f"g{i}.* EXCLUDE (technology, snapshot)" for i in range(1, len(GROUPS)))
    + ", coalesce(gn.new_relation_count, 0) AS new_relation_count FROM g0 "
    + " ".join(f"JOIN g{i} ON g{i}.technology = g0.technology AND g{i}.snapshot = g0.snapshot" for i in range(1, len(GROUPS)))
    + f""" LEFT JOIN gn ON gn.technology = g0.technology AND gn.snapshot = g0.snapshot) WHERE document_count >= {LEAST_DOCUMENTS}),
k AS (SELECT *, {_MISSING} AS missing FROM j)
SELECT * EXCLUDE (missing), CAST(missing AS BIGINT) AS feature_missingness_count, round(1 - missing / {len(PREDICTORS)}.0, 6) AS data_completeness_score, {', '.join(map(_pct, PERCENTILES))} FROM k"""
)


@query("snapshot_rows", _ROWS)
def snapshot_rows(spark, sf, dates=SNAPSHOTS):
    """All predictors of every part at every date: the feature groups of one shared view, missingness, and ranks within the date."""
    return _feature_rows(spark, sf, f.dealt_facts(spark, sf, _last(dates)), dates)


def _last(dates):
    return F.lit(max(dates)).cast("date")


def _feature_rows(spark, sf, facts, dates):
    view = visible(facts, snapshots(spark, dates))
    countries = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("organization"), F.col("s_nationkey").alias("country"))
    r = sn._round
    tiered = view.withColumn("tier", F.left("family", F.lit(1)).try_cast("double"))
    absolute = lambda df, c: df.withColumn(c, F.abs(c))
    groups = [
        r(f.dynamics(view)), r(f.decline(view)), absolute(r(f.diversity(view, "organization", "organization")), "organization_entropy"), absolute(r(f.participants(view, countries)), "country_entropy"),
        absolute(r(f.convergence(view, ("N", "R", "A"))), "source_entropy"), r(f.credibility(tiered), 9), r(f.claim_slots(view)), r(f.maturity(view)), r(f.quality(view)), f.relations(view, ("A", "N", "R")),
    ]
    rows = r(f.activity(view)).where(F.col("document_count") >= LEAST_DOCUMENTS)
    for group in groups:
        rows = rows.join(group, _KEY)
    rows = rows.join(f.new_relations(view), _KEY, "left").withColumn("new_relation_count", F.coalesce("new_relation_count", F.lit(0)))
    rows = rows.withColumn("growth_plateau_score", F.round(x.growth_plateau(F.col("mention_count"), F.col("mention_growth_12m")), 6))
    out = f.midrank(f.missingness(rows, PREDICTORS), list(PERCENTILES))
    rounded = [c for c in out.columns if c.endswith("_snapshot_pct") or c == "data_completeness_score"]
    return out.select(*(F.round(c, 6).alias(c) if c in rounded else F.col(c).cast("long").alias(c) if c == "feature_missingness_count" else F.col(c) for c in out.columns))


@query("dataset_rows", f"""WITH rows_ AS ({_ROWS}), outcomes AS ({sn.ORACLE_SQL['future_outcomes']}), splits AS ({sn.ORACLE_SQL['temporal_split_purge']})
SELECT r.technology, r.snapshot, r.document_count, r.mention_growth_12m, r.data_completeness_score, o.future_documents, o.label_realized, o.label_reason, coalesce(s.split, 'unlabelled') AS split
FROM rows_ r LEFT JOIN outcomes o ON o.technology = r.technology AND o.snapshot = r.snapshot LEFT JOIN splits s ON s.technology = r.technology AND s.snapshot = r.snapshot""")
def dataset_rows(spark, sf):
    """Feature rows of all parts and dates with what came after, and the part of the split each belongs to."""
    facts = f.dealt_facts(spark, sf, F.add_months(_last(SNAPSHOTS), sn.HORIZON))
    rows = _feature_rows(spark, sf, facts, SNAPSHOTS).select(*_KEY, "document_count", "mention_growth_12m", "data_completeness_score")
    labelled = materialise(sn.outcomes(spark, facts), "outcomes")
    outcomes = labelled.select(*_KEY, "future_documents", "label_realized", "label_reason")
    splits = sn.split(labelled).select(*_KEY, "split")
    return rows.join(outcomes, _KEY, "left").join(splits, _KEY, "left").withColumn("split", F.coalesce("split", F.lit("unlabelled")))


_AT = "1999-01-01"
WEIGHTS = {"mention_growth_12m": 1.0, "growth_acceleration": 0.5, "source_type_diversity": 0.5, "organization_count": 0.75, "maturity_growth": 0.5, "implementation_count": -1.0}
_GENERIC = ("red plate", "small widget")
_RANKED = f"""rows_ AS (SELECT * FROM ({_ROWS}) WHERE snapshot = DATE '{_AT}'), src AS (SELECT l_partkey AS technology, count(DISTINCT l_suppkey) AS sources FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) <= DATE '{_AT}' AND CAST(o_orderdate AS DATE) > DATE '{_AT}' - INTERVAL 24 MONTH GROUP BY 1),
jd AS (SELECT rows_.*, CASE WHEN p_type IN ('PROMO') THEN 'noise' WHEN lower(trim(p_name)) IN {_GENERIC} THEN 'standard' WHEN max_maturity_rank > 6 AND implementation_count > 3 THEN 'mature' WHEN age_days > 6.9 * 365.25 THEN 'mature' WHEN coalesce(sources, 0) < 2 THEN 'noise' ELSE 'candidate' END AS category FROM rows_ JOIN part ON p_partkey = rows_.technology LEFT JOIN src ON src.technology = rows_.technology),
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in WEIGHTS)} FROM jd WHERE category = 'candidate'),
ct AS (SELECT technology, category, {', '.join(f"round({w} * coalesce(greatest(-3.0, least(3.0, ({c} - m_{c}) / nullif(s_{c}, 0))), 0), 6) AS c_{c}" for c, w in WEIGHTS.items())} FROM jd, st),
rk AS (SELECT technology, category, CASE WHEN category = 'candidate' THEN round({' + '.join(f'c_{c}' for c in WEIGHTS)}, 6) END AS raw_score, CASE WHEN category = 'candidate' THEN array_to_string(list_transform(list_sort([{', '.join(f"struct_pack(s := -abs(c_{c}), n := '{c}')" for c in WEIGHTS)}])[1:3], lambda s: s.n), ',') END AS top_features FROM ct)"""


def _rank(spark, sf):
    at = F.lit(_AT).cast("date")
    facts = f.dealt_facts(spark, sf, at)
    rows = _feature_rows(spark, sf, facts, (_AT,)).select("technology", "max_maturity_rank", "age_days", *WEIGHTS)
    sources = rk.independent_sources(facts, "technology", "organization", "observed", x.months_before(at, 24))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("technology"), "p_name", "p_type")
    rows = rows.join(parts, "technology").join(sources, "technology", "left")
    rules = [
        ("noise", F.col("p_type").isin("PROMO")), ("standard", F.lower(F.trim("p_name")).isin(*_GENERIC)), ("mature", (F.col("max_maturity_rank") > 6) & (F.col("implementation_count") > 3)),
        ("mature", F.col("age_days") > 6.9 * 365.25), ("noise", F.coalesce("sources", F.lit(0)) < 2),
    ]
    return rk.rank_snapshot(rows, "technology", rules, WEIGHTS)


@query("rank_snapshot", f"WITH {_RANKED} SELECT technology, category, raw_score, round(1 / (1 + exp(-raw_score)), 6) AS score, top_features FROM rk")
def rank_snapshot(spark, sf):
    """Parts at one date: the rule that rejects each, or its score among the candidates and what it is made of."""
    return _rank(spark, sf).select("technology", "category", "raw_score", F.round("score", 6).alias("score"), "top_features")


#: Queries, and the domains they may name: brands under types.
SEARCHES = ((1, "hot rings"), (2, "Brand 17 bolt"), (3, "economy gear"), (4, "any"))
_QUERIES = ", ".join(f"({q}, '{t}')" for q, t in SEARCHES)
_CATALOGUE = "cat AS (SELECT DISTINCT p_brand AS domain, p_brand AS phrase, min(p_type) OVER (PARTITION BY p_brand) AS parent FROM part UNION ALL SELECT DISTINCT p_type, p_type, NULL FROM part)"
_DOMAINS = f"""qs AS (SELECT * FROM (VALUES {_QUERIES}) v(query, text)), {_CATALOGUE}, qw AS (SELECT query, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS q FROM qs), pw AS (SELECT DISTINCT domain, regexp_extract_all(lower(phrase), '[\\p{{L}}\\p{{N}}_]+') AS p FROM cat),
nm AS (SELECT query, domain FROM qw, pw WHERE len(list_filter(p, lambda w: len(list_filter(q, lambda z: z = w OR (least(len(z), len(w)) >= 4 AND left(z, greatest(4, least(len(z), len(w)) - 2)) = left(w, greatest(4, least(len(z), len(w)) - 2))))) = 0)) = 0),
dm AS (SELECT query, domain FROM nm UNION SELECT query, cat.domain FROM nm JOIN cat ON cat.parent = nm.domain)"""


def _catalogue(spark, sf):
    p = table(spark, sf, "part")
    brands = p.groupBy(F.col("p_brand").alias("domain")).agg(F.min("p_type").alias("parent")).select("domain", F.col("domain").alias("phrase"), "parent")
    return brands.unionByName(p.select(F.col("p_type").alias("domain"), F.col("p_type").alias("phrase"), F.lit(None).cast("string").alias("parent")).distinct())


def _queries(spark):
    return spark.createDataFrame(list(SEARCHES), "query int, text string")


@query("domain_matches", f"WITH {_DOMAINS} SELECT query, domain FROM dm")
def domain_matches(spark, sf):
    """Domains that a query names, and those below them."""
    return rk.match_domains(_queries(spark), _catalogue(spark, sf))


@query("search_scope", f"""WITH {_DOMAINS}, pt AS (SELECT p_partkey AS technology, p_name AS label, p_brand AS domain FROM part), bd AS (SELECT DISTINCT query, 'domain' AS scope, technology FROM dm JOIN pt USING (domain)), rest AS (SELECT * FROM qw WHERE query NOT IN (SELECT query FROM dm)),
bl AS (SELECT DISTINCT query, 'label' AS scope, technology FROM (SELECT query, unnest(q) AS z FROM rest) a JOIN (SELECT technology, unnest(regexp_extract_all(lower(label), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM pt) b ON len(z) >= 4 AND (z = w OR (len(w) >= 4 AND left(z, greatest(4, least(len(z), len(w)) - 2)) = left(w, greatest(4, least(len(z), len(w)) - 2)))))
SELECT * FROM bd UNION ALL SELECT * FROM bl UNION ALL SELECT query, 'all', NULL FROM rest WHERE query NOT IN (SELECT query FROM bl)""")
def search_scope(spark, sf):
    """Parts in a query's scope: by brand, else by a word of the name, else all."""
    p = table(spark, sf, "part")
    parts = p.select(F.col("p_partkey").alias("technology"), F.col("p_name").alias("label"))
    return rk.scope(_queries(spark), parts, p.select(F.col("p_partkey").alias("technology"), F.col("p_brand").alias("domain")), _catalogue(spark, sf))


SETTINGS = {"min_cosine": 0.3, "cosine_weight": 0.65, "bm25_weight": 0.35, "relevance_weight": 0.75, "signal_weight": 0.25}
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_+#]+')"
_MATCHES = f"""{_RANKED}, qs AS (SELECT * FROM (VALUES {_QUERIES}) v(query, text)), qt AS (SELECT DISTINCT query, unnest({_TOK.format('text')}) AS term FROM qs),
cd AS (SELECT rk.technology, 1 / (1 + exp(-raw_score)) AS score, {_TOK.format("p_name || ' ' || p_name || ' ' || p_name || ' ' || p_brand")} AS w FROM rk JOIN part ON p_partkey = rk.technology WHERE category = 'candidate'),
sx AS (SELECT count(*) AS n, avg(len(w)) AS a FROM cd), tf AS (SELECT technology, term, len, count(*) AS tf FROM (SELECT technology, len(w) AS len, unnest(w) AS term FROM cd) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lx AS (SELECT query, technology, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS b FROM tf JOIN df USING (term) JOIN qt USING (term), sx GROUP BY ALL),
cs AS (SELECT qs.query, cd.technology, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS c FROM qs JOIN embeddings q ON q.vec_id = qs.query, cd JOIN embeddings e ON e.vec_id = cd.technology),
bo AS (SELECT coalesce(lx.query, cs.query) AS query, coalesce(lx.technology, cs.technology) AS technology, coalesce(b, 0) AS b, c, max(b) OVER (PARTITION BY coalesce(lx.query, cs.query)) AS top FROM lx FULL JOIN cs ON lx.query = cs.query AND lx.technology = cs.technology),
rl AS (SELECT bo.*, score, (0.65 * greatest(coalesce(c, 0), 0) + 0.35 * coalesce(b / top, 0)) / ((CASE WHEN c IS NOT NULL THEN 0.65 ELSE 0 END) + (CASE WHEN b > 0 THEN 0.35 ELSE 0 END)) AS rel FROM bo JOIN cd USING (technology) WHERE b > 0 OR c >= 0.3),
fn AS (SELECT query, technology, round(b, 6) AS bm25_score, round(c, 6) AS semantic_similarity, round(rel, 6) AS relevance_score, round(0.75 * rel + 0.25 * score, 6) AS search_score FROM rl)"""


@query("search_response", f"""WITH {_MATCHES}, od AS (SELECT fn.*, p_size >= 40 AS flag, row_number() OVER (PARTITION BY query ORDER BY search_score DESC, relevance_score DESC, technology) AS rank FROM fn JOIN part ON p_partkey = technology),
tl AS (SELECT *, sum(CASE WHEN rank > 15 AND flag THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank) AS f FROM od) SELECT * EXCLUDE (f) FROM tl WHERE rank <= 15 OR (rank > 15 AND flag AND f <= 5)""")
def search_response(spark, sf):
    """Candidates of one date for four queries: by words of name and brand, by vector, and by score; flagged ones beyond the first 15."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("technology"), F.col("p_name").alias("label"), F.col("p_brand").alias("domains"), "p_size")
    candidates = materialise(_rank(spark, sf).where("category = 'candidate'").select("technology", "score").join(p, "technology"), "candidates")
    e = table(spark, sf, "embeddings")
    asked = _queries(spark).join(e, F.col("query") == F.col("vec_id")).select("query", F.col("embedding").alias("q"))
    vectors = candidates.join(e, F.col("technology") == F.col("vec_id")).select("technology", "embedding")
    cosines = vectors.join(F.broadcast(asked)).select("query", "technology", x.cosine(F.col("q"), F.col("embedding")).alias("cosine"))  # a stated set of queries against all
    from almagest.operators.search import tokens

    terms = _queries(spark).select("query", F.explode(tokens(F.col("text"))).alias("term")).distinct()
    found = rk.relevance(candidates, terms, cosines, SETTINGS)
    found = found.select("query", "technology", *(F.round(c, 6).alias(c) for c in ("bm25_score", "semantic_similarity", "relevance_score", "search_score")))
    return rk.search_response(found, candidates.select("technology", (F.col("p_size") >= 40).alias("flag")), 15, 5).withColumn("rank", F.col("rank").cast("long"))
