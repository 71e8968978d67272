"""Feature rows of every part at the fixed snapshots, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.operators import features as f
from almagest.sources.tables import SNAPSHOTS, mentions, snapshots, table, visible

_GRID = "g AS (SELECT CAST(d AS DATE) AS snapshot FROM (VALUES " + ", ".join(f"('{d}')" for d in SNAPSHOTS) + ") v(d))"
_FACTS = """m AS (SELECT l_partkey AS technology, l_orderkey AS document, CAST(o_orderdate AS DATE) AS observed, l_suppkey AS organization,
 o_custkey AS customer, o_orderpriority AS family, l_returnflag AS kind, l_linestatus AS status, l_linenumber AS stage,
 1 - l_discount AS confidence, l_extendedprice AS amount, l_quantity AS quantity, CAST(l_shipdate AS DATE) AS recorded
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_VIEW = f"{_GRID}, {_FACTS}, v AS (SELECT * FROM m JOIN g ON observed <= snapshot)"


def _back(n: int) -> str:
    return f"CAST(snapshot - INTERVAL {n} MONTH AS DATE)"


def _sum(a: int, b: int, date: str = "observed") -> str:
    """Rows in (T - b months, T - a months]."""
    return f"count(*) FILTER (WHERE {date} > {_back(b)} AND {date} <= {_back(a)})"


def _growth(x: str, y: str) -> str:
    return f"ln((({x}) + 1.0) / (({y}) + 1.0))"


def _view(spark, sf):
    return visible(mentions(spark, sf), snapshots(spark))


def _round(df, digits: int = 6):
    """Floats rounded: sums of doubles depend on their order in the last digits."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") and c != "technology" else F.col(c) for c, t in df.dtypes))


def _rounded(sql: str, floats: dict, ints=(), keys=("technology", "snapshot")) -> str:
    cols = [*keys, *(f"round({c}, 6) AS {c}" for c in floats), *(f"CAST({c} AS BIGINT) AS {c}" for c in ints)]
    return f"{sql} SELECT {', '.join(cols)} FROM r"


QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


_ACTIVITY = f"""WITH {_VIEW}, d AS (SELECT technology, snapshot, document, min(observed) AS fv, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT technology, snapshot, min(fv) AS first_seen, date_diff('day', min(fv), snapshot) AS age_days, count(*) AS document_count, sum(n) AS mention_count,
 {_sum(0, 12, 'fv')} AS documents_last_year, {_growth(_sum(0, 12, 'fv'), _sum(12, 24, 'fv'))} AS publication_growth FROM d GROUP BY technology, snapshot)"""


@query("snapshot_activity", _rounded(_ACTIVITY, ["publication_growth"], ["age_days", "document_count", "mention_count", "documents_last_year"], ("technology", "snapshot", "first_seen")))
def snapshot_activity(spark, sf):
    return _round(f.activity(_view(spark, sf)))


_Q = [_sum(3 * q, 3 * q + 3) for q in range(7, -1, -1)]
_E = f"(3 * ({_sum(3, 24)}) / 21.0)"
_DYNAMICS = f"""WITH {_VIEW}, r AS (SELECT technology, snapshot,
 {', '.join(f"{_growth(_sum(0, n), _sum(n, 2 * n))} AS mention_growth_{n}m" for n in (3, 6, 12, 24))},
 {_growth(_sum(0, 6), _sum(6, 12))} - {_growth(_sum(6, 12), _sum(12, 18))} AS growth_acceleration,
 ({_sum(0, 3)} - {_E}) / sqrt({_E} + 1) AS burst_score,
 ({' + '.join(f"(CASE WHEN {b} > {a} THEN 1 ELSE 0 END)" for a, b in zip(_Q, _Q[1:]))}) / 7.0 AS growth_persistence,
 count(DISTINCT date_diff('month', observed, snapshot) - (CASE WHEN day(observed) > 1 THEN 1 ELSE 0 END)) FILTER (WHERE observed > {_back(24)}) * 1.0
  / least(24, date_diff('month', min(observed), snapshot) - (CASE WHEN day(min(observed)) > 1 THEN 1 ELSE 0 END) + 1) AS active_month_ratio,
 date_diff('day', max(observed), snapshot) AS days_since_last_signal FROM v GROUP BY technology, snapshot)"""


@query("snapshot_dynamics", _rounded(_DYNAMICS, [*(f"mention_growth_{n}m" for n in (3, 6, 12, 24)), "growth_acceleration", "burst_score", "growth_persistence", "active_month_ratio"], ["days_since_last_signal"]))
def snapshot_dynamics(spark, sf):
    return _round(f.dynamics(_view(spark, sf)))


@query("snapshot_decline", f"""WITH {_VIEW}, b AS (SELECT technology, snapshot, date_diff('month', observed, snapshot) - (CASE WHEN day(observed) > 1 THEN 1 ELSE 0 END) AS back FROM v),
c AS (SELECT technology, snapshot, back, count(*) AS n FROM b GROUP BY ALL),
p AS (SELECT x.technology, x.snapshot, x.back, sum(y.n) AS rolling FROM c x JOIN c y ON x.technology = y.technology AND x.snapshot = y.snapshot AND y.back BETWEEN x.back AND x.back + 11 GROUP BY ALL),
q AS (SELECT technology, snapshot, max(rolling) AS peak FROM p GROUP BY ALL), l AS (SELECT technology, snapshot, coalesce(sum(n) FILTER (WHERE back < 12), 0) AS last FROM c GROUP BY ALL)
SELECT technology, snapshot, round(1 - last / CAST(peak AS DOUBLE), 6) AS decline_rate FROM q JOIN l USING (technology, snapshot)""")
def snapshot_decline(spark, sf):
    return _round(f.decline(_view(spark, sf)))


def _diversity_sql(value: str, prefix: str, source: str = "v") -> str:
    return f"""c AS (SELECT technology, snapshot, {value} AS k, CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY ALL),
s AS (SELECT *, sum(c) OVER (PARTITION BY technology, snapshot) AS t FROM c),
r AS (SELECT technology, snapshot, count(*) AS {prefix}_count, -sum(c / t * ln(c / t)) AS {prefix}_entropy, sum(c / t * c / t) AS {prefix}_hhi, max(c / t) AS top_{prefix}_share FROM s GROUP BY technology, snapshot)"""


@query("source_entropy_hhi", f"WITH {_VIEW}, {_diversity_sql('organization', 'organization')} SELECT technology, snapshot, organization_count, abs(round(organization_entropy, 6)) AS organization_entropy, round(organization_hhi, 6) AS organization_hhi, round(top_organization_share, 6) AS top_organization_share FROM r")
def source_entropy_hhi(spark, sf):
    out = _round(f.diversity(_view(spark, sf), "organization", "organization"))
    return out.withColumn("organization_entropy", F.abs("organization_entropy"))


@query("snapshot_participants", f"""WITH {_VIEW}, n AS (SELECT v.*, s_nationkey AS country FROM v JOIN supplier ON organization = s_suppkey),
a AS (SELECT technology, snapshot, organization, bool_or(observed > {_back(12)}) AS r, bool_or(observed <= {_back(12)}) AS e FROM v GROUP BY ALL),
t AS (SELECT technology, snapshot, count(*) FILTER (WHERE r AND NOT e) * 1.0 / nullif(count(*) FILTER (WHERE r), 0) AS x, count(*) FILTER (WHERE r AND e) * 1.0 / nullif(count(*) FILTER (WHERE e), 0) AS y FROM a GROUP BY technology, snapshot),
{_diversity_sql('country', 'country', 'n')},
b AS (SELECT technology, snapshot, count(DISTINCT organization) AS o, count(DISTINCT customer) AS u FROM v GROUP BY ALL)
SELECT technology, snapshot, country_count, abs(round(country_entropy, 6)) AS country_entropy, round(country_hhi, 6) AS country_hhi, round(top_country_share, 6) AS top_country_share,
 round(x, 6) AS new_organization_rate, round(y, 6) AS returning_organization_rate, round((o - u) * 1.0 / (o + u), 6) AS organization_user_balance
FROM r JOIN t USING (technology, snapshot) JOIN b USING (technology, snapshot)""")
def snapshot_participants(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("organization"), F.col("s_nationkey").alias("country"))
    return _round(f.participants(_view(spark, sf), suppliers)).withColumn("country_entropy", F.abs("country_entropy"))


@query("snapshot_convergence", f"""WITH {_VIEW}, f AS (SELECT technology, snapshot, count(DISTINCT family) AS source_type_diversity, count(DISTINCT family) FILTER (WHERE observed > {_back(12)}) AS recent_source_convergence,
 min(observed) FILTER (WHERE kind = 'N') AS n, min(observed) FILTER (WHERE kind = 'R') AS x, min(observed) FILTER (WHERE kind = 'A') AS a FROM v GROUP BY technology, snapshot), {_diversity_sql('family', 'source')}
SELECT technology, snapshot, source_type_diversity, recent_source_convergence, CAST(date_diff('day', n, x) AS BIGINT) AS n_to_r_lag_days, CAST(date_diff('day', n, a) AS BIGINT) AS n_to_a_lag_days,
 CAST((CASE WHEN n >= n THEN 1 ELSE 0 END) + (CASE WHEN x >= n THEN 1 ELSE 0 END) + (CASE WHEN a >= n THEN 1 ELSE 0 END) AS BIGINT) AS evidence_chain_length, abs(round(source_entropy, 6)) AS source_entropy FROM f JOIN r USING (technology, snapshot)""")
def snapshot_convergence(spark, sf):
    return _round(f.convergence(_view(spark, sf), ("N", "R", "A"))).withColumn("source_entropy", F.abs("source_entropy"))


@query("snapshot_credibility", f"""WITH {_VIEW}, r AS (SELECT technology, snapshot, sum(CAST(left(family, 1) AS DOUBLE)) / 3.0 AS reliability_weighted_mentions, count(*) FILTER (WHERE status = 'F') * 1.0 / count(*) AS accepted_mention_ratio,
 count(*) FILTER (WHERE kind = 'N') * 1.0 / count(*) AS speculative_claim_ratio, count(*) FILTER (WHERE kind = 'R') * 1.0 / count(*) AS negated_claim_ratio, count(DISTINCT document) AS independent_evidence_family_count,
 ln(1 + count(*)) - ln(1 + count(DISTINCT document)) AS claim_to_evidence_gap, avg(confidence) AS mean_extraction_confidence FROM v GROUP BY technology, snapshot)
SELECT technology, snapshot, round(reliability_weighted_mentions, 9) AS reliability_weighted_mentions, round(accepted_mention_ratio, 9) AS accepted_mention_ratio, round(speculative_claim_ratio, 9) AS speculative_claim_ratio, round(negated_claim_ratio, 9) AS negated_claim_ratio,
 independent_evidence_family_count, round(claim_to_evidence_gap, 9) AS claim_to_evidence_gap, round(mean_extraction_confidence, 9) AS mean_extraction_confidence FROM r""")
def snapshot_credibility(spark, sf):
    view = _view(spark, sf).withColumn("tier", F.left("family", F.lit(1)).try_cast("double"))
    return _round(f.credibility(view), 9)


@query("claim_conflict", f"""WITH {_VIEW}, s AS (SELECT technology, snapshot, organization, document, bool_or(kind <> 'R') AS pos, bool_or(kind = 'R') AS neg FROM v GROUP BY ALL),
c AS (SELECT technology, snapshot, organization, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE neg) AS n, count(*) FILTER (WHERE pos AND neg) AS x FROM s GROUP BY technology, snapshot, organization)
SELECT technology, snapshot, count(*) AS comparable_claim_slot_count, count(*) FILTER (WHERE p >= 2) AS corroborated_claim_slot_count, CAST(sum(x) AS BIGINT) AS mixed_origin_group_count,
 round(max(2.0 * least(p, n) / (p + n)), 6) AS independent_claim_conflict_strength, round(sum(n) * 1.0 / sum(p + n), 6) AS independent_refutation_share FROM c GROUP BY technology, snapshot""")
def claim_conflict(spark, sf):
    return _round(f.claim_slots(_view(spark, sf)))


@query("maturity_progress", f"""WITH {_VIEW} SELECT technology, snapshot, CAST(max(stage) AS BIGINT) AS max_maturity_rank, CAST(max(stage) - coalesce(max(stage) FILTER (WHERE observed <= {_back(12)}), 0) AS BIGINT) AS maturity_growth,
 CAST(date_diff('day', min(observed), min(observed) FILTER (WHERE stage >= 4)) AS BIGINT) AS time_to_pilot_days, CAST(date_diff('day', min(observed) FILTER (WHERE stage >= 3), snapshot) AS BIGINT) AS time_in_prototype_stage_days,
 count(*) FILTER (WHERE stage >= 6) AS implementation_count FROM v GROUP BY technology, snapshot""")
def maturity_progress(spark, sf):
    return _round(f.maturity(_view(spark, sf)))


@query("snapshot_quality", f"""WITH {_VIEW}, d AS (SELECT technology, snapshot, document, max(CASE WHEN recorded <= snapshot THEN 1.0 ELSE 0 END) AS full_ FROM v GROUP BY ALL),
a AS (SELECT technology, snapshot, avg(full_) AS x FROM d GROUP BY ALL), b AS (SELECT technology, snapshot, avg(CASE WHEN status = 'O' THEN 1.0 ELSE 0 END) AS y FROM v GROUP BY technology, snapshot)
SELECT technology, snapshot, round(x, 6) AS fulltext_coverage, round(y, 6) AS provisional_resolution_ratio FROM a JOIN b USING (technology, snapshot)""")
def snapshot_quality(spark, sf):
    return _round(f.quality(_view(spark, sf)))


@query("relation_targets_pivot", f"""WITH {_VIEW} SELECT technology, snapshot, count(DISTINCT organization) FILTER (WHERE kind = 'A') AS "A", count(DISTINCT organization) FILTER (WHERE kind = 'N') AS "N", count(DISTINCT organization) FILTER (WHERE kind = 'R') AS "R" FROM v GROUP BY technology, snapshot""")
def relation_targets_pivot(spark, sf):
    return f.relations(_view(spark, sf), ("A", "N", "R"))


_COUNTS = f"{_VIEW}, r AS (SELECT technology, snapshot, count(DISTINCT document) AS document_count, count(*) AS mention_count FROM v GROUP BY ALL)"


def _counts(spark, sf):
    return _view(spark, sf).groupBy(*f.KEY).agg(F.count_distinct("document").alias("document_count"), F.count("*").alias("mention_count"))


@query("midrank_pct", f"""WITH {_COUNTS} SELECT technology, snapshot, document_count, mention_count,
 round((rank() OVER (PARTITION BY snapshot ORDER BY document_count) - 1 + 0.5 * count(*) OVER (PARTITION BY snapshot, document_count)) / count(*) OVER (PARTITION BY snapshot), 6) AS document_count_snapshot_pct,
 round((rank() OVER (PARTITION BY snapshot ORDER BY mention_count) - 1 + 0.5 * count(*) OVER (PARTITION BY snapshot, mention_count)) / count(*) OVER (PARTITION BY snapshot), 6) AS mention_count_snapshot_pct FROM r""")
def midrank_pct(spark, sf):
    return _round(f.midrank(_counts(spark, sf), ["document_count", "mention_count"]))


@query("deltas_12m", f"""WITH {_COUNTS} SELECT r.technology, r.snapshot, r.document_count - coalesce(p.document_count, 0) AS document_count_delta_12m, r.mention_count - coalesce(p.mention_count, 0) AS mention_count_delta_12m
FROM r LEFT JOIN r p ON p.technology = r.technology AND p.snapshot = CAST(r.snapshot - INTERVAL 12 MONTH AS DATE)""")
def deltas_12m(spark, sf):
    return f.deltas(_counts(spark, sf), ["document_count", "mention_count"])


@query("new_relation_count", f"""WITH {_VIEW}, e AS (SELECT DISTINCT technology, snapshot, organization, kind FROM v), p AS (SELECT DISTINCT technology, snapshot, organization, kind FROM v WHERE observed <= {_back(12)})
SELECT technology, snapshot, count(*) AS new_relation_count FROM (SELECT * FROM e EXCEPT SELECT * FROM p) GROUP BY ALL""")
def new_relation_count(spark, sf):
    view, edge = _view(spark, sf), [*f.KEY, "organization", "kind"]
    earlier = view.where(F.col("observed") <= f.months_before(F.col("snapshot"), 12)).select(*edge)
    return view.select(*edge).distinct().join(earlier.distinct(), edge, "left_anti").groupBy(*f.KEY).agg(F.count("*").alias("new_relation_count"))


@query("feature_missingness", f"""WITH {_VIEW}, f AS (SELECT technology, snapshot, min(observed) FILTER (WHERE kind = 'N') AS a, min(observed) FILTER (WHERE stage >= 6) AS b, max(stage) FILTER (WHERE observed <= {_back(12)}) AS c FROM v GROUP BY technology, snapshot),
n AS (SELECT technology, snapshot, (CASE WHEN a IS NULL THEN 1 ELSE 0 END) + (CASE WHEN b IS NULL THEN 1 ELSE 0 END) + (CASE WHEN c IS NULL THEN 1 ELSE 0 END) AS k FROM f)
SELECT technology, snapshot, CAST(k AS BIGINT) AS feature_missingness_count, round(1 - k / 3.0, 6) AS data_completeness_score FROM n""")
def feature_missingness(spark, sf):
    t, d = F.col("snapshot"), F.col("observed")
    rows = _view(spark, sf).groupBy(*f.KEY).agg(F.min(F.when(F.col("kind") == "N", F.unix_date(d))).alias("a"), F.min(F.when(F.col("stage") >= 6, F.unix_date(d))).alias("b"), F.max(F.when(d <= f.months_before(t, 12), F.col("stage"))).alias("c"))
    return _round(f.missingness(rows, ["a", "b", "c"]).drop("a", "b", "c"))


_CRAWLS = (("1-URGENT", "1990-01-01", "1999-06-30", "1999-07-01", True, "done"), ("2-HIGH", "1996-06-01", "2000-12-31", "1997-06-01", True, "done"), ("3-MEDIUM", "1990-01-01", "2001-01-01", "1996-01-01", False, "done"), ("5-LOW", "1990-01-01", "2001-01-01", "1996-01-01", True, "failed"), ("4-NOT SPECIFIED", "1995-01-01", "2000-06-01", "1996-12-31", True, "done"))


@query("coverage_interval", f"""WITH {_GRID}, c AS (SELECT family, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b, CAST(e AS DATE) AS e, x, s FROM (VALUES {', '.join(f"('{c[0]}', '{c[1]}', '{c[2]}', '{c[3]}', {str(c[4]).lower()}, '{c[5]}')" for c in _CRAWLS)}) t(family, a, b, e, x, s)),
k AS (SELECT DISTINCT snapshot, family FROM g JOIN c ON e <= snapshot AND a <= {_back(12)} AND b >= snapshot AND x AND s = 'done'),
n AS (SELECT snapshot, o_orderpriority AS family, count(*) AS n FROM g JOIN orders ON CAST(o_orderdate AS DATE) <= snapshot GROUP BY ALL)
SELECT n.snapshot, n.family, k.family IS NOT NULL AS source_covered, CASE WHEN k.family IS NOT NULL THEN n END AS document_count FROM n LEFT JOIN k USING (snapshot, family)""")
def coverage_interval(spark, sf):
    """A count is known only where its family was searched."""
    grid = snapshots(spark)
    crawls = spark.createDataFrame(list(_CRAWLS), "family string, a string, b string, c string, exhaustive boolean, state string").select("family", "exhaustive", "state", F.col("a").cast("date").alias("period_start"), F.col("b").cast("date").alias("period_end"), F.col("c").cast("date").alias("finished"))
    known = f.covered(grid, crawls, 12).withColumn("source_covered", F.lit(True))
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderdate").cast("date").alias("observed"))
    counts = visible(orders, grid).groupBy("snapshot", "family").agg(F.count("*").alias("n"))
    return counts.join(known, ["snapshot", "family"], "left").select("snapshot", "family", F.coalesce("source_covered", F.lit(False)).alias("source_covered"), F.when(F.col("source_covered"), F.col("n")).alias("document_count"))


_END = "2000-06-01"
HORIZON = 12  # months
_OUTCOMES = f"""WITH {_GRID}, {_FACTS}, x AS (SELECT *, CAST(snapshot + INTERVAL 12 MONTH AS DATE) AS h FROM m CROSS JOIN g),
s AS (SELECT technology, snapshot, count(*) FILTER (WHERE observed <= snapshot) AS known, count(DISTINCT document) FILTER (WHERE observed > snapshot AND observed <= h) AS future_documents,
 count(DISTINCT organization) FILTER (WHERE observed > snapshot AND observed <= h) AS future_sources, count(*) FILTER (WHERE kind = 'A' AND observed <= snapshot) AS c, min(observed) FILTER (WHERE kind = 'A' AND observed > snapshot AND observed <= h) AS fc FROM x GROUP BY technology, snapshot),
r AS (SELECT technology, snapshot, future_documents, future_sources, CASE WHEN c > 0 THEN 'already_commercial' WHEN CAST(snapshot + INTERVAL 12 MONTH AS DATE) > DATE '{_END}' THEN 'censored' WHEN fc IS NOT NULL THEN 'realized' ELSE 'not_realized' END AS label_reason FROM s WHERE known > 0),
l AS (SELECT *, CASE label_reason WHEN 'realized' THEN 1 WHEN 'not_realized' THEN 0 END AS label_realized FROM r)"""


@query("future_outcomes", f"{_OUTCOMES} SELECT technology, snapshot, future_documents, future_sources, label_realized, label_reason FROM l")
def future_outcomes(spark, sf):
    return outcomes(spark, mentions(spark, sf))


def outcomes(spark, facts):
    return f.outcomes(facts, snapshots(spark), HORIZON, _END)


@query("temporal_split_purge", f"""{_OUTCOMES}, a AS (SELECT * FROM l WHERE label_realized IS NOT NULL), d AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot DESC) AS k FROM (SELECT DISTINCT snapshot FROM a)),
b AS (SELECT max(snapshot) FILTER (WHERE k = 1) AS test, max(snapshot) FILTER (WHERE k = 2) AS valid FROM d)
SELECT technology, snapshot, label_realized, CASE WHEN snapshot = test THEN 'test' WHEN snapshot = valid THEN CASE WHEN CAST(snapshot + INTERVAL 12 MONTH AS DATE) > test THEN 'purged' ELSE 'valid' END
 WHEN CAST(snapshot + INTERVAL 12 MONTH AS DATE) > valid THEN 'purged' ELSE 'train' END AS split FROM a CROSS JOIN b""")
def temporal_split_purge(spark, sf):
    """The last date tests, the one before validates; a row whose horizon reaches into a later part is purged."""
    return split(future_outcomes(spark, sf))


def split(outcomes):
    rows = outcomes.where("label_realized is not null")
    dates = rows.groupBy().agg(F.max("snapshot").alias("test"), F.sort_array(F.collect_set("snapshot"), asc=False).alias("all")).select("test", F.get("all", F.lit(1)).alias("valid"))
    t, horizon = F.col("snapshot"), F.add_months("snapshot", HORIZON)
    split = F.when(t == F.col("test"), "test").when(t == F.col("valid"), F.when(horizon > F.col("test"), "purged").otherwise("valid")).when(horizon > F.col("valid"), "purged").otherwise("train")
    return rows.join(F.broadcast(dates)).select("technology", "snapshot", "label_realized", split.alias("split"))
