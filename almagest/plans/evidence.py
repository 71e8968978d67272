"""Resolution, gates, sections, cards, splits and late data over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.functions import expressions as x
from almagest.operators import cards as cd
from almagest.operators import graph as g
from almagest.operators import linking as li
from almagest.operators import resolution as rs
from almagest.operators import vectors as v
from almagest.plans import evaluation as ev
from almagest.plans import graphs as gr
from almagest.sources.runtime import table
from almagest.sources.tables import mentions

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


_FORM = "p_brand || ' ' || p_name"
_CASCADE = f"""n AS (SELECT p_partkey AS concept, p_type AS family, p_name AS key, {_FORM} AS form FROM part WHERE p_size >= 45), m AS (SELECT p_partkey AS mention, p_type AS family, p_name AS key, {_FORM} AS form FROM part WHERE p_size < 45),
gp AS (SELECT DISTINCT p_type AS family, k AS key FROM part, (VALUES ('red bolt'), ('hot bolt'), ('hot gizmo')) v(k)), i AS (SELECT DISTINCT family, key, concept FROM n UNION SELECT b.family, b.key, n.concept FROM n JOIN gp a ON a.family = n.family AND a.key = n.key JOIN gp b ON b.family = a.family),
h AS (SELECT DISTINCT mention, m.form, concept FROM m JOIN i USING (family, key)), d AS (SELECT mention, min(form) AS form, min(concept) AS concept FROM (SELECT DISTINCT m.mention, m.form, i.concept FROM m JOIN i ON i.family = m.family AND i.key = regexp_replace(m.key, '^\\w+', 'small') WHERE m.mention NOT IN (SELECT mention FROM h)) GROUP BY mention HAVING count(*) = 1),
a AS (SELECT mention, form, concept, 'alias' AS method FROM h UNION ALL SELECT mention, form, concept, 'declared_alias' FROM d), f AS (SELECT mention, count(*) AS n, count(*) FILTER (WHERE nf.concept IS NOT NULL) AS named, min(a.concept) AS only_, min(nf.concept) AS exactly_, min(method) AS method FROM a LEFT JOIN (SELECT DISTINCT concept, form FROM n) nf ON nf.concept = a.concept AND nf.form = a.form GROUP BY mention),
s AS (SELECT DISTINCT m.mention FROM m JOIN embeddings e ON e.vec_id = m.mention JOIN embeddings o ON o.label = e.label JOIN n ON n.concept = o.vec_id WHERE list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])) >= 0.3)"""


@query("resolution_cascade", f"""WITH {_CASCADE} SELECT m.mention, CASE WHEN n = 1 OR named = 1 THEN 'accepted' WHEN n > 1 THEN 'ambiguous' ELSE 'provisional' END AS status,
CASE WHEN n = 1 THEN CAST(only_ AS VARCHAR) WHEN named = 1 THEN CAST(exactly_ AS VARCHAR) WHEN n IS NULL THEN 'concept:' || left(sha256(m.family || chr(31) || m.key), 24) END AS concept,
CASE WHEN n = 1 THEN method WHEN named = 1 THEN 'exact_form' WHEN n > 1 THEN 'collision' WHEN s.mention IS NOT NULL THEN 'similar_candidate' ELSE 'new' END AS method, coalesce(n, CASE WHEN s.mention IS NOT NULL THEN 1 ELSE 0 END) AS candidates FROM m LEFT JOIN f USING (mention) LEFT JOIN s USING (mention)""")
def resolution_cascade(spark, sf):
    """Small parts as mentions, large ones as the registry: key and synonym group, declared name, exact form, similar vector, new concept."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("family"), F.col("p_name").alias("key"), F.concat_ws(" ", "p_brand", "p_name").alias("form"), "p_size")
    names, found = p.where("p_size >= 45").withColumnRenamed("id", "concept"), p.where("p_size < 45").withColumnRenamed("id", "mention")
    groups = p.select("family").distinct().withColumn("key", F.explode(F.array(F.lit("red bolt"), F.lit("hot bolt"), F.lit("hot gizmo")))).withColumn("group", F.col("family"))
    declared = found.select("mention", F.regexp_replace("key", r"^\w+", "small").alias("key"))
    pairs = v.pairs_above(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.3, "label")
    pairs = pairs.select(F.col("left").alias("mention"), F.col("right").alias("concept"), F.col("cosine").alias("score")).unionByName(pairs.select(F.col("right").alias("mention"), F.col("left").alias("concept"), F.col("cosine").alias("score")))
    return rs.resolve_cascade(found, rs.alias_index(names, groups), names.select("concept", "form").distinct(), declared, pairs.join(names.select("concept"), "concept", "left_semi"))


@query("preferred_forms", "SELECT concept, form, n FROM (SELECT l_suppkey AS concept, l_returnflag || l_linestatus AS form, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY n DESC, form) = 1")
def preferred_forms(spark, sf):
    votes = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("concept"), F.concat("l_returnflag", "l_linestatus").alias("form"))
    return rs.preferred_forms(votes)


@query("settled_kinds", """SELECT l_partkey AS technology, kind FROM (SELECT l_partkey, l_returnflag AS kind, count(*) AS n, max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS r FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, r DESC) = 1""")
def settled_kinds(spark, sf):
    """The flag most lines of a part have; ties go to the one of higher rank."""
    votes = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("technology"), F.col("l_returnflag").alias("kind"), F.lit("flag").alias("now"))
    rank = F.when(F.col("kind") == "A", 1).when(F.col("kind") == "N", 2).otherwise(3)
    return li.settled_kinds(votes, "technology", "kind", "now", F.lit("flag"), rank, ("flag",))


@query("link_records", "SELECT l_orderkey AS document, l_returnflag AS chunk, l_suppkey AS concept, min(struct_pack(s := l_linenumber, p := l_partkey)).s AS start, min(struct_pack(s := l_linenumber, p := l_partkey)).p AS part FROM lineitem GROUP BY ALL")
def link_records(spark, sf):
    """The first line of each supplier in a part of an order."""
    l = table(spark, sf, "lineitem")
    return rs.link_records(l.select(F.col("l_orderkey").alias("document"), F.col("l_returnflag").alias("chunk"), F.col("l_suppkey").alias("concept"), F.col("l_linenumber").alias("start"), F.col("l_partkey").alias("part")))


@query("known_concepts", """WITH a AS (SELECT l_orderkey AS packet, l_partkey AS concept, CAST(min(l_linenumber) AS DOUBLE) AS o, 'named' AS basis FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_orderkey AS packet, l_partkey AS concept, -round(max(1 - l_discount), 9) AS o, 'similar' AS basis FROM lineitem WHERE l_returnflag = 'N' AND 1 - l_discount >= 0.95 GROUP BY 1, 2),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.packet = b.packet AND a.concept = b.concept)) SELECT packet, concept, basis, row_number() OVER (PARTITION BY packet ORDER BY basis, o, concept) AS rank FROM u QUALIFY rank <= 3""")
def known_concepts(spark, sf):
    """What an order names first, then what it is near to, three in all."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("packet"), F.col("l_partkey").alias("concept"), F.col("l_linenumber").alias("start"), (1 - F.col("l_discount")).alias("cosine"), "l_returnflag")
    return rs.known_concepts(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'N'"), 3, 0.95).withColumn("rank", F.col("rank").cast("long"))


@query("domain_bridge", """WITH c AS (SELECT c_custkey AS concept, 'NATION_' || c_nationkey AS label FROM customer), d AS (SELECT n_name AS label, n_nationkey AS domain FROM nation WHERE n_nationkey < 9), al AS (SELECT n_name AS label, n_regionkey AS domain FROM nation UNION ALL SELECT 'NATION_' || s_nationkey, CASE WHEN s_nationkey % 3 = 0 THEN 100 ELSE s_nationkey % 5 END FROM supplier),
e AS (SELECT concept, domain FROM c JOIN d USING (label)), u AS (SELECT label, min(domain) AS domain FROM al GROUP BY label HAVING count(DISTINCT domain) = 1) SELECT * FROM e UNION ALL SELECT concept, u.domain FROM c JOIN u USING (label) WHERE concept NOT IN (SELECT concept FROM e)""")
def domain_bridge(spark, sf):
    """Customers' nations by name, else by an alias of one domain."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    concepts = table(spark, sf, "customer").select(F.col("c_custkey").alias("concept"), F.concat(F.lit("NATION_"), "c_nationkey").alias("label"))
    aliases = n.select(F.col("n_name").alias("label"), F.col("n_regionkey").alias("domain")).union(s.select(F.concat(F.lit("NATION_"), "s_nationkey"), F.when(F.col("s_nationkey") % 3 == 0, 100).otherwise(F.col("s_nationkey") % 5)))
    return rs.domain_bridge(concepts, n.where("n_nationkey < 9").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("domain")), aliases)


_RULES = (("A", "F", None, "Company", "USED_BY"), ("N", "O", "ECONOMY", None, "DEVELOPED_BY"), ("R", "F", None, None, "RELATED_TO"))


@query("project_claims", f"""WITH r AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if c is None else repr(c) for c in rule) + ')' for rule in _RULES)}) t(predicate, role, subject_kind, object_kind, relation)),
c AS (SELECT l_returnflag AS predicate, l_partkey AS subject, p_type AS subject_kind, l_linestatus AS role, l_suppkey AS object, CASE WHEN s_acctbal > 5000 THEN 'Company' ELSE 'Organization' END AS object_kind, l_orderkey AS span FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT subject, relation, object, count(DISTINCT span) AS spans FROM c JOIN r ON c.predicate = r.predicate AND c.role = r.role AND (r.subject_kind IS NULL OR r.subject_kind = c.subject_kind) AND (r.object_kind IS NULL OR r.object_kind = c.object_kind) GROUP BY ALL""")
def project_claims(spark, sf):
    """Lines as claims, turned into edges by a table of rules."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    claims = l.select(F.col("l_returnflag").alias("predicate"), F.col("l_partkey").alias("subject"), F.col("p_type").alias("subject_kind"), F.col("l_linestatus").alias("role"), F.col("l_suppkey").alias("object"), F.when(F.col("s_acctbal") > 5000, "Company").otherwise("Organization").alias("object_kind"), F.col("l_orderkey").alias("span"))
    return rs.project_claims(claims, spark.createDataFrame(list(_RULES), "predicate string, role string, subject_kind string, object_kind string, relation string"))


@query("projected_gate", "SELECT o_orderstatus AS status, count(*) FILTER (WHERE coalesce(nullif(o_orderstatus, 'P') = 'F', true) AND left(o_orderpriority, 1) IN ('1', '2')) AS passed, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 200000) AS companies FROM orders GROUP BY 1")
def projected_gate(spark, sf):
    """Absent fields pass; a company by its labels or its kind."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") != "P", "proposed")
    urgent = F.when(F.left("o_orderpriority", F.lit(1)).isin("1", "2"), "reported").otherwise("planned")
    gate = rs.projected_gate(status, F.lit(None).cast("string"), F.lit("affirmed"), urgent)
    company = rs.is_company(F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("Concept"), F.lit("Company"))), F.when(F.col("o_totalprice") > 200000, "Company"))
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(gate).alias("passed"), F.count_if(company).alias("companies"))


_CHUNKS = "c AS (SELECT l_orderkey AS document, l_linenumber AS place, l_returnflag AS role FROM lineitem)"


def _chunks(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("role"))


@query("read_sections", f"WITH {_CHUNKS} SELECT document, place, role FROM c WHERE role <> 'N' OR document NOT IN (SELECT document FROM c WHERE role <> 'N')")
def read_sections(spark, sf):
    """Lines that are not of a skipped kind; orders of such lines alone are read whole."""
    return rs.read_sections(_chunks(spark, sf), "document", "role", ("N",))


@query("select_sections", f"""WITH {_CHUNKS}, d AS (SELECT DISTINCT * FROM c), k AS (SELECT *, CASE role WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS r, count(*) OVER w AS n, row_number() OVER (PARTITION BY document ORDER BY place) AS i FROM d WINDOW w AS (PARTITION BY document)),
z AS (SELECT *, count(r) OVER (PARTITION BY document) AS kn, row_number() OVER (PARTITION BY document ORDER BY r NULLS LAST, place) AS b FROM k) SELECT document, place, role FROM z WHERE n <= 3 OR (kn > 0 AND r IS NOT NULL AND b <= 3) OR (kn = 0 AND (i <= 2 OR i > n - 1))""")
def select_sections(spark, sf):
    """Of orders with more than three lines, those of the wanted kinds first, else the first two and the last."""
    return rs.select_sections(_chunks(spark, sf).distinct(), "document", "place", "role", ["R", "A"], 3, 2, 1)


@query("work_keys", "SELECT p_partkey AS document, unnest(list_filter([CASE WHEN p_size < 40 THEN 'sku:' || p_size END, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') AND len(list_filter(string_split(p_brand || ' ' || p_name, ' '), lambda t: NOT regexp_matches(t, '^[0-9]+$'))) >= 3 THEN 'title:' || p_brand || ' ' || p_name END], lambda k: k IS NOT NULL)) AS key FROM part")
def work_keys(spark, sf):
    p = table(spark, sf, "part")
    keys = F.array_compact(F.array(F.when(F.col("p_size") < 40, F.concat(F.lit("sku:"), "p_size"))))
    found = rs.work_keys(F.col("p_type"), keys, F.split(F.concat_ws(" ", "p_brand", "p_name"), " "), ("PROMO",), ("ECONOMY", "STANDARD"), 3)
    return p.select(F.col("p_partkey").alias("document"), F.explode(found).alias("key"))


@query("task_novelty", """WITH s AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS t FROM lineitem), f AS (SELECT l_suppkey AS k, min(CAST(o_orderdate AS DATE)) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1), n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
b AS (SELECT a.k AS a, c.k AS b, count(*) AS k FROM s a JOIN s c USING (t) JOIN f x ON x.k = a.k JOIN f y ON y.k = c.k WHERE y.d < x.d GROUP BY ALL), m AS (SELECT a, min(1 - b.k * 1.0 / (x.n + y.n - b.k)) AS d FROM b JOIN n x ON x.k = a JOIN n y ON y.k = b.b GROUP BY a)
SELECT f.k AS supplier, CASE WHEN f.d > (SELECT min(d) FROM f) THEN round(coalesce(m.d, 1), 6) END AS novelty FROM f LEFT JOIN m ON m.a = f.k""")
def task_novelty(spark, sf):
    """How far a supplier's set of parts is from that of any supplier met before it."""
    m = mentions(spark, sf)
    sets, first = m.select(F.col("organization").alias("supplier"), "technology"), m.groupBy(F.col("organization").alias("supplier")).agg(F.min("observed").alias("day"))
    return rs.task_novelty(sets, first, "supplier", "technology").withColumn("novelty", F.round("novelty", 6))


@query("bridge_scores", f"""WITH h AS ({gr.ORACLE_SQL['structural_hole']}), p AS ({gr.ORACLE_SQL['neighbour_profile']}), {gr._NATION_EDGES}, {gr._BOTH}
SELECT b.src AS node, count(DISTINCT CASE WHEN x.n_regionkey <> y.n_regionkey THEN y.n_regionkey END) AS community_crossing_count, max(round(structural_hole * neighbour_entropy, 5)) AS bridge_score FROM b JOIN nation x ON x.n_nationkey = b.src JOIN nation y ON y.n_nationkey = b.dst LEFT JOIN h ON h.node = b.src LEFT JOIN p ON p.node = b.src GROUP BY b.src""")
def bridge_scores(spark, sf):
    """Regions that a nation's neighbours reach beyond its own, and its bridge score."""
    edges = gr._nations(spark, sf)
    region = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("region"))
    out = rs.bridges(edges, region, gr.structural_hole(spark, sf), gr.neighbour_profile(spark, sf))
    return out.withColumn("bridge_score", F.round("bridge_score", 5))


_STAGES = {1: "concept", 2: "concept", 3: "prototype", 4: "pilot", 5: "early_adoption"}
_STAGE_POINTS = {"concept": 1, "prototype": 2, "pilot": 3, "early_adoption": 4}
_TREND_POINTS = {"fast": 3, "growing": 2, "stable": 1, "declining": 0}
_DAY = "CAST(o_orderdate AS DATE)"


@query("signal_cards", f"""WITH f AS (SELECT l_partkey AS t, l_orderkey AS k, {_DAY} AS d, l_linenumber AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey), n AS (SELECT t, count(DISTINCT k) FILTER (WHERE d > DATE '1998-01-01' AND d <= DATE '1999-01-01') AS a, count(DISTINCT k) FILTER (WHERE d > DATE '1997-01-01' AND d <= DATE '1998-01-01') AS b FROM f GROUP BY t),
tr AS (SELECT t, CASE WHEN (a + 1) / (b + 1) >= 2 AND a >= 3 THEN 'fast' WHEN (a + 1) / (b + 1) >= 1.2 THEN 'growing' WHEN (a + 1) / (b + 1) >= 0.8 THEN 'stable' ELSE 'declining' END AS trend FROM n), e AS (SELECT t, d, r, CASE r WHEN 1 THEN 'concept' WHEN 2 THEN 'concept' WHEN 3 THEN 'prototype' WHEN 4 THEN 'pilot' ELSE 'early_adoption' END AS s FROM f WHERE r <= 5 AND d <= DATE '1999-01-01'),
st AS (SELECT t, arg_max(s, r) AS stage, arg_min(s, struct_pack(d := d, r := r)) AS first_stage FROM e GROUP BY t) SELECT tr.t AS technology, stage, first_stage, trend, CAST(coalesce(CASE stage WHEN 'concept' THEN 1 WHEN 'prototype' THEN 2 WHEN 'pilot' THEN 3 WHEN 'early_adoption' THEN 4 END, 0) + CASE trend WHEN 'fast' THEN 3 WHEN 'growing' THEN 2 WHEN 'stable' THEN 1 ELSE 0 END AS BIGINT) AS score FROM tr LEFT JOIN st USING (t)""")
def signal_cards(spark, sf):
    """Stage, trend and score of every part at one date."""
    m = mentions(spark, sf)
    documents = m.select("technology", "document", F.col("observed").alias("day")).distinct()
    return cd.cards(documents, m.select("technology", F.col("observed").alias("day"), F.col("stage").alias("rank")), "technology", "1999-01-01", _STAGES, _STAGE_POINTS, _TREND_POINTS)


@query("source_list", f"SELECT technology, row_number() OVER w AS rank, document, day, round(tier / 3.0, 6) AS reliability FROM (SELECT DISTINCT l_partkey AS technology, l_orderkey AS document, {_DAY} AS day, CAST(left(o_orderpriority, 1) AS INT) AS tier FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WINDOW w AS (PARTITION BY technology ORDER BY day DESC NULLS LAST, document) QUALIFY rank <= 5")
def source_list(spark, sf):
    d = mentions(spark, sf).select("technology", "document", F.col("observed").alias("day"), F.left("family", F.lit(1)).cast("int").alias("tier")).distinct()
    return cd.source_list(d, "technology", 5, 3.0).select("technology", F.col("rank").cast("long").alias("rank"), "document", "day", F.round("reliability", 6).alias("reliability"))


_COLUMNS = ("l_quantity", "l_discount", "gap")


@query("distribution", "WITH l AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN l_tax END AS gap FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS deviation, min({c}) AS low, median({c}) AS median, max({c}) AS high FROM l" for c in _COLUMNS))
def distribution(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("gap", F.when(F.col("l_returnflag") == "A", F.col("l_tax")))
    out = cd.distribution(l, list(_COLUMNS))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


@query("cohorts", f"SELECT l_partkey AS technology, CAST((CASE WHEN min({_DAY}) >= DATE '1995-03-01' THEN 1 ELSE 0 END) + (CASE WHEN min({_DAY}) >= DATE '1995-06-01' THEN 1 ELSE 0 END) AS BIGINT) AS cohort FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def cohorts(spark, sf):
    first = mentions(spark, sf).groupBy("technology").agg(F.min("observed").alias("day"))
    return cd.cohorts(first, "technology", ["1995-03-01", "1995-06-01"]).withColumn("cohort", F.col("cohort").cast("long"))


@query("split_windows", f"""WITH w AS (SELECT i AS "window", CAST(t AS DATE) AS t FROM (VALUES (0, '1997-01-01'), (1, '1998-01-01')) v(i, t)) SELECT "window", CASE WHEN {_DAY} >= t THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM orders JOIN w ON {_DAY} < t + INTERVAL 6 MONTH WHERE {_DAY} >= t OR CAST({_DAY} + INTERVAL 8 MONTH AS DATE) <= t GROUP BY ALL""")
def split_windows(spark, sf):
    """Orders in two forward windows of six months, with two months of embargo."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return cd.split_windows(o, "day", ["1997-01-01", "1998-01-01"], 6, 2).groupBy("window", "part").agg(F.count("*").alias("n"))


@query("clear_stale", "SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN o_totalprice END AS o_totalprice FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey")
def clear_stale(spark, sf):
    keep = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return cd.clear_stale(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), keep, "o_orderkey", ["o_totalprice"])


@query("dated_observations", "WITH l AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL) SELECT user_id, day, event_type FROM l QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY day) OR row_number() OVER (PARTITION BY user_id ORDER BY day) = 1")
def dated_observations(spark, sf):
    """A user's last event of a day, kept where it is another than before."""
    rows = table(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_type", F.col("event_id").alias("seq"))
    return cd.dated_observations(rows, "user_id", "day", ["event_type"])


@query("late_retrievals", f"SELECT l_orderkey AS document, min(CAST(l_shipdate AS DATE)) AS first_retrieved, bool_or({_DAY} <= DATE '1998-01-01') AS known, min(greatest({_DAY}, CAST(l_shipdate AS DATE))) <= DATE '1998-01-01' AS known_strictly FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def late_retrievals(spark, sf):
    """The first retrieval of a document stays; in strict mode a late one doesn't put it back in time."""
    at = F.lit("1998-01-01").cast("date")
    m = mentions(spark, sf)
    return m.groupBy("document").agg(F.min("recorded").alias("first_retrieved"), F.max(F.col("observed") <= at).alias("known"), (F.min(F.greatest("observed", "recorded")) <= at).alias("known_strictly"))


@query("incremental_links", f"WITH a AS ({ev.ORACLE_SQL['corroborate_links']}) SELECT source, target, relation FROM a WHERE source IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {_DAY} > DATE '1998-06-01')")
def incremental_links(spark, sf):
    """Only links that start from claims after a date."""
    claims = ev._claims(spark, sf)
    return li.new_claim_links(claims, claims.where(F.col("day") > F.lit("1998-06-01").cast("date")).select("claim"))


@query("semantic_novelty", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, DATE '1995-01-01' + CAST(vec_id * 5 AS INT) AS day FROM embeddings), p AS (SELECT a.vec_id, 1 - list_cosine_similarity(a.v, b.v) AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND b.day <= CAST(a.day - INTERVAL 12 MONTH AS DATE)) SELECT vec_id, round(min(d), 6) AS semantic_novelty FROM p GROUP BY vec_id")
def semantic_novelty(spark, sf):
    """The distance of a vector to the nearest of its label that was known a year before."""
    e = table(spark, sf, "embeddings").withColumn("day", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("vec_id") * 5).cast("int")))
    e = e.withColumn("until", x.months_before(F.col("day"), 12))
    near = v.neighbours(e, "vec_id", "embedding", 1, group="label", known=("day", "until"))
    return near.select(F.col("a").alias("vec_id"), F.round(1 - F.col("cosine"), 6).alias("semantic_novelty"))


@query("number_readings", "SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DOUBLE) AS plain, CAST(round(o_totalprice, 2) AS DOUBLE) AS grouped, -CAST(floor(o_totalprice) AS DOUBLE) AS signed, CAST(floor(o_totalprice) AS DOUBLE) AS blanks FROM orders WHERE o_totalprice >= 1000")
def number_readings(spark, sf):
    """Totals written in four ways and read back."""
    o = table(spark, sf, "orders").where("o_totalprice >= 1000")
    price, whole = F.col("o_totalprice"), F.floor("o_totalprice")
    read = lambda c: x.parse_number(c).cast("double")
    texts = {"plain": F.translate(F.format_number(price, 2), ",", ""), "grouped": F.format_number(price, 2), "signed": F.concat(F.lit("-"), F.format_number(whole, 0)), "blanks": F.translate(F.format_number(whole, 0), ",", " ")}
    return o.select("o_orderkey", *(read(t).alias(c) for c, t in texts.items()))
