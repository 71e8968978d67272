"""Scans, traces, packets, queues, dossiers and plans over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.operators import documents as dc
from almagest.operators import linking as li
from almagest.plans import evidence as ed
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


_DAY = "CAST(o_orderdate AS DATE)"


@query("registry_scan", "SELECT label, count(*) AS n, min(vec_id) AS least FROM embeddings GROUP BY label")
def registry_scan(spark, sf):
    """Concepts by label; the vectors are not read."""
    return dc.registry(table(spark, sf, "embeddings")).groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))


@query("label_scan", "SELECT p_partkey, p_type, p_size FROM part WHERE p_partkey % 7 <> 0")
def label_scan(spark, sf):
    """Labels of parts that were not merged into another."""
    p = table(spark, sf, "part").withColumn("merged_into", F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey") - 1))
    return dc.labels(p, "merged_into", ["p_partkey", "p_type", "p_size"])


@query("vector_scan", "SELECT vec_id AS concept, label AS kind, len(embedding) AS size FROM embeddings WHERE vec_id % 5 <> 0 AND label IN (1, 3, 5)")
def vector_scan(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("concept"), F.col("label").cast("string").alias("kind"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 5 == 0, "merged").otherwise("active").alias("status"), F.lit("m").alias("model"))
    return dc.vectors_of(e, "m", ("1", "3", "5")).select("concept", F.col("kind").cast("int").alias("kind"), F.size("vector").cast("long").alias("size"))


@query("claim_scan", "WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS claim, l_partkey % 50 = 3 OR l_suppkey % 20 = 1 AS touches FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'N' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) SELECT claim FROM c WHERE claim IN (SELECT claim FROM c WHERE touches)")
def claim_scan(spark, sf):
    """Accepted claims of finished orders that touch some parts or suppliers."""
    l = table(spark, sf, "lineitem")
    claims = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), F.col("l_orderkey").alias("version"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("proposed").alias("status"), F.when(F.col("l_returnflag") != "N", "supported").alias("verification"), F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")).alias("concepts"))
    versions = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("version"))
    parts = table(spark, sf, "part").where("p_partkey % 50 = 3").select(F.concat(F.lit("p"), "p_partkey").alias("concept"))
    suppliers = table(spark, sf, "supplier").where("s_suppkey % 20 = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("concept"))
    return dc.claims_of(claims, versions, parts.union(suppliers)).select("claim")


@query("taxonomy_input", f"""WITH f AS (SELECT l_partkey AS concept, l_orderkey AS document, min({_DAY}) AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {_DAY} <= DATE '1998-01-01' GROUP BY ALL), p AS (SELECT DISTINCT l_partkey AS concept, s_nationkey AS parent FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE {_DAY} <= DATE '1998-01-01')
SELECT f.concept, min(day) AS first_seen, count(*) AS documents, max(k) AS parents FROM f JOIN (SELECT concept, string_agg(CAST(parent AS VARCHAR), ',' ORDER BY parent) AS k FROM p GROUP BY concept) q USING (concept) GROUP BY f.concept""")
def taxonomy_input(spark, sf):
    """Parts known at a date, the days of their orders, and the nations of their suppliers as parents."""
    m = mentions(spark, sf)
    nations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("organization"), F.col("s_nationkey").alias("parent"))
    parents = m.join(nations, "organization").select(F.col("technology").alias("concept"), "parent", F.col("observed").alias("day"))
    rows = dc.taxonomy_input(table(spark, sf, "part").select(F.col("p_partkey").alias("concept")), m.select(F.col("technology").alias("concept"), "document", F.col("observed").alias("day")), parents, "1998-01-01")
    return rows.select("concept", "first_seen", F.size("documents").cast("long").alias("documents"), F.array_join(F.col("parents").cast("array<string>"), ",").alias("parents"))


@query("document_traces", f"WITH v AS (SELECT o_custkey AS document, o_orderkey AS version, {_DAY} AS day FROM orders WHERE {_DAY} <= DATE '1998-01-01') SELECT document, max(struct_pack(d := day, v := version)).v AS version, max(day) AS day, min(day) AS first_visible, count(*) AS versions FROM v GROUP BY document")
def document_traces(spark, sf):
    """A customer's orders as versions of a document: the latest one known at a date, and the first."""
    v = table(spark, sf, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").cast("date").alias("day"))
    return dc.traces(v, "1998-01-01")


@query("score_labels", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_discount * 10 <= 0.3 THEN 1 WHEN l_discount * 10 >= 0.7 THEN 0 END AS label FROM lineitem")
def score_labels(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("is_technology", F.col("l_returnflag") != "N").withColumn("score", F.col("l_discount") * 10)
    return dc.score_labels(l, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


_LINES = "l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)"


@query("packets", f"""WITH RECURSIVE {_LINES}, r AS (SELECT *, CAST(0 AS BIGINT) AS packet, q AS used FROM l WHERE i = 1 UNION ALL SELECT l.*, CASE WHEN l.l_linestatus <> r.l_linestatus OR r.used + l.q > 60 THEN r.packet + 1 ELSE r.packet END, CASE WHEN l.l_linestatus <> r.l_linestatus OR r.used + l.q > 60 THEN l.q ELSE r.used + l.q END FROM r JOIN l ON l.l_orderkey = r.l_orderkey AND l.i = r.i + 1)
SELECT l_orderkey, i, packet FROM r""")
def packets(spark, sf):
    """Lines of an order in packets of one status and at most 60 pieces."""
    from pyspark.sql import Window

    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", F.col("l_quantity").cast("long").alias("q"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("i"))
    return dc.packets(l, "l_orderkey", "i", "l_linestatus", "q", 60).select("l_orderkey", "i", "packet")


@query("pilot_queue", """WITH d AS (SELECT DISTINCT o_custkey AS customer, CAST(o_orderdate AS DATE) AS day FROM orders), m AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY day) AS i, count(*) OVER (PARTITION BY customer) AS n FROM d),
s AS (SELECT customer, day, CASE WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' WHEN i = floor((n + 1) / 2) THEN 'middle' END AS slice FROM m), e AS (SELECT customer, CAST(floor(year(min(day)) / 2) * 2 AS INT) AS era FROM d GROUP BY customer),
t AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY sha256(CAST(customer AS VARCHAR))) AS turn FROM e), c AS (SELECT * FROM t ORDER BY turn, era LIMIT 50) SELECT customer, slice, day, era, turn FROM s JOIN c USING (customer) WHERE slice IS NOT NULL""")
def pilot_queue(spark, sf):
    """Three dates of fifty customers, spread over the eras they begin in."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"))
    return dc.pilot_queue(o, "customer", "day", 50, 2).withColumn("turn", F.col("turn").cast("long"))


@query("dossiers", """WITH o AS (SELECT l_partkey AS t, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY ALL), a AS (SELECT t, string_agg(CAST(s AS VARCHAR), ',' ORDER BY n DESC, s) AS organizations FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY t ORDER BY n DESC, s) <= 5) GROUP BY t),
d AS (SELECT DISTINCT l_partkey AS t, l_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey), b AS (SELECT t, string_agg(CAST(k AS VARCHAR), ',' ORDER BY d DESC, k) AS documents FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY t ORDER BY d DESC, k) <= 4) GROUP BY t)
SELECT t AS technology, organizations, documents FROM a JOIN b USING (t)""")
def dossiers(spark, sf):
    """A part's five busiest suppliers and four latest orders."""
    m = mentions(spark, sf)
    busy = m.groupBy("technology", F.col("organization").alias("item")).agg(F.count("*").alias("n"))
    late = m.select("technology", F.col("document").alias("item"), "observed").distinct()
    out = dc.dossiers(m, "technology", {"organizations": (busy, [F.desc("n"), F.col("item")], 5), "documents": (late, [F.desc("observed"), F.col("item")], 4)})
    return out.select("technology", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("organizations", "documents")))


@query("cards_table", f"SELECT technology, score, row_number() OVER (ORDER BY score DESC, technology) AS number FROM ({ed.ORACLE_SQL['signal_cards']}) ORDER BY number LIMIT 100")
def cards_table(spark, sf):
    """The hundred cards of highest score."""
    return dc.numbered_cards(ed.signal_cards(spark, sf).select("technology", "score"), "technology", 100).withColumn("number", F.col("number").cast("long"))


@query("normalise_plan", "WITH k AS (SELECT c_custkey AS id, c_mktsegment || ' ' || c_nationkey AS key, c_name AS name, c_acctbal AS r FROM customer), b AS (SELECT key, arg_max(struct_pack(i := id, n := name), struct_pack(r := r, m := -id)) AS b FROM k GROUP BY key HAVING count(*) > 1) SELECT k.id, b.i AS target, key, b.n AS display FROM k JOIN b USING (key)")
def normalise_plan(spark, sf):
    """Customers of one segment and nation go to the richest, whose name shows."""
    c = table(spark, sf, "customer")
    return dc.normalise_plan(c, F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")), "c_custkey", "c_name", F.col("c_acctbal"))


@query("unreferenced", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def unreferenced(spark, sf):
    """Orders that no returned and no large line refers to."""
    l = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return dc.unreferenced(table(spark, sf, "orders").select("o_orderkey"), [l.where("l_returnflag = 'R'"), l.where("l_quantity > 45")], "o_orderkey")


@query("reconcile", f"SELECT relation, count(*) AS links FROM ({ev.ORACLE_SQL['corroborate_links']}) GROUP BY relation UNION ALL SELECT 'SHARES_CONTEXT_WITH', count(*) FROM ({gr.ORACLE_SQL['shared_contexts_capped']})")
def reconcile(spark, sf):
    """A full rebuild of the claims' links and of shared contexts, summed up."""
    links = ev.corroborate_links(spark, sf).groupBy("relation").agg(F.count("*").alias("links"))
    return links.union(gr.shared_contexts_capped(spark, sf).agg(F.lit("SHARES_CONTEXT_WITH").alias("relation"), F.count("*").alias("links")).select("relation", "links"))


@query("anchors", """WITH q AS (SELECT doc_id, text, list_extract(string_split(text, ' '), 3) AS quote FROM documents), p AS (SELECT *, instr(text, quote) AS i FROM q) SELECT doc_id, CASE WHEN quote IS NULL OR quote = '' OR i = 0 THEN 'missing' WHEN instr(substr(text, i + 1), quote) > 0 THEN 'ambiguous' ELSE 'anchored' END AS state,
CASE WHEN quote <> '' AND i > 0 AND instr(substr(text, i + 1), quote) = 0 THEN i - 1 END AS start FROM p""")
def anchors(spark, sf):
    """The third word of each text as a quote: where it stands, if it stands once."""
    d = table(spark, sf, "documents").withColumn("quote", F.get(F.split("text", " "), F.lit(2)))
    return d.select("doc_id", dc.anchor(F.col("text"), F.col("quote")).alias("a")).select("doc_id", "a.state", F.col("a.start").cast("long").alias("start"))


@query("normal_names", r"SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS name FROM supplier")
def normal_names(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", dc.normal_name(F.col("s_name")).alias("name"))


@query("country_lookup", "SELECT c_custkey, CASE WHEN n_regionkey < 3 THEN 'N' || n_nationkey END AS code FROM customer JOIN nation ON n_nationkey = c_nationkey")
def country_lookup(spark, sf):
    """Codes of customers' countries by name; a name without a code has none."""
    codes = table(spark, sf, "nation").where("n_regionkey < 3").select(F.lower("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("code"))
    c = table(spark, sf, "customer").select("c_custkey", F.lower(F.concat(F.lit("NATION_"), "c_nationkey")).alias("name"))
    return c.join(F.broadcast(codes.limit(1000)), "name", "left").select("c_custkey", "code")


@query("legacy_rows", f"""WITH f AS (SELECT l_partkey AS t, l_orderkey AS k, min({_DAY}) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {_DAY} <= DATE '1999-01-01' GROUP BY ALL)
SELECT t AS technology, count(*) AS documents, round(count(*) FILTER (WHERE d > DATE '1998-01-01') * 1.0 / greatest(1, count(*) FILTER (WHERE d > DATE '1997-01-01' AND d <= DATE '1998-01-01')), 6) AS publication_growth, CAST(DATE '1999-01-01' - min(d) AS BIGINT) AS age_days FROM f GROUP BY t""")
def legacy_rows(spark, sf):
    """The older rows, in which growth is last year over the year before, one at least."""
    at = F.lit("1999-01-01").cast("date")
    d = mentions(spark, sf).where(F.col("observed") <= at).groupBy("technology", "document").agg(F.min("observed").alias("d"))
    last, before = F.count_if(F.col("d") > F.add_months(at, -12)), F.count_if((F.col("d") > F.add_months(at, -24)) & (F.col("d") <= F.add_months(at, -12)))
    return d.groupBy("technology").agg(F.count("*").alias("documents"), F.round(last / F.greatest(F.lit(1), before), 6).alias("publication_growth"), F.datediff(at, F.min("d")).cast("long").alias("age_days"))


@query("model_winner", "SELECT source AS model FROM (SELECT source, round(avg(quality), 6) AS m FROM labels JOIN documents USING (doc_id) GROUP BY source) ORDER BY m DESC, source LIMIT 1")
def model_winner(spark, sf):
    """The source of best mean quality, as the model of best validation score."""
    reports = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("model")), "doc_id").groupBy("model").agg(F.round(F.avg("quality"), 6).alias("score"))
    return dc.winner(reports, "score", "none")


@query("judged_pairs", "SELECT a.p_partkey AS l, b.p_partkey AS r, CASE WHEN a.p_name = b.p_name THEN 'merge' END AS action FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE a.p_name = b.p_name")
def judged_pairs(spark, sf):
    """Pairs of parts of one brand, type, size and name, judged by their names."""
    p = table(spark, sf, "part")
    side = lambda s: p.select("p_brand", "p_type", "p_size", "p_name", F.col("p_partkey").alias(s))
    pairs = side("l").join(side("r"), ["p_brand", "p_type", "p_size", "p_name"]).where("l < r").select("l", "r", F.col("p_name").alias("left_label"), F.col("p_name").alias("right_label"), F.lit(0.95).alias("cosine"))
    return li.judge_pairs(pairs).select("l", "r", "action")
