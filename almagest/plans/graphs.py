"""Graph and vector queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almagest.operators import graph as g
from almagest.operators import vectors as v
from almagest.operators.components import connected_components
from almagest.sources.runtime import materialise
from almagest.sources.tables import mentions, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


# parts that share an order, which grow with the tables; nations that share more orders than the average pair, which do not
_PART_EDGES = "e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(DISTINCT a.l_orderkey) AS contexts FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)"
_NATION_EDGES = "n AS (SELECT DISTINCT c_nationkey AS k, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey UNION SELECT DISTINCT s_nationkey, l_orderkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey), x AS (SELECT a.k AS src, b.k AS dst, count(*) AS contexts FROM n a JOIN n b ON a.o_orderkey = b.o_orderkey AND a.k < b.k GROUP BY ALL), t AS (SELECT avg(contexts) AS m FROM x), e AS (SELECT src, dst, contexts FROM x, t WHERE contexts > m)"
_BOTH = "b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


def _parts(spark, sf):
    return g.co_mentions(mentions(spark, sf), "technology", "document")


def _nations(spark, sf):
    """Nations tied by more shared orders than the average pair."""
    c, o, s, li = (table(spark, sf, t) for t in ("customer", "orders", "supplier", "lineitem"))
    rows = c.join(o, c.c_custkey == o.o_custkey).select(F.col("c_nationkey").alias("k"), "o_orderkey").union(s.join(li, s.s_suppkey == li.l_suppkey).select("s_nationkey", "l_orderkey"))
    pairs = g.co_mentions(rows, "k", "o_orderkey")
    return pairs.join(F.broadcast(pairs.agg(F.avg("contexts").alias("m")))).where("contexts > m").drop("m")


@query("co_mention_graph", f"WITH {_PART_EDGES} SELECT src, dst, contexts FROM e")
def co_mention_graph(spark, sf):
    return _parts(spark, sf)


@query("degree", f"WITH {_PART_EDGES}, {_BOTH} SELECT src AS node, count(*) AS degree FROM b GROUP BY src")
def degree(spark, sf):
    return g.degree(_parts(spark, sf))


@query("shared_contexts_capped", "WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), k AS (SELECT p FROM s GROUP BY p HAVING count(*) BETWEEN 2 AND 24), c AS (SELECT s.* FROM s JOIN k USING (p)) SELECT a.s AS src, b.s AS dst, count(*) AS contexts FROM c a JOIN c b ON a.p = b.p AND a.s < b.s GROUP BY ALL HAVING count(*) >= 2")
def shared_contexts_capped(spark, sf):
    """Suppliers with at least two parts in common; parts of more than 24 suppliers say too little."""
    return g.co_mentions(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", 24).where("contexts >= 2")


@query("structural_hole", f"""WITH {_NATION_EDGES}, {_BOTH}, d AS (SELECT src, count(*) AS k FROM b GROUP BY src), p AS (SELECT b.src, b.dst, 1.0 / k AS p FROM b JOIN d USING (src)),
v AS (SELECT x.src AS i, y.dst AS j, sum(x.p * y.p) AS via FROM p x JOIN p y ON x.dst = y.src WHERE x.src <> y.dst GROUP BY ALL), c AS (SELECT p.src AS node, sum((p.p + coalesce(via, 0)) ** 2) AS c FROM p LEFT JOIN v ON v.i = p.src AND v.j = p.dst GROUP BY 1)
SELECT node, round(greatest(0, least(1, 1 - c)), 6) AS structural_hole FROM c""")
def structural_hole(spark, sf):
    return g.structural_hole(_nations(spark, sf)).select("node", F.round("structural_hole", 6).alias("structural_hole"))


@query("neighbour_profile", f"""WITH {_NATION_EDGES}, {_BOTH}, c AS (SELECT b.src, d.n_regionkey AS v, o.n_regionkey AS own, CAST(count(*) AS DOUBLE) AS c FROM b JOIN nation d ON d.n_nationkey = b.dst JOIN nation o ON o.n_nationkey = b.src GROUP BY ALL), s AS (SELECT *, sum(c) OVER (PARTITION BY src) AS t FROM c)
SELECT src AS node, abs(round(-sum(c / t * ln(c / t)), 6)) AS neighbour_entropy, round(coalesce(sum(c) FILTER (WHERE v <> own), 0) / max(t), 6) AS crossing_share, CAST(max(t) AS BIGINT) AS neighbours FROM s GROUP BY src""")
def neighbour_profile(spark, sf):
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("region"))
    out = g.neighbour_profile(_nations(spark, sf), regions, "region")
    return out.select("node", F.abs(F.round("neighbour_entropy", 6)).alias("neighbour_entropy"), F.round("crossing_share", 6).alias("crossing_share"), "neighbours")


@query("domain_pair_surprise", """WITH m AS (SELECT DISTINCT s_nationkey AS k, l_orderkey AS o, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT a.k AS src, b.k AS dst, a.early, count(*) AS c FROM m a JOIN m b ON a.o = b.o AND a.k < b.k GROUP BY ALL), t AS (SELECT coalesce(sum(c) FILTER (WHERE early), 0) + (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM p)) + 1 AS t FROM p)
SELECT n.src, n.dst, coalesce(o.c, 0) AS before, round(-ln((coalesce(o.c, 0) + 1) / t), 6) AS surprise FROM p n CROSS JOIN t LEFT JOIN p o ON o.src = n.src AND o.dst = n.dst AND o.early WHERE NOT n.early""")
def domain_pair_surprise(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("organization"), "s_nationkey")
    m = mentions(spark, sf).join(s, "organization")
    early = F.col("observed") < F.lit("1998-01-01").cast("date")
    pairs = lambda c: g.co_mentions(m.where(c), "s_nationkey", "document")
    return g.pair_surprise(pairs(early), pairs(~early)).withColumn("surprise", F.round("surprise", 6))


@query("jaccard_min", """WITH s AS (SELECT s_nationkey AS n, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), k AS (SELECT n, count(*) AS c FROM s GROUP BY n), i AS (SELECT a.n AS x, b.n AS y, count(*) AS both_ FROM s a JOIN s b ON a.p = b.p AND a.n <> b.n GROUP BY ALL)
SELECT x AS node, round(min(1 - both_ * 1.0 / (a.c + b.c - both_)), 6) AS min_distance FROM i JOIN k a ON a.n = x JOIN k b ON b.n = y GROUP BY x""")
def jaccard_min(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n"))
    sets = table(spark, sf, "lineitem").join(s, "l_suppkey").select("n", F.col("l_partkey").alias("p")).distinct()
    sizes = sets.groupBy("n").agg(F.count("*").alias("c"))
    pairs = g.co_mentions(sets, "n", "p")
    both = pairs.select("src", "dst", "contexts").union(pairs.select("dst", "src", "contexts"))
    j = both.join(sizes.withColumnRenamed("n", "src").withColumnRenamed("c", "a"), "src").join(sizes.withColumnRenamed("n", "dst").withColumnRenamed("c", "b"), "dst")
    return j.groupBy(F.col("src").alias("node")).agg(F.round(F.min(1 - F.col("contexts") / (F.col("a") + F.col("b") - F.col("contexts"))), 6).alias("min_distance"))


@query("components_families", "WITH RECURSIVE k AS (SELECT text, min(doc_id) AS h FROM documents GROUP BY text), e AS (SELECT doc_id AS a, h AS b FROM documents JOIN k USING (text) WHERE doc_id <> h UNION SELECT doc_id, doc_id - 1 FROM documents WHERE doc_id > 0 AND n_chars = (SELECT max(d.n_chars) FROM documents d WHERE d.doc_id = documents.doc_id - 1)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS n, b AS m FROM u UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a) SELECT n AS node, least(min(m), n) AS component FROM r GROUP BY n")
def components_families(spark, sf):
    """Documents tied by equal text, or to the one before by equal length."""
    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    first = d.groupBy("text").agg(F.min("doc_id").alias("h"))
    copies = d.join(first, "text").where("doc_id <> h").select("doc_id", "h")
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), "n_chars").join(d.select("doc_id", "n_chars"), ["doc_id", "n_chars"]).select("doc_id", (F.col("doc_id") - 1).alias("h"))
    return connected_components(copies.union(before), "doc_id", "h")


@query("pagerank", f"WITH {_NATION_EDGES}, {_BOTH}, d AS (SELECT src, CAST(count(*) AS DOUBLE) AS k FROM b GROUP BY src), z AS (SELECT n_nationkey AS v FROM nation), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM z), r0 AS (SELECT v, 1.0 / n AS r FROM z, c), " + ", ".join(f"m{i} AS (SELECT b.dst AS v, sum(r / k) AS g FROM b JOIN d USING (src) JOIN r{i - 1} ON r{i - 1}.v = b.src GROUP BY b.dst), r{i} AS (SELECT z.v, 0.15 / n + 0.85 * (1 - (SELECT sum(g) FROM m{i})) / n + 0.85 * coalesce(g, 0) AS r FROM z CROSS JOIN c LEFT JOIN m{i} ON m{i}.v = z.v)" for i in range(1, 9)) + " SELECT v AS node, round(r, 6) AS rank FROM r8")
def pagerank(spark, sf):
    """Eight rounds over all nations."""
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return g.pagerank(_nations(spark, sf), nodes, iterations=8, tolerance=0.0).select("node", F.round("rank", 6).alias("rank"))


@query("part_pagerank")
def part_pagerank(spark, sf):
    """All parts, to convergence."""
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return g.pagerank(_parts(spark, sf), nodes).select("node", F.round("rank", 9).alias("rank"))


@query("part_structural_hole")
def part_structural_hole(spark, sf):
    return g.structural_hole(_parts(spark, sf)).select("node", F.round("structural_hole", 6).alias("structural_hole"))


@query("part_neighbour_profile")
def part_neighbour_profile(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("brand"))
    out = g.neighbour_profile(_parts(spark, sf), brands, "brand")
    return out.select("node", F.abs(F.round("neighbour_entropy", 6)).alias("neighbour_entropy"), F.round("crossing_share", 6).alias("crossing_share"), "neighbours")


@query("k_core")
def k_core(spark, sf):
    return g.k_core(_parts(spark, sf))


def _one_graph(spark, sf):
    return materialise(_parts(spark, sf).select("src", "dst"), "parts").select(F.lit("parts").alias("graph"), "src", "dst")


@query("communities")
def communities(spark, sf):
    return g.communities(_one_graph(spark, sf), "graph")


@query("betweenness")
def betweenness(spark, sf):
    return g.betweenness(_one_graph(spark, sf), "graph").withColumn("betweenness", F.round("betweenness", 9))


@query("two_hop_sample", f"""WITH {_PART_EDGES}, {_BOTH}, f AS (SELECT p_partkey AS root, dst AS node FROM part JOIN b ON b.src = p_partkey QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY sha256(concat_ws('|', '13', p_partkey, dst)), dst) <= 4),
s AS (SELECT root, b.dst AS node FROM f JOIN b ON b.src = f.node WHERE b.dst <> root QUALIFY row_number() OVER (PARTITION BY root, f.node ORDER BY sha256(concat_ws('|', '13', root, f.node, b.dst)), b.dst) <= 4)
SELECT root, node, min(hop) AS hop FROM (SELECT p_partkey AS root, p_partkey AS node, 0 AS hop FROM part UNION ALL SELECT root, node, 1 FROM f UNION ALL SELECT root, node, 2 FROM s) GROUP BY ALL""")
def two_hop_sample(spark, sf):
    """Up to four neighbours a node, two hops from every part."""
    roots = table(spark, sf, "part").select(F.col("p_partkey").alias("root"))
    return g.two_hop_sample(_parts(spark, sf).select("src", "dst"), roots, 4)


def _hop_sql(k: int, frontier: str, taken: str) -> str:
    digest = "sha256('13|' || root || '|' || b.dst)"
    return f"""h{k} AS (SELECT root, b.src, b.dst, b.type, {digest} AS h FROM {frontier} f JOIN b ON b.src = f.node QUALIFY row_number() OVER (PARTITION BY root, b.src, b.type ORDER BY {digest}, b.dst) <= 4),
m{k} AS (SELECT root, dst, min(struct_pack(s := src, t := type, h := h)) AS o FROM h{k} GROUP BY root, dst), n{k} AS (SELECT m.root, m.dst AS node, {k} AS hop FROM m{k} m JOIN (SELECT root, 12 - count(*) AS space FROM ({taken}) GROUP BY root) l ON l.root = m.root WHERE NOT EXISTS (SELECT 1 FROM ({taken}) t WHERE t.root = m.root AND t.node = m.dst) QUALIFY row_number() OVER (PARTITION BY m.root ORDER BY o, m.dst) <= any_value(space) OVER (PARTITION BY m.root))"""


_TAKEN = ["SELECT root, node FROM n0", "SELECT root, node FROM n0 UNION ALL SELECT root, node FROM n1"]


@query("sample_subgraph", f"""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag AS type FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN' FROM supplier), b AS (SELECT src, dst, type FROM e UNION SELECT dst, src, type FROM e),
n0 AS (SELECT 's' || s_suppkey AS root, 's' || s_suppkey AS node, 0 AS hop FROM supplier), {_hop_sql(1, 'n0', _TAKEN[0])}, {_hop_sql(2, 'n1', _TAKEN[1])} SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2""")
def sample_subgraph(spark, sf):
    """Two hops from every supplier, along four parts a flag and the nation, twelve nodes in all."""
    lines, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    supplied = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("type"))
    located = s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.lit("LOCATED_IN"))
    return g.sample_subgraph(supplied.union(located).distinct(), s.select(F.concat(F.lit("s"), "s_suppkey").alias("root")), 2, 4, 12)


@query("typed_snapshot_graph", "SELECT src, dst, type, min(t) AS first, count(*) AS n FROM (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, 'SUPPLIED_BY' AS type, CAST(o_orderdate AS DATE) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1998-01-01' UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN', NULL FROM supplier) GROUP BY ALL")
def typed_snapshot_graph(spark, sf):
    """Typed edges known at a date, with the earliest day of each."""
    known = mentions(spark, sf).where(F.col("observed") <= F.lit("1998-01-01").cast("date"))
    supplied = known.select(F.concat(F.lit("p"), "technology").alias("src"), F.concat(F.lit("s"), "organization").alias("dst"), F.lit("SUPPLIED_BY").alias("type"), F.col("observed").alias("t"))
    located = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.lit("LOCATED_IN"), F.lit(None).cast("date"))
    return supplied.union(located).groupBy("src", "dst", "type").agg(F.min("t").alias("first"), F.count("*").alias("n"))


_COS = "p AS (SELECT a.vec_id AS l, b.vec_id AS r, a.label AS label, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label)"


@query("cosine_pairs", f'WITH {_COS} SELECT l AS "left", r AS "right", round(c, 6) AS cosine FROM p WHERE c >= 0.3')
def cosine_pairs(spark, sf):
    return v.pairs_above(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.3, "label").withColumn("cosine", F.round("cosine", 6))


@query("mutual_knn", f'WITH {_COS}, q AS (SELECT l AS a, r AS b, c FROM p WHERE c >= 0.2 UNION ALL SELECT r, l, c FROM p WHERE c >= 0.2), n AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 8) SELECT x.a AS "left", x.b AS "right", round(x.c, 6) AS cosine FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b')
def mutual_knn(spark, sf):
    return v.mutual_neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 8, 0.2, "label")


@query("nearest_list", "SELECT a.vec_id AS query, b.vec_id AS item, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank FROM embeddings a CROSS JOIN (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) b QUALIFY rank <= 3")
def nearest_list(spark, sf):
    """The three nearest of the reference items (the first vector of each label)."""
    e = table(spark, sf, "embeddings")
    items = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    return v.nearest(e, items, "vec_id", "embedding", 3).withColumn("cosine", F.round("cosine", 6))


@query("outlier_distance", "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id AND a.label = b.label), n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p) SELECT a AS vec_id, round(min(d), 6) AS nearest_known_distance, round(avg(d), 6) AS outlier_distance FROM n WHERE k <= 5 GROUP BY a")
def outlier_distance(spark, sf):
    """Distance to the nearest earlier vector of the label, and the mean to the five nearest."""
    near = v.neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 5, group="label", earlier=True)
    return near.groupBy(F.col("a").alias("vec_id")).agg(F.round(F.min(1 - F.col("cosine")), 6).alias("nearest_known_distance"), F.round(F.avg(1 - F.col("cosine")), 6).alias("outlier_distance"))


@query("taxonomy")
def taxonomy(spark, sf):
    return v.taxonomy(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("greedy_clusters")
def greedy_clusters(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("score", F.get("embedding", F.lit(0)).cast("double"))
    return v.greedy_clusters(e, "label", "vec_id", "embedding", "score", 0.25, 8)


@query("dedup_stars")
def dedup_stars(spark, sf):
    """Pairs of near vectors; the centre of each star is its row of highest first component."""
    e = table(spark, sf, "embeddings")
    pairs = v.pairs_above(e, "vec_id", "embedding", 0.3, "label").select(F.col("left").alias("src"), F.col("right").alias("dst"))
    comp = connected_components(pairs, "src", "dst")
    grouped = pairs.join(comp.select(F.col("node").alias("src"), "component"), "src")
    priority = e.select(F.col("vec_id").alias("node"), F.get("embedding", F.lit(0)).cast("double").alias("priority"))
    return g.stars(grouped, priority, "component")
