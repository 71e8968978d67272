"""Queries of the relational, as-of, ranking-window and set operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almagest.functions import expressions as x
from almagest.operators import rows as r
from almagest.sources.tables import mentions, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def _day(c):
    return F.col(c).cast("date")


@query("review_gate", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'R' AND l_discount <= 0.05) AS passed FROM lineitem GROUP BY 1")
def review_gate(spark, sf):
    """Accepted, not negated and confident enough."""
    ok = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R") & (F.col("l_discount") <= 0.05)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"))


@query("economic_class", """SELECT class, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'negated' WHEN l_returnflag = 'N' THEN 'forecast' WHEN l_linestatus = 'F' THEN 'reviewed' ELSE 'candidate' END AS class FROM lineitem) GROUP BY class""")
def economic_class(spark, sf):
    li = table(spark, sf, "lineitem")
    polarity = F.when(F.col("l_returnflag") == "R", "negated").otherwise("affirmed")
    modality = F.when(F.col("l_returnflag") == "N", "planned").otherwise("reported")
    status = F.when(F.col("l_linestatus") == "F", "accepted").otherwise("proposed")
    return li.groupBy(x.economic_class(status, polarity, modality).alias("class")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


_FX = {"1-URGENT": ("EUR", 1.1), "2-HIGH": ("USD", 1.0), "3-MEDIUM": ("GBP", 1.5), "4-NOT SPECIFIED": ("JPY", 0.01), "5-LOW": ("CHF", 0.9)}
_CPI = {1995: 0.70, 1997: 0.74, 1999: 0.77, 2000: 0.80}


@query("real_usd", f"""WITH fx(p, rate) AS (VALUES {', '.join(f"('{p}', {v[1]})" for p, v in _FX.items())}), cpi(y, k) AS (VALUES {', '.join(f'({y}, {k})' for y, k in _CPI.items())}),
near AS (SELECT yy, arg_min(k, abs(y - yy) * 10000 - y) AS k, min(abs(y - yy)) AS away FROM (SELECT DISTINCT year(o_orderdate) AS yy FROM orders) CROSS JOIN cpi GROUP BY yy)
SELECT CAST(yy AS BIGINT) AS year, count(*) AS n, round(sum(o_totalprice * rate / k), 2) AS real_usd, away > 0 AS nearest_year FROM orders JOIN fx ON p = o_orderpriority JOIN near ON yy = year(o_orderdate) GROUP BY yy, away""")
def real_usd(spark, sf):
    """Currency to dollars, then to base-year prices by the nearest year's index (the later of two)."""
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    fx = spark.createDataFrame([(p, v[1]) for p, v in _FX.items()], "o_orderpriority string, rate double")
    cpi = spark.createDataFrame(list(_CPI.items()), "y long, k double")
    away = F.abs(F.col("y") - F.col("year"))
    near = orders.select("year").distinct().join(F.broadcast(cpi)).groupBy("year").agg(F.min_by("k", F.struct(away, -F.col("y"))).alias("k"), F.min(away).alias("away"))
    priced = orders.join(F.broadcast(fx), "o_orderpriority").join(F.broadcast(near), "year")
    return priced.groupBy("year", "away").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice") * F.col("rate") / F.col("k")), 2).alias("real_usd")).select("year", "n", "real_usd", (F.col("away") > 0).alias("nearest_year"))


@query("candidate_rejections", """WITH m AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS s, min(o_orderdate) AS f, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-01-01') AS recent, max(l_linenumber) AS stage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'kind' WHEN f IS NULL THEN 'undated' WHEN stage > 6 THEN 'stage' WHEN f < TIMESTAMP '1995-02-01' THEN 'age' WHEN s < 25 THEN 'sources' WHEN recent < 10 THEN 'silent' ELSE 'accepted' END AS reason FROM part LEFT JOIN m ON l_partkey = p_partkey""")
def candidate_rejections(spark, sf):
    """The first rule that rejects a part; missing data passes a rule."""
    seen = mentions(spark, sf).groupBy("technology").agg(F.count_distinct("organization").alias("s"), F.min("observed").alias("f"), F.count_if(F.col("observed") > F.lit("1998-01-01").cast("date")).alias("recent"), F.max("stage").alias("stage"))
    parts = table(spark, sf, "part").join(seen, F.col("technology") == F.col("p_partkey"), "left")
    rules = [("kind", F.col("p_type").startswith("PROMO")), ("undated", F.col("f").isNull()), ("stage", F.col("stage") > 6), ("age", F.col("f") < F.lit("1995-02-01").cast("date")), ("sources", F.col("s") < 25), ("silent", F.col("recent") < 10)]
    return parts.select("p_partkey", r.first_reason(rules).alias("reason"))


@query("asof_version", """WITH q AS (SELECT c_custkey, CAST(d AS DATE) AS at FROM customer CROSS JOIN (VALUES ('1996-01-01'), ('1998-06-15'), ('2000-03-31')) v(d)),
o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT q.c_custkey, q.at, o.d AS as_of_date, o.k AS o_orderkey FROM q ASOF LEFT JOIN o ON o.o_custkey = q.c_custkey AND o.d <= q.at""")
def asof_version(spark, sf):
    """The last order up to each date, the greatest key of its day."""
    dates = spark.createDataFrame([("1996-01-01",), ("1998-06-15",), ("2000-03-31",)], "d string").select(F.col("d").cast("date").alias("at"))
    asked = table(spark, sf, "customer").select("c_custkey").join(F.broadcast(dates))
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), _day("o_orderdate").alias("d")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return r.as_of(asked, orders, ["c_custkey"], "at", "d", ["o_orderkey"])


@query("asof_metrics", """WITH o AS (SELECT l_partkey, CAST(o_orderdate AS DATE) AS d, max(l_extendedprice) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
v AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS d FROM lineitem GROUP BY ALL)
SELECT v.l_partkey, v.d, o.d AS as_of_date, o.p AS price FROM v ASOF LEFT JOIN o ON v.l_partkey = o.l_partkey AND o.d <= v.d""")
def asof_metrics(spark, sf):
    """At each shipping day of a part, the last price known by then (greatest of its day)."""
    m = mentions(spark, sf)
    known = m.groupBy(F.col("technology").alias("l_partkey"), F.col("observed").alias("seen")).agg(F.max("amount").alias("price"))
    asked = m.select(F.col("technology").alias("l_partkey"), F.col("recorded").alias("d")).distinct()
    return r.as_of(asked, known, ["l_partkey"], "d", "seen", ["price"])


@query("asof_label_horizon", """WITH s AS (SELECT o_custkey, date_trunc('quarter', CAST(o_orderdate AS DATE))::DATE AS t, count(*) AS n FROM orders GROUP BY ALL), q AS (SELECT *, CAST(t + INTERVAL 12 MONTH AS DATE) AS h FROM s)
SELECT q.o_custkey, q.t, q.n, f.t AS as_of_date, f.n AS later FROM q ASOF LEFT JOIN s f ON f.o_custkey = q.o_custkey AND f.t <= q.h""")
def asof_label_horizon(spark, sf):
    """The state of a customer at the last snapshot within a year after each of theirs."""
    s = table(spark, sf, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "quarter").alias("t")).agg(F.count("*").alias("n"))
    asked = s.withColumn("_h", F.add_months("t", 12))
    return r.as_of(asked, s.select("o_custkey", "t", F.col("n").alias("later")), ["o_custkey"], "_h", "t", ["later"]).drop("_h")


@query("year_fill", """WITH y AS (SELECT conv_id, CAST(range AS BIGINT) AS slot FROM (SELECT DISTINCT conv_id FROM conversations), range(0, 8)), a AS (SELECT conv_id, turn, max(length(text)) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
j AS (SELECT y.conv_id, y.slot, a.n, min(CASE WHEN a.n IS NOT NULL THEN slot END) OVER (PARTITION BY y.conv_id) AS f FROM y LEFT JOIN a ON a.conv_id = y.conv_id AND a.turn = y.slot)
SELECT conv_id, slot, coalesce(last_value(n IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY slot), first_value(n IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS n FROM j""")
def year_fill(spark, sf):
    """A missing place takes the nearest earlier value, else the first."""
    c = table(spark, sf, "conversations")
    places = c.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("slot"))
    said = c.where("role = 'assistant'").groupBy("conv_id", F.col("turn").alias("slot")).agg(F.max(F.length("text")).cast("long").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("slot")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = places.join(said, ["conv_id", "slot"], "left")
    return filled.select("conv_id", "slot", F.coalesce(F.last("n", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("n", True).over(whole)).alias("n"))


@query("trajectory_cumulative", """SELECT user_id, event_type, d, CAST(sum(n) OVER w AS BIGINT) AS events, round(sum(v) OVER w, 4) AS total FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS d, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY d)""")
def trajectory_cumulative(spark, sf):
    daily = table(spark, sf, "events").groupBy("user_id", "event_type", _day("ts").alias("d")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    w = Window.partitionBy("user_id", "event_type").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("user_id", "event_type", "d", F.sum("n").over(w).alias("events"), F.round(F.sum("v").over(w), 4).alias("total"))


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    return r.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("year_representative", "SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1, 2")
def year_representative(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count("*").alias("n"))


@query("family_first_part", "SELECT p_partkey, p_brand, first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS first_part, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) > 1 AS purged FROM part")
def family_first_part(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.first("p_partkey").over(w).alias("first_part"), (F.row_number().over(w) > 1).alias("purged"))


@query("era_round_robin", "SELECT o_orderkey, CAST(era AS BIGINT) AS era, turn FROM (SELECT o_orderkey, year(o_orderdate) AS era, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS turn FROM orders) ORDER BY turn, era LIMIT 120")
def era_round_robin(spark, sf):
    out = r.round_robin(table(spark, sf, "orders"), F.year("o_orderdate").cast("long"), [F.col("o_orderkey")], 120)
    return out.select("o_orderkey", "era", F.col("turn").cast("long").alias("turn"))


@query("hash_rank", "SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(concat_ws('|', '13', p_brand, CAST(p_partkey AS VARCHAR))), p_partkey) AS rank FROM part) WHERE rank <= 5")
def hash_rank(spark, sf):
    """The first five of each group in the order of a seeded hash."""
    order = [F.sha2(F.concat_ws("|", F.lit("13"), "p_brand", F.col("p_partkey").cast("string")), 256), F.col("p_partkey")]
    return r.top_per_key(table(spark, sf, "part"), ["p_brand"], order, 5).select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("snapshot_grid", "SELECT d AS snapshot FROM (SELECT CAST(range AS DATE) AS d FROM range(DATE '2001-01-01', (SELECT max(o_orderdate)::DATE + 1 FROM orders), INTERVAL 3 MONTH)) UNION ALL SELECT CAST(range AS DATE) FROM range(DATE '1995-01-01', DATE '1998-01-01', INTERVAL 12 MONTH) UNION ALL SELECT CAST(range AS DATE) FROM range(DATE '1998-01-01', DATE '2001-01-01', INTERVAL 6 MONTH)")
def snapshot_grid(spark, sf):
    """Yearly first, then half-yearly, then quarterly up to the last date."""
    last = table(spark, sf, "orders").agg(F.max("o_orderdate").cast("date").alias("last"))
    parts = [("date'1995-01-01'", "date'1997-12-31'", 12), ("date'1998-01-01'", "date'2000-12-31'", 6), ("date'2001-01-01'", "last", 3)]
    grids = [last.select(F.explode(F.expr(f"sequence({a}, {b}, interval {n} month)")).alias("snapshot")) for a, b, n in parts]
    return grids[0].unionByName(grids[1]).unionByName(grids[2])


@query("trend_vector", """WITH q AS (SELECT p_partkey, k FROM part, range(0, 8) t(k)), w AS (SELECT p_partkey, k, CAST(DATE '2000-01-01' - to_months(CAST(3 * (k + 1) AS INT)) AS DATE) AS a, CAST(DATE '2000-01-01' - to_months(CAST(3 * k AS INT)) AS DATE) AS b FROM q),
n AS (SELECT w.p_partkey, k, count(d) AS n FROM w LEFT JOIN (SELECT l_partkey, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) ON l_partkey = p_partkey AND d > a AND d <= b GROUP BY ALL)
SELECT p_partkey, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k DESC) AS trend, CASE WHEN (sum(n) FILTER (WHERE k < 4) + 1.0) / (sum(n) FILTER (WHERE k >= 4) + 1.0) >= 1.5 THEN 'rising' WHEN (sum(n) FILTER (WHERE k < 4) + 1.0) / (sum(n) FILTER (WHERE k >= 4) + 1.0) <= 0.67 THEN 'falling' ELSE 'steady' END AS category FROM n GROUP BY p_partkey""")
def trend_vector(spark, sf):
    """Mentions of the last eight quarters, oldest first, and the trend of the last year against the one before."""
    at = F.lit("2000-01-01").cast("date")
    m = mentions(spark, sf)
    quarters = [x.window_sum(F.col("observed"), F.add_months(at, -3 * (k + 1)), F.add_months(at, -3 * k)) for k in range(7, -1, -1)]
    counts = m.groupBy(F.col("technology").alias("p_partkey")).agg(F.array(*quarters).alias("q"))
    full = table(spark, sf, "part").select("p_partkey").join(counts, "p_partkey", "left").withColumn("q", F.coalesce("q", F.array(*[F.lit(0).cast("long")] * 8)))
    total = lambda a, n: F.aggregate(F.slice("q", a, n), F.lit(0).cast("long"), lambda s, v: s + v)
    change = (total(5, 4) + 1) / (total(1, 4) + 1)
    return full.select("p_partkey", F.array_join(F.col("q").cast("array<string>"), ",").alias("trend"), F.when(change >= 1.5, "rising").when(change <= 0.67, "falling").otherwise("steady").alias("category"))


@query("quotes_one_per_doc", """SELECT l_partkey, l_orderkey, k FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY d DESC, l_orderkey) AS k FROM (SELECT l_partkey, l_orderkey, max(CAST(o_orderdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)) WHERE k <= 3""")
def quotes_one_per_doc(spark, sf):
    docs = mentions(spark, sf).groupBy(F.col("technology").alias("l_partkey"), F.col("document").alias("l_orderkey")).agg(F.max("observed").alias("d"))
    return r.top_per_key(docs, ["l_partkey"], [F.desc("d"), F.col("l_orderkey")], 3).select("l_partkey", "l_orderkey", F.col("rank").cast("long").alias("k"))


@query("topk_contributions", """WITH s AS (SELECT l_partkey, l_suppkey, sum(l_extendedprice * (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)) AS v FROM lineitem GROUP BY ALL) SELECT l_partkey, l_suppkey, round(v, 2) AS contribution FROM s QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY abs(round(v, 2)) DESC, l_suppkey) <= 3""")
def topk_contributions(spark, sf):
    signed = F.col("amount") * F.when(F.col("kind") == "R", -1).otherwise(1)
    s = mentions(spark, sf).groupBy(F.col("technology").alias("l_partkey"), F.col("organization").alias("l_suppkey")).agg(F.round(F.sum(signed), 2).alias("contribution"))
    return r.top_per_key(s, ["l_partkey"], [F.desc(F.abs("contribution")), F.col("l_suppkey")], 3).drop("rank")


@query("search_order_flagged_tail", """WITH s AS (SELECT p_partkey, p_retailprice AS score, p_size >= 48 AS flagged FROM part), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, p_partkey) AS a, row_number() OVER (PARTITION BY flagged ORDER BY score DESC, p_partkey) AS b FROM s) SELECT p_partkey, score, flagged FROM k WHERE a <= 25 OR (flagged AND b <= 40)""")
def search_order_flagged_tail(spark, sf):
    """The best rows, and flagged ones further down: two bounded sorts, no window over all rows."""
    s = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("score"), (F.col("p_size") >= 48).alias("flagged"))
    best = [F.desc("score"), F.col("p_partkey")]
    return s.orderBy(*best).limit(25).union(s.where("flagged").orderBy(*best).limit(40)).distinct()


@query("set_operations", """SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997) UNION ALL SELECT 'lost', count(*) FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997) UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 UNION SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997) UNION ALL SELECT 'all', count(*) FROM orders WHERE year(o_orderdate) IN (1996, 1997)""")
def set_operations(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (o.where(F.year("o_orderdate") == y).select("o_custkey") for y in (1996, 1997))
    count = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count("both", a.intersect(b)).union(count("lost", a.subtract(b))).union(count("either", a.union(b).distinct())).union(count("all", a.union(b)))


@query("array_sets", """WITH s AS (SELECT o_custkey, list_distinct(list(o_orderpriority) FILTER (WHERE year(o_orderdate) <= 1997)) AS a, list_distinct(list(o_orderpriority) FILTER (WHERE year(o_orderdate) > 1997)) AS b FROM orders GROUP BY 1), t AS (SELECT o_custkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT o_custkey, CAST(len(list_filter(b, lambda v: NOT list_contains(a, v))) AS BIGINT) AS new, CAST(len(list_intersect(a, b)) AS BIGINT) AS kept, round(1 - len(list_intersect(a, b)) * 1.0 / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS jaccard_distance FROM t""")
def array_sets(spark, sf):
    early = F.year("o_orderdate") <= 1997
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(early, F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(~early, F.col("o_orderpriority"))).alias("b"))
    size = lambda c: F.size(c).cast("long")
    both, either = F.array_intersect("a", "b"), F.array_union("a", "b")
    return s.select("o_custkey", size(F.array_except("b", "a")).alias("new"), size(both).alias("kept"), F.round(1 - x.ratio(F.size(both), F.size(either)), 6).alias("jaccard_distance"))


@query("recursive_closure", """WITH RECURSIVE e(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), c(root, node) AS (SELECT parent, child FROM e UNION SELECT c.root, e.child FROM c JOIN e ON e.parent = c.node) SELECT root, count(*) AS below FROM c GROUP BY root""")
def recursive_closure(spark, sf):
    """Everything below a node, by recursion over the parent table."""
    nations = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    suppliers = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    nations.union(suppliers).createOrReplaceTempView("almagest_edges")
    return spark.sql("WITH RECURSIVE c(root, node) AS (SELECT parent, child FROM almagest_edges UNION ALL SELECT c.root, e.child FROM c JOIN almagest_edges e ON e.parent = c.node) SELECT root, count(DISTINCT node) AS below FROM c GROUP BY root")


@query("parents_removed", "SELECT s_suppkey, node FROM (SELECT s_suppkey, 'n' || s_nationkey AS node FROM supplier UNION ALL SELECT s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, 'other' FROM supplier) WHERE node NOT LIKE 'r%'")
def parents_removed(spark, sf):
    """A region is dropped where the supplier also has the nation below it."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    tags = s.select("s_suppkey", F.concat(F.lit("n"), "s_nationkey").alias("node")).union(s.where("s_acctbal > 0").join(n, n.n_nationkey == s.s_nationkey).select("s_suppkey", F.concat(F.lit("r"), "n_regionkey"))).union(s.select("s_suppkey", F.lit("other")))
    return r.without_ancestors(tags, "s_suppkey", "node", n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))


@query("upsert_first_last", """WITH o AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l, count(*) AS n FROM orders WHERE year(o_orderdate) <= 1998 GROUP BY 1), w AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l, count(*) AS n FROM orders WHERE year(o_orderdate) > 1998 GROUP BY 1)
SELECT coalesce(o.o_custkey, w.o_custkey) AS o_custkey, CAST(least(o.f, w.f) AS DATE) AS first, CAST(greatest(o.l, w.l) AS DATE) AS last, coalesce(o.n, 0) + coalesce(w.n, 0) AS n FROM o FULL JOIN w ON o.o_custkey = w.o_custkey""")
def upsert_first_last(spark, sf):
    """Merge of a new batch: first retrieval kept, last advanced, counts added."""
    daily = table(spark, sf, "orders").withColumn("d", _day("o_orderdate"))
    part = lambda c: daily.where(c).groupBy("o_custkey").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n"))
    zero = F.lit(0)
    merge = {"first": F.least("o.first", "n.first"), "last": F.greatest("o.last", "n.last"), "n": F.coalesce("o.n", zero) + F.coalesce("n.n", zero)}
    return r.upsert(part(F.year("d") <= 1998), part(F.year("d") > 1998), ["o_custkey"], merge)


@query("replace_by_version", "SELECT l_returnflag AS version, count(*) AS n, round(sum(l_quantity * (CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END)), 2) AS q FROM lineitem WHERE l_returnflag <> 'A' OR l_linestatus = 'F' GROUP BY 1")
def replace_by_version(spark, sf):
    """A new run replaces the rows of its version only."""
    old = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("version"), "l_linestatus", "l_quantity")
    new = old.where("version = 'A' and l_linestatus = 'F'").withColumn("l_quantity", F.col("l_quantity") * 2)
    return r.replace_versions(old, new, "version").groupBy("version").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("semi_anti_joins", "SELECT count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS urgent, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS never_pending FROM customer")
def semi_anti_joins(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    urgent = c.join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi").agg(F.count("*").alias("urgent"))
    return urgent.join(c.join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti").agg(F.count("*").alias("never_pending")))


@query("reviewer_agreement", """WITH p AS (SELECT doc_id, quality AS a, CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END AS b, CASE WHEN toxic = 1 AND quality = 1 THEN quality END AS j FROM labels) SELECT doc_id, CASE WHEN a = b THEN a ELSE j END AS label, CASE WHEN a = b THEN 'agreed' WHEN j IS NOT NULL THEN 'adjudicated' ELSE 'conflict' END AS state FROM p""")
def reviewer_agreement(spark, sf):
    """Two reviews and an optional adjudication must give one label."""
    labels = table(spark, sf, "labels")
    first = labels.select("doc_id", F.col("quality").alias("a"))
    second = labels.select("doc_id", F.when(F.col("toxic") == 1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("b"))
    third = labels.where("toxic = 1 and quality = 1").select("doc_id", F.col("quality").alias("j"))
    both = first.join(second, "doc_id").join(third, "doc_id", "left")
    same = F.col("a") == F.col("b")
    return both.select("doc_id", F.when(same, F.col("a")).otherwise(F.col("j")).alias("label"), F.when(same, "agreed").when(F.col("j").isNotNull(), "adjudicated").otherwise("conflict").alias("state"))


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), (F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("long").alias("g"))


@query("class_balance_weights", """WITH e AS (SELECT doc_id, quality, doc_id // 1000 AS era FROM labels), c AS (SELECT *, count(*) OVER (PARTITION BY era, quality) AS k, count(*) OVER (PARTITION BY era) AS n FROM e) SELECT doc_id, round(n / (2.0 * k), 6) AS weight FROM c""")
def class_balance_weights(spark, sf):
    """Each class weighs the same within an era."""
    e = table(spark, sf, "labels").withColumn("era", F.expr("doc_id div 1000"))
    counts = e.groupBy("era", "quality").agg(F.count("*").alias("k"))
    totals = counts.groupBy("era").agg(F.sum("k").alias("n"))
    return e.join(counts, ["era", "quality"]).join(totals, "era").select("doc_id", F.round(F.col("n") / (2.0 * F.col("k")), 6).alias("weight"))


@query("robust_scaler", """SELECT l_returnflag, round(median(l_extendedprice), 4) AS center, round(greatest(1, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)), 4) AS scale FROM lineitem GROUP BY 1""")
def robust_scaler(spark, sf):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(q.alias("q"))
    return s.select("l_returnflag", F.round(F.get("q", F.lit(1)), 4).alias("center"), F.round(F.greatest(F.lit(1.0), F.get("q", F.lit(2)) - F.get("q", F.lit(0))), 4).alias("scale"))


@query("element_percentiles", """SELECT event_type, round(s[1 + CAST(floor(0.5 * len(s)) AS INT)], 6) AS p50, round(s[1 + CAST(floor(0.95 * len(s)) AS INT)], 6) AS p95 FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY 1)""")
def element_percentiles(spark, sf):
    """The element at int(share * n) of the ordered values, found by rank, not by gathering them."""
    e = table(spark, sf, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy("event_type")))
    pick = lambda share: F.round(F.min(F.when(F.col("upto") > F.floor(share * F.col("total")), F.col("value"))), 6)
    return e.groupBy("event_type").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"))


@query("signal_union", """SELECT signal, count(*) AS n, count(DISTINCT part) AS parts FROM (SELECT 'relation' AS signal, l_partkey AS part FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'maturity', l_partkey FROM lineitem WHERE l_linenumber >= 5 UNION ALL SELECT 'economic', l_partkey FROM lineitem WHERE l_extendedprice > 50000) GROUP BY signal""")
def signal_union(spark, sf):
    """Three patterns in one long table."""
    li = table(spark, sf, "lineitem")
    part = lambda name, c: li.where(c).select(F.lit(name).alias("signal"), F.col("l_partkey").alias("part"))
    rows = part("relation", "l_returnflag = 'A'").unionByName(part("maturity", "l_linenumber >= 5")).unionByName(part("economic", "l_extendedprice > 50000"))
    return rows.groupBy("signal").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"))


@query("kind_votes", """WITH v AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, arg_max(l_returnflag, struct_pack(n := n, k := l_returnflag)) AS settled, CAST(sum(n) AS BIGINT) AS votes FROM v GROUP BY 1""")
def kind_votes(spark, sf):
    """The most voted kind, the later letter on ties."""
    v = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return v.groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.struct("n", "l_returnflag")).alias("settled"), F.sum("n").alias("votes"))


@query("uniform_sample", """WITH k AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey FROM k WHERE floor((i + 1) / (n / 50.0)) <> floor(i / (n / 50.0))""")
def uniform_sample(spark, sf):
    return r.evenly(table(spark, sf, "part").select("p_partkey"), [F.col("p_partkey")], 50)


@query("budget_select", """SELECT l_orderkey, l_partkey, used FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS used FROM lineitem) WHERE used <= 60""")
def budget_select(spark, sf):
    """Best first while a budget lasts."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "lineitem").withColumn("used", F.sum("l_quantity").over(w)).where("used <= 60").select("l_orderkey", "l_partkey", "used")


@query("publish_latest_run", """SELECT o_custkey, arg_max(o_orderkey, struct_pack(s := CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END, d := o_orderdate, k := o_orderkey)) AS published FROM orders GROUP BY 1""")
def publish_latest_run(spark, sf):
    """A finished run before a partial one before none, then the newest."""
    priority = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(priority, "o_orderdate", "o_orderkey")).alias("published"))


@query("merge_by_mapping", """SELECT CAST(l_suppkey // 3 * 3 AS BIGINT) AS survivor, count(*) AS links, count(DISTINCT l_partkey) AS parts, min(CAST(l_shipdate AS DATE)) AS first_seen FROM lineitem GROUP BY 1""")
def merge_by_mapping(spark, sf):
    """Merged ids are rewritten through a mapping; edges, counts and first dates are gathered again."""
    li = table(spark, sf, "lineitem")
    mapping = table(spark, sf, "supplier").select("s_suppkey", F.expr("s_suppkey div 3 * 3").alias("survivor"))
    moved = li.join(mapping, li.l_suppkey == mapping.s_suppkey, "left").withColumn("survivor", F.coalesce("survivor", F.expr("l_suppkey div 3 * 3")))
    return moved.groupBy("survivor").agg(F.count("*").alias("links"), F.count_distinct("l_partkey").alias("parts"), F.min(_day("l_shipdate")).alias("first_seen"))


@query("legacy_training_rows", """WITH t AS (SELECT CAST(d AS DATE) AS t FROM (VALUES ('1997-01-01'), ('1998-01-01'), ('1999-01-01')) v(d)), c AS (SELECT l_partkey, t, count(DISTINCT l_orderkey) FILTER (WHERE o_orderdate <= t) AS known, count(DISTINCT l_orderkey) FILTER (WHERE o_orderdate > t AND o_orderdate <= t + INTERVAL 24 MONTH) AS future FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN t GROUP BY ALL)
SELECT l_partkey, t, known, future, CASE WHEN future >= 12 THEN 1 ELSE 0 END AS label FROM c WHERE known >= 3 AND (future >= 12 OR future <= 6)""")
def legacy_training_rows(spark, sf):
    """Yearly rows labelled by what follows; the middle is dropped."""
    dates = spark.createDataFrame([("1997-01-01",), ("1998-01-01",), ("1999-01-01",)], "d string").select(F.col("d").cast("date").alias("t"))
    d, t = F.col("observed"), F.col("t")
    rows = mentions(spark, sf).join(F.broadcast(dates)).groupBy(F.col("technology").alias("l_partkey"), "t").agg(F.count_distinct(F.when(d <= t, F.col("document"))).alias("known"), F.count_distinct(F.when(x.within(d, t, F.add_months(t, 24)), F.col("document"))).alias("future"))
    return rows.where("known >= 3 and (future >= 12 or future <= 6)").withColumn("label", F.when(F.col("future") >= 12, 1).otherwise(0))


@query("auto_outcome_label", """WITH s AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderdate <= TIMESTAMP '1998-01-01') AS past, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1999-01-01') AS next, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN past = 0 THEN 'censored' WHEN next >= 3 THEN 'mainstream' WHEN next >= 2 THEN 'adopted' WHEN next = 0 THEN 'silent' ELSE 'ambiguous' END AS outcome FROM s""")
def auto_outcome_label(spark, sf):
    d = _day("o_orderdate")
    day = lambda s: F.lit(s).cast("date")
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(d <= day("1998-01-01")).alias("past"), F.count_if(x.within(d, day("1998-01-01"), day("1999-01-01"))).alias("next"))
    return s.select("o_custkey", F.when(F.col("past") == 0, "censored").when(F.col("next") >= 3, "mainstream").when(F.col("next") >= 2, "adopted").when(F.col("next") == 0, "silent").otherwise("ambiguous").alias("outcome"))


@query("stable_ids", "SELECT doc_id, 'doc:' || left(sha256(trim(source) || chr(31) || trim(CAST(doc_id AS VARCHAR))), 24) AS id, sha256(text) AS content_hash FROM documents")
def stable_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", x.stable_id("doc", F.col("source"), F.col("doc_id")).alias("id"), F.sha2("text", 256).alias("content_hash"))


@query("family_fold", "SELECT fold, count(*) AS n FROM (SELECT CAST(CAST('0x' || left(sha256(CAST(p_partkey AS VARCHAR)), 16) AS UBIGINT) % 5 AS INT) AS fold FROM part) GROUP BY fold")
def family_fold(spark, sf):
    return table(spark, sf, "part").groupBy(x.hash_fold(F.col("p_partkey").cast("string"), 5).alias("fold")).agg(F.count("*").alias("n"))


@query("content_hash_dups", "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def content_hash_dups(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("h")


@query("json_numbers", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_numbers(spark, sf):
    e = table(spark, sf, "events").withColumn("m", x.numeric_map(F.col("props")))
    return e.groupBy("event_type").agg(F.sum(F.try_element_at("m", F.lit("k"))).cast("long").alias("k"), F.count("*").alias("n"))
