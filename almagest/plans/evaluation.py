"""Search, linking, metric, text and streaming queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almagest.functions import expressions as x
from almagest.operators import linking as li
from almagest.operators import metrics as mt
from almagest.operators import search as s
from almagest.operators import text as tx
from almagest.sources.runtime import new_path, small
from almagest.sources.tables import mentions, table
from almagest.streaming import events as ev

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


_Z = "SELECT l_partkey, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS docs, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS sources, avg(l_discount) AS discount FROM lineitem GROUP BY 1"


@query("zscore_rank", f"""WITH f AS ({_Z}), m AS (SELECT avg(docs) AS a, stddev_pop(docs) AS b, avg(sources) AS c, stddev_pop(sources) AS d FROM f),
z AS (SELECT l_partkey, round(0.7 * greatest(-3, least(3, (docs - a) / b)) + 0.3 * greatest(-3, least(3, (sources - c) / d)), 6) AS raw FROM f, m) SELECT l_partkey, raw AS raw_score, round(1 / (1 + exp(-raw)), 6) AS score FROM z""")
def zscore_rank(spark, sf):
    f = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").cast("double").alias("docs"), F.count_distinct("l_suppkey").cast("double").alias("sources"))
    return s.zscore_rank(f, "l_partkey", {"docs": 0.7, "sources": 0.3})


_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_+#]+')"


@query("bm25_search", f"""WITH q AS (SELECT DISTINCT item_id AS query, unnest({_TOK.format('text')}) AS term FROM benchmark), d AS (SELECT doc_id AS doc, {_TOK.format('text')} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d), t AS (SELECT doc, term, len, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
r AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM t JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)
SELECT query, doc, round(score, 4) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 4) DESC, doc) <= 10""")
def bm25_search(spark, sf):
    """The ten best documents for each benchmark passage."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(s.tokens(F.col("text"))).alias("term")).distinct()
    scored = s.bm25(table(spark, sf, "documents"), "doc_id", "text", q).withColumn("score", F.round("score", 4))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("k", F.row_number().over(w)).where("k <= 10").drop("k")


@query("hybrid_search", """WITH l AS (SELECT label AS query, vec_id AS doc, CAST(list_extract(embedding, 1) + 1 AS DOUBLE) AS score FROM embeddings), c AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1),
sem AS (SELECT c.label AS query, vec_id AS doc, list_cosine_similarity(CAST(c.e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS k FROM embeddings, c), lx AS (SELECT query, doc, score / max(score) OVER (PARTITION BY query) AS x FROM l), sx AS (SELECT * FROM sem WHERE k >= 0.15)
SELECT coalesce(lx.query, sx.query) AS query, coalesce(lx.doc, sx.doc) AS doc, round((0.65 * coalesce(x, 0) + 0.35 * coalesce(k, 0)) / ((CASE WHEN x IS NULL THEN 0 ELSE 0.65 END) + (CASE WHEN k IS NULL THEN 0 ELSE 0.35 END)), 6) AS score FROM lx FULL JOIN sx ON lx.query = sx.query AND lx.doc = sx.doc""")
def hybrid_search(spark, sf):
    """A lexical score for a label's vectors mixed with the cosine to its first vector."""
    e = table(spark, sf, "embeddings")
    lexical = e.select(F.col("label").alias("query"), F.col("vec_id").alias("doc"), (F.get("embedding", F.lit(0)) + F.lit(1).cast("float")).cast("double").alias("score"))
    first = e.groupBy(F.col("label").alias("query")).agg(F.min_by("embedding", "vec_id").alias("e"))
    semantic = e.join(F.broadcast(first)).select("query", F.col("vec_id").alias("doc"), x.cosine(F.col("e"), F.col("embedding")).alias("cosine"))
    return s.hybrid(lexical, semantic, ["query", "doc"], 0.65, 0.15).select("query", "doc", F.round("score", 6).alias("score"))


@query("backtest_precision", """WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderdate <= TIMESTAMP '1998-01-01') AS past, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '2000-01-01') AS future FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY past DESC, o_custkey) AS k, CASE WHEN future >= 3 AND future > 0.5 * past THEN 1 ELSE 0 END AS grew FROM c)
SELECT CAST(n AS BIGINT) AS k, round(sum(grew) FILTER (WHERE r.k <= n) * 1.0 / n, 6) AS precision, round(sum(grew) FILTER (WHERE r.k <= n) * 1.0 / sum(grew), 6) AS recall, round((sum(grew) FILTER (WHERE r.k <= n) * 1.0 / n) / (sum(grew) * 1.0 / count(*)), 6) AS lift FROM r, (VALUES (10), (50), (100)) v(n) GROUP BY n""")
def backtest_precision(spark, sf):
    """Of the customers with most orders before a date, how many grew after it."""
    d = F.col("o_orderdate").cast("date")
    day = lambda v: F.lit(v).cast("date")
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(d <= day("1998-01-01")).alias("past"), F.count_if(x.within(d, day("1998-01-01"), day("2000-01-01"))).alias("future"))
    c = c.withColumn("grew", F.when((F.col("future") >= 3) & (F.col("future") > 0.5 * F.col("past")), 1).otherwise(0))
    out = s.precision_at(c, [F.desc("past"), F.col("o_custkey")], "grew", [10, 50, 100])
    return out.select("k", *(F.round(m, 6).alias(m) for m in ("precision", "recall", "lift")))


_SCORED = "p AS (SELECT l.doc_id, l.quality AS y, round(1 / (1 + exp(-(d.n_chars / 1000.0 - 1))), 6) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), F.round(x.sigmoid(F.col("n_chars") / 1000.0 - 1), 6).alias("p"))


@query("areas", f"""WITH {_SCORED}, a AS (SELECT p, count(*) AS n, sum(y) AS k FROM p GROUP BY p), c AS (SELECT *, sum(n) OVER (ORDER BY p DESC) AS an, sum(k) OVER (ORDER BY p DESC) AS ak, sum(k) OVER () AS tk, sum(n) OVER () AS tn FROM a)
SELECT round(sum(k * ak / CAST(an AS DOUBLE) / tk), 6) AS pr_auc, round(sum(k * ((tn - tk) - (an - ak) + 0.5 * (n - k))) / max(tk * (tn - tk)), 6) AS roc_auc FROM c""")
def areas(spark, sf):
    return mt.areas(_scored(spark, sf), "p", "y").select(F.round("pr_auc", 6).alias("pr_auc"), F.round("roc_auc", 6).alias("roc_auc"))


@query("best_f1", f"""WITH {_SCORED}, a AS (SELECT p, count(*) AS n, sum(y) AS k FROM p GROUP BY p), c AS (SELECT p, sum(n) OVER (ORDER BY p DESC) AS an, sum(k) OVER (ORDER BY p DESC) AS ak, sum(k) OVER () AS tk FROM a)
SELECT p AS threshold, round(ak / CAST(an AS DOUBLE), 6) AS precision, round(ak / CAST(tk AS DOUBLE), 6) AS recall, round(2.0 * ak / (an + tk), 6) AS f1 FROM c ORDER BY round(2.0 * ak / (an + tk), 12) DESC, p DESC LIMIT 1""")
def best_f1(spark, sf):
    out = mt.best_f1(_scored(spark, sf), "p", "y")
    return out.select("threshold", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("calibration", f"""WITH {_SCORED}, b AS (SELECT *, least(floor(p * 10), 9) AS b FROM p), g AS (SELECT b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY b)
SELECT round((SELECT avg((p - y) ** 2) FROM p), 6) AS brier, round((SELECT avg(CASE WHEN y = 1 THEN -ln(greatest(p, 1e-15)) ELSE -ln(1 - least(p, 1 - 1e-15)) END) FROM p), 6) AS log_loss, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM g""")
def calibration(spark, sf):
    out = mt.calibration(_scored(spark, sf), "p", "y")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("class_summary", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ROLLUP (quality, toxic)")
def class_summary(spark, sf):
    return table(spark, sf, "labels").rollup("quality", "toxic").agg(F.count("*").alias("n"))


@query("feature_selection")
def feature_selection(spark, sf):
    """Features that are present, vary, and don't repeat one another."""
    f = table(spark, sf, "lineitem").withColumn("gross", F.col("l_extendedprice") * 2).withColumn("one", F.lit(1.0)).withColumn("gap", F.when(F.col("l_returnflag") == "A", F.col("l_tax")))
    kept = mt.select_features(f, ["l_extendedprice", "gross", "l_quantity", "l_discount", "one", "gap", "l_tax"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("family_bootstrap")
def family_bootstrap(spark, sf):
    """The interval of the mean quality over resampled sources."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    return mt.bootstrap(table(spark, sf, "labels").join(d, "doc_id"), "source", "quality")


_CLAIMS = "c AS (SELECT l_partkey || ':' || l_suppkey AS slot, l_orderkey AS work, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS side, min(struct_pack(d := CAST(o_orderdate AS DATE), k := l_orderkey * 10 + l_linenumber)) AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), k AS (SELECT slot, work, side, f.d AS day, f.k AS claim FROM c)"


def _claims(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("day")), "l_orderkey")
    return lines.select(F.concat_ws(":", "l_partkey", "l_suppkey").alias("slot"), F.col("l_orderkey").alias("work"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("side"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), "day")


@query("corroborate_links", f"""WITH {_CLAIMS}, o AS (SELECT a.claim AS source, a.side AS sa, b.side AS sb, b.claim AS target, row_number() OVER (PARTITION BY a.slot, a.work, a.side, b.side ORDER BY b.day, b.claim) AS n FROM k a JOIN k b ON a.slot = b.slot AND a.work <> b.work AND (b.day < a.day OR (b.day = a.day AND b.claim < a.claim)))
SELECT source, target, CASE WHEN sa = sb THEN 'CORROBORATES' ELSE 'CONTRADICTS' END AS relation FROM o WHERE n = 1""")
def corroborate_links(spark, sf):
    return li.claim_links(_claims(spark, sf))


@query("claim_slots_keyed", """SELECT count(DISTINCT slot) AS slots, count(*) FILTER (WHERE slot IS NULL) AS measurements FROM (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_partkey || '|' || l_suppkey || '|' || l_returnflag END AS slot FROM lineitem)""")
def claim_slots_keyed(spark, sf):
    l = table(spark, sf, "lineitem")
    roles = F.create_map(F.lit("subject"), F.col("l_partkey").cast("string"), F.lit("object"), F.col("l_suppkey").cast("string"))
    predicate = F.when(F.col("l_returnflag") == "N", "measured").otherwise(F.col("l_returnflag"))
    slot = li.claim_slot(predicate, roles, F.create_map(F.lit("unit"), F.lit("x")))
    return l.select(slot.alias("slot")).agg(F.count_distinct("slot").alias("slots"), F.count_if(F.col("slot").isNull()).alias("measurements"))


@query("lexical_keys", "SELECT p_partkey, lower(p_name) AS key FROM part")
def lexical_keys(spark, sf):
    """Names of parts by their spelling-proof key."""
    return table(spark, sf, "part").select("p_partkey", li.lexical_key("p_name").alias("key"))


@query("organization_types", r"""SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^\p{L}\p{N}]+', ' ', 'g'), '\b(inc|ltd|llc|gmbh|corp|corporation|company|co|ag)\b', '', 'g')) AS key,
CASE WHEN regexp_matches(lower(s_name), '\b(univ\w*|college|institute|école|hochschule)\b') THEN 'university' WHEN regexp_matches(lower(s_name), '\b(inc|ltd|llc|gmbh|corp|ag|s\.a)\b\.?') THEN 'company' ELSE 'organization' END AS type FROM supplier""")
def organization_types(spark, sf):
    """Suppliers' names as keys, and what kind of organization each tells of."""
    return table(spark, sf, "supplier").select("s_suppkey", li.company_key(F.col("s_name")).alias("key"), li.organization_type(F.col("s_name")).alias("type"))


@query("mention_resolution", """WITH i AS (SELECT p_brand AS key, p_partkey AS concept FROM part WHERE p_size >= 49), n AS (SELECT p_partkey AS mention, p_brand AS key FROM part)
SELECT mention, CASE WHEN count(concept) = 1 THEN 'accepted' WHEN count(concept) > 1 THEN 'ambiguous' ELSE 'new' END AS state FROM n LEFT JOIN i USING (key) GROUP BY mention, key""")
def mention_resolution(spark, sf):
    """All parts by brand, against a registry of the largest ones (the index of the example, not a limit)."""
    p = table(spark, sf, "part")
    index = p.where("p_size >= 49").select(F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("concept"))
    return li.resolve(p.select(F.col("p_partkey").alias("mention"), F.col("p_brand").alias("key")), index).select("mention", "state")


@query("works_by_key", "SELECT min(doc_id) AS work, count(*) AS versions FROM documents GROUP BY lang, lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))")
def works_by_key(spark, sf):
    """Documents of equal plain text are one work, named by its least id."""
    d = table(spark, sf, "documents")
    return d.groupBy("lang", F.sha2(F.lower(x.plain_title(F.col("text"))), 256).alias("key")).agg(F.min("doc_id").alias("work"), F.count("*").alias("versions")).select("work", "versions")


@query("language_guess", r"""SELECT lang, count(*) FILTER (WHERE NOT ru AND k >= 2) AS english, count(*) FILTER (WHERE ru) AS russian FROM (SELECT lang, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ('the', 'and', 'of', 'with', 'for')))) AS k,
len(regexp_extract_all(text, '\p{L}')) > 0 AND len(regexp_extract_all(text, '[\x{0400}-\x{04ff}]')) * 10 >= len(regexp_extract_all(text, '\p{L}')) * 3 AS ru FROM documents) GROUP BY lang""")
def language_guess(spark, sf):
    """How many documents of each language column are taken for English and for Russian."""
    guess = x.language_guess(F.col("text"))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count_if(guess == "en").alias("english"), F.count_if(guess == "ru").alias("russian"))


@query("html_blocks")
def html_blocks(spark, sf):
    return tx.explode_html(table(spark, sf, "pages"))


@query("markdown_chunks")
def markdown_chunks(spark, sf):
    return tx.explode_chunks(table(spark, sf, "documents"))


@query("sentence_split")
def sentence_split(spark, sf):
    return tx.explode_sentences(table(spark, sf, "documents"))


@query("near_dup_words", f"""WITH q AS (SELECT DISTINCT item_id AS query, unnest({_TOK.format('text')}) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents), n AS (SELECT query, count(*) AS n FROM q GROUP BY query),
h AS (SELECT query, doc_id, count(*) AS k FROM d JOIN q USING (term) GROUP BY ALL) SELECT query, doc_id, round(k / n, 6) AS share FROM h JOIN n USING (query) QUALIFY row_number() OVER (PARTITION BY query ORDER BY k DESC, doc_id) = 1""")
def near_dup_words(spark, sf):
    """Benchmark passages by how many of their words the best document has."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(s.tokens(F.col("text")))).alias("term"))
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(s.tokens(F.col("text")))).alias("term"))
    size = q.groupBy("query").agg(F.count("*").alias("n"))
    hits = d.join(small(q), "term").groupBy("query", "doc_id").agg(F.count("*").alias("hits"))
    best = hits.groupBy("query").agg(F.max(F.struct("hits", -F.col("doc_id"))).alias("b"))
    return best.join(size, "query").select("query", (-F.col("b.col2")).alias("doc_id"), F.round(F.col("b.hits") / F.col("n"), 6).alias("share"))


def _flat(df, *keys):
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *keys, "n", F.round("total", 4).alias("total"))


@query("stream_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return _flat(ev.run_to_end(ev.tumbling(ev.read_events(spark, sf))), "event_type")


@query("stream_sliding", "SELECT date_trunc('day', ts) - to_days(CAST(k AS INT)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 2) r(k) GROUP BY ALL")
def stream_sliding(spark, sf):
    return _flat(ev.run_to_end(ev.sliding(ev.read_events(spark, sf))), "event_type")


@query("stream_session", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def stream_session(spark, sf):
    return _flat(ev.run_to_end(ev.sessions(ev.read_events(spark, sf))), "user_id")


@query("stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, sf):
    """Each event once, however often it is sent."""
    twice = ev.read_events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return ev.run_to_end(ev.once(twice, "event_id", "60 days").select("event_type", "event_id"), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("late_events", """WITH e AS (SELECT *, ts + to_seconds(CAST((event_id * 7919) % 7200 AS INT)) + to_microseconds(event_id) AS arrived FROM events), m AS (SELECT *, max(ts) OVER (ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT event_type, count(*) FILTER (WHERE top IS NULL OR ts >= top - INTERVAL 30 MINUTE) AS in_time, count(*) FILTER (WHERE ts < top - INTERVAL 30 MINUTE) AS late FROM m GROUP BY event_type""")
def late_events(spark, sf):
    """Events that arrive up to two hours late, against half an hour that is allowed."""
    e = table(spark, sf, "events").withColumn("arrived", F.expr("ts + make_dt_interval(0, 0, 0, cast((event_id * 7919) % 7200 + event_id / 1000000.0 as decimal(18,6)))"))
    kept, dropped = ev.late(e, "30 minutes")
    both = kept.select("event_type", F.lit(1).alias("k")).unionByName(dropped.select("event_type", F.lit(0).alias("k")))
    return both.groupBy("event_type").agg(F.sum("k").alias("in_time"), F.count_if(F.col("k") == 0).alias("late"))


@query("stream_ledger", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_ledger(spark, sf):
    """Two runs over the same input: the second finds every key in the ledger."""
    ledger, sink = new_path(spark, "ledger"), new_path(spark, "sink")
    for _ in range(2):
        ev.each_batch(ev.read_events(spark, sf), ledger, "event_id", lambda df: df.select("event_type", "value"), sink)
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("batch_as_known", "SELECT CAST(l_partkey AS BIGINT) AS technology, count(*) AS known, count(*) FILTER (WHERE greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) <= DATE '1998-01-01') AS known_strictly FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) <= DATE '1998-01-01' GROUP BY 1")
def batch_as_known(spark, sf):
    """Facts dated by their content, and strictly by the later of content and recording."""
    at = F.lit("1998-01-01").cast("date")
    m = mentions(spark, sf).where(F.col("observed") <= at)
    return m.groupBy("technology").agg(F.count("*").alias("known"), F.count_if(F.greatest("observed", "recorded") <= at).alias("known_strictly"))
