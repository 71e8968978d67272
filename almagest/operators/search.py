"""Retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.functions.expressions import sigmoid
from almagest.sources.runtime import materialise, small


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits, _, + and #."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w+#]+"), F.lit(0))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of every document that has a word of the query.

    ``queries`` has (query, term).  Only postings of its terms are kept; they are
    written once and serve document frequencies and scores.
    """
    words = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("w")).select("doc", F.size("w").alias("len"), "w")
    terms = small(queries.select("term").distinct())
    tf = words.select("doc", "len", F.explode("w").alias("term")).join(terms, "term").groupBy("term", "doc", "len").agg(F.count("*").alias("tf"))
    tf = materialise(tf, "postings")
    stats = words.agg(F.count("*").alias("_n"), F.avg("len").alias("_avg"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("_avg")))
    scored = tf.join(small(df), "term").join(F.broadcast(stats)).withColumn("part", part)
    return scored.join(small(queries), "term").groupBy("query", "doc").agg(F.sum("part").alias("score"))


def hybrid(lexical: DataFrame, semantic: DataFrame, keys: list[str], weight: float = 0.65, least_cosine: float = 0.4) -> DataFrame:
    """Lexical scores over their greatest and cosines from ``least_cosine`` on, mixed by weight where both exist."""
    top = lexical.groupBy(*keys[:1]).agg(F.max("score").alias("_top"))
    lex = lexical.join(top, keys[:1]).select(*keys, (F.col("score") / F.col("_top")).alias("lexical"))
    sem = semantic.where(F.col("cosine") >= least_cosine).select(*keys, F.col("cosine").alias("semantic"))
    both = lex.join(sem, keys, "full")
    have = F.when(F.col("lexical").isNotNull(), weight).otherwise(0.0) + F.when(F.col("semantic").isNotNull(), 1 - weight).otherwise(0.0)
    mixed = weight * F.coalesce("lexical", F.lit(0.0)) + (1 - weight) * F.coalesce("semantic", F.lit(0.0))
    return both.select(*keys, "lexical", "semantic", (mixed / have).alias("score"))


def zscore_rank(df: DataFrame, key: str, weights: dict[str, float], clip: float = 3.0) -> DataFrame:
    """(key, raw_score, score): weighted z-scores over all rows, clipped, missing as 0; the logistic of the sum."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in weights for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    total = F.lit(0.0)
    for c, w in weights.items():
        z = F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))
        total = total + w * F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), z)), F.lit(0.0))
    raw = F.round(total, 6)
    return df.join(F.broadcast(stats)).select(key, raw.alias("raw_score"), F.round(sigmoid(raw), 6).alias("score"))


def precision_at(ranked: DataFrame, order: list[Column], label: str, ks: list[int]) -> DataFrame:
    """(k, precision, recall, lift) of the first k rows; only the longest list is kept sorted."""
    totals = ranked.agg(F.sum(F.col(label).cast("double")).alias("_p"), F.count("*").alias("_n"))
    from pyspark.sql import Window

    head = ranked.orderBy(*order).limit(max(ks)).withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    rows = head.agg(*(F.sum(F.when(F.col("_r") <= k, F.col(label)).otherwise(0)).cast("double").alias(f"k{k}") for k in ks)).join(totals)
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.least(F.lit(k), F.col("_n")).alias("shown"), F.col(f"k{k}").alias("hits")) for k in ks)))
    return rows.select("_p", "_n", each.alias("e")).select("e.k", (F.col("e.hits") / F.col("e.shown")).alias("precision"), F.try_divide(F.col("e.hits"), F.col("_p")).alias("recall"), F.try_divide(F.col("e.hits") / F.col("e.shown"), F.col("_p") / F.col("_n")).alias("lift"))
