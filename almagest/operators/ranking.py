"""Ranked candidates of a snapshot, query scope and the search response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions.expressions import sigmoid, word_match
from almagest.operators.rows import first_reason
from almagest.operators.search import bm25
from almagest.sources.runtime import materialise, small


def words(text: Column) -> Column:
    """Words in small letters, ё as е."""
    return F.regexp_extract_all(F.translate(F.lower(text), "ё", "е"), F.lit(r"(?U)\w+"), F.lit(0))


def independent_sources(facts: DataFrame, key: str, source: str, date: str, since) -> DataFrame:
    """(key, sources): distinct sources of each key's facts after ``since``."""
    return facts.where(F.col(date) > since).select(key, source).distinct().groupBy(key).agg(F.count(source).alias("sources"))


def rank_snapshot(rows: DataFrame, key: str, rules: list[tuple[str, Column]], weights: dict[str, float], clip: float = 3.0, top: int = 3) -> DataFrame:
    """(key, category, raw_score, score, contributions, top_features): candidates that no rule rejects, scored by weighted z-scores among themselves.

    ``rules`` are (category, test) in order; a rejected row has its category and no
    score.  A missing value or a constant column contributes 0.  ``top_features``
    names the greatest contributions by size, then by name.
    """
    judged = materialise(rows.withColumn("category", first_reason(rules, "candidate")), "judged")
    candidate = F.col("category") == "candidate"
    stats = judged.where(candidate).agg(*(f(c).alias(f"_{n}_{c}") for c in weights for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in weights}
    parts = {c: F.round(w * F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), z[c])), F.lit(0.0)), 6) for c, w in weights.items()}
    scored = judged.join(F.broadcast(stats)).withColumn("contributions", F.when(candidate, F.struct(*(p.alias(c) for c, p in parts.items()))))
    part = lambda c: F.col(f"contributions.{c}")
    raw = F.round(sum((part(c) for c in weights), F.lit(0.0)), 6)
    order = F.array_sort(F.array(*(F.struct((-F.abs(part(c))).alias("size"), F.lit(c).alias("name")) for c in weights)))
    names = F.array_join(F.transform(F.slice(order, 1, top), lambda s: s["name"]), ",")
    return scored.select(key, "category", raw.alias("raw_score"), F.when(raw.isNotNull(), sigmoid(raw)).alias("score"), "contributions", F.when(candidate, names).alias("top_features"))


def with_descendants(names: DataFrame, catalogue: DataFrame, most_levels: int = 16) -> DataFrame:
    """(query, domain): the given ones and all domains below them; ``catalogue`` is (domain, parent) and small."""
    children = small(catalogue.where("parent is not null").select(F.col("domain").alias("child"), "parent").distinct())
    found = level = names.select("query", "domain").distinct()
    for _ in range(most_levels):
        level = level.join(children, F.col("domain") == F.col("parent")).select("query", F.col("child").alias("domain")).distinct()
        level = materialise(level.join(found, ["query", "domain"], "left_anti"), "level")
        if level.isEmpty():
            return found
        found = found.union(level)
    raise ValueError(f"domains more than {most_levels} deep")


def match_domains(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(query, domain): domains with a phrase all of whose words the query has, up to an inflected ending, and the domains below.

    ``queries`` is (query, text); ``catalogue`` (domain, phrase, parent) has a row a phrase and is small.
    """
    named = queries.select("query", words(F.col("text")).alias("_q"))
    phrases = small(catalogue.select("domain", words(F.col("phrase")).alias("_p")).where(F.size("_p") > 0))
    fits = F.forall("_p", lambda w: F.exists("_q", lambda q: word_match(q, w)))
    return with_descendants(named.join(phrases, fits).select("query", "domain"), catalogue)


def scope(queries: DataFrame, technologies: DataFrame, domains: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(query, scope, technology): by a named domain, else by a word of four letters or more that the label has, else all.

    ``technologies`` is (technology, label), ``domains`` (technology, domain).  All
    is one row without a technology, not a row for each.
    """
    by_domain = match_domains(queries, catalogue).join(domains, "domain").select("query", F.lit("domain").alias("scope"), "technology").distinct()
    named = match_domains(queries, catalogue).select("query").distinct()
    rest = queries.join(named, "query", "left_anti")
    # words that match share their first four letters, so these are the key
    asked = rest.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("q")).where(F.length("q") >= 4).withColumn("head", F.left("q", F.lit(4)))
    parts = technologies.select("technology", F.explode(F.array_distinct(words(F.col("label")))).alias("w")).withColumn("head", F.left("w", F.lit(4)))
    by_label = asked.join(parts, "head").where(word_match(F.col("q"), F.col("w"))).select("query", F.lit("label").alias("scope"), "technology").distinct()
    others = rest.join(by_label.select("query").distinct(), "query", "left_anti").select("query", F.lit("all").alias("scope"), F.lit(None).cast(dict(technologies.dtypes)["technology"]).alias("technology"))
    return by_domain.unionByName(by_label).unionByName(others)


def relevance(candidates: DataFrame, queries: DataFrame, cosines: DataFrame, settings: dict, repeat: int = 3) -> DataFrame:
    """(query, technology, bm25_score, semantic_similarity, relevance_score, search_score): matches of each query.

    ``candidates`` is (technology, label, domains, score), the label counting
    ``repeat`` times against the domains' text; ``queries`` (query, term);
    ``cosines`` (query, technology, cosine) of those that have a vector, candidates
    beyond the least cosine first.  A technology matches by a word or by cosine.
    """
    text = F.concat_ws(" ", *[F.col("label")] * repeat, F.coalesce("domains", F.lit("")))
    lexical = bm25(candidates.withColumn("_text", text), "technology", "_text", queries).withColumnRenamed("doc", "technology").withColumnRenamed("score", "bm25_score")
    top = lexical.groupBy("query").agg(F.max("bm25_score").alias("_top"))
    both = lexical.join(cosines, ["query", "technology"], "full").join(top, "query", "left")
    words_, cosine = F.coalesce("bm25_score", F.lit(0.0)), F.col("cosine")
    both = both.where((words_ > 0) | (cosine >= settings["min_cosine"]))
    have = F.when(cosine.isNotNull(), settings["cosine_weight"]).otherwise(0.0) + F.when(words_ > 0, settings["bm25_weight"]).otherwise(0.0)
    mixed = settings["cosine_weight"] * F.greatest(F.coalesce(cosine, F.lit(0.0)), F.lit(0.0)) + settings["bm25_weight"] * F.coalesce(F.try_divide(words_, F.col("_top")), F.lit(0.0))
    scored = both.join(candidates.select("technology", "score"), "technology").withColumn("relevance_score", mixed / have)
    final = settings["relevance_weight"] * F.col("relevance_score") + settings["signal_weight"] * F.col("score")
    return scored.select("query", "technology", words_.alias("bm25_score"), cosine.alias("semantic_similarity"), "relevance_score", final.alias("search_score"))


def search_response(matches: DataFrame, flags: DataFrame, top_k: int, most_flagged: int) -> DataFrame:
    """The first ``top_k`` matches of each query, and after them those that are flagged, ``most_flagged`` at most; ``rank`` is that among all matches."""
    order = Window.partitionBy("query").orderBy(F.desc("search_score"), F.desc("relevance_score"), "technology")
    ranked = matches.join(flags, "technology", "left").withColumn("rank", F.row_number().over(order)).withColumn("flag", F.coalesce("flag", F.lit(False)))
    tail = (F.col("rank") > top_k) & F.col("flag")
    so_far = F.sum(tail.cast("int")).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_f", so_far).where((F.col("rank") <= top_k) | (tail & (F.col("_f") <= most_flagged))).drop("_f")
