"""Terms, amounts and claims in text, and plans over names and keys."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions.expressions import claim_modality, claim_polarity, parse_number
from almagest.operators.components import connected_components

#: Scale words of amounts (fixed values).
SCALES = {"thousand": 1e3, "k": 1e3, "тыс": 1e3, "million": 1e6, "m": 1e6, "mln": 1e6, "млн": 1e6, "billion": 1e9, "bn": 1e9, "млрд": 1e9}
#: Currency marks (fixed values).
CURRENCIES = {"$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "₽": "RUB", "руб": "RUB", "¥": "JPY"}


def amount(text: Column, scales: dict[str, float] = SCALES) -> Column:
    """"$1,5 mln" -> 1500000; NULL where the number is ambiguous and no scale word follows it."""
    low = F.lower(text)
    digits = F.regexp_extract(low, r"(\d[\d\s .,]*\d|\d)", 1)
    word = F.regexp_extract(low, r"\d[\s ]*(" + "|".join(sorted(map(re.escape, scales), key=len, reverse=True)) + r")\b\.?", 1)
    factor = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in scales.items() for v in kv)), word), F.lit(1.0))
    return parse_number(F.nullif(digits, F.lit(""))).cast("double") * factor


def currency(text: Column, marks: dict[str, str] = CURRENCIES) -> Column:
    low, out = F.lower(text), F.lit(None).cast("string")
    for mark, name in reversed(marks.items()):
        out = F.when(F.contains(low, F.lit(mark)), name).otherwise(out)
    return out


def material_identity(source: Column, source_id: Column, url: Column) -> Column:
    """One id per source and item, else per address without scheme, query and trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://(www\.)?|[?#].*$", ""), "/+$", "")
    return F.when(source_id.isNotNull(), F.concat_ws(":", F.lower(source), F.lower(F.trim(source_id)))).otherwise(F.concat(F.lit("url:"), bare))


def strip_volatile(json: Column, names: tuple[str, ...]) -> Column:
    """A JSON object without top-level fields that change on every read, keys sorted: the base of a content hash."""
    m = F.from_json(json, "map<string,string>")
    kept = F.map_filter(m, lambda k, _: ~k.isin(*names))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def tag_domains(docs: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """Adds ``domains``: those with an alias (alias, domain) that occurs as whole words; the alias table is a small catalogue."""
    table = [(r.alias.lower(), r.domain) for r in aliases.select("alias", "domain").limit(10_001).collect()]
    if len(table) > 10_000:
        raise ValueError("more than 10000 aliases")
    found = [F.when(F.lower(F.col(text)).rlike(r"(?<![\p{L}\p{N}])" + re.escape(a) + r"(?![\p{L}\p{N}])"), F.lit(d)) for a, d in table]
    return docs.withColumn("domains", F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))) if found else F.expr("cast(array() as array<string>)"))


def find_names(docs: DataFrame, key: str, text: str, names: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """(key, concept, start, end): names (name, concept) in a text, longest first, not inside words; one that means several concepts is consumed and not reported.

    Places are those of the text as it is; a letter whose small form is longer than itself stays as it is.
    """
    small = lambda t: t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    rows = names.where("name is not null").select("name", "concept").distinct().limit(bound + 1).toPandas()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} names")
    meaning: dict = {}
    for name, concept in zip(rows.name, rows.concept):
        meaning.setdefault(small(name), set()).add(concept)

    def look(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in meaning:
            automaton.add_word(name, name)
        if meaning:
            automaton.make_automaton()
        for part in batches:
            out = []
            for k, t in zip(part["key"], part["text"]):
                low, hits = small(t or ""), []
                for end, name in automaton.iter(low) if meaning else ():
                    a, b = end + 1 - len(name), end + 1
                    if not (a and low[a - 1].isalnum()) and not (b < len(low) and low[b].isalnum()):
                        hits.append((a - b, a, b, name))
                taken: list = []
                for _, a, b, name in sorted(hits):
                    if all(b <= x or a >= y for x, y in taken):
                        taken.append((a, b))
                        if len(meaning[name]) == 1:
                            out.append((k, next(iter(meaning[name])), a, b))
            yield pd.DataFrame(out, columns=["key", "concept", "start", "end"])

    found = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(look, "key long, concept string, start long, end long")
    return found.withColumnRenamed("key", key)


def generic_term(label: Column, phrases: tuple[str, ...], fillers: tuple[str, ...]) -> Column:
    """A label that consists of generic phrases and filler words alone."""
    rest = F.concat(F.lit(" "), F.lower(label), F.lit(" "))
    for phrase in sorted(phrases, key=len, reverse=True) + sorted(fillers, key=len, reverse=True):
        rest = F.regexp_replace(rest, rf"(?<= ){re.escape(phrase)}(?= )", "")
    return F.trim(rest) == ""


def rule_claims(sentences: DataFrame, names: DataFrame, connectors: dict[str, str], key: str, text: str) -> DataFrame:
    """(key, subject, predicate, object, polarity, modality): sentences with one name, a connector, and one name after it."""
    found = find_names(sentences, key, text, names)
    pair = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "concept"))).alias("n")).where("size(n) = 2")
    rows = sentences.join(pair, key).withColumn("_between", F.lower(F.expr(f"substring({text}, n[0].end + 1, n[1].start - n[0].end)")))
    predicate = F.lit(None).cast("string")
    for pattern, name in reversed(connectors.items()):
        predicate = F.when(F.col("_between").rlike(pattern), name).otherwise(predicate)
    out = rows.withColumn("predicate", predicate).where("predicate is not null")
    return out.select(key, F.expr("n[0].concept").alias("subject"), "predicate", F.expr("n[1].concept").alias("object"), claim_polarity(F.col(text)).alias("polarity"), claim_modality(F.col(text)).alias("modality"))


def plan_works(keys: DataFrame, titles: DataFrame) -> DataFrame:
    """(document, work): documents with a strong key in common are one work; then a unique, compatible title joins the rest.

    ``keys`` is (document, key); ``titles`` (document, title, kind).  A title that
    several works have, or works of different kinds, joins nothing.
    """
    node = F.concat(F.lit("k:"), "key")
    docs = titles.select("document").distinct()
    strong = connected_components(keys.select(F.concat(F.lit("d:"), F.col("document").cast("string")).alias("a"), node.alias("b")), "a", "b")
    own = docs.join(strong.select(F.expr("substring(node, 3)").alias("_d"), "component"), F.col("document").cast("string") == F.col("_d"), "left")
    own = own.select("document", F.coalesce("component", F.concat(F.lit("d:"), F.col("document").cast("string"))).alias("work"))
    named = titles.join(own, "document")
    unique = named.groupBy("title").agg(F.count_distinct("work").alias("w"), F.count_distinct("kind").alias("kinds"), F.count("*").alias("n"), F.min("work").alias("least"), F.max("work").alias("most")).where("w = 2 and kinds = 1")
    merged = connected_components(unique.select("least", "most"), "least", "most")
    out = named.select("document", "work").distinct().join(merged.select(F.col("node").alias("work"), "component"), "work", "left")
    out = out.select("document", F.coalesce("component", "work").alias("_w"))
    return out.withColumn("work", F.min("document").over(Window.partitionBy("_w"))).select("document", "work")


def plan_keys(concepts: DataFrame, order: list[Column]) -> DataFrame:
    """(concept, target): of the concepts of one (family, key), the first in ``order`` takes the others."""
    w = Window.partitionBy("family", "key").orderBy(*order)
    return concepts.select("concept", F.first("concept").over(w).alias("target")).where("concept <> target")


def review_plan(pairs: DataFrame, merge_at: float = 0.95) -> DataFrame:
    """Adds ``plan``: merge aliases, review pairs of disjoint domains, then by score."""
    disjoint = (F.size("left_domains") > 0) & (F.size("right_domains") > 0) & (F.size(F.array_intersect("left_domains", "right_domains")) == 0)
    return pairs.withColumn("plan", F.when(F.col("alias"), "merge").when(disjoint, "review").when(F.col("cosine") >= merge_at, "merge").otherwise("review"))


def follow_merges(rows: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """Re-point a column through (old, new) merges, however many in a row."""
    names = connected_components(merged, "old", "new")
    final = merged.join(merged.select(F.col("old").alias("new")), "new", "left_anti").select(F.col("new").alias("_end")).distinct()
    ends = final.join(names, F.col("_end") == F.col("node")).select("component", "_end")
    target = names.join(ends, "component").select(F.col("node").alias(column), "_end")
    return rows.join(target, column, "left").withColumn(column, F.coalesce("_end", column)).drop("_end")


def branch_growth(paths: DataFrame, documents: DataFrame, snapshot: str, months: int = 12) -> DataFrame:
    """(node, documents, new_share): documents under each taxonomy node, each by its earliest day, and the share of last year's.

    ``paths`` is (id, path) with dots; ``documents`` (id, document, day).
    """
    parts = F.split("path", r"\.")
    nodes = paths.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("node"))
    first = nodes.join(documents, "id").groupBy("node", "document").agg(F.min("day").alias("day"))
    at = F.lit(snapshot).cast("date")
    known = first.where(F.col("day") <= at)
    return known.groupBy("node").agg(F.count("*").alias("documents"), F.avg((F.col("day") > F.add_months(at, -months)).cast("double")).alias("new_share"))


def node_labels(members: DataFrame, top: int = 3) -> DataFrame:
    """(node, label): names of the members of greatest (1 + ln(1 + documents)) * cosine."""
    weight = (1 + F.log1p("documents")) * F.col("cosine")
    ranked = members.withColumn("_w", weight).withColumn("_k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("_w"), "name"))).where(F.col("_k") <= top)
    return ranked.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "name"))), lambda s: s["name"]), ", ").alias("label"))
