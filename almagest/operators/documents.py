"""Scans of evidence, document traces, packets, queues, dossiers and plans."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.operators.corpus import take_within


def registry(concepts: DataFrame, heavy: tuple[str, ...] = ("embedding", "vector")) -> DataFrame:
    """Concepts without their vectors, which are then never read."""
    return concepts.drop(*heavy)


def labels(concepts: DataFrame, merged: str, columns: list[str]) -> DataFrame:
    """The label columns of concepts that were not merged into another."""
    return concepts.where(F.col(merged).isNull()).select(*columns)


def vectors_of(concepts: DataFrame, model: str, kinds: tuple[str, ...]) -> DataFrame:
    """(concept, kind, vector) of active concepts of ``kinds`` with a vector of one model."""
    active = (F.col("status") != "merged") & (F.col("model") == model) & F.col("vector").isNotNull()
    return concepts.where(active & F.col("kind").isin(*kinds)).select("concept", "kind", "vector")


def claims_of(claims: DataFrame, versions: DataFrame | None = None, concepts: DataFrame | None = None) -> DataFrame:
    """Accepted claims, of some versions or touching some concepts if these are given."""
    out = claims.where((F.col("status") == "accepted") & (F.col("verification") == "supported"))
    if versions is not None:
        out = out.join(versions, "version", "left_semi")
    if concepts is not None:
        touched = out.select("claim", F.explode("concepts").alias("concept")).join(concepts, "concept", "left_semi").select("claim")
        out = out.join(touched, "claim", "left_semi")
    return out


def taxonomy_input(concepts: DataFrame, evidence: DataFrame, parents: DataFrame, at) -> DataFrame:
    """(concept, first_seen, documents, parents): concepts known at a date with the days of their documents and the parents known then."""
    t = F.lit(at).cast("date")
    known = evidence.where(F.col("day") <= t).groupBy("concept", "document").agg(F.min("day").alias("day"))
    documents = known.groupBy("concept").agg(F.min("day").alias("first_seen"), F.array_sort(F.collect_list("day")).alias("documents"))
    above = parents.where(F.col("day") <= t).groupBy("concept").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    none = F.array().cast("array<" + dict(parents.dtypes)["parent"] + ">")
    return concepts.join(documents, "concept").join(above, "concept", "left").withColumn("parents", F.coalesce("parents", none))


def related_chunks(chunks: DataFrame, phrase: str, exclude: Column, documents: int, most: int, chars: int, near: DataFrame | None = None) -> DataFrame:
    """Whole chunks that have the phrase, then those in ``near`` (chunk, cosine) by cosine, within bounds of documents, chunks and characters.

    ``chunks`` is (chunk, document, place, text).  A chunk too large for what is left
    of the characters is skipped, not cut.
    """
    literal = F.contains(F.lower("text"), F.lit(phrase.lower()))
    rows = chunks.where(~exclude)
    hits = rows.where(literal).withColumn("score", F.lit(2.0))
    if near is not None:
        hits = hits.unionByName(rows.where(~literal).join(near, "chunk").withColumnRenamed("cosine", "score"))
    head = hits.orderBy(F.desc("score"), "document", "place").limit(most * 20)  # the bounds are small; this one bounds what is sorted in one task
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "document", "place")
    first = F.min("i").over(Window.partitionBy("document"))
    ranked = head.withColumn("i", F.row_number().over(w)).withColumn("first", first)
    ranked = ranked.withColumn("d", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("first"))).where(F.col("d") <= documents)
    fitting = take_within(ranked.withColumn("size", F.length("text").cast("long")).withColumn("all", F.lit(0)), "all", ["i"], "size", chars)
    return fitting.withColumn("rank", F.row_number().over(Window.partitionBy("all").orderBy("i"))).where(F.col("rank") <= most).select("chunk", "document", "score", "rank")


def processed(rows: DataFrame, columns: list[str]) -> Iterator[dict]:
    """Rows one after another, a partition at a time; the driver never holds them all."""
    for row in rows.select(*columns).toLocalIterator(prefetchPartitions=True):
        yield row.asDict()


def traces(versions: DataFrame, at) -> DataFrame:
    """(document, version, day, first_visible, versions): the latest version of each document at a date, and since when it was known."""
    known = versions.where(F.col("day") <= F.lit(at).cast("date"))
    last = F.max(F.struct("day", "version"))
    return known.groupBy("document").agg(last.alias("_l"), F.min("day").alias("first_visible"), F.count("*").alias("versions")).select("document", F.col("_l.version").alias("version"), F.col("_l.day").alias("day"), "first_visible", "versions")


def score_labels(scores: DataFrame, key: list[str], low: float = 0.3, high: float = 0.7) -> DataFrame:
    """(key, label): 1 up to ``low``, 0 from ``high`` on, none between or for what is no technology."""
    label = F.when(~F.col("is_technology"), F.lit(None).cast("int")).when(F.col("score") <= low, 1).when(F.col("score") >= high, 0)
    return scores.select(*key, label.alias("label"))


def packets(chunks: DataFrame, document: str, place: str, section: str, size: str, budget: int) -> DataFrame:
    """Adds ``packet``: chunks of a document in order, a new packet at each change of section and where the budget would be exceeded.

    A chunk larger than the budget is a packet of its own.  Documents stream by in
    sorted order, so a document of any size is never held.
    """
    schema = chunks.withColumn("packet", F.lit(0).cast("long")).schema

    def run(batches):
        now, used, number, last = None, 0, 0, None
        for part in batches:
            out = []
            for d, s, n in zip(part[document], part[section], part[size]):
                if d != now:
                    now, used, number, last = d, 0, 0, s
                elif s != last or used + n > budget:
                    number, used, last = number + 1, 0, s
                used += n
                out.append(number)
            yield part.assign(packet=out)

    return chunks.repartition(document).sortWithinPartitions(document, place).mapInPandas(run, schema)


def pilot_queue(rows: DataFrame, key: str, date: str, limit: int, years: int = 10) -> DataFrame:
    """(key, slice, date, era, turn): the first, middle and last date of ``limit`` keys that are spread over the eras they begin in.

    Keys of an era come in the order of a hash; eras take turns.
    """
    w = Window.partitionBy(key).orderBy(date)
    n = F.count("*").over(Window.partitionBy(key))
    i = F.row_number().over(w)
    marked = rows.select(key, date).distinct().withColumn("_i", i).withColumn("_n", n)
    name = F.when(F.col("_i") == 1, "first").when(F.col("_i") == F.col("_n"), "last").when(F.col("_i") == F.floor((F.col("_n") + 1) / 2), "middle")
    slices = marked.withColumn("slice", name).where("slice is not null")
    era = rows.groupBy(key).agg((F.floor(F.year(F.min(date)) / years) * years).cast("int").alias("era"))
    turn = F.row_number().over(Window.partitionBy("era").orderBy(F.sha2(F.col(key).cast("string"), 256)))
    chosen = era.withColumn("turn", turn).orderBy("turn", "era").limit(limit)
    return slices.join(chosen, key).select(key, "slice", date, "era", "turn")


def dossiers(members: DataFrame, key: str, lists: dict[str, tuple[DataFrame, list[Column], int]]) -> DataFrame:
    """One row a key of ``members`` with, for each list, its first items in order as an array.

    A list is (rows with key and item, order, most).
    """
    out = members.select(key).distinct()
    for name, (rows, order, most) in lists.items():
        ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_i") <= most)
        items = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "item"))), lambda s: s["item"]).alias(name))
        out = out.join(items, key, "left")
    return out


def numbered_cards(cards: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` cards by score and then by key, numbered."""
    order = [F.desc("score"), F.col(key)]
    head = cards.orderBy(*order).limit(top)
    return head.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def normalise_plan(rows: DataFrame, key: Column, id_col: str, name: str, rank: Column) -> DataFrame:
    """(id, target, key, display): rows of one new identity go to the least of greatest ``rank``, whose name shows."""
    keyed = rows.withColumn("_key", key).where("_key is not null and _key <> ''").withColumn("_rank", rank)
    best = keyed.groupBy("_key").agg(F.max(F.struct("_rank", (-F.col(id_col)).alias("m"), F.col(name).alias("name"))).alias("b"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(best, "_key").select(F.col(id_col).alias("id"), (-F.col("b.m")).alias("target"), F.col("_key").alias("key"), F.col("b.name").alias("display"))


def unreferenced(chunks: DataFrame, references: list[DataFrame], key: str) -> DataFrame:
    """Chunks that no reference names."""
    for rows in references:
        chunks = chunks.join(rows.select(key).distinct(), key, "left_anti")
    return chunks


def anchor(text: Column, quote: Column, first_occurrence: bool = False) -> Column:
    """struct<state, start, end> of a literal quote (0-based code points): anchored if it occurs once, or at its first place if asked; missing; ambiguous."""
    place = F.instr(text, quote)
    rest = F.substring(text, place + 1, F.length(text))
    again = (place > 0) & (F.instr(rest, quote) > 0)
    known = F.coalesce(F.length(quote) > 0, F.lit(False)) & F.coalesce(place > 0, F.lit(False))
    state = F.when(~known, "missing").when(again & F.lit(not first_occurrence), "ambiguous").otherwise("anchored")
    start = F.when(state == "anchored", place - 1)
    return F.struct(state.alias("state"), start.alias("start"), (start + F.length(quote)).alias("end"))


def normal_name(name: Column) -> Column:
    """Small letters, punctuation as blanks, blanks squeezed (of names in one Unicode form)."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def winner(reports: DataFrame, metric: str, fallback: str) -> DataFrame:
    """(model): that of the greatest metric, the first by name on ties; ``fallback`` where none has one."""
    best = reports.where(F.col(metric).isNotNull()).agg(F.min(F.struct((-F.col(metric)).alias("m"), "model")).alias("b"))
    return best.select(F.coalesce("b.model", F.lit(fallback)).alias("model"))
