"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks.  With weight w, block k (from 0) of
a source may run from slot floor(k / w) on and must have run by slot
ceil((k + 1) / w).  In every slot the released block of earliest deadline runs,
so after any number of slots each source is less than one block away from its
share.  Weights are fractions of a period; the schedule repeats after it, so
only one period is computed, whatever the number of documents, and the slot of
any block follows from its number.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A source catalogue larger than this is not a mixture; it bounds what the driver holds.
MOST_SOURCES = 100_000
#: Rows of a piece of a source, at least; there are some MOST_PIECES pieces at most.
PIECE_ROWS, MOST_PIECES = 1024, 1 << 16


def quotas(weights: dict, period: int) -> dict:
    """Blocks of each source in a period, at least one each, summing up to it (largest remainders)."""
    total = sum(weights.values())
    if not weights or min(weights.values()) <= 0 or period < len(weights):
        raise ValueError("weights must be positive, and the period at least their number")
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    left = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[:left]:
        out[s] += 1
    return out


def schedule(quota: dict) -> list:
    """The source of each slot of one period: earliest deadline first among released blocks."""
    period = sum(quota.values())
    names = sorted(quota, key=str)
    released = [[] for _ in range(period)]
    for rank, s in enumerate(names):
        for k in range(quota[s]):
            released[k * period // quota[s]].append((-(-(k + 1) * period // quota[s]), rank))
    ready, out = [], []
    for slot in range(period):
        for item in released[slot]:
            heapq.heappush(ready, item)
        out.append(names[heapq.heappop(ready)[1]])
    return out


def numbered(docs: DataFrame, source: str, id_col: str, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, dict]:
    """(doc_id, source, number): a row's place within its source in the order of a hash of its id, and the sizes.

    A source is numbered in pieces, which are ranges of the hash with about
    ``piece_rows`` rows (or a ``MOST_PIECES``th of all rows, if that is more), however
    large the source is: counts of the pieces give each its first number.  The
    driver holds a row a source and a row a piece.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"))
    found = rows.groupBy("source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    order = lambda r: (r.source is not None, r.source or "")
    sizes = {r.source: r.n for r in sorted(found, key=order)}
    piece_rows = max(piece_rows, -(-sum(sizes.values()) // MOST_PIECES))
    bits = {s: (-(-n // piece_rows) - 1).bit_length() for s, n in sizes.items()}
    text = T.StructField("s", T.StringType())
    cut = spark.createDataFrame(list(bits.items()), T.StructType([text, T.StructField("bits", T.IntegerType())]))
    rows = rows.join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("key", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("mix")))
    rows = rows.withColumn("piece", F.when(F.col("bits") == 0, 0).otherwise(F.expr("shiftrightunsigned(key, 64 - bits)")).cast("int"))
    counts, first, seen = rows.groupBy("source", "piece").agg(F.count("*").alias("n")).collect(), [], dict.fromkeys(sizes, 0)
    # windows sort signed keys, so the pieces of a source are in order of the unsigned hash and rows within a piece of the signed one
    for r in sorted(counts, key=lambda r: (*order(r), r.piece)):
        first.append((r.source, r.piece, seen[r.source]))
        seen[r.source] += r.n
    starts = spark.createDataFrame(first, T.StructType([text, T.StructField("p", T.IntegerType()), T.StructField("first", T.LongType())]))
    window = Window.partitionBy("source", "piece").orderBy("key", "doc_id")
    rows = rows.withColumn("here", F.row_number().over(window) - 1)
    rows = rows.join(F.broadcast(starts), F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
    return rows.select("doc_id", "source", (F.col("first") + F.col("here")).alias("number")), sizes


def mix_sources(docs: DataFrame, weights: dict | None = None, power: float = 0.7, block_docs: int = 16, period: int = 1000, source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, source, weight, block, release_slot, slot, deadline_slot, place, in_mix.

    The mixture is the order (slot, place).  ``weights`` maps sources to target
    weights (any scale); without it a source of n documents weighs n ** power.  A
    null source is a source; sources without a weight are an error.  All rows are
    kept: once a source has run out its slots stay empty, and in_mix is false from
    the first such slot on, up to which the weights hold.  Rows of one id and
    source take neighbouring numbers.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows, sizes = numbered(docs, source, id_col)
    target = dict(weights) if weights is not None else {s: n**power for s, n in sizes.items()}
    lacking = [s for s in sizes if s not in target]
    if lacking:
        raise ValueError(f"no weight for {lacking[:5]}")
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("k", T.LongType()), T.StructField("at", T.LongType()), T.StructField("quota", T.LongType())])
    quota = quotas(target, max(period, 4 * len(target))) if target else {}
    length, seen, table, at = sum(quota.values()), dict.fromkeys(quota, 0), [], {}
    for slot, s in enumerate(schedule(quota)):
        table.append((s, seen[s], slot, quota[s]))
        at[s, seen[s]] = slot
        seen[s] += 1
    ends = [(b // quota[s]) * length + at[s, b % quota[s]] for s, n in sizes.items() for b in [-(-n // block_docs)]]
    length = max(length, 1)
    rows = rows.withColumn("block", F.floor(F.col("number") / block_docs).cast("long")).withColumn("place", (F.col("number") % block_docs).cast("int"))
    counts = spark.createDataFrame([(s, q) for s, q in quota.items()], T.StructType([schema[0], schema[3]]))
    rows = rows.join(F.broadcast(counts), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    slots = spark.createDataFrame(table, schema).drop("quota")  # one row a slot of the period
    rows = rows.join(F.broadcast(slots), F.col("source").eqNullSafe(F.col("s")) & (F.pmod("block", "quota") == F.col("k")))
    slot = F.floor(F.col("block") / F.col("quota")).cast("long") * length + F.col("at")
    return rows.select(
        "doc_id", "source", (F.col("quota") / F.lit(length)).alias("weight"), "block",
        F.expr(f"block * {length} div quota").alias("release_slot"), slot.alias("slot"),
        F.expr(f"((block + 1) * {length} + quota - 1) div quota").alias("deadline_slot"),
        "place", (slot < min(ends, default=0)).alias("in_mix"),
    )


def in_mixed_order(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, range after range; ids must be distinct to order every row by its own slot."""
    order = mix_sources(docs, id_col=id_col, **options).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("_mixed"))
    mixed = docs.join(order.withColumnRenamed("doc_id", "_mixed_id"), F.col(id_col).cast("long").eqNullSafe(F.col("_mixed_id")))
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mixed.repartitionByRange(ranges, "_mixed").sortWithinPartitions("_mixed").drop("_mixed", "_mixed_id")


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
