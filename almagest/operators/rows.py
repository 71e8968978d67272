"""Row-level operators: as-of joins, latest and top rows, gates, upserts, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.sources.runtime import materialise


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of greatest ``order`` for each key; the order must have no ties.  An aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in df.columns if c not in keys))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, date: str, values: list[str]) -> DataFrame:
    """For each left row the right values of the last ``date`` up to ``at``; NULL where there is none.

    Both sides are merged into one ordered stream a key, so neither is replicated;
    values of one date must be unique a key.
    """
    l = left.withColumn("_when", F.col(at)).withColumn("_side", F.lit(1))
    r = right.select(*keys, F.col(date).alias("_when"), F.struct(F.col(date).alias("as_of_date"), *values).alias("_value")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_when", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_value", F.last("_value", ignorenulls=True).over(order)).where("_side = 1")
    return filled.select(*left.columns, F.col("_value.as_of_date").alias("as_of_date"), *(F.col(f"_value.{v}").alias(v) for v in values))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, numbered from 1."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "accepted") -> Column:
    """The name of the first rule that holds; a rule on missing data does not hold."""
    out = F.when(F.lit(False), F.lit(""))
    for name, test in rules:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out.otherwise(otherwise)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, Column]) -> DataFrame:
    """Full outer merge; ``merge`` gives each column from ``o.`` and ``n.``, other columns prefer the new row."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), keys, "full")
    return joined.select(*keys, *(merge.get(c, F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).alias(c) for c in rest))


def replace_versions(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """Rows of a version that ``new`` brings replace the old ones of that version only."""
    return old.join(new.select(version).distinct(), version, "left_anti").unionByName(new)


def running(df: DataFrame, order: str, sums: list[str], descending: bool = False, parts: int = 256) -> DataFrame:
    """Adds ``above_x`` for each column of ``sums``: its sum over all rows up to this one in ``order``, which must be distinct.

    Rows are cut at quantiles of ``order``; sums run within a part, and the totals
    of the parts before, one row a part, are added.
    """
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 40 * parts)).head()[0]
    cuts = F.array(*map(F.lit, sorted(set(cuts or []))))
    dealt = df.withColumn("_part", F.size(F.filter(cuts, lambda c: c <= F.col(order))) if cuts is not None else F.lit(0))
    direction = F.desc if descending else F.asc
    within = Window.partitionBy("_part").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    before = Window.orderBy(direction("_part")).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums))
    rows = dealt.join(F.broadcast(starts), "_part")
    return rows.select(*df.columns, *((F.sum(c).over(within) + F.col(f"_{c}")).alias(f"above_{c}") for c in sums))


def running_max(df: DataFrame, order: str, value: str, parts: int = 256) -> DataFrame:
    """Adds ``above_value``: the greatest ``value`` of all rows before this one in ``order``, which must be distinct; NULL for the first.

    Rows are cut at quantiles of ``order``, as in ``running``.
    """
    number = F.unix_micros(F.col(order).cast("timestamp")) if dict(df.dtypes)[order].startswith(("timestamp", "date")) else F.col(order).cast("long")
    cuts = df.agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], 40 * parts)).head()[0]
    line = F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts or []))))
    dealt = df.withColumn("_part", F.size(F.filter(line, lambda c: c <= number)))
    tops = dealt.groupBy("_part").agg(F.max(value).alias("_top"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = tops.select("_part", F.max("_top").over(before).alias("_before"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(F.broadcast(starts), "_part")
    return rows.select(*df.columns, F.greatest(F.max(value).over(within), F.col("_before")).alias(f"above_{value}"))


def evenly(df: DataFrame, order: list[str], limit: int, phase: float = 0.0) -> DataFrame:
    """``limit`` rows evenly spaced in ``order``.

    Rows are sorted in ranges, each of which is numbered by itself from the number
    of rows in the ranges before.
    """
    n = df.count()
    if n <= limit:
        return df
    ranges = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n))
    dealt = materialise(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts, starts, at = dealt.groupBy("_range").agg(F.count("*").alias("n")).collect(), [], 0  # one row a range
    for r in sorted(counts, key=lambda r: r["_range"]):
        starts.append((r["_range"], at))
        at += r.n
    numbered = dealt.join(F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _start long")), "_range")
    numbered = numbered.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_start"))
    step = n / limit
    place = F.floor((F.col("_i") + 1 - phase) / step) != F.floor((F.col("_i") - phase) / step)
    return numbered.where(place).select(*df.columns)


def round_robin(df: DataFrame, era: Column, order: list[Column], limit: int) -> DataFrame:
    """One row of each era in turn until ``limit``."""
    ranked = df.withColumn("era", era).withColumn("turn", F.row_number().over(Window.partitionBy("era").orderBy(*order)))
    return ranked.orderBy("turn", "era").limit(limit)


def without_ancestors(df: DataFrame, key: str, node: str, parents: DataFrame) -> DataFrame:
    """Drops a node where its child (``parents``: child, parent) is present under the same key."""
    covered = df.join(parents, F.col(node) == F.col("child")).select(F.col(key).alias("_k"), F.col("parent").alias("_p")).distinct()
    return df.join(covered, (F.col(key) == F.col("_k")) & (F.col(node) == F.col("_p")), "left_anti")
