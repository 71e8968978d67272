"""Signal cards, cohorts and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions.expressions import months_before, within


def trend(recent: Column, before: Column, fast: float = 2.0, growth: float = 1.2, stable: float = 0.8, least_fast: int = 3) -> Column:
    """fast, growing, stable or declining, by the add-one ratio of a window to the one before."""
    ratio = (recent + 1) / (before + 1)
    return F.when((ratio >= fast) & (recent >= least_fast), "fast").when(ratio >= growth, "growing").when(ratio >= stable, "stable").otherwise("declining")


def stage_of(events: DataFrame, key: str, ranks: dict[int, str]) -> DataFrame:
    """(key, stage, first_stage): that of the highest rank, and that of the first event; ties go to the earlier and then the smaller one."""
    name = F.create_map(*(F.lit(v) for kv in ranks.items() for v in kv))
    known = events.withColumn("_s", F.try_element_at(name, F.col("rank"))).where("_s is not null")
    top = F.max(F.struct("rank", (-F.unix_date("day")).alias("d"), F.col("_s").alias("s")))
    first = F.min(F.struct("day", "rank", F.col("_s").alias("s")))
    return known.groupBy(key).agg(top.alias("_t"), first.alias("_f")).select(key, F.col("_t.s").alias("stage"), F.col("_f.s").alias("first_stage"))


def cards(documents: DataFrame, events: DataFrame, key: str, at, ranks: dict[int, str], stage_points: dict[str, int], trend_points: dict[str, int], months: int = 12) -> DataFrame:
    """(key, stage, first_stage, trend, score): points of stage and trend; no stage, no points for it.

    ``documents`` is (key, day) of dated documents, ``events`` (key, day, rank) of
    maturity evidence, both known at ``at``.
    """
    t, d = F.lit(at).cast("date"), F.col("day")
    counts = documents.groupBy(key).agg(F.count_if(within(d, months_before(t, months), t)).alias("recent"), F.count_if(within(d, months_before(t, 2 * months), months_before(t, months))).alias("before"))
    rows = counts.withColumn("trend", trend(F.col("recent"), F.col("before"))).join(stage_of(events.where(d <= t), key, ranks), key, "left")
    points = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), F.col(c)), F.lit(0))
    return rows.select(key, "stage", "first_stage", "trend", (points(stage_points, "stage") + points(trend_points, "trend")).cast("long").alias("score"))


def source_list(documents: DataFrame, key: str, limit: int, tier_max: float) -> DataFrame:
    """(key, rank, document, day, reliability): a key's latest documents, undated ones last, with their tier's share."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("day"), "document")
    ranked = documents.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select(key, "rank", "document", "day", (F.col("tier") / tier_max).alias("reliability"))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, mean, deviation, low, median, high) of each column, in one pass over the rows."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)))
    long = df.select(each.alias("e")).select("e.column", "e.value").groupBy("column", "value").agg(F.count("*").alias("c"))  # values first, so a pass over distinct ones
    v, c = F.col("value"), F.col("c")
    n, s = F.sum(F.when(v.isNotNull(), c)), F.sum(v * c)
    moments = long.groupBy("column").agg(n.alias("n"), F.coalesce(F.sum(F.when(v.isNull(), c)), F.lit(0)).alias("missing"), (s / n).alias("mean"), F.sqrt(F.greatest(F.sum(v * v * c) / n - (s / n) * (s / n), F.lit(0.0))).alias("deviation"), F.min(v).alias("low"), F.percentile(v, 0.5, c).alias("median"), F.max(v).alias("high"))
    return moments


def cohorts(days: DataFrame, key: str, cuts: list[str]) -> DataFrame:
    """(key, cohort): the number of cut-off dates at or before a key's day; NULL without a day."""
    return days.select(key, F.when(F.col("day").isNotNull(), sum((F.when(F.col("day") >= F.lit(c).cast("date"), 1).otherwise(0) for c in cuts), F.lit(0))).alias("cohort"))


def split_windows(rows: DataFrame, date: str, tests: list[str], months: int, embargo: int = 0) -> DataFrame:
    """One row a row and window it is in, with window and part: each test date opens a window of ``months``; rows whose horizon ends ``embargo`` months before it train."""
    windows = rows.sparkSession.createDataFrame([(i, t) for i, t in enumerate(tests)], "window int, _t string").withColumn("_t", F.col("_t").cast("date"))
    d, t = F.col(date), F.col("_t")
    joined = rows.join(F.broadcast(windows), d < F.add_months(t, months))
    part = F.when(d >= t, "test").when(F.add_months(d, months + embargo) <= t, "train")
    return joined.withColumn("part", part).where("part is not null").drop("_t")


def clear_stale(scores: DataFrame, keep: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Scores with ``columns`` emptied where the key is not among those to keep."""
    kept = keep.select(key).distinct().withColumn("_keep", F.lit(True))
    rows = scores.join(kept, key, "left")
    return rows.select(*(F.when(F.col("_keep"), F.col(c)).alias(c) if c in columns else F.col(c) for c in scores.columns))


def dated_observations(rows: DataFrame, key: str, date: str, values: list[str]) -> DataFrame:
    """Counters as dated observations: a row a key and day on which a value is not what it was before; the first one stays."""
    w = Window.partitionBy(key).orderBy(date)
    last = rows.groupBy(key, date).agg(*(F.max_by(v, F.struct("seq")).alias(v) for v in values))
    changed = sum((F.when(F.col(v).eqNullSafe(F.lag(v).over(w)), 0).otherwise(1) for v in values), F.lit(0))
    return last.withColumn("_c", changed).withColumn("_i", F.row_number().over(w)).where("_c > 0 or _i = 1").select(key, date, *values)
