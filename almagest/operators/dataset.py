"""Labelled datasets: neighbours, splits, checks, calibration, stacking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions.expressions import sigmoid


def neighbour_features(edges: DataFrame, rows: DataFrame, key: str, date: str, columns: list[str]) -> DataFrame:
    """Mean and greatest of the neighbours' own values at the same date, their number, and the share with a positive first column."""
    other = rows.select(F.col(key).alias("dst"), date, *columns)
    near = edges.select("src", "dst").join(other, "dst")
    aggs = [f(c).alias(f"nb_{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("max", F.max))]
    return near.groupBy(F.col("src").alias(key), date).agg(F.count("*").alias("nb_count"), F.avg((F.col(columns[0]) > 0).cast("double")).alias("nb_growing_share"), *aggs)


def family_split(rows: DataFrame, family: str, date: str, label: str, valid: float = 0.8, test: float = 0.9, embargo_months: int = 0) -> DataFrame:
    """Families go to a part by the date they were first seen; rows of earlier parts within the embargo of a cut are purged.

    Cuts are the dates at the given shares of positive families, by rank.
    """
    first = rows.groupBy(family).agg(F.min(date).alias("_first"), F.max(label).alias("_positive"))
    # families are counted by date first, so the window runs over dates
    days = first.where("_positive = 1").groupBy("_first").agg(F.count("*").alias("_c"))
    upto = days.withColumn("_upto", F.sum("_c").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, 0)))
    n = days.agg(F.sum("_c").alias("_n"))
    cuts = upto.join(n).agg(*(F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * s), F.col("_first"))).alias(c) for c, s in (("_valid", valid), ("_test", test))))
    r = rows.join(first.select(family, "_first"), family).join(F.broadcast(cuts))
    d, f = F.col(date), F.col("_first")
    part = F.when(f >= F.col("_test"), "test").when(f >= F.col("_valid"), "valid").otherwise("train")
    late = F.when(part == "train", F.add_months(d, embargo_months) > F.col("_valid")).when(part == "valid", F.add_months(d, embargo_months) > F.col("_test")).otherwise(False)
    return r.select(*rows.columns, F.when(late, "purged").otherwise(part).alias("split"))


def check_trainable(rows: DataFrame, family: str, label: str, least: int = 1) -> list[str]:
    """What forbids training: a family in two parts, or a part with too few families of a class."""
    used = rows.where("split <> 'purged'")
    out = [f"family {r[0]} is in several parts" for r in used.groupBy(family).agg(F.count_distinct("split").alias("n")).where("n > 1").orderBy(family).limit(10).collect()]
    counts = {(r.split, r[1]): r.n for r in used.groupBy("split", label).agg(F.count_distinct(family).alias("n")).collect()}
    return out + [f"{s} has {counts.get((s, y), 0)} families of class {y}" for s in ("train", "valid", "test") for y in (0, 1) if counts.get((s, y), 0) < least]


def guard_names(columns: list[str]) -> None:
    """Features must not carry what comes after the snapshot."""
    bad = [c for c in columns if c.startswith(("future_", "label_", "first_commercial")) or c == "split"]
    if bad:
        raise ValueError(f"columns from the future: {bad}")


def temperature(df: DataFrame, logit: str, label: str, steps: int = 201) -> float:
    """The temperature of least log loss on a fixed grid, in one pass over the rows."""
    grid = [10 ** (-1 + 2 * i / (steps - 1)) for i in range(steps)]

    def loss(t: float):
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), sigmoid(F.col(logit) / t)))
        return F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p)))

    row = df.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(grid))).head()
    return min((v if v is not None else float("inf"), t) for v, t in zip(row, grid))[1]


def stacked(parts: list[DataFrame], key: str, score: str) -> DataFrame:
    """Mean logit of several models' scores for rows that all have."""
    out = parts[0].select(key, F.col(score).alias("_s0"))
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.select(key, F.col(score).alias(f"_s{i}")), key)
    logit = [F.log(F.col(f"_s{i}") / (1 - F.col(f"_s{i}"))) for i in range(len(parts))]
    return out.select(key, sigmoid(sum(logit, F.lit(0.0)) / len(parts)).alias(score))


def shuffled(df: DataFrame, label: str, key: str, seed: int = 13, buckets: int = 64) -> DataFrame:
    """The same labels in another order: the control of an experiment.  Labels change places within hash buckets, so no task sees all rows."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit("bucket")), F.lit(buckets))
    order = lambda c: Window.partitionBy("_b").orderBy(c, key)
    dealt = df.withColumn("_b", bucket)
    rows = dealt.withColumn("_i", F.row_number().over(order(F.col(key))))
    labels = dealt.select("_b", F.col(label).alias("_l"), F.row_number().over(order(F.xxhash64(F.col(key), F.lit(seed)))).alias("_i"))
    return rows.join(labels, ["_b", "_i"]).withColumn(label, F.col("_l")).drop("_b", "_i", "_l")


def boosted_trees(train: DataFrame, columns: list[str], label: str, rounds: int = 40, depth: int = 5, seed: int = 13):
    """MLlib gradient boosting over a feature list; missing values are passed as NaN's stand-in, -1e30."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    guard_names(columns)
    filled = train.select(label, *(F.coalesce(F.col(c).cast("double"), F.lit(-1e30)).alias(c) for c in columns))
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)]).fit(filled)
