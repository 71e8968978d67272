"""Model metrics.  Scores are counted by distinct value first, so windows run over values, not rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.operators.rows import running
from almagest.sources.runtime import materialise


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row a distinct score: rows and positives at or above it, and the totals."""
    at = materialise(df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label)).alias("p")), "curve")
    totals = at.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    return running(at, "score", ["n", "p"], descending=True).join(F.broadcast(totals))


def areas(df: DataFrame, score: str, label: str) -> DataFrame:
    """(pr_auc, roc_auc): average precision, and the chance that a positive outranks a negative (ties half)."""
    c = curve(df, score, label)
    negatives = F.col("all_n") - F.col("all_p")
    below = negatives - (F.col("above_n") - F.col("above_p"))
    pairs = F.col("p") * (below + 0.5 * (F.col("n") - F.col("p")))
    return c.agg(F.sum(F.col("p") * F.col("above_p") / F.col("above_n") / F.col("all_p")).alias("pr_auc"), (F.sum(pairs) / F.max(F.col("all_p") * negatives)).alias("roc_auc"))


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, precision, recall, f1) of the greatest F1; the higher threshold on ties."""
    c = curve(df, score, label)
    f1 = F.round(2 * F.col("above_p") / (F.col("above_n") + F.col("all_p")), 12)
    return c.agg(F.max(F.struct(f1.alias("f1"), "score", (F.col("above_p") / F.col("above_n")).alias("precision"), (F.col("above_p") / F.col("all_p")).alias("recall"))).alias("b")).select(F.col("b.score").alias("threshold"), "b.precision", "b.recall", "b.f1")


def calibration(df: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """(brier, log_loss, ece)."""
    p, y = F.col(probability), F.col(label)
    safe = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    rows = df.select(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("b"), p.alias("p"), y.cast("double").alias("y"), ((p - y) * (p - y)).alias("sq"), F.when(y == 1, -F.log(safe)).otherwise(-F.log(1 - safe)).alias("ll"))
    each = rows.groupBy("b").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum("y").alias("y"), F.sum("sq").alias("sq"), F.sum("ll").alias("ll"))
    n = F.sum("n")
    return each.agg((F.sum("sq") / n).alias("brier"), (F.sum("ll") / n).alias("log_loss"), (F.sum(F.abs(F.col("p") - F.col("y"))) / n).alias("ece"))


def select_features(df: DataFrame, columns: list[str], most_missing: float = 0.4, most_correlated: float = 0.95) -> list[str]:
    """Columns in their order without those mostly missing, constant, or too correlated with one kept before.

    One pass gives all counts, spreads and correlations; only the choice is made here.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"c_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns), *(F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))).alias(f"r_{a}|{b}") for a, b in pairs)).head()
    kept: list[str] = []
    for c in columns:
        if row["n"] and row[f"c_{c}"] >= (1 - most_missing) * row["n"] and (row[f"s_{c}"] or 0) > 0:
            related = [row[f"r_{a}|{c}"] for a in kept]
            if all(r is None or abs(r) <= most_correlated for r in related):
                kept.append(c)
    return kept


def bootstrap(df: DataFrame, family: str, value: str, draws: int = 200, seed: int = 13) -> DataFrame:
    """(mean, low, high): the 95 % interval of a mean over resampled families.

    Each family gets a Poisson(1) weight in each draw from a hash, so draws need no
    shuffle of rows and every run gives the same interval.
    """
    sums = df.groupBy(F.col(family).alias("f")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    cuts, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term
        cuts.append(total)
        term /= k + 1
    u = F.pmod(F.xxhash64("f", "d", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))
    drawn = sums.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = drawn.groupBy("d").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
