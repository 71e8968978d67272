"""The driver's tables in the roles of dated evidence.

A part is a technology, an order a document dated by its order date, a line item
a mention of the part in it; suppliers are organizations in nations, the order
priority is the source family, the return flag the document type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.sources.runtime import table

SNAPSHOTS = ("1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01")


def snapshots(spark: SparkSession, dates=SNAPSHOTS) -> DataFrame:
    """One row (snapshot) per date: crossed with the facts once, never looped over."""
    return spark.createDataFrame([(d,) for d in dates], "d string").select(F.col("d").cast("date").alias("snapshot"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, dated by its order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("observed"), "o_orderstatus", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_partkey").alias("technology"), F.col("l_orderkey").alias("document"), "observed",
        F.col("l_suppkey").alias("organization"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("family"),
        F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("stage"),
        (1 - F.col("l_discount")).alias("confidence"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("quantity"),
        F.col("l_shipdate").cast("date").alias("recorded"),
    )


def visible(facts: DataFrame, grid: DataFrame, date: str = "observed") -> DataFrame:
    """Facts known at each snapshot: a broadcast of the few dates, not a scan per date."""
    return facts.join(F.broadcast(grid), F.col(date) <= F.col("snapshot"))
