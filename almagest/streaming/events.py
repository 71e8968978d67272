"""Structured Streaming forms of the windowed operators, and incremental batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.sources.runtime import new_path


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream over the files of a folder that match ``name``; ``ts`` becomes a time stamp in the session's zone."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything available now, as a table in the shared folder; a batch that runs again writes over its own rows."""
    spark, folder = stream.sparkSession, new_path(stream.sparkSession, "stream-result")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder if mode == "complete" else f"{folder}/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(step).trigger(availableNow=True)
    writer.option("checkpointLocation", new_path(spark, "stream")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder if mode == "complete" else f"{folder}/batch=*")


def late(events: DataFrame, allowed: str, arrived: str = "arrived") -> tuple[DataFrame, DataFrame]:
    """Rows that came in time, and rows dropped as they came more than ``allowed`` after the newest time stamp that had come before them.

    The batch form of a watermark: rows in the order of arrival, each against the
    greatest ``ts`` so far, for replays and tests; it is a global order.
    """
    from almagest.operators.rows import running_max

    seen = running_max(events, arrived, "ts")
    dropped = F.coalesce(F.col("ts") < F.col("above_ts") - F.expr(f"interval {allowed}"), F.lit(False))
    return seen.where(~dropped).drop("above_ts"), seen.where(dropped).drop("above_ts")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def each_batch(stream: DataFrame, ledger: str, key: str, apply: Callable[[DataFrame], DataFrame], sink: str) -> None:
    """Apply a function to rows whose key the ledger lacks and append the result; then note the keys.

    Results and keys of a batch lie in folders named by its number and are written
    over when it runs again, so a retried batch counts once.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key])
        if exists(spark, ledger):
            known = spark.read.parquet(f"{ledger}/*").where(F.col("_batch") != number)
            new = new.join(known.select(key), key, "left_anti")
        new = new.persist()
        try:
            apply(new).write.mode("overwrite").parquet(f"{sink}/batch={number}")
            new.select(key, F.lit(number).alias("_batch")).write.mode("overwrite").parquet(f"{ledger}/{number}")
        finally:
            new.unpersist()

    query = stream.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", f"{ledger}-checkpoint").start()
    query.awaitTermination()
