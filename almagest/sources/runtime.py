"""Where a job may keep data that outlives one executor.

``spark.checkpoint.dir`` names a folder that the driver and all executors
share.  Lineage is cut by writing a table there; losing an executor then costs
only the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; where none is named, a temporary one in local mode and an error on a cluster, whose hosts don't share one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="almagest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/almagest/{name}-{uuid.uuid4().hex}"


_written: list[str] | None = None


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are materialised inside are deleted at the end, so what is kept must have been written elsewhere by then."""
    global _written
    before, _written = _written, []
    try:
        yield
    finally:
        for path in _written:
            _delete(spark, path)
        _written = before


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _written is not None:
        _written.append(path)
    with _tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of what is run inside go when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Input that is dealt in one turn, and the most turns, each of which reads all of it.
TURN_BYTES, MOST_TURNS = 192 << 20, 8


def input_bytes(df: DataFrame) -> int:
    """Size of the tables that ``df`` reads, by their files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))


def dealt(df: DataFrame, key: str, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder in files by the hash of ``key``, so that what groups by ``key`` and other columns reads it without a shuffle.

    With ``by``, rows of a large input are dealt in turns by the hash of that column, and
    the shuffle files of a turn go before the next begins: no more than a turn's rows
    lie on disk besides the table.  If ``by`` is what ``df`` was joined on, so are those of its joins.
    """
    spark = df.sparkSession
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, name)
    if _written is not None:
        _written.append(path)
    named = f"almagest_{name}_{uuid.uuid4().hex}"
    turns = min(MOST_TURNS, max(1, -(-input_bytes(df) // TURN_BYTES))) if by else 1
    for turn in range(turns):
        mine = df if turns == 1 else df.where(F.pmod(F.hash(by), F.lit(turns)) == turn)
        with _tidy(spark):
            mine.repartition(parts, key).write.mode("append").option("path", path).bucketBy(parts, key).saveAsTable(named)
    return spark.table(named)


@contextmanager
def together(spark: SparkSession):
    """What is run inside joins rows that are dealt by one of the keys of the join as they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def apart(spark: SparkSession):
    """What is run inside keeps the tables of a union in partitions of their own, even if each has but one."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete(df: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, which are counted; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fitting(df: DataFrame, group: str, most: int) -> DataFrame:
    """``df``, whose groups one task can hold: an error if one has more than ``most`` rows."""
    large = df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > most).head()
    if large is not None:
        raise ValueError(f"{group} {large[0]!r} has {large.n} rows, more than the {most} that one task holds")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
