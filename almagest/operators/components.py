"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.sources.runtime import delete, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return row[0], row[1]


#: A node with more neighbours than this (and than a ten-thousandth of all edges) gets its least one by broadcast, so that its edges stay spread.
SPREAD = 100


def _star(directed: DataFrame, edges: int, large: bool) -> DataFrame:
    """Ties each node's neighbours to its least one: those above the node if ``large``, else those below and the node."""
    least = directed.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    most = max(SPREAD, edges // 10_000)
    if edges <= most:
        tied = directed.join(least, "u")
    else:
        hubs = F.broadcast(least.where(F.col("n") > most).select("u", "m"))  # at most 20,000 rows
        tied = directed.join(hubs, "u").unionByName(directed.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= most), "u").select("u", "v", "m"))
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each node of a non-loop edge, itself included.

    Edges count in both directions; nulls and loops are left out.  Each round is
    two aggregations and equi-joins over the edges and is written to the shared
    folder, so lineage stays short; the number of rounds grows with the
    logarithm of the longest path.  No node's neighbours are gathered in a row
    or, beyond a bound, in a task.
    """
    edges = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v")
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        middle = materialise(_star(both, state[0], large=True), "edges")
        after = materialise(_star(middle, state[0], large=False), "edges")
        now = _state(after)
        delete(edges)
        delete(middle)
        edges, done, state = after, now == state, now
        if done:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
