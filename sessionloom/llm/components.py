"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.packing import written

BROADCAST_NODES = 1_000_000
TASK_ROWS = 50_000


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of nodes of ``edges(a, b)`` with ``b < a``, and of those that are not yet in a star around its smallest node."""
    ends = edges.select(F.col("a").alias("node"), "b").unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("b")))
    nodes = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count_if(F.col("b").isNull()).alias("under"))
    row = nodes.agg(F.count("*").alias("n"), F.count_if(F.expr("low < high or low is not null and under > 0")).alias("open")).first()
    return row["n"], row["open"]


def sized(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, known to be at most ``most``, in no more tasks and files than these need."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, most // TASK_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges(a, b)``.

    Alternating large and small stars: every node's neighbours are joined to its
    smallest one, until the edges are the stars of the components. A node's
    neighbours are only aggregated to a minimum and joined back to it, so a node
    with very many neighbours is never one group. The minima are broadcast while
    there are at most ``BROADCAST_NODES`` nodes, so that edges are shuffled only
    to take out equal ones.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nodes, apart = _state(edges)
    few = F.broadcast if nodes <= BROADCAST_NODES else lambda rows: rows
    while apart:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(few(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(few(least), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        edges = written(sized(small.where("a <> b").distinct(), 2 * nodes), "edges")
        apart = _state(edges)[1]
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return sized(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct(), nodes)
