"""Order-dependent columns (row number, previous row, running sum) without hot tasks.

``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one task, so
a key that holds a third of the data stalls the job, and a window with no key
is one task outright. Here rows are range-partitioned on the *whole* order,
which ends in a unique column, so even a single key or instant spreads over
many tasks. Per-block work uses ordinary windows over blocks of bounded size,
and blocks are stitched together through a summary of at most two rows per
block. That summary grows with the number of shuffle partitions, not with the
data, so broadcasting it is safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.session import cut_lineage

BLOCK, PLACE = "_block", "_place"


def place(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition by ``order`` and stamp each row with its block and place.

    ``order`` must end in something unique per row. The result is written to the
    checkpoint folder because the stamps depend on sampled range bounds.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if partitions <= 2 * spark.sparkContext.defaultParallelism:
        # Few partitions for the cores there are: keep them all busy.
        ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    else:
        ranged = df.orderBy(*order)  # adaptive execution may merge small ranges
    stamped = ranged.withColumn(PLACE, F.monotonically_increasing_id())
    stamped = stamped.withColumn(BLOCK, F.shiftright(PLACE, 33))
    return cut_lineage(stamped)


def _in_block() -> Window:
    return Window.partitionBy(BLOCK).orderBy(PLACE)


def row_number(placed: DataFrame, name: str = "row_num") -> DataFrame:
    """1-based position in the total order."""
    counts = placed.groupBy(BLOCK).agg(F.count("*").alias("_rows"), F.min(PLACE).alias("_first"))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        BLOCK, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_skip")
    )
    numbered = placed.join(F.broadcast(starts), BLOCK)
    return numbered.withColumn(name, F.col(PLACE) - F.col("_first") + F.col("_skip") + 1).drop(
        "_first", "_skip"
    )


def previous(
    placed: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), prefix: str = "prev_"
) -> DataFrame:
    """Add the preceding row's ``columns`` (NULL at the start of each key)."""
    kept = list(dict.fromkeys([*keys, *columns]))
    row = F.struct(*kept)
    tails = placed.groupBy(BLOCK).agg(F.max_by(row, PLACE).alias("_last"))
    tails = tails.select(
        BLOCK, F.lag("_last").over(Window.orderBy(BLOCK)).alias("_tail")
    ).where(F.col("_tail").isNotNull())
    joined = placed.withColumn("_lag", F.lag(row).over(_in_block())).join(
        F.broadcast(tails), BLOCK, "left"
    )
    source = F.coalesce("_lag", "_tail")
    same = F.lit(True)
    for key in keys:
        same = same & source[key].eqNullSafe(F.col(key))
    joined = joined.withColumn("_source", F.when(same, source))
    for column in columns:
        joined = joined.withColumn(prefix + column, F.col("_source")[column])
    return joined.drop("_lag", "_tail", "_source")


def running_sums(
    placed: DataFrame, sums: Mapping[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Add inclusive running sums in order, restarting at each key.

    ``keys`` must be the leading columns of the order given to ``place``.
    """
    values = {name: f"_value_{i}" for i, name in enumerate(sums)}
    valued = placed
    for name, expression in sums.items():
        valued = valued.withColumn(values[name], expression)
    key = F.struct(*keys) if keys else F.lit(1)
    valued = valued.withColumn("_key", key)

    # Only a block's first and last key can continue into a neighbour.
    edges = valued.groupBy(BLOCK).agg(
        F.array_distinct(F.array(F.min_by("_key", PLACE), F.max_by("_key", PLACE))).alias("_edge")
    )
    edge_keys = edges.select(BLOCK, F.explode("_edge").alias("_key"))
    partial = (
        valued.join(F.broadcast(edge_keys), [BLOCK, "_key"], "left_semi")
        .groupBy(BLOCK, "_key")
        .agg(*[F.sum(value).alias(value) for value in values.values()])
    )
    before = Window.partitionBy("_key").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = partial.select(
        BLOCK, "_key", *[F.sum(v).over(before).alias(f"{v}_carry") for v in values.values()]
    )
    so_far = (
        Window.partitionBy(BLOCK, "_key")
        .orderBy(PLACE)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = valued
    for value in values.values():
        out = out.withColumn(f"{value}_here", F.sum(value).over(so_far))
    out = out.join(F.broadcast(carry), [BLOCK, "_key"], "left")
    for name, value in values.items():
        out = out.withColumn(
            name, F.col(f"{value}_here") + F.coalesce(F.col(f"{value}_carry"), F.lit(0))
        )
    helper = [c for v in values.values() for c in (v, f"{v}_here", f"{v}_carry")]
    return out.drop("_key", *helper)
