"""Joining rows to a per-key table when a few keys may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 10_000
SALTS = 64


def join_by_key(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    size: str,
    spread: Column,
    max_hot: int = MAX_HOT_KEYS,
    stored: bool = False,
) -> DataFrame:
    """Left-join ``rows`` to ``table``, which has one row per key and a ``size`` column.

    ``size`` is how many rows share the key. A key is hot when it owns at least
    ``1/max_hot`` of the summed sizes; the sizes add up to the total, so there
    are never more than ``max_hot`` hot keys and broadcasting them is bounded
    whatever the data size. The rest go through a shuffle join in which no key
    exceeds that share; rows already answered by the broadcast are salted by
    ``spread`` so that they stay spread out. ``stored`` rows are cheap to read twice:
    those the broadcast answers are then not moved at all.
    """
    total = table.agg(F.sum(size)).scalar()
    values = [c for c in table.columns if c not in keys]
    packed = table.select(*keys, F.struct(*values).alias("_value"))
    is_hot = F.col(f"_value.{size}") * max_hot >= total
    hot = packed.where(is_hot).withColumnRenamed("_value", "_hot")
    cold = packed.where(~is_hot).select(*keys, F.lit(0).alias("_salt"), F.col("_value").alias("_cold"))

    own = [c for c in rows.columns if c not in keys]
    if stored:
        answered = rows.join(F.broadcast(hot), list(keys)).withColumnRenamed("_hot", "_value")
        rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
        moved = rest.join(cold.drop("_salt").withColumnRenamed("_cold", "_value"), list(keys), "left")
        both = answered.unionByName(moved)
        return both.select(*keys, *own, *[F.col("_value")[v].alias(v) for v in values])

    known = rows.join(F.broadcast(hot), list(keys), "left")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS)) + 1)
    known = known.withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("int"))
    joined = known.join(cold, [*keys, "_salt"], "left").withColumn("_value", F.coalesce("_hot", "_cold"))
    return joined.select(*keys, *own, *[F.col("_value")[v].alias(v) for v in values])
