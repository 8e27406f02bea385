"""Merging and sanitising the eight kinds of finding.

Every merge is an algebraic aggregate (sum, max, min_by), so Spark combines
map-side and a key repeated across a third of the batches costs one row per
task in the shuffle. ``ord`` is the arrival order (batch, then position); the
first-seen example, context or suggestion is the one with the smallest ``ord``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scores import finite_clamp

MAX_MINUTES = 525_600.0
MAX_FREQUENCY = 1_000_000

# Per kind: merge key, summed, maximised and first-seen columns.
MERGES = {
    "model_failures": (["model", "issue"], ["frequency"], [], ["example"]),
    "harness_friction": (["harness", "issue"], [], ["severity"], []),
    "missing_tooling": (["tool_name", "purpose"], [], ["estimated_value"], []),
    "workflow_bottlenecks": (["description"], ["frequency"], ["time_impact_minutes"], []),
    "repeated_commands": (["command"], ["frequency"], [], ["context"]),
    "repeated_prompts": (["prompt_pattern"], ["frequency"], [], ["suggested_improvement"]),
    "automation_opportunities": (["description"], [], ["estimated_time_saved", "confidence"], []),
}

UNIT_RANGE = ("severity", "estimated_value", "confidence")
MINUTES = ("time_impact_minutes", "estimated_time_saved")


def merge(findings: DataFrame, kind: str, *within: str) -> DataFrame:
    """Merge findings of one kind; ``within`` adds leading keys such as a run id."""
    keys, summed, maximised, first = MERGES[kind]
    return findings.groupBy(*within, *keys).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in summed],
        *[F.max(c).alias(c) for c in maximised],
        *[F.min_by(c, "ord").alias(c) for c in first],
        F.min("ord").alias("ord"),
    )


def merge_context_loss(findings: DataFrame, *within: str) -> tuple[DataFrame, DataFrame]:
    """Merged descriptions with distinct-segment counts, and the (description, segment) table.

    ``findings`` has one row per description with an ``affected_segments`` array.
    The union of segments stays a child table: a description seen everywhere
    would otherwise gather an unbounded array in one task.
    """
    keys = [*within, "description"]
    exploded = findings.select(
        *keys, "ord", F.posexplode_outer("affected_segments").alias("pos", "segment")
    )
    segments = (
        exploded.where(F.col("segment").isNotNull())
        .groupBy(*keys, "segment")
        .agg(F.min(F.struct("ord", "pos")).alias("first_seen"))
    )
    counts = segments.groupBy(*keys).agg(
        F.count("*").alias("segments"), F.min_by("segment", "first_seen").alias("first_segment")
    )
    merged = (
        findings.groupBy(*keys)
        .agg(F.min("ord").alias("ord"))
        .join(counts, keys, "left")
        .withColumn("segments", F.coalesce("segments", F.lit(0)))
    )
    return merged, segments


def sanitize(merged: DataFrame) -> DataFrame:
    """Clamp merged values; applies to whichever of the known columns are present."""
    out = merged
    for column in merged.columns:
        if column in UNIT_RANGE:
            out = out.withColumn(column, finite_clamp(F.col(column), 0.0, 1.0))
        elif column in MINUTES:
            out = out.withColumn(column, finite_clamp(F.col(column), 0.0, MAX_MINUTES))
        elif column == "frequency":
            out = out.withColumn(column, F.least(F.col(column), F.lit(MAX_FREQUENCY)))
    return out
