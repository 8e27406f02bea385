"""Findings to patterns, and merging of near-duplicate patterns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scores import impact_score, mapped
from sessionloom.operators import leaders
from sessionloom.operators.lookups import join_by_key
from sessionloom.schema import PATTERN_TYPES

TYPE_ORDER = {name: i for i, name in enumerate(PATTERN_TYPES)}

PATTERN_COLUMNS = [
    "pattern_type", "idx", "description", "comparison", "frequency", "confidence",
    "impact_score", "minutes", "first_harness", "harness_count",
]


def _rule(kind: str) -> dict[str, Column]:
    """How one sanitised finding becomes a pattern (fixed weights per kind)."""
    col, lit, text = F.col, F.lit, F.concat
    one, none = lit(1).cast("bigint"), lit(None)
    by_frequency = lambda hours: impact_score(col("frequency"), lit(hours))
    rules = {
        "model_failures": lambda: dict(
            description=text("model", lit(": "), "issue"), comparison=col("issue"),
            frequency=col("frequency"), confidence=lit(0.8), impact_score=by_frequency(0.7),
            first_harness=col("model"),
        ),
        "harness_friction": lambda: dict(
            description=text("harness", lit(" friction: "), "issue"), comparison=col("issue"),
            frequency=one, confidence=col("severity"), impact_score=col("severity"),
            first_harness=col("harness"),
        ),
        "missing_tooling": lambda: dict(
            description=text(lit("Missing tool: "), "tool_name", lit(" - "), "purpose"),
            comparison=text("tool_name", lit(" "), "purpose"),
            frequency=one, confidence=lit(0.9), impact_score=col("estimated_value"),
        ),
        "workflow_bottlenecks": lambda: dict(
            description=col("description"), comparison=col("description"),
            frequency=col("frequency"), confidence=lit(0.85),
            impact_score=impact_score(col("frequency"), col("time_impact_minutes") / 60.0),
            minutes=col("time_impact_minutes"),
        ),
        "repeated_commands": lambda: dict(
            description=text(lit("Repeated command: "), "command"), comparison=col("command"),
            frequency=col("frequency"), confidence=lit(0.95), impact_score=by_frequency(0.5),
            first_harness=col("context"),
        ),
        "repeated_prompts": lambda: dict(
            description=text(lit("Repeated prompt pattern: "), "prompt_pattern"),
            comparison=col("prompt_pattern"),
            frequency=col("frequency"), confidence=lit(0.9), impact_score=by_frequency(0.3),
        ),
        "context_loss": lambda: dict(
            description=col("description"), comparison=col("description"),
            frequency=col("segments"), confidence=lit(0.75),
            impact_score=impact_score(col("segments"), lit(0.8)),
            first_harness=col("first_segment"), harness_count=col("segments"),
        ),
        "automation_opportunities": lambda: dict(
            description=col("description"), comparison=col("description"),
            frequency=one, confidence=col("confidence"),
            impact_score=impact_score(lit(1), col("estimated_time_saved") / 60.0),
            minutes=col("estimated_time_saved"),
        ),
    }
    rule = rules[kind]()
    named = set(rule)
    rule.setdefault("minutes", none.cast("double"))
    rule.setdefault("first_harness", none.cast("string"))
    rule.setdefault("harness_count", lit(1 if "first_harness" in named else 0).cast("bigint"))
    return rule


def extract(merged: Mapping[str, DataFrame], *within: str) -> DataFrame:
    """One pattern per merged, sanitised finding; ``idx`` is arrival order inside its type."""
    union = None
    for pattern_type, kind in PATTERN_TYPES.items():
        if kind not in merged:
            continue
        rule = {name: column.alias(name) for name, column in _rule(kind).items()}
        rule["pattern_type"], rule["idx"] = F.lit(pattern_type).alias("pattern_type"), F.col("ord").alias("idx")
        part = merged[kind].select(*within, *[rule[name] for name in PATTERN_COLUMNS])
        union = part if union is None else union.unionByName(part)
    return union


def harness_links(merged: Mapping[str, DataFrame], loss_segments: DataFrame) -> DataFrame:
    """(pattern_type, idx, harness): the affected harnesses of every pattern."""
    links = None
    for kind, column in (
        ("model_failures", "model"), ("harness_friction", "harness"), ("repeated_commands", "context"),
    ):
        pattern_type = next(t for t, k in PATTERN_TYPES.items() if k == kind)
        part = merged[kind].select(
            F.lit(pattern_type).alias("pattern_type"), F.col("ord").alias("idx"), F.col(column).alias("harness")
        )
        links = part if links is None else links.unionByName(part)
    loss = merged["context_loss"].select("description", "segments", F.col("ord").alias("idx"))
    return links.unionByName(
        join_by_key(loss_segments, loss, ["description"], "segments", F.col("segment")).select(
            F.lit("ContextLoss").alias("pattern_type"), "idx", F.col("segment").alias("harness")
        )
    )


def assign_leaders(patterns: DataFrame) -> DataFrame:
    """(pattern_type, idx, leader): near-duplicate clusters inside each type."""
    return leaders.greedy_leaders(patterns, "pattern_type", "idx", "comparison")


def cluster_harnesses(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """(pattern_type, leader, harness), distinct."""
    return (
        links.join(assigned, ["pattern_type", "idx"])
        .select("pattern_type", "leader", "harness")
        .distinct()
    )


def merge_clusters(patterns: DataFrame, assigned: DataFrame, harnesses: DataFrame) -> DataFrame:
    """One row per cluster; the highest-impact member (last on ties) gives the description."""
    members = patterns.join(assigned, ["pattern_type", "idx"])
    merged = members.groupBy("pattern_type", "leader").agg(
        F.max_by("description", F.struct("impact_score", "idx")).alias("description"),
        F.sum("frequency").cast("bigint").alias("frequency"),
        F.count("*").alias("manifestation_count"),
        F.max("minutes").alias("minutes"),
        F.max("confidence").alias("confidence"),
        F.max("impact_score").alias("impact_score"),
        F.min_by("first_harness", "idx").alias("_own_first"),
    )
    listed = harnesses.groupBy("pattern_type", "leader").agg(
        F.count("*").alias("harness_count"), F.min("harness").alias("_least")
    )
    joined = merged.join(listed, ["pattern_type", "leader"], "left")
    single = F.col("manifestation_count") == 1
    # A merged cluster floors its scores at 0 and sorts its harnesses; a single pattern is untouched.
    return (
        joined.withColumn(
            "confidence", F.when(single, F.col("confidence")).otherwise(F.greatest("confidence", F.lit(0.0)))
        )
        .withColumn(
            "impact_score",
            F.when(single, F.col("impact_score")).otherwise(F.greatest("impact_score", F.lit(0.0))),
        )
        .withColumn("first_harness", F.when(single, F.col("_own_first")).otherwise(F.col("_least")))
        .withColumn("harness_count", F.coalesce("harness_count", F.lit(0)))
        .withColumnRenamed("leader", "idx")
        .drop("_own_first", "_least")
    )


def by_impact() -> list[Column]:
    """Ordering of patterns: impact descending, then declared type order, then idx."""
    return [F.col("impact_score").desc(), mapped(F.col("pattern_type"), TYPE_ORDER).asc(), F.col("idx").asc()]


def impact_rank() -> Column:
    """The same ordering as a struct for min_by."""
    return F.struct(
        (-F.col("impact_score")).alias("i"), mapped(F.col("pattern_type"), TYPE_ORDER).alias("t"), F.col("idx").alias("x")
    )
