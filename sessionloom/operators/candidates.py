"""Intervention candidates, directives and their exported views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.prose_numbers import first_number
from sessionloom.functions.scores import impact_label, mapped, priority
from sessionloom.functions.text import SPACE_RUN, truncate_bytes
from sessionloom.operators import ordered, registry, steering
from sessionloom.operators.patterns import by_impact, impact_rank

# Which intervention category each pattern type leads to.
CATEGORY = {
    "MissingTool": "MissingCapability", "AutomationOpportunity": "MissingCapability",
    "WorkflowBottleneck": "WorkflowAcceleration", "RepeatedCommand": "WorkflowAcceleration",
    "RepeatedPrompt": "ContextManagement", "ContextLoss": "ContextManagement",
    "ModelFailure": "ModelReliability", "HarnessFriction": "Other",
}
EFFORT = {"High": "Medium", "Medium": "Low", "Low": "Low"}

CANDIDATE_COLUMNS = [
    "id", "name", "priority", "category", "reason", "estimated_time_saved", "confidence",
    "existing_matches", "mutation_fitness", "capability_overlap", "implementation_cost",
    "project_count", "pattern_type", "idx",
]


def suggest_name(description: Column) -> Column:
    text = F.lower(description)

    def mentions(*words: str) -> Column:
        return text.rlike("|".join(words))

    first = F.get(F.filter(F.split(description, SPACE_RUN), lambda w: w != ""), 0)
    return (
        F.when(mentions("git"), "git-assistant")
        .when(mentions("package", "install"), "package-manager")
        .when(mentions("search", "find"), "smart-search")
        .when(mentions("context"), "context-manager")
        .otherwise(F.concat(F.lit("tool-"), F.coalesce(first, F.lit("helper"))))
    )


def _category(name: Column, by_kind: Column) -> Column:
    return F.when(F.contains(name, F.lit("package")), "PackageManagerFriction").otherwise(by_kind)


def _numbered(n: Column) -> Column:
    return F.format_string("DS-%04d", n)


def _overlap(matches: Column) -> Column:
    return F.least(F.size(matches) / 3.0, F.lit(1.0))


def _with_matches(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    none = F.array().cast("array<string>")
    if known is None:
        return rows.withColumn("existing_matches", none)
    found = registry.matches(rows.select("name"), known)
    return rows.join(found, "name", "left").withColumn(
        "existing_matches", F.coalesce("existing_matches", none)
    )


def pattern_candidates(patterns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One candidate per suggested name; the highest-impact pattern wins it."""
    strong = patterns.where(F.col("impact_score") > 0.6).withColumn(
        "name", suggest_name(F.col("description"))
    )
    row = F.struct(*[c for c in strong.columns if c != "name"])
    # min_by combines map-side, so a name shared by a third of all patterns is no hot spot.
    winners = strong.groupBy("name").agg(F.min_by(row, impact_rank()).alias("_w")).select("name", "_w.*")
    numbered = ordered.row_number(ordered.place(winners, by_impact()), "_n")
    rows = _with_matches(numbered, known)
    level = priority(F.col("impact_score"))
    merged = F.concat(
        truncate_bytes(F.col("description"), 220),
        F.format_string(" (seen %d times, consolidated)", "manifestation_count"),
    )
    return rows.select(
        _numbered(F.col("_n")).alias("id"),
        "name",
        level.alias("priority"),
        _category(F.col("name"), mapped(F.col("pattern_type"), CATEGORY)).alias("category"),
        F.when(F.col("manifestation_count") > 1, merged)
        .otherwise(truncate_bytes(F.col("description"), 240))
        .alias("reason"),
        impact_label(F.col("minutes"), level).alias("estimated_time_saved"),
        "confidence",
        "existing_matches",
        (F.col("confidence") * 0.7 + F.col("impact_score") * 0.3).alias("mutation_fitness"),
        _overlap(F.col("existing_matches")).alias("capability_overlap"),
        F.when(F.size("existing_matches") == 0, "high").otherwise("medium").alias("implementation_cost"),
        F.col("harness_count").alias("project_count"),
        "pattern_type",
        "idx",
    )


def steering_candidates(
    events: DataFrame, taken: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """Candidates from steering clusters whose name is not taken yet (at most eight rows)."""
    fresh = steering.clusters(events).join(taken.select("name").distinct(), "name", "left_anti")
    enum_order = mapped(F.col("category"), steering.CATEGORY_ORDER)
    rank = F.row_number().over(Window.orderBy(enum_order)) + taken.agg(F.count("*")).scalar()
    rows = _with_matches(fresh.withColumn("_n", rank), known)
    overlap = _overlap(F.col("existing_matches"))
    return rows.select(
        _numbered(F.col("_n")).alias("id"),
        "name",
        "priority",
        _category(F.col("name"), F.col("intervention")).alias("category"),
        F.concat("events", F.lit(" steering events clustered as "), "category").alias("reason"),
        impact_label(F.lit(None).cast("double"), F.col("priority")).alias("estimated_time_saved"),
        "confidence",
        "existing_matches",
        steering.cluster_fitness(F.col("avg_severity"), F.col("events"), overlap).alias("mutation_fitness"),
        overlap.alias("capability_overlap"),
        F.when(overlap >= 0.34, "medium").otherwise("high").alias("implementation_cost"),
        F.lit(0).cast("bigint").alias("project_count"),
        F.lit(None).cast("string").alias("pattern_type"),
        F.lit(None).cast("bigint").alias("idx"),
    )


def candidates(patterns: DataFrame, events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    first = pattern_candidates(patterns, known)
    return first.unionByName(steering_candidates(events, first, known))


def projects(candidate_rows: DataFrame, harnesses: DataFrame) -> DataFrame:
    """(id, project): existing matches when there are any, else the affected harnesses."""
    matched = candidate_rows.select("id", F.explode("existing_matches").alias("project"))
    affected = (
        candidate_rows.where(F.size("existing_matches") == 0)
        .join(harnesses.withColumnRenamed("leader", "idx"), ["pattern_type", "idx"])
        .select("id", F.col("harness").alias("project"))
    )
    return matched.unionByName(affected)


def directives(candidate_rows: DataFrame) -> DataFrame:
    return candidate_rows.select(
        "id",
        F.col("name").alias("title"),
        F.col("project_count").alias("frequency"),
        "estimated_time_saved",
        "confidence",
        F.col("confidence").alias("automation_score"),
        mapped(F.col("priority"), EFFORT).alias("implementation_effort"),
    ).orderBy(F.col("automation_score").desc(), "id")


def interventions(candidate_rows: DataFrame) -> DataFrame:
    """The reader's view: what to do and on how many projects."""
    has = F.size("existing_matches") > 0
    return candidate_rows.select(
        "id", "priority", "category", F.col("name").alias("title"),
        F.col("estimated_time_saved").alias("time_saved"), "confidence",
        F.when(has, F.concat(F.lit("extend "), F.array_join("existing_matches", ", ")))
        .otherwise("create new capability").alias("action"),
        F.col("reason").alias("rationale"),
        F.when(has, F.size("existing_matches").cast("bigint")).otherwise(F.col("project_count")).alias("projects"),
    )


def opportunities(candidate_rows: DataFrame) -> DataFrame:
    """Privacy-reduced rows for publishing: no contexts, no configuration."""
    has = F.size("existing_matches") > 0
    bounded = F.greatest(F.least("confidence", F.lit(1.0)), F.lit(0.0))
    return candidate_rows.select(
        "id",
        F.col("name").alias("title"),
        F.col("reason").alias("summary"),
        F.lower("priority").alias("priority"),
        F.round(F.round(bounded, 9) * 100, 0).cast("int").alias("confidence"),
        # The first number of the label, whatever its unit.
        first_number(F.col("estimated_time_saved")).alias("estimated_value"),
        F.lit(1).alias("evidence_count"),
        F.when(has, F.size("existing_matches").cast("bigint")).otherwise(F.col("project_count")).alias("repositories"),
        F.when(has, "extend").otherwise("generate").alias("decision"),
    )


ENVELOPE_PART = 1_000
OPPORTUNITY = [
    "id", "title", "summary", "priority", "confidence", "estimated_hours", "evidence_count", "repositories", "decision",
]


def _run(source_id: str, version: str, *more: Column) -> Column:
    stamp = F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.struct(
        F.col("run_id").alias("id"),
        stamp.alias("generated_at"),
        F.struct(F.lit(source_id).alias("id"), F.lit(version).alias("cli_version")).alias("source"),
        F.col("executive_summary").alias("summary"),
        F.struct("raw_entries", "normalized_entries", "segments", "estimated_input_tokens").alias("pipeline"),
        *more,
    )


def envelopes(run_rows: DataFrame, source_id: str, version: str) -> DataFrame:
    """(run_id, envelope): the JSON header of each published run.

    ``run_rows`` has run_id, generated_at, executive_summary and the pipeline counts.
    """
    header = F.to_json(F.struct(F.lit(1).alias("schema_version"), _run(source_id, version).alias("run")))
    return run_rows.select("run_id", header.alias("envelope"))


def nested_envelopes(
    run_rows: DataFrame, opportunity_rows: DataFrame, source_id: str, version: str, part: int = ENVELOPE_PART
) -> DataFrame:
    """(run_id, part, envelope): each run's JSON document with its opportunities in id order.

    ``opportunity_rows`` is ``opportunities`` with a run_id. A document holds at most
    ``part`` of them; a run with more has further parts, each with the run's header.
    Project names are not nested: ``projects`` has them as rows by run and id.
    """
    named = opportunity_rows.withColumnRenamed("estimated_value", "estimated_hours")
    placed = ordered.place(named.select("run_id", *OPPORTUNITY), ["run_id", "id"])
    numbered = ordered.running_sums(placed, {"_n": F.lit(1)}, ["run_id"])
    filled = numbered.groupBy("run_id", F.expr(f"cast((_n - 1) div {part} as int)").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("_n", F.struct(*OPPORTUNITY).alias("o"))))["o"].alias("_held")
    )
    rows = run_rows.join(filled, "run_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    nested = _run(source_id, version, F.coalesce("_held", F.array()).alias("opportunities"))
    document = F.to_json(F.struct(F.lit(1).alias("schema_version"), nested.alias("run")))
    return rows.select("run_id", "part", document.alias("envelope"))


def backlog(candidate_rows: DataFrame) -> DataFrame:
    """Numbered backlog items in confidence order."""
    placed = ordered.place(candidate_rows, [F.col("confidence").desc(), F.col("id").asc()])
    rows = ordered.row_number(placed, "_n")
    has = F.size("existing_matches") > 0
    return rows.select(
        F.format_string("dream-%03d", "_n").alias("id"),
        F.upper("priority").alias("priority"),
        F.lit("workflow-friction").alias("category"),
        F.col("name").alias("title"),
        F.col("reason").alias("problem"),
        F.round(F.round("confidence", 9), 2).alias("confidence"),
        F.round(F.round("mutation_fitness", 9), 2).alias("mutation_fitness"),
        F.when(has, F.array_join("existing_matches", ", ")).otherwise("none identified").alias("affected"),
        F.when(has, "extend existing capability").otherwise("create capability").alias("action"),
        F.col("estimated_time_saved").alias("expected_value"),
    )


def average_confidence(candidate_rows: DataFrame) -> DataFrame:
    return candidate_rows.agg(
        F.count("*").alias("candidates"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
    )
