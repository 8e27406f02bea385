"""User-correction ("steering") detection and clustering."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scores import mapped
from sessionloom.functions.text import computed_once
from sessionloom.operators import ordered

# Categories in priority order with their phrases, matched on lowercase text.
PHRASES = {
    "MissingTool": [
        r"i wish i had", r"we need a tool for", r"there should be a command", r"missing.*tool",
        r"would be nice if.*could",
    ],
    "MissingContext": [
        r"we already decided", r"you forgot", r"as i mentioned", r"remember that", r"we discussed",
        r"losing context",
    ],
    "WrongAbstraction": [
        r"that's not what i asked", r"you're solving the wrong problem", r"wrong approach",
        r"not the right abstraction", r"misunderstood the requirement",
    ],
    "ExcessVerbosity": [
        r"be more concise", r"too verbose", r"\bshorter\b", r"get to the point", r"less detail",
        r"keep it brief",
    ],
    "Hallucination": [
        r"that.*doesn't exist", r"no such.*api", r"that command doesn't", r"\binvented\b",
        r"\bhallucinated\b", r"not a real",
    ],
    "ArchitecturalMismatch": [
        r"doesn't fit the workflow", r"architectural mismatch", r"wrong for this use case",
        r"doesn't scale", r"not the right fit",
    ],
    "ManualRepetition": [
        r"\b(?:do|run|execute|perform|say|write|try)\s+(?:it|that|this)\s+again\b",
        r"\brepeat(?:\s+(?:that|this|it|the\s+\w+))?\b", r"\bsame as before\b", r"\bdo it again\b",
        r"\blike last time\b",
    ],
}

# Words that a text must hold before a pattern is tried on it; a phrase that is not
# listed here is plain text and is searched for as it is.
NEEDED_WORDS = {
    r"missing.*tool": "missing",
    r"would be nice if.*could": "would be nice if",
    r"\bshorter\b": "shorter",
    r"that.*doesn't exist": "doesn't exist",
    r"no such.*api": "no such",
    r"\binvented\b": "invented",
    r"\bhallucinated\b": "hallucinated",
    r"\b(?:do|run|execute|perform|say|write|try)\s+(?:it|that|this)\s+again\b": "again",
    r"\brepeat(?:\s+(?:that|this|it|the\s+\w+))?\b": "repeat",
    r"\bsame as before\b": "same as before",
    r"\bdo it again\b": "do it again",
    r"\blike last time\b": "like last time",
}

# Per category description, severity, suggested capability, intervention kind.
DESCRIPTIONS = {
    "MissingTool": "User indicated missing tool or capability",
    "MissingContext": "Model forgot previous context or decisions",
    "WrongAbstraction": "Model solved the wrong problem",
    "ExcessVerbosity": "User requested conciseness",
    "Hallucination": "Model invented API or command",
    "ArchitecturalMismatch": "Existing tool no longer fits workflow",
    "ManualRepetition": "User repeated same sequence manually",
}
SEVERITY = {
    "MissingTool": 0.8, "MissingContext": 0.7, "WrongAbstraction": 0.9, "ExcessVerbosity": 0.3,
    "Hallucination": 0.95, "ArchitecturalMismatch": 0.85, "ManualRepetition": 0.6, "Other": 0.5,
}
SUGGESTED_NAME = {
    "MissingTool": "workflow-acceleration", "MissingContext": "context-manager",
    "WrongAbstraction": "requirement-guard", "ExcessVerbosity": "response-compressor",
    "Hallucination": "verification-gateway", "ArchitecturalMismatch": "architecture-reviewer",
    "ManualRepetition": "workflow-automator", "Other": "workflow-friction-reducer",
}
INTERVENTION = {
    "MissingTool": "MissingCapability", "MissingContext": "ContextManagement",
    "Hallucination": "ModelReliability", "ManualRepetition": "WorkflowAcceleration",
}
OPENERS = ("hi", "hello", "hey", "hello!", "hi!", "hey!", "good morning", "good evening")

CATEGORY_ORDER = {name: i for i, name in enumerate(SEVERITY)}

if not set(NEEDED_WORDS) <= {phrase for phrases in PHRASES.values() for phrase in phrases}:
    raise ValueError("a phrase with needed words is no phrase of any category")


def is_opener(text: Column) -> Column:
    """Whether a lowercase text is nothing but a greeting."""
    return text.rlike(r"(?U)\A\s*(?:" + "|".join(OPENERS) + r")\s*\z")


def _mentions(text: Column, phrase: str) -> Column:
    """Substring search first: it is far cheaper than a pattern and usually says no.

    (?U) makes the word classes Unicode-aware and (?d) lets "." stop only at \\n.
    """
    words = NEEDED_WORDS.get(phrase)
    found = F.contains(text, F.lit(words or phrase))
    return found & text.rlike("(?Ud)" + phrase) if words else found


def steering_category(text: Column) -> Column:
    """First matching category of a lowercase text, NULL for none."""
    chain = F.when(is_opener(text), F.lit(None).cast("string"))
    for category, phrases in PHRASES.items():
        matched = reduce(or_, [_mentions(text, phrase) for phrase in phrases])
        chain = chain.when(matched, F.lit(category))
    return chain


def detect(entries: DataFrame) -> DataFrame:
    """One event per entry that matches; columns of ``entries`` other than content are kept."""
    lowered = entries.select("*", computed_once(F.lower("content")).alias("_lower"))
    events = lowered.select("*", computed_once(steering_category(F.col("_lower"))).alias("category"))
    return (
        events.drop("_lower").where(F.col("category").isNotNull())
        .withColumn("description", mapped(F.col("category"), DESCRIPTIONS))
        .withColumn("severity", mapped(F.col("category"), SEVERITY))
        .withColumnRenamed("content", "context")
        .withColumnRenamed("id", "entry_id")
        .withColumn("id", F.sha2(F.concat_ws("|", F.lit("steering"), F.col("entry_id")), 256))
    )


def by_time(events: DataFrame) -> DataFrame:
    """Events with ``position``, their number in time order; equal instants keep entry order."""
    placed = ordered.place(events, ["ts", "entry_id"])
    return ordered.row_number(placed, "position").drop(ordered.BLOCK, ordered.PLACE)


def clusters(events: DataFrame) -> DataFrame:
    """Category totals with at least two events (at most eight rows)."""
    count = F.col("events")
    # Averaged as decimals: sums of doubles differ with the tasks they are added up in, and candidates of equal
    # confidence would be ordered by that difference.
    severity = F.avg(F.col("severity").cast("decimal(20,18)")).cast("double")
    totals = events.groupBy("category").agg(F.count("*").alias("events"), severity.alias("avg_severity"))
    return (
        totals.where(count >= 2)
        .withColumn("name", mapped(F.col("category"), SUGGESTED_NAME))
        .withColumn("priority", F.when(count >= 10, "High").otherwise("Medium"))
        .withColumn("intervention", mapped(F.col("category"), INTERVENTION, "Other"))
        .withColumn(
            "confidence", (F.col("avg_severity") + F.least(count / 20.0, F.lit(1.0))) / 2.0
        )
    )


def cluster_fitness(avg_severity: Column, events: Column, overlap: Column) -> Column:
    return F.least(
        avg_severity * 0.55 + F.least(events / 100.0, F.lit(1.0)) * 0.25 + overlap * 0.2,
        F.lit(1.0),
    )
