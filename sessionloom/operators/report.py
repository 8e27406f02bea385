"""Run report: summary counts, milestones, behaviour, weaknesses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scores import friction_score, two_decimals
from sessionloom.operators import ordered
from sessionloom.operators.patterns import by_impact


def count_row(counts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row with a named aggregate from each table, without joining the tables; each is read once."""
    tables = {id(df): df for df, _ in counts.values()}
    parts = []
    for key, df in tables.items():
        own = {name: aggregate.cast("bigint").alias(name) for name, (table, aggregate) in counts.items() if id(table) == key}
        named = [F.struct(F.lit(name).alias("name"), F.col(name).alias("value")) for name in own]
        parts.append(df.agg(*own.values()).select(F.inline(F.array(*named))))
    long = reduce(DataFrame.unionByName, parts)
    return long.agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in counts]
    )


def executive_summary(counts: DataFrame, date: Column) -> DataFrame:
    """``counts`` holds raw_entries, normalized_entries, segments, tokens, patterns, steering, high_impact."""
    pieces = [
        date, ": reviewed ", F.col("raw_entries"), " raw entries and retained ",
        F.col("normalized_entries"), " normalized events across ", F.col("segments"),
        " segments (~", F.col("tokens"), " estimated input tokens). Found ", F.col("patterns"),
        " patterns and ", F.col("steering"), " human steering events; ", F.col("high_impact"),
        " high-impact opportunities require follow-up.",
    ]
    text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])
    return counts.withColumn("executive_summary", text)


def friction(counts: DataFrame) -> DataFrame:
    return counts.withColumn("score", friction_score(F.col("high_impact"), F.col("steering")))


def milestones(patterns: DataFrame, events: DataFrame) -> DataFrame:
    from_patterns = patterns.where(F.col("impact_score") > 0.8).select(
        F.concat(
            F.lit("High-impact pattern identified: "), "description",
            F.lit(" (score: "), two_decimals(F.col("impact_score")), F.lit(")"),
        ).alias("milestone")
    )
    from_events = events.where(F.col("severity") > 0.8).select(
        F.concat(F.lit("Critical steering event: "), "category", F.lit(" - "), "description").alias("milestone")
    )
    return from_patterns.unionByName(from_events)


def user_behaviour(patterns: DataFrame, events: DataFrame) -> DataFrame:
    """(bucket, item); plain substring tests, so "git" also matches "digital"."""

    def has(column: str, *words: str) -> Column:
        return F.col(column).rlike("|".join(words))

    bucket = F.when(
        (F.col("pattern_type") == "RepeatedCommand") & has("description", "git"),
        "repeated_git_workflows",
    ).when(
        (F.col("pattern_type") == "MissingTool") & has("description", "install", "package"),
        "repeated_package_installs",
    )
    from_patterns = patterns.select(bucket.alias("bucket"), F.col("description").alias("item"))
    from_events = events.where(has("context", "cd", "ls", "find")).select(
        F.lit("repeated_file_navigation").alias("bucket"), F.col("context").alias("item")
    )
    return from_patterns.where(F.col("bucket").isNotNull()).unionByName(from_events)


def _failures_by_model(patterns: DataFrame) -> DataFrame:
    return patterns.where(F.col("pattern_type") == "ModelFailure").withColumn(
        "model", F.coalesce("first_harness", F.lit("unknown"))
    )


def model_weaknesses(patterns: DataFrame) -> DataFrame:
    """One row per model with its number of failures; the texts are ``model_weakness_items``."""
    return _failures_by_model(patterns).groupBy("model").agg(F.count("*").alias("frequency"))


def model_weakness_items(patterns: DataFrame) -> DataFrame:
    """(model, seq, description): a model's failures numbered from 1, strongest first.

    Joined by "; " in this order they are the model's weakness text, and one by one
    its examples; as rows they need no task that holds all of a model's texts.
    """
    placed = ordered.place(_failures_by_model(patterns), [F.col("model").asc(), *by_impact()])
    listed = ordered.running_sums(placed, {"seq": F.lit(1).cast("bigint")}, ["model"])
    return listed.select("model", "seq", "description")


def harness_weaknesses(patterns: DataFrame, harnesses: DataFrame) -> DataFrame:
    friction_rows = patterns.where(F.col("pattern_type") == "HarnessFriction")
    linked = friction_rows.join(harnesses.withColumnRenamed("leader", "idx"), ["pattern_type", "idx"])
    return linked.groupBy("harness").agg(
        F.lit("General friction detected").alias("weakness"), F.avg("impact_score").alias("severity")
    )
