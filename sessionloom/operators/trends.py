"""Run metrics and their comparison with earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scores import trend_bars, trend_direction
from sessionloom.operators import ordered

# Metric key and display label.
METRICS = {
    "context_loss": "Context-loss issues",
    "git_friction": "Git workflow friction",
    "documentation_friction": "Documentation friction",
    "prompt_repetition": "Prompt repetition",
    "command_repetition": "Repeated shell commands",
}


def run_metrics(runs: DataFrame, patterns: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, generated_at, one column per metric) for every run, zero when nothing matched."""
    kind, text = F.col("pattern_type"), F.col("description")

    def freq_if(test: Column) -> Column:
        return F.sum(F.when(test, F.col("frequency")).otherwise(0)).cast("double")

    by_pattern = patterns.groupBy("run_id").agg(
        F.count_if((kind == "RepeatedCommand") & F.contains(text, F.lit("git"))).cast("double").alias("git_friction"),
        freq_if(F.contains(F.lower(text), F.lit("document"))).alias("documentation_friction"),
        freq_if(kind == "RepeatedPrompt").alias("prompt_repetition"),
        freq_if(kind == "RepeatedCommand").alias("command_repetition"),
    )
    by_event = events.groupBy("run_id").agg(
        F.count_if(F.col("category") == "MissingContext").cast("double").alias("context_loss")
    )
    joined = runs.select("run_id", "generated_at").join(by_pattern, "run_id", "left").join(by_event, "run_id", "left")
    return joined.fillna(0.0, list(METRICS))


def _unpivot(wide: DataFrame) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"), F.lit(label).alias("metric_name"),
                F.col(metric).alias("current_value"), F.col(f"prev_{metric}").alias("previous_value"),
            )
            for metric, label in METRICS.items()
        ]
    )
    return wide.select("run_id", F.inline(pairs))


def _described(long: DataFrame, days: int) -> DataFrame:
    current, previous = F.col("current_value"), F.col("previous_value")
    return (
        long.withColumn("period", F.lit(f"Past {max(days, 1)} days"))
        .withColumn("trend_direction", trend_direction(current, previous))
        .withColumn("visualization", trend_bars(current, previous))
    )


def compare(metrics: DataFrame, run_id: Column, as_of: Column, days: int = 30) -> DataFrame:
    """One run against the mean of runs in the ``days`` before ``as_of``, itself excluded.

    One aggregation over the history: the current run and the window are both
    picked out by conditions, so nothing is joined.
    """
    is_current = F.col("run_id") == run_id
    cutoff = as_of - F.make_dt_interval(days=F.lit(max(days, 1)))
    in_window = ~is_current & (F.col("generated_at") > cutoff) & (F.col("generated_at") < as_of)
    wide = metrics.agg(
        F.max(F.when(is_current, F.col("run_id"))).alias("run_id"),
        *[F.max(F.when(is_current, F.col(m))).alias(m) for m in METRICS],
        *[F.coalesce(F.avg(F.when(in_window, F.col(m))), F.lit(0.0)).alias(f"prev_{m}") for m in METRICS],
    )
    return _described(_unpivot(wide), days)


def backfill(metrics: DataFrame, days: int = 30) -> DataFrame:
    """Every run against the mean of the runs in its own preceding window.

    A range frame with no partition key would be one task. Instead each run
    contributes its values at its own time, and two probes: one just before it
    and one at the cutoff. The difference of the running sums at the two probes
    is the sum over the window.
    """
    values = list(METRICS)
    cutoff = F.col("generated_at") - F.make_dt_interval(days=F.lit(max(days, 1)))
    zero = [F.lit(0.0).alias(m) for m in values]

    def rows(at: Column, kind: int, columns: list) -> DataFrame:
        return metrics.select(
            at.alias("at"), F.lit(kind).alias("kind"), "run_id", *columns,
            F.lit(1 if kind == 1 else 0).alias("runs"),
        )

    # At one instant: upper probes, then runs, then cutoff probes.
    line = (
        rows(F.col("generated_at"), 0, zero)
        .unionByName(rows(F.col("generated_at"), 1, values))
        .unionByName(rows(cutoff, 2, zero))
    )
    placed = ordered.place(line, ["at", "kind", "run_id"])
    sums = {f"sum_{c}": F.col(c) for c in [*values, "runs"]}
    running = ordered.running_sums(placed, sums).where(F.col("kind") != 1)

    def window(column: str) -> Column:
        # Both probes lie inside the order, so the difference is the window's total.
        signed = F.when(F.col("kind") == 0, F.col(column)).otherwise(-F.col(column))
        return F.sum(signed)

    totals = running.groupBy("run_id").agg(*[window(s).alias(s) for s in sums])
    wide = metrics.join(totals, "run_id")
    for m in values:
        mean = F.when(F.col("sum_runs") > 0, F.col(f"sum_{m}") / F.col("sum_runs")).otherwise(0.0)
        wide = wide.withColumn(f"prev_{m}", mean)
    return _described(_unpivot(wide), days)
