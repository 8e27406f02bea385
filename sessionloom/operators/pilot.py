"""Cohort-level pilot metrics per week, with small cohorts suppressed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import ordered

MIN_COHORT = 5


def medians(sessions: DataFrame) -> DataFrame:
    """(cohort, week, median_resolution_minutes): the exact median of the known minutes.

    Equal minutes are counted first; running counts over the distinct values then
    show which value stands in the middle, without gathering a cohort anywhere.
    """
    group = ["cohort", "week"]
    known = sessions.where(F.col("resolution_minutes").isNotNull())
    values = known.groupBy(*group, "resolution_minutes").agg(F.count("*").alias("_n"))
    placed = ordered.place(values, [*group, "resolution_minutes"])
    ranked = ordered.running_sums(placed, {"_upto": F.col("_n")}, group)
    totals = known.groupBy(*group).agg(F.count("*").alias("_all"))
    joined = ranked.join(totals, group)

    def holds(rank):
        return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col("resolution_minutes")))

    low, high = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    middle = joined.groupBy(*group).agg(holds(low).alias("_low"), holds(high).alias("_high"))
    return middle.select(*group, ((F.col("_low") + F.col("_high")) / 2).alias("median_resolution_minutes"))


def weekly(sessions: DataFrame, min_cohort: int = MIN_COHORT) -> DataFrame:
    """``sessions``: one row per session with cohort, started_at, steering, repeated
    (sessions needing repeated correction for one issue), context_loss, missing_tool,
    resolution_minutes (NULL when unresolved), adopted, accepted and files counts."""
    dated = sessions.withColumn("week", F.date_trunc("week", "started_at"))
    counted = dated.groupBy("cohort", "week").agg(
        F.count("*").alias("sessions"),
        F.avg(F.col("repeated").cast("double")).alias("rework_rate"),
        F.avg("steering").alias("steering_per_session"),
        F.sum("context_loss").cast("bigint").alias("context_loss"),
        F.sum("missing_tool").cast("bigint").alias("missing_tool"),
        F.sum(F.col("adopted").cast("int")).cast("bigint").alias("adoption"),
        F.try_divide(F.sum("accepted"), F.sum("files")).alias("completeness"),
        F.sum("privacy_exceptions").cast("bigint").alias("privacy_exceptions"),
    )
    return counted.where(F.col("sessions") >= min_cohort).join(medians(dated), ["cohort", "week"], "left")
