"""Lookups over the table of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _newest(runs: DataFrame, *keys: str) -> DataFrame:
    row = F.struct(*[c for c in runs.columns if c not in keys])
    latest = runs.groupBy(*keys).agg(F.max_by(row, F.struct("generated_at", "run_id")).alias("_r"))
    return latest.select(*keys, "_r.*")


def latest_per_date(runs: DataFrame, date: str | None = None) -> DataFrame:
    """Newest run of each date; a given ``date`` prunes partitions of the run table."""
    chosen = runs if date is None else runs.where(F.col("date") == date)
    return _newest(chosen, "date")


def latest(runs: DataFrame) -> DataFrame:
    return _newest(runs).where(F.col("run_id").isNotNull())


def listing(runs: DataFrame) -> DataFrame:
    """Newest first."""
    return runs.orderBy(F.col("generated_at").desc(), "run_id")


def history(runs: DataFrame) -> DataFrame:
    """Oldest first."""
    return runs.orderBy("generated_at", "run_id")


def by_id(runs: DataFrame, run_id: str | Column) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def summary_rows(documents: DataFrame) -> DataFrame:
    """One listing row per run document."""
    return documents.select(
        F.col("id").alias("run_id"), "date", "generated_at", "executive_summary",
        F.size(F.coalesce("candidate_tools", F.array())).cast("bigint").alias("candidates"),
    )


def sync_status(files: DataFrame) -> DataFrame:
    """Per file: uploaded (a run document), skipped (other JSON) or failed (unreadable).

    ``files`` has ``readable`` and ``is_run``; sending a run anywhere is the caller's business.
    """
    status = F.when(~F.col("readable"), "failed").when(F.col("is_run"), "uploaded").otherwise("skipped")
    return files.withColumn("status", status)


def sync_summary(files: DataFrame) -> DataFrame:
    return sync_status(files).groupBy("status").agg(F.count("*").alias("files"))
