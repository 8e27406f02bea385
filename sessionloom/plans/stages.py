"""Shared intermediate tables.

A production run writes its merged patterns once and every report table reads
them. The same holds here: a stage is built on first use in a session, written
to the shared folder, and reread by the other queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import findings, patterns, steering
from sessionloom.operators.normalize import normalize
from sessionloom.plans.inputs import load
from sessionloom.session import cut_lineage

_WRITTEN: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = cut_lineage(build())
    return _WRITTEN[key]


def forget() -> None:
    """Drop remembered stages, so the next query pays for building them."""
    _WRITTEN.clear()


def raw_merged(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merged findings of every kind (not yet clamped) and the context-loss segment table."""
    merged = {kind: findings.merge(load(spark, sf_dir, kind), kind) for kind in findings.MERGES}
    loss = load(spark, sf_dir, "context_loss").withColumn("affected_segments", F.array("segment"))
    merged["context_loss"], segments = findings.merge_context_loss(loss)
    return merged, segments


def merged_findings(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    merged, segments = raw_merged(spark, sf_dir)
    return {kind: findings.sanitize(df) for kind, df in merged.items()}, segments


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "extracted", lambda: patterns.extract(merged_findings(spark, sf_dir)[0])
    )


def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "leaders", lambda: patterns.assign_leaders(extracted(spark, sf_dir))
    )


def harnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        merged, segments = merged_findings(spark, sf_dir)
        return patterns.cluster_harnesses(
            leaders(spark, sf_dir), patterns.harness_links(merged, segments)
        )

    return stored(spark, sf_dir, "harnesses", build)


def merged_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "merged_patterns",
        lambda: patterns.merge_clusters(
            extracted(spark, sf_dir), leaders(spark, sf_dir), harnesses(spark, sf_dir)
        ),
    )


def steering_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steering.detect(normalize(load(spark, sf_dir, "raw_entries")))
