"""The row-local operators on a stream, and gap sessions by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import steering
from sessionloom.operators.normalize import normalize

# session_window merges a gap equal to its duration, while a segment splits at
# exactly 31 minutes: one microsecond less gives the same cut.
SESSION_GAP = "1859.999999 seconds"


def steering_stream(entries: DataFrame) -> DataFrame:
    """Normalised entries through the steering classifier; stateless."""
    return steering.detect(normalize(entries))


def session_stream(entries: DataFrame, *keys: str, lateness: str = "1 hour") -> DataFrame:
    """Gap sessions per key; ``ts`` must be a TIMESTAMP column."""
    window = F.session_window("ts", SESSION_GAP)
    return (
        entries.withWatermark("ts", lateness)
        .groupBy(*keys, window.alias("session"))
        .agg(F.count("*").alias("entries"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
        .drop("session")
    )
