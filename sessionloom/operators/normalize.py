"""Whitespace, noise and tool-call normalisation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.text import SPACE_RUN, computed_once, space_separated_words

# Literal markers deleted from content.
NOISE = ("[system]", "[debug]")


def normalize_content(content: Column) -> Column:
    """Single-space, trim, then delete noise markers (in that order)."""
    cleaned = F.trim(F.regexp_replace(content, SPACE_RUN, " "))
    for marker in NOISE:
        cleaned = F.replace(cleaned, F.lit(marker), F.lit(""))
    return cleaned


def _tidy(value):
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return [_tidy(item) for item in value]
    if isinstance(value, dict):
        return {key.lower(): _tidy(value[key]) for key in sorted(value)}
    return value


@F.pandas_udf(T.ArrayType(T.StringType()))
def tidy_parameters(batches: pd.Series) -> pd.Series:
    """Trim strings and lowercase keys at every depth of JSON documents."""

    def one(text):
        if text is None:
            return None
        return json.dumps(
            _tidy(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False
        )

    return batches.map(lambda texts: None if texts is None else [one(t) for t in texts])


def normalize_tool_calls(df: DataFrame, column: str = "tool_calls") -> DataFrame:
    tidy = df.withColumn("_params", tidy_parameters(F.col(f"{column}.parameters")))
    calls = F.zip_with(
        F.col(column),
        F.col("_params"),
        lambda call, params: F.struct(
            F.lower(call["tool_name"]).alias("tool_name"),
            params.alias("parameters"),
            call["result"].alias("result"),
            call["duration_ms"].alias("duration_ms"),
        ),
    )
    return tidy.withColumn(column, calls).drop("_params")


def normalize(entries: DataFrame) -> DataFrame:
    """Normalise entries and drop empty ones; repeats are evidence and stay."""
    others = [c for c in entries.columns if c != "content"]
    cleaned = computed_once(normalize_content(F.col("content"))).alias("content")
    kept = entries.select(*others, cleaned).where(F.col("content") != "")
    return normalize_tool_calls(kept) if "tool_calls" in entries.columns else kept


def token_estimate(entries: DataFrame, *keys: str) -> DataFrame:
    return entries.groupBy(*keys).agg(
        F.count("*").alias("entries"),
        F.sum(space_separated_words(F.col("content"))).cast("bigint").alias("tokens"),
    )
