"""Splitting an ordered log into topical segments.

``keys=[]`` is one global time line; ``keys=["user_id"]`` segments each user on
their own. Both run through the same range-partitioned order, so neither form
has a single-task stage and a hot key is spread like any other rows. Only keys
and order columns are ordered, written and numbered; texts and all else join the
result once, by key and order (which ends in something unique per key); ``keep``
names those that are wanted (all by default).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import each_word, word_set
from sessionloom.operators import ordered, tfidf
from sessionloom.operators.lookups import join_by_key
from sessionloom.session import cut_lineage

MAX_GAP_MINUTES = 30
MIN_SIMILARITY = 0.3


def _in_order(entries: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``keys``, ``order`` and ``seq``, the place in the whole order: no other column is ordered."""
    named = list(dict.fromkeys([*keys, *order]))
    return ordered.row_number(ordered.place(entries.select(*named), [*keys, *order]), "seq")


def _with_rest(
    entries: DataFrame, found: DataFrame, keys: Sequence[str], order: Sequence[str], rest: Sequence[str] | None = None
) -> DataFrame:
    """``found`` with the other columns of its entries, fetched once by key and order."""
    named = list(dict.fromkeys([*keys, *order]))
    rest = [c for c in entries.columns if c not in named] if rest is None else list(rest)
    if not rest:
        return found
    left, right = entries.select(*named, *rest), found.withColumnsRenamed({c: f"_{c}" for c in named})
    same = reduce(and_, [left[c].eqNullSafe(right[f"_{c}"]) for c in named])
    return left.join(right, same).drop(*[f"_{c}" for c in named])


def _with_gap(rows: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    linked = ordered.previous(rows, [ts, "seq"], keys)
    # Whole minutes, truncated: 30:59 is 30, 31:00 is 31.
    gap = F.timestamp_diff("MINUTE", F.col(f"prev_{ts}"), F.col(ts))
    return linked.withColumn("gap_minutes", gap).drop(f"prev_{ts}")


def _cosines(entries: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    worded = _with_rest(entries, rows.drop(ordered.BLOCK, ordered.PLACE), keys, order, ["content"])
    return tfidf.neighbour_cosine(tfidf.weights(worded, ["seq"]), "seq")


def gaps(
    entries: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None
) -> DataFrame:
    """Entries with truncated minutes since the previous one and the gap-only split flag."""
    found = _with_gap(_in_order(entries, keys, order), keys, order[0]).withColumn(
        "splits", F.col("prev_seq").isNull() | (F.col("gap_minutes") > MAX_GAP_MINUTES)
    )
    return _with_rest(entries, found, keys, order, keep)


def similarity(
    entries: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None
) -> DataFrame:
    """Entries with the cosine to their predecessor (NULL for the first of a key)."""
    rows = _in_order(entries, keys, order)
    cosines = _cosines(entries, rows, keys, order)
    found = ordered.previous(rows, ["seq"], keys).join(cosines, "seq", "left").withColumn(
        "cosine", F.when(F.col("prev_seq").isNotNull(), F.coalesce("cosine", F.lit(0.0)))
    )
    return _with_rest(entries, found, keys, order, keep)


def segment(
    entries: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None
) -> DataFrame:
    """Entries with ``segment_no`` (from 1, per key) and ``seq`` (global order)."""
    rows = _in_order(entries, keys, order)
    cosines = _cosines(entries, rows, keys, order)
    scored = _with_gap(rows, keys, order[0]).join(cosines, "seq", "left")
    splits = (
        F.col("prev_seq").isNull()
        | (F.col("gap_minutes") > MAX_GAP_MINUTES)
        | (F.coalesce("cosine", F.lit(0.0)) < MIN_SIMILARITY)
    )
    # Written because its blocks drive the running sum; narrow, like all that is ordered.
    flagged = cut_lineage(scored.withColumn("splits", splits.cast("int")).drop("cosine"))
    numbered = ordered.running_sums(flagged, {"segment_no": F.col("splits")}, keys)
    found = numbered.drop(ordered.BLOCK, ordered.PLACE, "splits", "prev_seq", "gap_minutes")
    return _with_rest(entries, found, keys, order, keep)


def topics(segmented: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most widespread word longer than 3 bytes per segment; ties go to the smaller word."""
    group = [*keys, "segment_no"]
    words = (
        segmented.select(*group, each_word(word_set(F.col("content"))).alias("word"))
        .where(F.octet_length("word") > 3)
        .groupBy(*group, "word")
        .agg(F.count("*").alias("n"))
    )
    return words.groupBy(*group).agg(
        F.min_by("word", F.struct((-F.col("n")).alias("n"), F.col("word").alias("w"))).alias("topic")
    )


def confidences(segmented: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean neighbour cosine with IDF counted inside each segment of two or more entries."""
    group = [*keys, "segment_no"]
    sizes = segmented.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    rows = join_by_key(segmented, sizes, group, "_n", F.col("seq")).where(F.col("_n") > 1)
    cosines = tfidf.neighbour_cosine(tfidf.weights_within(rows, ["seq"], group), "seq", group)
    totals = cosines.groupBy(*group).agg(F.sum("cosine").alias("_sum"))
    return sizes.join(totals, group, "left").select(
        *group, (F.coalesce("_sum", F.lit(0.0)) / (F.col("_n") - 1)).alias("confidence")
    )


def summarize(segmented: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row per segment: span, size, topic, confidence."""
    group = [*keys, "segment_no"]
    spans = segmented.groupBy(*group).agg(
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count("*").alias("entries")
    )
    return (
        spans.join(topics(segmented, keys), group, "left")
        .join(confidences(segmented, keys), group, "left")
        .withColumn("topic", F.coalesce("topic", F.lit("general")))
        .withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    )
