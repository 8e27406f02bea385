"""Benchmark decontamination with a positional inverted index of the training texts.

The index is stored: one row per segment, which holds whole documents up to a
bounded size, with the distinct words of the segment, and for each word its
positions. A test item is cut into windows of ``width`` words. For a window the
words with the shortest posting lists come first; a position survives while every
further word has a position within ``near`` words in the same document (proximity
match), and then while every word stands at its own offset (exact phrase).

Windows are searched in blocks of bounded size, so the block that goes to the tasks
is bounded whatever the number of items.

Cases: null and empty texts have no words; an item with fewer words than ``width``
is one window, one without words none; repeated items count once by item_id, a null
item_id counts as the empty name; a document of any length is in one segment;
matches never cross documents; an empty test set leaves every document clean.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.packing import written
from sessionloom.llm.workers import slices, table

WIDTH, NEAR = 10, 20
WINDOWS_PER_BLOCK = 200_000
BROADCAST_IDS = 4_000_000
#: Bytes to words: letters and digits of ASCII and all bytes above it, A-Z lowered.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

SEGMENTS = pa.schema(
    [("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
     ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())]
)
SEGMENTS_SQL = (
    "segment bigint, doc_ids array<bigint>, sizes array<bigint>, terms binary, counts binary, positions binary"
)
FOUND_SQL = (
    "segment bigint, row int, doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, "
    "items array<string>, near_items array<string>"
)
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
FOUND = pa.schema(
    [("segment", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
     ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))]
)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def index(docs: DataFrame) -> DataFrame:
    """Write the positional index of ``docs(doc_id, text)`` and return its table."""

    def build(batches):
        segment = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            terms, ids, sizes = _Terms(), [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                own = words(text)
                ids += [terms[w] for w in own]
                sizes.append(len(own))
            ids = np.array(ids, np.int32)
            columns = {
                "segment": [segment], "doc_ids": [batch.column("doc_id").to_pylist()], "sizes": [sizes],
                "terms": [b"\n".join(terms)],
                "counts": [np.bincount(ids, minlength=len(terms)).astype("<u4").tobytes()],
                "positions": [np.argsort(ids, kind="stable").astype("<u4").tobytes()],
            }
            yield table(columns, SEGMENTS)
            segment += 1

    return written(docs.select("doc_id", "text").mapInArrow(build, SEGMENTS_SQL), "postings")


class Segment:
    """One row of the index, opened for search."""

    def __init__(self, row: dict):
        self.doc_ids, self.sizes = row["doc_ids"], np.array(row["sizes"], np.int64)
        self.doc_ends = np.cumsum(self.sizes)
        self.terms = row["terms"].split(b"\n") if row["terms"] else []
        self.ends = np.cumsum(np.frombuffer(row["counts"], "<u4").astype(np.int64))
        self.positions = np.frombuffer(row["positions"], "<u4").view(np.int32)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term - 1] if term else 0 : self.ends[term]]


def match(segment: Segment, window: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of exact phrases, positions of the rarest word of proximity matches)."""
    counts = segment.ends[window] - np.where(window > 0, segment.ends[window - 1], 0)
    order = np.argsort(counts, kind="stable")
    rarest = order[0]
    at = segment.postings(window[rarest]).astype(np.int64)
    doc = np.searchsorted(segment.doc_ends, at, "right")
    low = np.maximum(at - near, segment.doc_ends[doc] - segment.sizes[doc])
    high = np.minimum(at + near, segment.doc_ends[doc] - 1)
    for place in order[1:]:
        other = segment.postings(window[place])
        kept = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
        at, low, high = at[kept], low[kept], high[kept]
        if not len(at):
            return at, at
    starts = at - rarest
    doc_start = np.searchsorted(segment.doc_ends, at, "right")
    first = segment.doc_ends[doc_start] - segment.sizes[doc_start]
    starts = starts[(starts >= first) & (starts + len(window) <= segment.doc_ends[doc_start])]
    for place in order[1:]:
        other = segment.postings(window[place])
        there = np.searchsorted(other, starts + place)
        starts = starts[other[np.minimum(there, len(other) - 1)] == starts + place]
    return starts, at


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (window, item) rows of ``items(item_id, text)``; a window joins its words by a blank."""
    schema = pa.schema([("window", pa.binary()), ("item", pa.string())])

    def cut(batches):
        for batch in slices(batches):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = words(text)
                found = {b" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()
                yield table({"window": list(found), "item": [item] * len(found)}, schema)

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(cut, "window binary, item string").distinct()


def _search_block(segments: DataFrame, block: dict[bytes, list[str]], near: int) -> DataFrame:
    """One row per document and block of windows."""

    def search(batches):
        vocabulary = _Terms()
        cut = [np.array([vocabulary[w] for w in window.split(b" ")], np.int64) for window in block]
        owners = list(block.values())
        for batch in slices(batches, "positions"):
            for row in batch.to_pylist():
                segment = Segment(row)
                here = np.full(len(vocabulary) + 1, -1, np.int64)
                for number, term in enumerate(segment.terms):
                    wanted = vocabulary.get(term)
                    if wanted is not None:
                        here[wanted] = number
                spans, items, close = (defaultdict(list), defaultdict(set), defaultdict(set))
                for window, owner in zip(cut, owners):
                    local = here[window]
                    if local.min() < 0:
                        continue
                    starts, at = match(segment, local, near)
                    if not len(at):
                        continue
                    for doc in set(np.searchsorted(segment.doc_ends, at, "right").tolist()):
                        close[doc].update(owner)
                    docs = np.searchsorted(segment.doc_ends, starts, "right").tolist()
                    for doc, start in zip(docs, starts.tolist()):
                        begin = start - int(segment.doc_ends[doc] - segment.sizes[doc])
                        spans[doc].append({"start": begin, "end": begin + len(window)})
                        items[doc].update(owner)
                n = len(segment.doc_ids)
                columns = {
                    "segment": [row["segment"]] * n, "row": range(n), "doc_id": segment.doc_ids,
                    "n_words": segment.sizes, "spans": [_merged(spans.get(i, [])) for i in range(n)],
                    "items": [sorted(items.get(i, ())) for i in range(n)],
                    "near_items": [sorted(close.get(i, ())) for i in range(n)],
                }
                yield table(columns, FOUND)

    return segments.mapInArrow(search, FOUND_SQL)


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: s["start"]):
        if out and span["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], span["end"])
        else:
            out.append(dict(span))
    return out


def _union_of(spans: Column) -> Column:
    """Number of positions covered by overlapping spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )


def search(
    segments: DataFrame, items: DataFrame, width: int = WIDTH, near: int = NEAR,
    windows_per_block: int = WINDOWS_PER_BLOCK,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans (word positions), items, near_items."""
    cut = windows(items, width)
    cut = cut.groupBy("window").agg(F.collect_set("item").alias("items"))
    blocks = max(1, -(-cut.count() // windows_per_block))
    parts = []
    for number in range(blocks):
        rows = cut.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == number).toArrow().to_pylist()
        parts.append(_search_block(segments, {r["window"]: r["items"] for r in rows}, near))
    found = reduce(DataFrame.unionByName, parts)
    if blocks > 1:
        found = found.groupBy("segment", "row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "items", "near_items")],
        )
    return found.select(
        "doc_id", "n_words", _union_of(F.col("spans")).alias("n_hit"), F.array_sort("spans").alias("spans"),
        F.array_sort("items").alias("items"), F.array_sort("near_items").alias("near_items"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; rows without a doc_id stay."""
    hit = search(index(docs), items, width).where("n_hit > 0 and doc_id is not null").select("doc_id")
    hit = written(hit.distinct(), "contaminated")
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_IDS else hit
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
