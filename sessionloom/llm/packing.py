"""Concatenate and cut: documents as one token stream, cut into sequences of fixed length.

Each task tokenises its documents once, writes the ids with their place among the
task's own tokens, and so yields its total. Prefix sums over the totals, one row
per task, give every document its place in the whole stream; fixed windows then
cut it, and a document that crosses a window boundary gets one piece on each side.
All sequences but the last are full.

Cases: a null or empty text is its end id alone; a text longer than a sequence has
many pieces; repeated documents are packed as often as they come; no documents,
no pieces.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.tokens import encoder
from sessionloom.llm.workers import slices, table
from sessionloom.session import shared_folder

LENGTH = 2048
TOKENISED = pa.schema(
    [("part", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("ids", pa.binary())]
)
TOKENISED_SQL = "part int, doc_id bigint, place bigint, size bigint, ids binary"
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)
PIECES_SQL = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, compressed, to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenised(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """One row per document: its ids (16 bits each where the vocabulary allows) and place in its task."""

    def encode(batches):
        coder, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = [coder.ids(text, end) for text in batch.column("text").to_pylist()]
            sizes = np.array([len(i) for i in ids], np.int64)
            places = place + np.cumsum(sizes) - sizes
            place += int(sizes.sum())
            columns = {
                "part": np.full(len(ids), part, np.int32), "doc_id": batch.column("doc_id"),
                "place": places, "size": sizes, "ids": [i.tobytes() for i in ids],
            }
            yield table(columns, TOKENISED)

    return written(docs.select("doc_id", "text").mapInArrow(encode, TOKENISED_SQL), "tokens")


def with_global_place(rows: DataFrame, size: str = "size") -> DataFrame:
    """Add ``before``: tokens of all tasks before the row's own ``part``.

    The table of totals has one row per task of the first pass, so its size is that
    of Spark's own task list, whatever the data; it is broadcast.
    """
    totals = rows.groupBy("part").agg(F.sum(size).alias("_total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part")


def pack(docs: DataFrame, tokenizer: str, end: int = 1, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids for each piece.

    ``ids`` are little-endian unsigned 32-bit integers.
    """

    def cut(batches):
        for batch in slices(batches, "ids"):
            columns = {field.name: [] for field in PIECES}
            for row in batch.to_pylist():
                size, raw = row["size"], row["ids"]
                ids = np.frombuffer(raw, f"<u{len(raw) // size}").astype("<u4")
                first = row["before"] + row["place"]
                for sequence in range(first // length, (first + size - 1) // length + 1):
                    begin = max(sequence * length, first)
                    stop = min((sequence + 1) * length, first + size)
                    piece = (row["doc_id"], begin - first, stop - begin, size, sequence, begin - sequence * length,
                             ids[begin - first : stop - first].tobytes())
                    for name, value in zip(columns, piece):
                        columns[name].append(value)
            yield table(columns, PIECES)

    placed = with_global_place(tokenised(docs, tokenizer, end))
    return placed.mapInArrow(cut, PIECES_SQL)
