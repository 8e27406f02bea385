"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Components become integers, ``floor(scale * x)`` of the double value. Queries
are taken in blocks of bounded size, so a block can go to every task. A task
turns its candidates, a bounded slice at a time, into postings per dimension;
each non-zero component of a query row scatters its weighted posting list into
that row's dense scores. The best k of a slice are merged with the task's best so
far, and the tasks' lists are merged by rank.

Cases: a vector that is null or holds a null or non-finite component takes no
part; vectors of other lengths count as padded with zeros; ties go to the smaller
id; a query never meets rows of its own id; fewer than k candidates give fewer
rows; scores that leave 64 bits saturate.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.workers import table

QUERIES_PER_BLOCK = 1024
ROWS_PER_SLICE = 2048
LONG = np.iinfo(np.int64)
PARTIAL = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
PARTIAL_SQL = "row bigint, vec_id bigint, score bigint"


def finite(vector: str):
    """Condition: the vector and all its components are there and finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good, F.lit(False))


def as_integers(column: pa.Array, width: int | None, scale: int) -> np.ndarray:
    """Rows as an integer matrix; Python integers where 64 bits could overflow."""
    column = column.cast(pa.large_list(pa.float64()))
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0)) if width is None else width
    values = np.floor(scale * column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]])
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)
    if np.abs(values).max(initial=0.0) >= 2.0**31:
        matrix = np.zeros((len(column), width), object)
        values = np.array([int(v) for v in values], object)
    else:
        matrix = np.zeros((len(column), width), np.int64)
        values = values.astype(np.int64)
    kept = place < width
    matrix[row[kept], place[kept]] = values[kept]
    return matrix


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of every query row against every candidate row, one dimension at a time."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    kind = np.int64 if most < LONG.max else object
    queries, rows = queries.astype(kind), rows.astype(kind)
    scores = np.zeros((len(queries), len(rows)), kind)
    for term in range(rows.shape[1]):
        posting = np.flatnonzero(rows[:, term])
        weights = rows[posting, term]
        asking = np.flatnonzero(queries[:, term])
        whole = len(posting) == len(rows)
        for q in asking:
            if whole:
                scores[q] += queries[q, term] * weights
            else:
                scores[q, posting] += queries[q, term] * weights
    return scores if kind is np.int64 else np.clip(scores, LONG.min, LONG.max).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
        ids, scores = ids[kept], scores[kept]
    order = np.lexsort((ids, np.negative(scores.astype(object)) if scores.min(initial=0) == LONG.min else -scores))[:k]
    return ids[order], scores[order]


def _searched(candidates: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, scale: int) -> DataFrame:
    def search(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_SLICE):
                piece = batch.slice(at, ROWS_PER_SLICE)
                row_ids = piece.column("vec_id").to_numpy(zero_copy_only=False)
                scores = accumulate(matrix, as_integers(piece.column("vector"), matrix.shape[1], scale))
                for q, own in enumerate(ids):
                    here = best(row_ids[row_ids != own], scores[q][row_ids != own], k)
                    found[q] = best(*(np.concatenate(pair) for pair in zip(found[q], here)), k)
        rows = np.repeat(np.arange(len(ids)), [len(f[0]) for f in found])
        yield table(
            {
                "row": rows,
                "vec_id": np.concatenate([f[0] for f in found]) if len(ids) else rows,
                "score": np.concatenate([f[1] for f in found]) if len(ids) else rows,
            },
            PARTIAL,
        )

    partial = candidates.mapInArrow(search, PARTIAL_SQL)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = candidates.sparkSession.createDataFrame(
        pa.table({"row": pa.array(range(len(ids)), pa.int64()), "query_id": pa.array(ids, pa.int64())})
    )
    return ranked.join(F.broadcast(names), "row").select("query_id", "rank", "vec_id", "score")


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score; both inputs have vec_id and embedding."""

    def prepared(df: DataFrame) -> DataFrame:
        known = F.col("vec_id").isNotNull() & finite("embedding")
        return df.where(known).select("vec_id", F.col("embedding").alias("vector"))

    queries, candidates = prepared(queries), prepared(candidates)
    blocks = max(1, -(-queries.count() // queries_per_block))
    results = []
    for number in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow()
        vectors = block.column("vector").combine_chunks()
        matrix = as_integers(vectors, None, scale)
        results.append(_searched(candidates, block.column("vec_id").to_numpy(), matrix, k, scale))
    return reduce(DataFrame.unionByName, results)
