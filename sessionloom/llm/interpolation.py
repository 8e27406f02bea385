"""Language-model scores by deleted interpolation of n-gram estimates.

    P(w | h) = a_b * c(h,w)/c(h) + b_b * c(w)/N + c_b / (V + 1)

The mixture weights belong to the bucket b of the context's frequency, log2 of c(h).
They are learned by expectation-maximisation on the deleted part of the training
texts, with counts from the retained part.

Counting and looking up go through packed rows. A task numbers the distinct words of
a bounded batch of documents, and sends the hashes of its distinct words and word
pairs, with their counts in the batch, to hashed buckets; a bucket adds them up and
answers each batch in the same order. A frequent word or pair is one entry per
batch, so no bucket is hot. The batches wait in a table bucketed by batch number, so
that only the answers are shuffled. For the weights each deleted token falls into a
cell (context bucket, size of both estimates); the cells are few whatever the data.

Words are told apart by 48 bits of hash besides their bucket's, pairs by 40; the
number of buckets grows with the data.

Cases: a null or empty text is the end token alone; repeated documents count as
often as they come; without training texts every estimate is 1 / (V + 1) = 1; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.packing import written
from sessionloom.llm.shingles import mix, words
from sessionloom.llm.workers import slices, table, utf8

RETAINED, DELETED, UNSEEN = 0, 1, 2
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
END = mix(np.array([1], np.uint64), 7)[0]
WORD_BYTES, PAIR_BYTES = 6, 5
CELLS_PER_OCTAVE = 4
ITERATIONS, FLOOR = 200, 1e-6
CONTEXTS = 64

BATCHES = pa.schema(
    [("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("kinds", pa.binary()), ("sizes", pa.list_(pa.int64())),
     ("vocabulary", pa.binary()), ("tokens", pa.binary()), ("retained", pa.int64()), ("deleted", pa.int64())]
)
BATCHES_SQL = (
    "batch bigint, doc_ids array<bigint>, kinds binary, sizes array<bigint>, vocabulary binary, tokens binary, "
    "retained bigint, deleted bigint"
)
REQUESTS = pa.schema(
    [("bucket", pa.int32()), ("batch", pa.int64())]
    + [(n, pa.binary()) for n in ("words", "word_all", "word_deleted", "pairs", "pair_all", "pair_deleted")]
)
REQUESTS_SQL = (
    "bucket int, batch bigint, words binary, word_all binary, word_deleted binary, "
    "pairs binary, pair_all binary, pair_deleted binary"
)
ANSWERS = ("word_all", "word_deleted", "pair_all", "pair_deleted")
REPLIES = pa.schema(
    [("bucket", pa.int32()), ("batch", pa.int64()), ("entries", pa.list_(pa.int64()))]
    + [(n, pa.binary()) for n in ANSWERS] + [("distinct", pa.int64())]
)
REPLIES_SQL = (
    "bucket int, batch bigint, entries array<bigint>, " + ", ".join(f"{n} binary" for n in ANSWERS) + ", distinct bigint"
)
CELLS = pa.schema(
    [("context", pa.int32()), ("pair_cell", pa.int32()), ("word_cell", pa.int32()), ("n", pa.int64()),
     ("pair_log", pa.float64()), ("word_log", pa.float64())]
)
CELLS_SQL = "context int, pair_cell int, word_cell int, n bigint, pair_log double, word_log double"
SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
SCORES_SQL = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with equal bytes together, which compresses well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def small(numbers: np.ndarray) -> bytes:
    """Counts in a byte each; those above 254 follow in full."""
    few = np.minimum(numbers, 255).astype(np.uint8)
    return few.tobytes() + numbers[few == 255].astype("<u8").tobytes()


def counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n)
    return out


def short(hashes: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def long(raw: list[bytes], size: int) -> np.ndarray:
    few = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, size)
    out = np.zeros((len(few), 8), np.uint8)
    out[:, :size] = few
    return out.view(np.uint64)[:, 0]


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so hash order is bucket order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Batch:
    """The tokens of a batch row: distinct words in hash order, pairs in hash order."""

    def __init__(self, row: dict):
        self.doc_ids, self.sizes = row["doc_ids"], np.array(row["sizes"], np.int64)
        self.kinds = np.frombuffer(row["kinds"], np.uint8)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.word = unplaned(row["tokens"])
        self.kind = np.repeat(self.kinds, self.sizes)
        self.stops = np.cumsum(self.sizes)
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]  # the end token stands before each text
        self.before[0] = self.word[-1]
        distinct, place = np.unique(self.before * len(self.vocabulary) + self.word, return_inverse=True)
        left, right = self.vocabulary[distinct // len(self.vocabulary)], self.vocabulary[distinct % len(self.vocabulary)]
        hashes = mix(left * np.uint64(0xD6E8FEB86659FD93) + mix(right, 8), 9)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.pairs, self.pair = hashes[order], rank[place]


def batches(docs: DataFrame) -> DataFrame:
    """The batch table, from ``docs(doc_id, text, kind)``; stored by batch number."""

    def number(rows):
        batch = TaskContext.get().partitionId() << 32
        for piece in slices(rows, limit=BATCH_BYTES):
            hashes, owner = words(*utf8(piece.column("text")))
            n = piece.num_rows
            sizes = np.bincount(owner, minlength=n) + 1
            stream = np.full(len(hashes) + n, END, np.uint64)
            stream[np.arange(len(hashes)) + owner] = hashes
            vocabulary, tokens = np.unique(stream, return_inverse=True)
            kinds = piece.column("kind").to_numpy(zero_copy_only=False).astype(np.uint8)
            columns = {
                "batch": [batch], "doc_ids": [piece.column("doc_id").to_pylist()], "sizes": [sizes],
                "kinds": [kinds.tobytes()], "retained": [sizes[kinds == RETAINED].sum()],
                "deleted": [sizes[kinds == DELETED].sum()],
                "vocabulary": [vocabulary.tobytes()], "tokens": [planes(tokens)],
            }
            yield table(columns, BATCHES)
            batch += 1

    spark = docs.sparkSession
    name = f"sessionloom_batches_{uuid.uuid4().hex}"
    rows = docs.select("doc_id", "text", "kind").mapInArrow(number, BATCHES_SQL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").option("compression", "zstd").bucketBy(parts, "batch").saveAsTable(name)
    return spark.table(name)


def _counted(stored: DataFrame, buckets: int) -> DataFrame:
    """Answers to every batch, and the number of distinct training words of each bucket."""

    def ask(rows):
        for piece in slices(rows, "tokens", BATCH_BYTES):
            for row in piece.to_pylist():
                batch = Batch(row)
                trained, deleted = batch.kind != UNSEEN, batch.kind == DELETED
                n, m = len(batch.vocabulary), len(batch.pairs)
                found = {
                    "word_all": np.bincount(batch.word[trained], minlength=n),
                    "word_deleted": np.bincount(batch.word[deleted], minlength=n),
                    "pair_all": np.bincount(batch.pair[trained], minlength=m),
                    "pair_deleted": np.bincount(batch.pair[deleted], minlength=m),
                }
                grid = np.arange(buckets + 1)
                cuts = np.searchsorted(buckets_of(batch.vocabulary, buckets), grid)
                pair_cuts = np.searchsorted(buckets_of(batch.pairs, buckets), grid)
                used = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(pair_cuts) > 0))
                columns = {name: [] for name in REQUESTS.names}
                for b in used.tolist():
                    w, p = slice(cuts[b], cuts[b + 1]), slice(pair_cuts[b], pair_cuts[b + 1])
                    columns["bucket"].append(b)
                    columns["batch"].append(row["batch"])
                    columns["words"].append(short(batch.vocabulary[w], WORD_BYTES))
                    columns["pairs"].append(short(batch.pairs[p], PAIR_BYTES))
                    for name in ANSWERS:
                        columns[name].append(small(found[name][w if name.startswith("word") else p]))
                yield table(columns, REQUESTS)

    def answer(key, group):
        rows = group.to_pylist()
        columns = {name: [] for name in REPLIES.names}
        totals = {}
        for side, size in (("word", WORD_BYTES), ("pair", PAIR_BYTES)):
            raw = [r[side + "s"] for r in rows]
            ends = np.cumsum([len(x) // size for x in raw])
            _, place = np.unique(long(raw, size), return_inverse=True)
            for name in (f"{side}_all", f"{side}_deleted"):
                own = np.concatenate([counts(r[name], len(x) // size) for r, x in zip(rows, raw)])
                total = np.bincount(place, weights=own).astype(np.int64) if len(place) else own
                if name == "word_all":
                    distinct = int((total > 0).sum())
                totals[name] = np.split(total[place], ends[:-1])
        for i, row in enumerate(rows):
            columns["bucket"].append(row["bucket"])
            columns["batch"].append(row["batch"])
            columns["entries"].append([len(totals["word_all"][i]), len(totals["pair_all"][i])])
            columns["distinct"].append(distinct if i == 0 else 0)
            for name in ANSWERS:
                columns[name].append(small(totals[name][i]))
        return pa.table(columns, REPLIES)

    asked = stored.mapInArrow(ask, REQUESTS_SQL)
    return written(asked.groupBy("bucket").applyInArrow(answer, REPLIES_SQL), "counts")


def _answered(stored: DataFrame, replies: DataFrame, answers: tuple[str, ...]) -> DataFrame:
    """Every batch with its answers; a batch has one answer per bucket, of bounded size together."""
    packed = replies.groupBy("batch").agg(
        F.collect_list(F.struct("bucket", "entries", *answers)).alias("replies")
    )
    return stored.join(packed, "batch")


def _opened(row: dict) -> tuple[Batch, dict[str, np.ndarray]]:
    replies = sorted(row["replies"], key=lambda r: r["bucket"])
    found = {
        name: np.concatenate([counts(r[name], r["entries"][name.startswith("pair")]) for r in replies])
        for name in ANSWERS
        if name in replies[0]
    }
    return Batch(row), found


def context_bucket(n: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + log2 of its count."""
    return np.where(n > 0, np.frexp(np.maximum(n, 1).astype(np.float64))[1], 0)


def _cells(answered: DataFrame, retained: int, distinct: int) -> DataFrame:
    """Deleted tokens per cell, from the retained counts; estimates relative to 1 / (V + 1)."""

    def fill(rows):
        for piece in rows:
            for row in piece.to_pylist():
                batch, found = _opened(row)
                at = batch.kind == DELETED
                word = (found["word_all"] - found["word_deleted"])
                here, before = word[batch.word[at]], word[batch.before[at]]
                pair = (found["pair_all"] - found["pair_deleted"])[batch.pair[at]]
                ratios = [
                    pair / np.maximum(before, 1) * (distinct + 1), here / max(retained, 1) * (distinct + 1)
                ]
                logs = [np.log2(np.where(r > 0, r, 1)) for r in ratios]
                cell = [
                    np.where(r > 0, np.floor(x * CELLS_PER_OCTAVE), -(1 << 20)).astype(np.int64)
                    for r, x in zip(ratios, logs)
                ]
                keys = np.stack([context_bucket(before), *cell], axis=1)
                kinds, place = np.unique(keys, axis=0, return_inverse=True)
                place = place.reshape(-1)
                columns = {
                    "context": kinds[:, 0], "pair_cell": kinds[:, 1], "word_cell": kinds[:, 2],
                    "n": np.bincount(place, minlength=len(kinds)),
                    "pair_log": np.bincount(place, logs[0], len(kinds)),
                    "word_log": np.bincount(place, logs[1], len(kinds)),
                }
                yield table(columns, CELLS)

    cells = answered.mapInArrow(fill, CELLS_SQL)
    return cells.groupBy("context", "pair_cell", "word_cell").agg(
        F.sum("n").alias("n"), F.sum("pair_log").alias("pair_log"), F.sum("word_log").alias("word_log")
    )


def weights(cells: pa.Table) -> np.ndarray:
    """(context bucket, [pair, word, uniform]) by expectation-maximisation."""
    context = cells.column("context").to_numpy()
    n = cells.column("n").to_numpy().astype(np.float64)
    estimates = np.ones((len(n), 3))
    for i, side in enumerate(("pair", "word")):
        seen = cells.column(f"{side}_cell").to_numpy() > -(1 << 20)
        estimates[:, i] = np.where(seen, np.exp2(cells.column(f"{side}_log").to_numpy() / np.maximum(n, 1)), 0)

    def learned(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        mixed = start
        for _ in range(ITERATIONS):
            parts = estimates[rows] * mixed
            mixed = (parts / parts.sum(axis=1, keepdims=True) * n[rows, None]).sum(axis=0) / n[rows].sum()
            mixed = np.maximum(mixed, FLOOR)
            mixed = mixed / mixed.sum()
        return mixed

    even = np.full(3, 1 / 3)
    general = learned(np.arange(len(n)), even) if len(n) else even
    out = np.tile(general, (CONTEXTS + 1, 1))
    for bucket in np.unique(context).tolist():
        out[bucket] = learned(np.flatnonzero(context == bucket), general)
    return out


def _scores(answered: DataFrame, mixture: np.ndarray, trained: int, distinct: int) -> DataFrame:
    def rate(rows):
        for piece in rows:
            for row in piece.to_pylist():
                batch, found = _opened(row)
                here, before = found["word_all"][batch.word], found["word_all"][batch.before]
                pair = found["pair_all"][batch.pair]
                mixed = mixture[context_bucket(before)]
                likely = mixed[:, 0] * pair / np.maximum(before, 1) + mixed[:, 1] * here / max(trained, 1)
                # What an estimate without counts leaves goes to the uniform one.
                likely += (mixed[:, 2] + np.where(before > 0, 0, mixed[:, 0]) + (0 if trained else mixed[:, 1])) / (
                    distinct + 1
                )
                starts = batch.stops - batch.sizes
                columns = {
                    "doc_id": batch.doc_ids, "held_out": batch.kinds == UNSEEN, "n_tokens": batch.sizes,
                    "n_known": np.add.reduceat((here > 0).astype(np.int64), starts),
                    "train_tokens": np.full(len(starts), trained),
                    "base_score": np.add.reduceat(np.log10((here + 1) / (trained + distinct + 1)), starts),
                    "score": np.add.reduceat(np.log10(likely), starts),
                }
                yield table(columns, SCORES)

    return answered.mapInArrow(rate, SCORES_SQL)


def score(docs: DataFrame, kind: Column) -> DataFrame:
    """Scores of ``docs(doc_id, text)``; ``kind`` is RETAINED, DELETED or UNSEEN for each row."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    stored = batches(docs.select("doc_id", "text", kind.cast("int").alias("kind")))
    replies = _counted(stored, max(1, size // BUCKET_BYTES))
    totals = stored.agg(F.sum("retained").alias("retained"), F.sum("deleted").alias("deleted")).first()
    retained, deleted = totals["retained"] or 0, totals["deleted"] or 0
    distinct = replies.agg(F.sum("distinct").alias("n")).first()["n"] or 0
    mixture = weights(_cells(_answered(stored, replies, ANSWERS), retained, distinct).toArrow())
    answered = _answered(stored, replies, ("word_all", "pair_all"))
    return _scores(answered, mixture, retained + deleted, distinct)
