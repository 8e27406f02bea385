"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

A token is a blank-separated word. Frequent words of the sample are tokens of their
own, all others stand for their shape (case, letters only or not, closing
punctuation); a word equal to the one before it adds a token of its own. Each token has a sparse random index vector fixed by its hash; its
word vector sums the index vectors of its neighbours in the sample, scaled to unit
length, plus its own. A document is pooled as mean and spread of its tokens'
vectors. Two layers in numpy give a logit, which a temperature fitted on a part of
the sample that the network did not see turns into a probability.

Only the fit is bounded: ``SAMPLE_ROWS`` labelled documents, those with the smallest id
hashes, whose texts have at most ``SAMPLE_CHARS`` characters. Scoring reads every
document whole. Labels, language, source and id are no inputs of a score.

Cases: a null or empty text pools to zeros and gets the score of that; repeated
label rows count once, rows with another quality than 0 or 1 not at all; without
labels of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from operator import eq
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.tokens import PUNCTUATION
from sessionloom.llm.workers import slices

SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 20_000
WORDS, SHAPES, WIDTH, ONES, REACH = 16_000, 4_096, 64, 8, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 48, 60, 128, 2e-3, 1e-4
KEPT_WORDS = 200_000
POOL_ROWS = 1 << 15


class Model(NamedTuple):
    words: dict[str, int]
    vectors: np.ndarray  # per token: vector and its square
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None


def share(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


class Tokens(dict):
    """Token numbers of words; words of no number of their own get their shape's."""

    AGAIN = WORDS + SHAPES

    def __init__(self, words: dict[str, int]):
        super().__init__(words)
        self.room = KEPT_WORDS

    @staticmethod
    def shape(word: str) -> str:
        core = word.rstrip(PUNCTUATION)
        case = "x" if core.islower() else "X" if core.isupper() else "Xx" if core.istitle() else "-"
        return case + ("" if core.isalpha() else "?") + word[len(core) :][:3]

    def __missing__(self, word: str) -> int:
        number = WORDS + crc32(self.shape(word).encode()) % SHAPES
        if self.room > 0:
            self.room -= 1
            self[word] = number
        return number

    def numbers(self, text: str | None) -> np.ndarray:
        """Tokens in order, then one more token for each word equal to the one before it."""
        words = (text or "").split()
        again = sum(map(eq, words[1:], words))
        return np.array([self[w] for w in words] + [self.AGAIN] * again, np.int64)


def index_vectors() -> np.ndarray:
    """A few +1 and -1 per token number, the same in every run."""
    rng = np.random.default_rng(7)
    out = np.zeros((WORDS + SHAPES + 1, WIDTH), np.float32)
    places = rng.integers(0, WIDTH, (len(out), ONES))
    out[np.arange(len(out))[:, None], places] = rng.choice(np.float32([-1, 1]), places.shape)
    return out / np.float32(np.sqrt(ONES))


def word_vectors(texts: list[np.ndarray]) -> np.ndarray:
    """Random indexing: neighbours' index vectors summed within each text."""
    own = index_vectors()
    context = np.zeros_like(own)
    stream = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for reach in range(1, REACH + 1):
        same = owner[reach:] == owner[:-reach]
        left, right = stream[:-reach][same], stream[reach:][same]
        for token, neighbour in ((left, right), (right, left)):
            order = np.argsort(token, kind="stable")
            token, neighbour = token[order], neighbour[order]
            for at in range(0, len(token), 1 << 17):
                here = token[at : at + (1 << 17)]
                starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                context[here[starts]] += np.add.reduceat(own[neighbour[at : at + (1 << 17)]], starts)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    vectors = context + own
    return np.concatenate([vectors, vectors**2], axis=1)


def pool(numbers: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the tokens' vectors."""
    total = np.zeros(2 * WIDTH)
    for at in range(0, len(numbers), POOL_ROWS):
        here = vectors[numbers[at : at + POOL_ROWS]]
        total += np.ones(len(here), np.float32) @ here
    total /= max(1, len(numbers))
    mean = total[:WIDTH]
    return np.concatenate([mean, np.sqrt(np.maximum(total[WIDTH:] - mean**2, 0))])


def logits(model: Model, pooled: np.ndarray) -> np.ndarray:
    x = (pooled - model.shift) / model.scale
    return np.maximum(x @ model.w1 + model.b1, 0) @ model.w2 + model.b2


def probability(model: Model, pooled: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(model, pooled) / model.temperature, -500, 500)))


def _train(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Two layers by Adam on the log loss."""
    rng = np.random.default_rng(11)
    weights = [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    x = (x - model.shift) / model.scale
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            hidden = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            out = hidden @ weights[2] + weights[3]
            error = (1 / (1 + np.exp(-np.clip(out, -500, 500))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (hidden > 0)
            slopes = [x[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True)]
            step += 1
            for i, slope in enumerate(slopes):
                slope = slope + DECAY * weights[i]
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[i] -= rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    return model._replace(w1=weights[0], b1=weights[1], w2=weights[2], b2=float(weights[3][0]))


def _temperature(out: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    loss = [np.mean(np.logaddexp(0, out / t) - y * out / t) for t in choices]
    return float(choices[int(np.argmin(loss))])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """(text, label) of the labelled rows to fit on, at most ``rows``."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    texts = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    # The ids are chosen on narrow rows; at most ``rows`` of them are broadcast to the texts.
    known = known.join(texts.select("doc_id").distinct(), "doc_id")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r["text"], r["label"]) for r in found.orderBy("doc_id").select("text", "label").collect()]


def fit(examples: list[tuple[str, int]]) -> Model:
    y = np.array([label for _, label in examples], np.float64)
    none = np.zeros(0)
    if len(set(y.tolist())) < 2:
        return Model({}, none, none, none, none, none, none, 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    counts: dict[str, int] = {}
    for text, _ in examples:
        for word in text.split():
            counts[word] = counts.get(word, 0) + 1
    frequent = sorted((w for w, n in counts.items() if n >= 5), key=lambda w: (-counts[w], w))[:WORDS]
    words = {w: i for i, w in enumerate(frequent)}
    tokens = Tokens(words)
    texts = [tokens.numbers(text) for text, _ in examples]
    vectors = word_vectors(texts)
    x = np.stack([pool(t, vectors) for t in texts])
    model = Model(words, vectors, x.mean(0), x.std(0) + 1e-3, none, none, none, 0.0, 1.0, None)
    seen = np.arange(len(y)) % 5 > 0
    model = _train(model, x[seen], y[seen])
    return model._replace(temperature=_temperature(logits(model, x[~seen]), y[~seen]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1, for whole texts."""
    # At most WORDS + SHAPES vectors of fixed width: about ten megabytes.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def classify(batches):
        model = shared.value
        tokens = Tokens(model.words)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            if model.constant is None:
                # Row by row: the last digits then do not depend on the rows beside it.
                pooled = [pool(tokens.numbers(t), model.vectors)[None] for t in texts]
                scores = np.concatenate([probability(model, row) for row in pooled])
            else:
                scores = np.full(len(texts), model.constant)
            columns = [*batch.columns, pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])

    return docs.mapInArrow(classify, schema)
