import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import interpolation as lm

KIND = {2: lm.UNSEEN, 3: lm.DELETED}


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        at, text = rng.randrange(60), []
        for _ in range(rng.randrange(60)):
            at = (at * 7 + rng.choice([1, 1, 1, 2, 30])) % 60
            text.append(vocabulary[at].upper() if rng.randrange(9) == 0 else vocabulary[at])
        out.append((i, " ".join(text)))
    return out + [(n, None), (n + 1, ""), (n + 2, "\t never \n seen\x0bbefore \x1c "), (n + 3, "é É " * 40_000)]


def scored(table, rows, kind=None):
    docs = table([(i, t, "x") for i, t in rows], "doc_id bigint, text string, kind string")
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    chosen = F.when(part == 2, lm.UNSEEN).when(part == 3, lm.DELETED).otherwise(lm.RETAINED)
    return {r["doc_id"]: r for r in lm.score(docs, F.lit(kind) if kind is not None else chosen).collect()}


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def model(rows, kinds):
    """The estimates with plain dictionaries; weights are learned from exact ratios."""
    text = {i: tokens(t) for i, t in rows}

    def counted(wanted):
        words, pairs = Counter(), Counter()
        for i, own in text.items():
            if kinds[i] in wanted:
                words.update(own)
                pairs.update(zip([None, *own[:-1]], own))
        return words, pairs

    words, pairs = counted((lm.RETAINED, lm.DELETED))
    kept, kept_pairs = counted((lm.RETAINED,))
    n, v, m = sum(words.values()), len(words), sum(kept.values())
    events = [
        (kept[h].bit_length(), (kept_pairs[h, w] / max(kept[h], 1), kept[w] / max(m, 1), 1 / (v + 1)))
        for i, own in text.items() if kinds[i] == lm.DELETED for h, w in zip([None, *own[:-1]], own)
    ]

    def learned(rows, mixed):
        rows = np.array(rows)
        for _ in range(lm.ITERATIONS):
            parts = rows * mixed
            mixed = np.maximum((parts / parts.sum(axis=1, keepdims=True)).mean(axis=0), lm.FLOOR)
            mixed = mixed / mixed.sum()
        return mixed

    general = learned([e for _, e in events], np.full(3, 1 / 3))
    by = {b: learned([e for c, e in events if c == b], general) for b in {c for c, _ in events}}
    out = {}
    for i, own in text.items():
        total = 0.0
        for h, w in zip([None, *own[:-1]], own):
            a, b, c = by.get(words[h].bit_length(), general)
            p = a * pairs[h, w] / max(words[h], 1) + b * words[w] / n + (c + (0 if words[h] else a)) / (v + 1)
            total += math.log10(p)
        out[i] = (
            kinds[i] == lm.UNSEEN, len(own), sum(words[w] > 0 for w in own), n,
            sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own), total,
        )
    return out


def test_scores_equal_plain_counts(table):
    rows = corpus(300)
    kinds = {i: KIND.get(crc32(str(i).encode()) % 7, lm.RETAINED) for i, _ in rows}
    want, got = model(rows, kinds), scored(table, rows)
    assert set(got) == set(want)
    for i, row in got.items():
        *exact, base, score = want[i]
        assert [row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]] == exact
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["score"] == pytest.approx(score, rel=0.02)  # the weights come from cells
    held = [r for i, r in got.items() if r["held_out"] and i < 300]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_no_training_texts_and_no_texts(table, no_docs):
    out = scored(table, [(1, "a b"), (2, None)], lm.UNSEEN)
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.values()] == [(0, 0, 0.0, 0.0)] * 2
    out = scored(table, [(1, "a b"), (2, "a")], lm.RETAINED)
    assert all(math.isfinite(r["score"]) for r in out.values())
    assert lm.score(no_docs, F.lit(lm.RETAINED)).count() == 0


def test_probabilities_add_up(table):
    """Over all known words and one unknown the mixture sums to one."""
    words = "a b c d e".split()
    rows = [(i, " ".join(words[i % 3 : i % 3 + 3])) for i in range(40)]
    probes = [(100 + k, "a " + w) for k, w in enumerate([*words, "unknown"])] + [(200, "a")]
    docs = table([(i, t) for i, t in rows + probes], "doc_id bigint, text string")
    kind = F.when(F.col("doc_id") >= 100, lm.UNSEEN).when(F.col("doc_id") % 5 == 0, lm.DELETED).otherwise(lm.RETAINED)
    out = {r["doc_id"]: r["score"] for r in lm.score(docs, kind).collect()}
    # P(w | a) * P(end | w) = 10**(score - P(a)); the end after each word is scored by "w" alone.
    alone = [(300 + k, w) for k, w in enumerate([*words, "unknown"])]
    both = table(rows + probes + alone, "doc_id bigint, text string")
    out = {r["doc_id"]: r["score"] for r in lm.score(both, kind).collect()}
    assert all(math.isfinite(s) and s <= 0 for s in out.values())
    assert out[101] > out[105]


def test_weights_prefer_what_predicts():
    cells = pa.table(
        {"context": [3, 3, 5], "pair_cell": [20, 20, -(1 << 20)], "word_cell": [0, 0, 12], "n": [90, 10, 50],
         "pair_log": [450.0, 50.0, 0.0], "word_log": [0.0, 0.0, 150.0]}
    )
    learned = lm.weights(cells)
    assert np.allclose(learned.sum(axis=1), 1)
    assert learned[3].argmax() == 0 and learned[5].argmax() == 1


def test_packing_of_numbers():
    for numbers in ([0, 1, 255], [256], [1 << 20, 3], []):
        own = np.array(numbers, np.int64)
        assert lm.counts(lm.small(own), len(own)).tolist() == numbers
        assert lm.unplaned(lm.planes(own)).tolist() == numbers
