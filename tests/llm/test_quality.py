import random

import numpy as np

from sessionloom.llm import quality


def examples(n, seed):
    """Label 1: prose of a small vocabulary; label 0: shouting, marks or one word over and over."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tur", "se") for b in ("na", "ret", "sol", "im", "o")]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        if i % 4 == 0:
            words = [words[0]] * 40 if i % 8 else [w.upper() + "!!" for w in words]
        out.append((" ".join(words), int(i % 4 > 0)))
    return out


def test_held_out_accuracy_and_calibration(table, odd_docs, odd_rows, no_docs):
    model = quality.fit(examples(600, 1))
    unseen = examples(400, 2)
    docs = table([(i, t) for i, (t, _) in enumerate(unseen)], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == label for i, (_, label) in enumerate(unseen)]) > 0.97
    assert np.mean([abs(scores[i] - label) for i, (_, label) in enumerate(unseen)]) < 0.1

    # Odd documents, with a column named like an input of the result.
    out = quality.score(odd_docs, model, "quality_score").collect()
    assert len(out) == len(odd_rows) and all(0 <= r["quality_score"] <= 1 for r in out)
    empty = {r["quality_score"] for r in out if not (r["text"] or "").split()}
    assert len(empty) == 1
    assert quality.score(no_docs, model).count() == 0


def test_score_depends_on_the_text_alone(table):
    model = quality.fit(examples(200, 3))
    rows = [(1, "kana loret mi", "en"), (2, "kana loret mi", "de"), (3, "kana loret mi", None)]
    docs = table(rows, "doc_id bigint, text string, lang string")
    assert len({r["score"] for r in quality.score(docs, model).collect()}) == 1


def test_fit_is_the_same_twice():
    a, b = (quality.fit(examples(120, 4)) for _ in range(2))
    assert np.array_equal(a.w1, b.w1) and a.temperature == b.temperature


def test_without_labels_or_with_one_class(table):
    docs = table([(1, "a b"), (2, None)], "doc_id bigint, text string")
    for known, want in (([], 0.5), ([("a", 1), ("b", 1)], 1.0), ([("a", 0)], 0.0)):
        assert {r["score"] for r in quality.score(docs, quality.fit(known)).collect()} == {want}


def test_sample_is_bounded_and_clean(table):
    docs = table([(i, f"text {i}") for i in range(50)] + [(60, None), (61, "x" * 30_000)], "doc_id bigint, text string")
    labels = table([(i, i % 2) for i in range(50)] + [(3, 1), (7, None), (8, 5), (60, 1), (61, 1), (None, 1)], "doc_id bigint, quality int")
    assert len(quality.sample(docs, labels, 20)) == 20
    assert len(quality.sample(docs, labels)) == 50
    assert quality.sample(docs, labels.limit(0)) == []


def test_shapes():
    assert len({quality.Tokens.shape(w) for w in ("word", "Word", "WORD", "wOrd", "w0rd", "word,", "WORD!!")}) == 7
