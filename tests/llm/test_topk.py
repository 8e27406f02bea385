import math

import numpy as np
import pytest

from sessionloom.llm import topk

NAN, INF = float("nan"), float("inf")


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 100 == 0:
            scored = [(-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in good if i != q]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def searched(table, rows, **options):
    vectors = table(rows, "vec_id bigint, embedding array<float>, label int")
    found = topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("block", [1024, 2])
def test_exact_with_ties_zeros_and_bad_vectors(table, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4.0], i) for i in range(0, 900, 7)]
    rows += [(100 * i, [float(x) for x in rng.normal(size=6)], None) for i in range(1, 6)]
    rows += [(1001, None, 1), (1002, [1.0, None], 1), (1003, [NAN, 1.0], 1), (1004, [INF], 1), (1100, [1.0, NAN], 1), (None, [1.0], 1)]
    rows += [(1005, [], 1), (1006, [2.0], 1), (1007, [1.0] * 9, 1), (1200, [0.5, -0.5], 1), (1300, [0.0] * 6, 1)]
    assert searched(table, rows, queries_per_block=block) == brute([r[:2] for r in rows])


def test_few_rows_and_none(table):
    assert searched(table, [(0, [1.0], 1)]) == []
    assert searched(table, []) == []
    assert searched(table, [(0, [1.0], 1), (3, [2.0], 1), (1, [2.0], 1)]) == [(0, 1, 1, 2**21), (0, 2, 3, 2**21)]


def test_scores_beyond_64_bits_saturate(table):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [-1e30, 0.0], 1), (3, [0.0, 1.0], 1)]
    assert searched(table, rows) == brute([r[:2] for r in rows])


def test_slices_are_merged(table, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(0, 2, 3)], 0) for i in range(400)]
    monkeypatch.setattr(topk, "ROWS_PER_SLICE", 17)
    assert searched(table, rows, k=25) == brute([r[:2] for r in rows], 25)
