import random

import numpy as np
import pytest

from sessionloom.llm import near
from sessionloom.llm.components import components
from sessionloom.llm.shingles import sets


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, num, den):
    """Union-find over all pairs of rows."""
    own = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(own)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = own[i], own[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(own[i]), root(i)) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"] * rng.randrange(2)
    return words


def variants(seed, sizes, copies, edits):
    """Groups of edited copies, around and below the threshold, and plain copies."""
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        base = [f"w{rng.randrange(10**5)}" for _ in range(size)]
        for _ in range(copies):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(edits + size // 25 + 1)))))
        rows.append((len(rows), " ".join(base).upper()))
        rows.append((len(rows), "  " + "\t".join(base) + "\n"))
    return rows


@pytest.mark.parametrize("width, num, den", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_components_equal_brute_force(table, width, num, den):
    rows = variants(width, [3, 4, 6, 7, 9, 14, 22, 40, 75, 160, 400, 900], 14, 3)
    rows += [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "a"), (10_004, "A"), (10_005, "a b"), (10_006, None)]
    docs = table(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(docs, width, num, den).collect()}
    assert out == brute(rows, width, num, den)


def test_large_groups_lose_no_link(table, monkeypatch):
    # Chains in which far ends do not link, all in groups above the small size.
    monkeypatch.setattr(near, "SMALL_GROUP", 2)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows, words = [], base
    for i in range(60):
        rows.append((i, " ".join(words)))
        words = edited(rng, words, 2)
    docs = table(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(docs).collect()}
    assert out == brute(rows, 4, 85, 100)


def test_large_groups_are_compared_in_bounded_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_ROWS", 20)
    rows = [(1, i, i if i % 3 else 0) for i in range(300)] + [(2, i, i if i % 3 else 0) for i in range(300)]
    rows += [(3, i, 7) for i in range(50)] + [(4, i, i % 2) for i in range(9)]
    blocks = near._blocks(table(rows, "large bigint, node bigint, component bigint")).collect()
    assert {r["large"] for r in blocks} == {1, 4}  # group 2 has the members of 1, group 3 one component
    calls = {}
    for r in blocks:
        calls.setdefault((r["large"], r["low"], r["high"]), []).append(r)
    assert max(map(len, calls.values())) < 4 * 20
    met = {
        (k[0], min(x["node"], y["node"]), max(x["node"], y["node"]))
        for k, own in calls.items() for x in own for y in own if x["cell"] == k[1] and y["cell"] == k[2]
    }
    part = {(g, n): c for g, n, c in rows}
    for g, n in ((1, 300), (4, 9)):
        for a in range(n):
            for b in range(a):
                assert part[g, a] == part[g, b] or (g, b, a) in met


def test_groups_of_one_first_member_are_taken_together(table):
    alike = [(0, b, g) for g in range(1, 6) for b in range(1, 20 + g)]
    apart = [(100, 1000 * g + b, 10 * g) for g in range(1, 6) for b in range(20)]
    groups = {}
    for r in near._members(table(alike + apart + [(7, 8, None)], "a bigint, b bigint, large bigint")).collect():
        groups.setdefault(r["large"], []).append(r["node"])
    assert sorted(map(sorted, groups.values())) == sorted(
        [list(range(25)), *([100, *range(1000 * g, 1000 * g + 20)] for g in range(1, 6))]
    )


def test_large_groups_of_far_copies_give_few_rows(table, monkeypatch):
    # Copies with words of their own: they share many keys, and few or none of them link.
    met, written = [], near.written
    monkeypatch.setattr(near, "written", lambda df, name: written(df, name) if name != "met" else met.append(written(df, name)) or met[-1])
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 9 + i % 5))) for i in range(150)]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(table(rows, "doc_id bigint, text string")).collect()}
    assert out == brute(rows, 4, 85, 100)
    assert met and sum(m.count() for m in met) < 10 * len(rows)


@pytest.mark.parametrize("block", [3, 10])
def test_blocks_lose_no_link(table, monkeypatch, block):
    monkeypatch.setattr(near, "SMALL_GROUP", 2)
    monkeypatch.setattr(near, "BLOCK_ROWS", block)
    rows = variants(21, [30, 90], 20, 9)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(table(rows, "doc_id bigint, text string")).collect()}
    assert out == brute(rows, 4, 85, 100)


def test_common_text_brings_no_unrelated_sets_together():
    """Sets of one template share no key; sets that link share one, whatever is common."""
    rng = np.random.default_rng(8)
    for share in (0.55, 0.6, 0.95):
        template = np.unique(rng.integers(0, 2**64, int(1000 * share), dtype=np.uint64))
        own = [rng.integers(0, 2**64, 1000 - len(template), dtype=np.uint64) for _ in range(4)]
        full = [np.unique(np.r_[template, o]) for o in own]
        full += [np.unique(np.r_[template[drop:], own[0]]) for drop in (20, 100)]
        full += [np.unique(np.r_[template, own[0][20:], rng.integers(0, 2**64, 20, dtype=np.uint64)])]
        keys = [{int(k) for band, top in near.bands(len(s), 85, 100) for k in near.sketch(s, band, top, 85, 100, template)} for s in full]
        for i in range(len(full)):
            for j in range(i):
                shared = len(np.intersect1d(full[i], full[j]))
                if 100 * shared >= 85 * (len(full[i]) + len(full[j]) - shared):
                    assert keys[i] & keys[j]
                elif share < 0.9:
                    assert not keys[i] & keys[j]


def test_many_copies_give_few_pairs(spark, table):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(i, text + (f" x{i}" if i % 2 else "")) for i in range(600)]
    docs = table(rows, "doc_id bigint, text string")
    features = near._features(docs, 3, 4, 85, 100)
    pairs = near._pairs(features.where("bucket is not null").select("bucket", "keys", "nodes"))
    assert pairs.selectExpr("least(a, b)", "greatest(a, b)").distinct().count() < 900
    assert {r["component_id"] for r in near.near_duplicates(docs).collect()} == {0}


def test_extra_columns_null_ids_repeats_and_empty_tables(table, no_docs):
    text = "a b c d e f g h"
    rows = [(5, text, 1, "x"), (3, text, 2, "y"), (3, text, 2, "y"), (None, text, 3, "z"), (None, "q r s t u", 4, "z"), (9, None, 5, None)]
    docs = table(rows, "doc_id bigint, text string, node int, component_id string")
    out = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in near.near_duplicates(docs).collect())
    assert out == [("3", 5, 3), ("3", 5, 3), ("5", 5, 3), ("9", 0, 9), ("None", 2, None), ("None", 5, 3)]
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None", "None"]
    assert near.near_duplicates(no_docs).count() == 0 and near.one_of_each(no_docs).count() == 0


def test_sketch_keeps_its_promise():
    """Sets that differ in at most d shingles share a key."""
    rng = np.random.default_rng(4)
    for size in (8, 20, 60, 300, 2000):
        for _ in range(20):
            own = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            for _ in range(3):
                drop = rng.integers(0, int(0.08 * size) + 1)
                other = np.unique(np.r_[rng.permutation(own)[drop:], rng.integers(0, 2**64, drop, dtype=np.uint64)])
                shared = len(np.intersect1d(own, other))
                if own.tolist() == other.tolist() or 100 * shared < 85 * (len(own) + len(other) - shared):
                    continue
                keys = [
                    {int(k) for band, top in near.bands(len(s), 85, 100) for k in near.sketch(s, band, top, 85, 100)}
                    for s in (own, other)
                ]
                assert keys[0] & keys[1]


def test_shingles_do_not_cross_documents():
    texts = [b"A b c", b"", b"d e F g h", b"  x ", b"d E f g", b"y"]
    offsets = np.cumsum([0, *map(len, texts)])
    found = list(sets(np.frombuffer(b"".join(texts), np.uint8), offsets, 4))
    assert [len(s) for s in found] == [len(shingle_set(t.decode(), 4)) for t in texts]
    assert set(found[4].tolist()) <= set(found[2].tolist())


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (5, 3)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    monkeypatch.setattr("sessionloom.llm.components.written", None)  # a round writes its edges
    edges = [(j, 100) for j in range(101, 160)] + [(7, 5), (5, 7), (8, 8)]
    out = sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert out == [(5, 5), (7, 5)] + [(j, 100) for j in range(100, 160)]


def test_new_links_join_components(table):
    parts = table([(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (30, 30), (31, 30)], "node bigint, component bigint")
    links = table([(3, 6), (9, 8), (9, 5), (2, 3), (20, 21)], "a bigint, b bigint")
    out = sorted(tuple(r) for r in near._grown(parts, links).collect())
    assert out == [(i, 1) for i in (1, 2, 3, 5, 6, 8, 9)] + [(20, 20), (21, 20), (30, 30), (31, 30)]


@pytest.mark.parametrize("shares", [(0, 3, float("inf")), (float("inf"),), (0, 0, float("inf"))])
def test_components_are_found_anew_only_for_new_links(table, monkeypatch, shares):
    monkeypatch.setattr(near, "SHARES", shares)
    links, joined, verified = [], [], near._verified
    monkeypatch.setattr(near, "_verified", lambda *a: links.append(verified(*a)) or links[-1])
    monkeypatch.setattr(near, "components", lambda edges: joined.append(1) or components(edges))
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 9 + i % 5))) for i in range(150)]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(table(rows, "doc_id bigint, text string")).collect()}
    assert out == brute(rows, 4, 85, 100)
    found = [x.count() for x in links]
    assert len(joined) == 1 + sum(n > 0 for n in found[1:])
    assert len(found) > 1
