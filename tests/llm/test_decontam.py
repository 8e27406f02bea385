import hashlib
import random
import re

import pytest

from sessionloom.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    raw = (text or "").encode()
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in raw))


def brute(rows, items, width):
    windows = []
    for item, text in items:
        own = words(text)
        windows += [(str(item) if item is not None else "", own[i : i + width]) for i in range(max(1, len(own) - width + 1)) if own]
    out = {}
    for doc_id, text in rows:
        own, hit, found = words(text), set(), set()
        for item, window in windows:
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
        out[doc_id] = (len(own), len(hit), sorted(found))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "Cc", "dé", "e1", "f-g", "hh!", "it's", "Z"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25, 40])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "..."), (None, "b a b a b a b"), (3, items[3][1]), (93, "Unseen")]
    rows = [(500, None), (501, ""), (502, items[7][1]), (503, items[7][1].upper() + "," + items[8][1])]
    for i in range(60):
        parts = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            passage = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(passage) + 1)
            parts += passage[at:] if rng.randrange(2) else passage
        rows.append((i, " ".join(parts)))
    return rows, items


@pytest.mark.parametrize("block", [200_000, 40])
def test_hits_equal_brute_force(table, block):
    rows, items = corpus(block)
    docs = table(rows, "doc_id bigint, text string")
    found = decontam.search(decontam.index(docs), table(items, "item_id int, text string"), windows_per_block=block)
    out = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.collect()}
    assert out == brute(rows, items, 10)


def test_proximity_finds_loose_words_and_keeps_to_documents(table):
    item = [(1, "alpha beta gamma delta")]
    rows = [(1, "delta x gamma alpha x x beta"), (2, "alpha beta"), (3, "gamma delta"), (4, "alpha beta gamma delta"),
            (5, "alpha " + "x " * 30 + "beta gamma delta")]
    docs = table(rows, "doc_id bigint, text string", 1)
    found = decontam.search(decontam.index(docs), table(item, "item_id int, text string"))
    assert {r["doc_id"]: (len(r["items"]), len(r["near_items"])) for r in found.collect()} == {
        1: (0, 1), 2: (0, 0), 3: (0, 0), 4: (1, 1), 5: (0, 0)
    }


def test_spans_are_word_positions(table):
    docs = table([(1, "x a b c y a b c a b c")], "doc_id bigint, text string")
    row = decontam.search(decontam.index(docs), table([("q", "a b c")], "item_id string, text string")).first()
    assert [tuple(s) for s in row["spans"]] == [(1, 4), (5, 11)] and row["n_hit"] == 9


def test_clean_keeps_columns_and_clean_documents(table, odd_docs, odd_rows, no_docs):
    items = table([(1, "Plain words of a short text, twice told.")], "item_id int, text string")
    kept = decontam.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in odd_rows if i not in (1, 6))
    none = items.limit(0)
    assert decontam.clean(odd_docs, none).count() == len(odd_rows)
    assert decontam.search(decontam.index(no_docs), items).count() == 0


def test_long_document_spans_segments(table, monkeypatch):
    long = " ".join(f"t{i}" for i in range(3000))
    rows = [(i, long if i == 5 else f"small {i} text") for i in range(12)]
    monkeypatch.setattr(decontam.slices, "__defaults__", ("text", 200))
    docs = table(rows, "doc_id bigint, text string")
    assert decontam.index(docs).count() >= 1
    items = table([(1, " ".join(f"t{i}" for i in range(2990, 3000)))], "item_id int, text string")
    hit = decontam.search(decontam.index(docs), items).where("n_hit > 0").collect()
    assert [(r["doc_id"], r["n_hit"]) for r in hit] == [(5, 10)]
