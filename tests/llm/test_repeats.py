import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.llm import repeats


def brute(rows, length):
    """Every string of ``length`` bytes against all that start earlier."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                covered[at : at + length] = True
            seen.add(window)
        covered = covered[: len(data)]
        runs = int((covered & ~np.r_[False, covered[:-1]]).sum()) if len(data) else 0
        left = np.frombuffer(data, np.uint8)[~covered].tobytes()
        out[doc_id] = (len(data), int(covered.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def documents(seed, length):
    """Copies, edited copies, shared passages, repeats inside a text, runs of one letter."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(5)] + ["ab" * 150, "z" * 400, "short line"]
    rows = [(100, None), (101, ""), (102, "x" * (length - 1)), (103, "x" * length), (104, "x" * (length + 7)), (105, "é" * length)]
    for i in range(60):
        parts = [text(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((i, "\n".join(parts)))
    for i in range(200, 230):
        old = rows[rng.randrange(6, 60)][1]
        at = rng.randrange(len(old))
        rows.append((i, old if i % 3 else old[:at] + "#" + old[at:]))
    return rows


def digested(docs, length, **options):
    rows = repeats.digests(docs, repeats.repeated_spans(repeats.keyed(docs), length, **options)).collect()
    return {r["doc_id"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("length, gram, wide", [(100, 32, 2000), (100, 32, 2), (40, 8, 3), (9, 9, 2000)])
def test_removed_bytes_equal_brute_force(table, length, gram, wide):
    rows = documents(length + wide, length)
    docs = table(rows, "doc_id bigint, text string")
    assert digested(docs, length, gram=gram, wide=wide) == brute(rows, length)


def test_common_line_in_changing_surroundings(table):
    line = "This very common line stands in most of the documents."
    rows = [(i, f"{hashlib.sha256(b'%d' % i).hexdigest()}{line}{hashlib.sha256(b'-%d' % (i // 2)).hexdigest()}") for i in range(90)]
    docs = table(rows, "doc_id bigint, text string")
    assert digested(docs, 100, wide=20) == brute(rows, 100)


def test_common_line_is_not_dealt_out_window_by_window(table, monkeypatch):
    dealt, deal = [], repeats._dealt_windows
    monkeypatch.setattr(repeats, "_dealt_windows", lambda cuts, length: dealt.append(cuts.count()) or deal(cuts, length))
    line = "This very common line stands in most of the documents."
    rows = [(i, f"{hashlib.sha256(b'%d' % i).hexdigest()}{line}{hashlib.sha256(b'-%d' % (i // 2)).hexdigest()}") for i in range(90)]
    assert digested(table(rows, "doc_id bigint, text string"), 100, wide=20) == brute(rows, 100)
    assert sum(dealt) == 0


@pytest.mark.parametrize("piece", [1, 4, 30, 200])
def test_pieces_of_any_size_find_all_windows(table, monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = documents(piece, 60)
    assert digested(table(rows, "doc_id bigint, text string"), 60, gram=20, wide=1) == brute(rows, 60)


def test_odd_documents(odd_docs, odd_rows, no_docs):
    assert digested(odd_docs, 100) == brute(odd_rows, 100)
    assert repeats.repeats(no_docs).count() == 0


def test_repeated_rows_and_null_ids(table):
    text = "".join(chr(97 + i * i % 26) for i in range(90)) + "-" * 20 + "".join(chr(97 + i % 26) for i in range(50))
    docs = table([(1, text), (1, text), (None, text), (2, text)], "doc_id bigint, text string")
    out = sorted((str(r["doc_id"]), r["n_removed"]) for r in repeats.repeats(docs).collect())
    assert out == [("1", len(text)), ("1", len(text)), ("2", len(text)), ("None", 0)]


def test_texts_without_repeats(table):
    rows = documents(5, 100)
    docs = table([(*r, "keep", 1) for r in rows], "doc_id bigint, text string, _spans string, key int")
    out = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    want = brute(rows, 100)
    for doc_id, text in rows:
        assert out[doc_id]["_spans"] == "keep"
        if text is None:
            assert out[doc_id]["text"] is None
        elif want[doc_id][1] == 0:
            assert out[doc_id]["text"] == text


pieces = st.lists(st.text("ab", min_size=1, max_size=30) | st.text("abcdefgh", min_size=1, max_size=30), min_size=1, max_size=25)


@settings(max_examples=150, deadline=None)
@given(pieces)
def test_suffix_array_orders_all_suffixes(parts):
    text = np.frombuffer("\x01".join([*parts, ""]).encode(), np.uint8).astype(np.uint16) + 1
    text[text == 2] = 0
    order = repeats.suffix_array(text, 24)
    assert sorted(order.tolist()) == list(range(len(text)))
    raw = text.astype(np.uint8).tobytes()
    heads = [raw[i : i + 24].split(b"\0")[0] for i in order]
    assert heads == sorted(heads)
    keys = repeats.eights(text, 24)
    common = repeats.common_prefixes(keys, order[:-1], order[1:], 24)
    for i, j, n in zip(order[:-1].tolist(), order[1:].tolist(), common.tolist()):
        a, b = raw[i : i + 24].ljust(24, b"\0"), raw[j : j + 24].ljust(24, b"\0")
        assert a[:n] == b[:n] and (n == 24 or a[n] != b[n])
