"""Byte-level BPE against the libraries themselves."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionloom.llm import bytebpe
from sessionloom.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bytebpe.read_ranks(PATH)
DESCRIBED = bytebpe.description(RANKS, PATTERN)
CODER = bytebpe.Coder(DESCRIBED)
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})

words = st.sampled_from(
    ["the", "Thing,", "über", "don't", "'s", "'ll", "3", "12345", "...", "$$$", "aaaaaaaaa", "-----", "中文字", "😀", "👩‍👩‍👧", "é",
     "<|endoftext|>", " ", "\x1c", " ", "\u0085", "　", "\x00", "ß!", "x" * 70, "�", "\U000f0000", ""]
)
spaces = st.sampled_from([" ", " ", " ", "\n", "  ", "   ", "\n\n", " \n", "\n ", "\r\n", "\t", ""])


def rows_of(texts):
    ids, bounds = CODER.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(words, spaces), max_size=12), min_size=1, max_size=4))
def test_ids_equal_tiktoken(parts):
    texts = ["".join(w + s for w, s in part) for part in parts]
    assert rows_of(texts) == [PLAIN.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), min_size=1, max_size=5))
def test_any_text_goes_and_comes_back(texts):
    rows = rows_of(texts)
    assert rows == [PLAIN.encode_ordinary(t or "") for t in texts]
    assert [CODER.decode(np.array(r, np.int32))[0].tobytes().decode() for r in rows] == [t or "" for t in texts]


def test_every_plane_is_split_as_the_library_splits_it():
    """Letters, digits, white space and the rest, over the code points."""
    points = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)}! {chr(c)} {chr(c)}" for c in points]
    assert rows_of(texts) == [PLAIN.encode_ordinary(t) for t in texts]


def test_merges_give_every_entry_back():
    made = {a + b for a, b in bytebpe.merges(RANKS)}
    assert made == {entry for entry in RANKS if len(entry) > 1}


def test_ranks_that_no_merges_make_are_refused():
    ranks = {bytes([b]): b for b in range(256)}
    assert bytebpe.merges({**ranks, b"ab": 256, b"abc": 257}) == [(b"a", b"b"), (b"ab", b"c")]
    with pytest.raises(ValueError):
        bytebpe.merges({**ranks, b"abc": 256})
    with pytest.raises(ValueError):
        bytebpe.merges({b"a": 0})


def test_rows_of_the_operators(spark, odd_docs, odd_rows):
    described = bytebpe.shared(spark, PATH, PATTERN)
    encoded = bytebpe.encode(odd_docs, described, keep=["doc_id", "score"], offsets=True)
    assert encoded.columns == ["doc_id", "score", "ids", "starts", "ends"]
    library = Tokenizer.from_str(DESCRIBED)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    assert len(rows) == len(odd_rows)
    for doc_id, text in odd_rows:
        whole = library.encode(text or "", add_special_tokens=False)
        assert rows[doc_id]["ids"] == PLAIN.encode_ordinary(text or "") == whole.ids
        assert list(zip(rows[doc_id]["starts"], rows[doc_id]["ends"])) == whole.offsets
    decoded = bytebpe.decode(encoded, described, keep=["doc_id"]).collect()
    assert {r["doc_id"]: (bytes(r["data"]).decode(), r["text"], r["cut_head"], r["cut_tail"]) for r in decoded} == {
        i: (t or "", t or "", 0, 0) for i, t in odd_rows
    }


def test_clashes_nulls_and_empty_tables(spark, no_docs, table):
    described = bytebpe.shared(spark, PATH, PATTERN)
    assert bytebpe.decode(bytebpe.encode(no_docs, described), described).count() == 0
    rows = table([(None, "one two"), (None, "one two"), (3, None)], "doc_id bigint, text string")
    found = [(r["doc_id"], bytes(r["data"])) for r in bytebpe.decode(bytebpe.encode(rows, described), described).collect()]
    assert sorted(found, key=str) == sorted([(None, b"one two"), (None, b"one two"), (3, b"")], key=str)
    with pytest.raises(ValueError):
        bytebpe.encode(rows.withColumnRenamed("doc_id", "IDS"), described, keep=["IDS"])
    missing = table([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {bytes(r["data"]) for r in bytebpe.decode(missing, described).collect()} == {b""}
    with pytest.raises(ValueError):
        CODER.decode(np.array([len(RANKS)]))
    with pytest.raises(ValueError):
        CODER.decode(np.array([-1]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé中😀", max_size=8), st.data())
def test_ends_inside_characters(text, data):
    raw = text.encode()
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(raw)), st.integers(0, len(raw)))))
    begin = [len(text[:i].encode()) for i in range(len(text) + 1)]
    head, tail = bytebpe.split_ends(raw[a:b])
    inside = [p for p in begin if a <= p <= b]
    if inside:  # some character begins or ends within the piece
        assert (a + head, b - tail) == (inside[0], inside[-1])


def test_pieces_of_one_text_join_to_it(spark, table):
    described = bytebpe.shared(spark, PATH, PATTERN)
    text = "中文😀 é ŋ 𝔘𝔫𝔦 ok"
    ids = PLAIN.encode_ordinary(text)
    pieces = table([(n, ids[n : n + 1]) for n in range(len(ids))], "n bigint, ids array<int>")
    rows = bytebpe.decode(pieces, described, keep=["n"]).orderBy("n").collect()
    assert b"".join(bytes(r["data"]) for r in rows).decode() == text
    assert any(r["cut_head"] or r["cut_tail"] for r in rows)


def test_query_against_tiktoken(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in QUERIES["op13_byte_bpe"](spark, folder).collect()}
    assert len(rows) == len(docs)
    for doc in docs:
        ids, row = PLAIN.encode_ordinary(doc["text"] or ""), rows[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()


def test_large_and_small_slices_agree():
    texts = [f"word{n} and\nmore  {n % 7}" for n in range(500)]
    together, apart = rows_of(texts), [rows_of([t])[0] for t in texts]
    assert together == apart
    assert np.concatenate([np.array(r) for r in together]).size > 1000
