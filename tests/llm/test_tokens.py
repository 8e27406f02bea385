"""Token ids, packing and directly addressable codes."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionloom.llm import directcodes, packing
from sessionloom.llm.tokens import Encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {f: Encoder(public_tokenizers.path(f)) for f in FILES}
LIBRARY = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
for library in LIBRARY.values():
    library.encode_special_tokens = True


def library_ids(file, text):
    return LIBRARY[file].encode(text or "", add_special_tokens=False).ids


words = st.sampled_from(
    ["the", "Thing,", "über", "ÀB", "don't", "'s", "a's", "3", "x1", "...", "$$$", "wort***", "\u00a0", "\x1c", "e\u0301", "İ", "ς", "Σ",
     "ª", "中文", "<|endoftext|>", "ﬁ", "ǅ", "I'LL", "ß!", "\u2028", "\t", "", "Ŀ", "ŉ", "na\u0308"]
)
spaces = st.sampled_from([" ", " ", " ", "\n", "  ", "\n\n", " \n", "\n ", "\r\n", ""])


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.tuples(words, spaces), max_size=12))
def test_ids_equal_the_library(file, parts):
    text = "".join(w + s for w, s in parts)
    assert ENCODERS[file].ids(text).tolist() == library_ids(file, text)


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=60))
def test_ids_of_any_text(file, text):
    assert ENCODERS[file].ids(text, 1).tolist() == [*library_ids(file, text), 1]


@pytest.mark.parametrize("length", [2048, 7])
def test_pieces_hold_every_id_once(odd_docs, odd_rows, length):
    file = FILES[0]
    pieces = packing.pack(odd_docs, public_tokenizers.path(file), length=length).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in odd_rows:
        own = sorted(by_doc[doc_id], key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own])
        assert ids.tolist() == [*library_ids(file, text), 1]
        assert [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own[:-1]]]).tolist()
        assert {p["doc_tokens"] for p in own} == {len(ids)}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, own in by_sequence.items():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *[p["length"] for p in own[:-1]]]).tolist()
        full = sum(p["length"] for p in own)
        assert full == length or number == max(by_sequence) and full < length


def test_empty_tables(no_docs):
    for file in FILES:
        assert packing.pack(no_docs, public_tokenizers.path(file)).count() == 0
        assert directcodes.read_back(directcodes.write(no_docs, public_tokenizers.path(file))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=3000), st.data())
def test_codes_round_trip(ids, data):
    codes = directcodes.Codes(directcodes.pack_codes(np.array(ids, np.uint32)))
    assert len(codes) == len(ids)
    assert codes.read(0, len(ids)).tolist() == ids
    if ids:
        for index in data.draw(st.lists(st.integers(0, len(ids) - 1), max_size=20)):
            assert codes[index] == ids[index]
        a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
        assert codes.read(a, b).tolist() == ids[a:b]


def test_codes_cross_directory_stretches():
    ids = (np.arange(20_000) * 7919) % 70_000
    codes = directcodes.Codes(directcodes.pack_codes(ids))
    assert [codes[i] for i in range(0, 20_000, 13)] == ids[::13].tolist()
    with pytest.raises(IndexError):
        codes[20_000]
    with pytest.raises(ValueError):
        directcodes.Codes(b"none" + bytes(20))


def test_codes_of_documents_in_order(odd_docs, odd_rows):
    file = FILES[1]
    shards = directcodes.write(odd_docs, public_tokenizers.path(file), shard_tokens=5_000)
    assert shards.count() > 3
    rows = sorted(directcodes.read_back(shards).collect(), key=lambda r: r["doc_id"])
    start = 0
    for row, (doc_id, text) in zip(rows, sorted(odd_rows)):
        ids = [*library_ids(file, text), 1]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(rows) == len(odd_rows)


@pytest.mark.parametrize("file", FILES)
def test_operators_take_added_tokens_as_the_unchanged_library(table, file):
    plain = Tokenizer.from_file(public_tokenizers.path(file))
    texts = ["a <|endoftext|> b", "x<|endoftext|>y", "<|startoftext|>Z <|endoftext|>", "<|ENDOFTEXT|> a", "a <| b |> c", "plain words", "<|endoftext|>"]
    expected = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    docs = table(list(enumerate(texts)), "doc_id bigint, text string")
    pieces = packing.pack(docs, public_tokenizers.path(file)).collect()
    assert {p["doc_id"]: np.frombuffer(p["ids"], "<u4").tolist() for p in pieces} == expected
    start = 0
    for row in sorted(directcodes.read_back(directcodes.write(docs, public_tokenizers.path(file))).collect(), key=lambda r: r["doc_id"]):
        ids = expected[row["doc_id"]]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


PLAIN = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
ADDED = {f: Encoder(public_tokenizers.path(f), added=True) for f in FILES}


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.tuples(words, spaces), max_size=12))
def test_added_tokens_among_any_words(file, parts):
    text = "".join(w + s for w, s in parts)
    assert ADDED[file].ids(text).tolist() == PLAIN[file].encode(text, add_special_tokens=False).ids
