"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

The driver reads the ranks once, works out the one merge that makes each entry, and
hands the tokenizers library's own description of the result to the workers (a few
MB, bounded by the vocabulary). The library then encodes Arrow batches: every byte
stands as a printable character (the byte-to-character mapping), each match of the
pattern is merged by itself, and offsets go back from bytes to characters.

A rank file need not come from merges in order; then merging by rank and merging by
list could differ. ``merges`` therefore checks each entry: its bytes, merged by
lower ranks alone, must fall into exactly two entries. Where that holds, a stretch
of text that no token crosses is in that very state when the entry's turn comes, so
the list gives what the ranks give; where it does not, the file is refused.

Texts are cut at blanks. The pattern can take a blank that follows or precedes a visible
character only as the first character of a match, so the ids of a text are those of
its parts in a row; in a slice of a batch the library sees every different part once.
Texts with blanks between other white space go to it whole.

Cases: a null or empty text has no ids and decodes to nothing; texts of any length are
encoded whole; repeated rows and equal ids keep their rows; rows with a null id column
are kept; strings of special tokens are ordinary text; no rows give no rows. ``encode``
and ``decode`` return only the columns they are asked to keep and their own, so
columns that clash are left behind; a kept column named like a result is refused.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.workers import per_worker, slices, utf8

#: Text whose different parts are encoded together, parts in one call, ids decoded at a time (or one longer row).
SLICE, PARTS, IDS = 4 << 20, 10_000, 1 << 19
ODD_BLANK = re.compile(r"\s (?:\s|\Z)")


def letters() -> list[str]:
    """The printable character that stands for each byte."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes to id of a rank file: one base64 entry and its rank a line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(entry): int(rank) for entry, rank in lines}


def _halves(entry: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two entries that ``entry`` is made of when only lower ranks have merged."""
    parts = [entry[i : i + 1] for i in range(len(entry))]
    while len(parts) > 2:
        pairs = [(ranks.get(a + b, ranks[entry]), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs)
        if rank >= ranks[entry]:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    if len(parts) != 2 or not all(p in ranks and ranks[p] < ranks[entry] for p in parts):
        raise ValueError(f"entry {ranks[entry]} of the ranks is not made by one merge of lower entries")
    return parts[0], parts[1]


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each entry of two bytes or more, in rank order."""
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks lack single bytes")
    return [_halves(entry, ranks) for entry in sorted(ranks, key=ranks.get) if len(entry) > 1]


def description(ranks: dict[bytes, int], pattern: str) -> str:
    """The library's description (JSON) of the tokenizer of these ranks."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    letter = letters()

    def shown(entry: bytes) -> str:
        return "".join(letter[b] for b in entry)

    pairs = [(shown(a), shown(b)) for a, b in merges(ranks)]
    model = models.BPE({shown(e): rank for e, rank in ranks.items()}, pairs, ignore_merges=True)
    tokenizer = Tokenizer(model)
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer.to_str()


class Coder:
    """Encoding and decoding with one described tokenizer."""

    def __init__(self, described: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(described)
        byte_of = {c: b for b, c in enumerate(letters())}
        entries = json.loads(described)["model"]["vocab"]
        by_id: list[bytes] = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            by_id[i] = bytes(byte_of[c] for c in entry)
        self.pool = np.frombuffer(b"".join(by_id), np.uint8)
        self.sizes = np.array([len(entry) for entry in by_id], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a blank and each part in a row, where each part's ids begin and end).

        Parts with visible ends go to the library as one text, and the bytes of its ids
        tell them apart again; the few others go one by one.
        """
        alone = [n for n, p in enumerate(parts) if not p or p[0].isspace() or p[-1].isspace()]
        texts = parts if not alone else np.delete(np.array(parts, object), alone).tolist()
        calls = [" " + " ".join(texts[n : n + PARTS]) for n in range(0, len(texts), PARTS)]
        ids = np.concatenate([np.zeros(0, np.int32), *[self._library([call])[0] for call in calls]])
        stops = np.cumsum([len(p.encode()) + 1 for p in texts], dtype=np.int64)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), stops) + 1
        counts = np.diff(ends, prepend=0)
        if alone:
            own = self._library([" " + parts[n] for n in alone])
            at = np.array(alone) - np.arange(len(alone))
            ids = np.insert(ids, np.repeat(np.concatenate([[0], ends])[at], [len(i) for i in own]), np.concatenate(own))
            counts = np.insert(counts, at, [len(i) for i in own])
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all whole texts in a row, where each text's ids begin and end)."""
        rows = texts.to_pylist()
        odd = [n for n, t in enumerate(rows) if t and ODD_BLANK.search(t)]
        for n in odd:
            rows[n] = None
        plain = pa.array(rows, pa.string()).fill_null("") if odd else texts.cast(pa.string()).fill_null("")
        parts = pa.compute.split_pattern(plain, " ")
        begins = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        which, different = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
        heads, place = np.unique(which[begins[:-1]], return_inverse=True)
        which[begins[:-1]] = len(different) + place
        pool, bounds = self._parts(different)
        starts = self._library([different[n] for n in heads])
        pool = np.concatenate([pool, *starts])
        sizes = np.concatenate([np.diff(bounds), np.array([len(s) for s in starts], np.int64)])
        first, lengths = np.cumsum(sizes) - sizes, sizes[which]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(first[which] - before[:-1], lengths) + np.arange(before[-1])]
        bounds = before[begins]
        if odd:
            each = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            for n in odd:
                each[n] = self._library([texts[n].as_py()])[0]
            ids, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])])
        return ids, bounds

    def spans(self, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and character after the last of each id's bytes in ``data``."""
        ends = np.cumsum(self.sizes[ids])
        character = np.cumsum(data & 0xC0 != 0x80) - 1
        return character[ends - self.sizes[ids]], character[ends - 1] + 1

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in a row, where each id's bytes begin and end); an unknown id is an error."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes) and self.sizes[ids].all()):
            raise ValueError("the ranks lack an id")
        sizes = self.sizes[ids]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return self.pool[np.repeat(self.first[ids] - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def split_ends(data: bytes) -> tuple[int, int]:
    """How many bytes at the start and the end belong to characters cut there."""
    head = 0
    while head < min(3, len(data)) and data[head] & 0xC0 == 0x80:
        head += 1
    for back in range(1, min(3, len(data) - head) + 1):
        byte = data[-back]
        if byte & 0xC0 != 0x80:
            needed = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            return head, back if needed > back else 0
    return head, 0


def shared(spark: SparkSession, path: str, pattern: str):
    """The description of a rank file, for all workers (bounded by the vocabulary)."""
    return spark.sparkContext.broadcast(description(read_ranks(path), pattern))


def _coder(described) -> Coder:
    return per_worker(("bytebpe", described.value), lambda: Coder(described.value))


def _kept(df: DataFrame, keep: Sequence[str], own: Sequence[str]) -> str:
    clash = {c.lower() for c in keep} & set(own)
    if clash:
        raise ValueError(f"kept columns have names of results: {sorted(clash)}")
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def encode(
    docs: DataFrame, described, keep: Sequence[str] = ("doc_id",), text: str = "text", offsets: bool = False
) -> DataFrame:
    """``keep`` and ``ids`` of each row's whole text; with ``offsets`` also ``starts`` and ``ends``.

    Offsets count characters: an id that holds part of a character has that character's span.
    """
    own = ["ids", "starts", "ends"] if offsets else ["ids"]
    shape = ", ".join([s for s in [_kept(docs, keep, own), *[f"{c} array<int>" for c in own]] if s])

    def run(batches):
        coder = _coder(described)
        for batch in slices(batches, "_text", SLICE):
            column = batch.column("_text")
            ids, bounds = coder.encode(column)
            values = [ids]
            if offsets:
                data, ends = utf8(column)
                rows = zip(bounds, bounds[1:], ends, ends[1:])
                spans = [coder.spans(ids[a:b], data[c:d]) for a, b, c, d in rows]
                values += [np.concatenate([s[k] for s in spans]) for k in (0, 1)]
            arrays = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, pa.int32())) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*keep, *own])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, shape)


def decode(
    rows: DataFrame, described, keep: Sequence[str] = ("doc_id", "ids"), ids: str = "ids", texts: bool = True
) -> DataFrame:
    """``keep``, ``data`` (the exact bytes), ``cut_head``, ``cut_tail`` and, with ``texts``, ``text``.

    Ids cut out of a longer row may begin or end inside a character: ``cut_head`` and
    ``cut_tail`` count the bytes of such characters, and ``text`` has U+FFFD for them.
    Pieces of one row in order give its text when their ``data`` are joined first.
    """
    own = {"data": "binary", "cut_head": "int", "cut_tail": "int"} | ({"text": "string"} if texts else {})
    shape = ", ".join([s for s in [_kept(rows, keep, list(own)), *[f"{c} {kind}" for c, kind in own.items()]] if s])

    def run(batches):
        coder = _coder(described)
        for whole in batches:
            sizes = whole.column("_ids").value_lengths().fill_null(0).to_numpy()
            part = np.cumsum(sizes) // IDS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
            for start, stop in zip(edges, edges[1:]):
                batch = whole.slice(start, stop - start)
                places = np.concatenate([[0], np.cumsum(sizes[start:stop])])
                data, bounds = coder.decode(batch.column("_ids").flatten().to_numpy())
                ends = bounds[places]
                found = [data[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                cuts = np.array([split_ends(d) for d in found], np.int32).reshape(-1, 2)
                arrays = [pa.array(found, pa.binary()), pa.array(cuts[:, 0]), pa.array(cuts[:, 1])]
                if texts:
                    arrays.append(pa.array([d.decode(errors="replace") for d in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*keep, *own])

    return rows.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, shape)
