"""Removal of repeated byte strings across documents with two-stage suffix sorting.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts
earlier: in a document of smaller id, or earlier in the same one.

Which suffixes can share their first ``LENGTH`` bytes is settled first. Every window
of that length has an anchor, the place of the least ``GRAM``-byte hash in it, which
depends on the window's bytes alone; so equal windows have equal anchors at equal
distances. The windows of one anchor make up one slice of the text. Slices meet by
anchor. Equal slices are merged: all but the first are removed whole. Where an
anchor has several different slices, their suffixes are sorted, a block of slices at
a time: those smaller than their successor directly, the others by scans of the
buckets of first bytes; the common prefixes of neighbours then give the equal
windows, all but the first of which are removed.

An anchor with more than ``WIDE`` different slices (a common line in changing
surroundings) is not put in one block. Its slices are cut into pieces of at most
``PIECE`` windows, at fixed distances from the anchor; the bytes that all windows of a
piece have in common are then most of a window, and pieces meet by them as slices do by
their anchor. Where more than ``WIDE`` different pieces still meet, their windows are
dealt out by their own hashes, and equal ones are found by an aggregation.

Cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose
nothing; texts of any length are handled whole; rows that share a doc_id are one
document, and a null doc_id comes before all others; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.packing import written
from sessionloom.llm.shingles import BASE, mix, powers
from sessionloom.llm.workers import fresh, per_worker, slices, table, utf8

LENGTH, GRAM = 100, 32
WIDE, PIECE = 2_000, 9
BUCKET_BYTES = 4 << 20
BLOCK_SLICES = 8_000
BROADCAST_IDS = 4_000_000
SCAN_BYTES = 2 << 20
INVERSE = pow(int(BASE), -1, 2**64)
FIRST = -(1 << 63)

ENTRY = np.dtype([("anchor", "<u8"), ("slice", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("more", "u1")])
PACKED = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])
SPANS = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("anchor", pa.int64())])
SPANS_SQL = "doc bigint, start int, end int, anchor bigint"
CUTS = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary())])
CUTS_SQL = "anchor bigint, doc bigint, start int, bytes binary"
PIECES = pa.schema(
    [("anchor", pa.int64()), ("slice", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary())]
)
PIECES_SQL = "anchor bigint, slice bigint, doc bigint, start int, bytes binary"
WINDOWS = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("doc", pa.int64()), ("start", pa.int32())])
WINDOWS_SQL = "one bigint, two bigint, doc bigint, start int"
DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
     ("kept_sha256", pa.string())]
)
DIGEST_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    room = 1 << max(21, int(n).bit_length())
    make = lambda: (powers(room), np.cumprod(np.full(room, INVERSE, np.uint64)))
    return per_worker(("powers", room), make) if room <= 1 << 22 else make()


class Hashes:
    """Hashes of any stretch of a byte array, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start], salt)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(anchor place, first window, last window) of every slice, in order of place."""
    empty = (np.zeros(0, np.int64),) * 3
    if len(data) < length:
        return None, empty
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    low = np.uint64((1 << int(len(data)).bit_length()) - 1)
    least = (hashes.of(at, at + gram) & ~low) | at.astype(np.uint64)
    reach, width = length - gram + 1, 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    window = np.flatnonzero(np.arange(len(least)) + length <= doc_end[: len(least)])
    if not len(window):
        return hashes, empty
    chosen = (least[window] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)])
    return hashes, (chosen[new], window[new], window[np.append(new[1:], len(window)) - 1])


def _entries(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    def scan(batches):
        for batch in slices(batches, limit=SCAN_BYTES):
            data, offsets = utf8(batch.column("text"))
            hashes, (place, first, last) = anchors(data, offsets, length, gram)
            if not len(place):
                continue
            owner = np.searchsorted(offsets, first, "right") - 1
            found = np.zeros(len(place), ENTRY)
            found["anchor"] = hashes.of(place, place + gram, 1)
            found["slice"] = hashes.of(first, last + length, 2) + (last - first).astype(np.uint64)
            found["doc"] = batch.column("key").to_numpy(zero_copy_only=False)[owner]
            found["start"] = first - offsets[owner]
            found["more"] = last - first
            bucket = (found["anchor"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, bucket = found[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.append(cuts[1:], len(bucket))
            # Bytes of equal rank together: the high ones of ids and places repeat.
            packed = [
                np.ascontiguousarray(found[a:b].view(np.uint8).reshape(b - a, -1).T).tobytes()
                for a, b in zip(cuts, ends)
            ]
            yield table({"bucket": bucket[cuts], "entries": packed}, PACKED)

    return docs.select("key", "text").mapInArrow(scan, "bucket int, entries binary")


def _unpacked(raw: bytes) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(ENTRY.itemsize, -1).T
    return np.ascontiguousarray(rows).view(ENTRY)[:, 0]


def _merged(entries: DataFrame, length: int) -> DataFrame:
    """Spans removed as later copies of a slice (anchor null), and the first of each
    different slice of an anchor that has several (its anchor given)."""

    def meet(group):
        found = np.concatenate([_unpacked(raw) for raw in group.column("entries").to_pylist()])
        found = found[np.lexsort((found["start"], found["doc"], found["slice"], found["anchor"]))]
        anchor = np.r_[True, found["anchor"][1:] != found["anchor"][:-1]]
        new = anchor | np.r_[True, found["slice"][1:] != found["slice"][:-1]]
        heads = np.flatnonzero(new)
        head = heads[np.cumsum(new) - 1]
        copy = (found["doc"] != found["doc"][head]) | (found["start"] != found["start"][head])
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(anchor))
        several = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(anchor), len(found))))
        out = []
        for rows, name in ((found[copy], False), (found[new & several], True)):
            ids = pa.array(rows["anchor"].view(np.int64)) if name else pa.nulls(len(rows), pa.int64())
            start = rows["start"].astype(np.int64)
            columns = {"doc": rows["doc"], "start": start, "end": start + rows["more"] + length, "anchor": ids}
            out.append(table(columns, SPANS))
        return pa.Table.from_batches(out, SPANS)

    return written(entries.groupBy("bucket").applyInArrow(meet, SPANS_SQL), "slices")


def _of_documents(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` joined to ``rows`` grouped by document; only documents with rows.

    When the documents with rows are few enough, their ids are broadcast and only
    their texts are shuffled.
    """
    spans = rows.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "anchor")).alias("spans"))
    ids = rows.select(F.col("doc").alias("key")).distinct()
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "key", "left_semi")
    return docs.join(spans.withColumnRenamed("doc", "key"), "key")


def _cut(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The bytes of the slices in ``heads``, with their places."""

    def cut(batches):
        for batch in slices(batches):
            columns = {name: [] for name in CUTS.names}
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for key, text, spans in zip(batch.column("key").to_pylist(), texts, batch.column("spans").to_pylist()):
                for span in spans:
                    columns["anchor"].append(span["anchor"])
                    columns["doc"].append(key)
                    columns["start"].append(span["start"])
                    columns["bytes"].append((text or b"")[span["start"] : span["end"]])
            yield table(columns, CUTS)

    return written(_of_documents(docs, heads).select("key", "text", "spans").mapInArrow(cut, CUTS_SQL), "cuts")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Two-stage sort of all suffixes of ``text`` (0 ends a string), by ``depth`` symbols.

    Suffixes smaller than their successor are sorted directly, eight symbols at a
    time. The others follow from them: a scan of the buckets of first symbols, from
    the smallest, puts the predecessor of each suffix met, if larger than it, next in
    its own bucket. Suffixes that agree in ``depth`` symbols stand together.
    """
    n = len(text)
    change = np.sign(np.diff(text.astype(np.int16), append=512))  # the last symbol ends all
    place = np.where(change != 0, np.arange(n), n - 1)
    smaller = change[np.minimum.accumulate(place[::-1])[::-1]] > 0
    direct = np.flatnonzero(smaller)
    ordered = direct[_direct_order(direct, eights(text, depth), depth)]
    symbols = text[ordered]
    lists: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for symbol in range(257):
        low, high = np.searchsorted(symbols, (symbol, symbol + 1))
        own = np.concatenate(lists[symbol]) if lists[symbol] else np.zeros(0, np.int64)
        found, newest = [own], own
        while len(newest):  # larger suffixes whose successor is in this very bucket
            before = newest[newest > 0] - 1
            newest = before[(text[before] == symbol) & ~smaller[before]]
            found.append(newest)
        bucket = np.concatenate([*found, ordered[low:high]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > symbol) & ~smaller[before]]
        if len(before):
            order = np.argsort(text[before], kind="stable")
            before = before[order]
            cuts = np.flatnonzero(np.diff(text[before])) + 1
            for part in np.split(before, cuts):
                lists[text[part[0]]].append(part)
    return np.concatenate(out)


def eights(text: np.ndarray, depth: int) -> np.ndarray:
    """At each place eight symbols as one big-endian number, padded for ``depth`` more.

    Symbols reach 245 (no byte of UTF-8 is above 244), so each fits a byte.
    """
    padded = np.concatenate([text.astype(np.uint8), np.zeros(depth + 16, np.uint8)])
    out = np.zeros(len(text) + depth + 8, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def _direct_order(places: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at ``places`` by ``depth`` symbols, refining tied groups."""
    order = np.argsort(keys[places], kind="stable")
    active = np.arange(len(places))  # ranks whose suffix is still tied
    group = np.zeros(len(places), np.int64)
    at = 0
    while len(active):
        value = keys[places[order[active]] + at]
        if at:
            new = np.lexsort((value, group[active]))
            order[active] = order[active[new]]
            value = value[new]
        same = (value[1:] == value[:-1]) & (group[active][1:] == group[active][:-1])
        group[active] = np.cumsum(np.r_[True, ~same])
        tied = np.r_[same, False] | np.r_[False, same]
        at += 8
        if at >= depth:
            break
        active = active[tied]
    return order


def common_prefixes(keys: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, at most ``most``."""
    out = np.zeros(len(left), np.int64)
    rows = np.arange(len(left))
    for at in range(0, most, 8):
        differ = keys[left[rows] + at] ^ keys[right[rows] + at]
        bits = np.zeros(len(rows), np.int64)
        whole = differ == 0
        high = differ[~whole]
        count = np.zeros(len(high), np.int64)
        for shift in (32, 16, 8):
            big = high >= np.uint64(1) << np.uint64(64 - shift)
            count += np.where(big, 0, shift)
            high = np.where(big, high, high << np.uint64(shift))
        bits[~whole] = count // 8
        out[rows] += np.where(whole, 8, bits)
        rows = rows[whole]
        if not len(rows):
            break
    return np.minimum(out, most)


def repeated_windows(cuts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int):
    """(slice, first window, window after the last) of runs that also start earlier."""
    sizes = np.array([len(c) for c in cuts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\xff".join(cuts) + b"\xff", np.uint8).astype(np.uint16) + 1
    text[text == 256] = 0
    owner = np.repeat(np.arange(len(cuts)), sizes + 1)
    inside = np.arange(len(text)) - begin[owner]
    order = suffix_array(text, length)
    order = order[inside[order] + length <= sizes[owner[order]]]
    if not len(order):
        return np.zeros((0, 3), np.int64)
    keys = eights(text, length)
    equal = common_prefixes(keys, order[:-1], order[1:], length) >= length
    group = np.cumsum(np.r_[True, ~equal]) - 1
    doc, start = docs[owner[order]], starts[owner[order]] + inside[order]
    ranked = np.lexsort((start, doc, group))
    first = ranked[np.flatnonzero(np.r_[True, group[ranked][1:] != group[ranked][:-1]])]
    later = (doc != doc[first][group]) | (start != start[first][group])
    covered = np.sort(order[later])
    if not len(covered):
        return np.zeros((0, 3), np.int64)
    new = np.flatnonzero(np.r_[True, covered[1:] != covered[:-1] + 1])
    end = covered[np.append(new[1:], len(covered)) - 1] + 1
    which = owner[covered[new]]
    return np.stack([which, covered[new] - begin[which], end - begin[which]], axis=1)


def _sorted_blocks(cuts: DataFrame, blocks: int, length: int) -> DataFrame:
    def search(group):
        pieces = group.column("bytes").to_pylist()
        docs, starts = group.column("doc").to_numpy(), group.column("start").to_numpy().astype(np.int64)
        runs = repeated_windows(pieces, docs, starts, length)
        at = starts[runs[:, 0]]
        columns = {
            "doc": docs[runs[:, 0]], "start": at + runs[:, 1], "end": at + runs[:, 2] - 1 + length,
            "anchor": pa.nulls(len(runs), pa.int64()),
        }
        return pa.Table.from_batches([table(columns, SPANS)], SPANS)

    dealt = cuts.withColumn("block", F.pmod("anchor", F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(search, SPANS_SQL)


def _pieces(cuts: DataFrame, length: int, gram: int) -> DataFrame:
    """Pieces of the slices in ``cuts``, named (anchor) by the bytes that their windows share."""
    span = min(PIECE, length)

    def each(batches):
        for batch in slices(batches, "bytes", SCAN_BYTES // 8):
            data, offsets = utf8(batch.column("bytes"))
            hashes, names = Hashes(data), batch.column("anchor").to_numpy().view(np.uint64)
            # A slice's anchor is the first string of its hash; bytes cut from another text of the document have none.
            at = np.arange(max(0, len(data) - gram + 1))
            owner = np.searchsorted(offsets, at, "right") - 1
            at = at[(at + gram <= offsets[owner + 1]) & (hashes.of(at, at + gram, 1) == names[owner])]
            whole, new = np.unique(np.searchsorted(offsets, at, "right") - 1, return_index=True)
            place, begin, end = at[new], offsets[whole], offsets[whole + 1]
            least, most = place - (end - length), place - begin
            good = (least >= 0) & (least <= most) & (most <= length - gram)
            whole, place, least, most = whole[good], place[good], least[good], most[good]
            counts = most // span - least // span + 1
            row = np.repeat(np.arange(len(whole)), counts)
            low = (least // span + np.cumsum(counts) - counts)[row]
            low = (2 * (least // span)[row] + np.arange(len(row)) - low) * span
            whole, place = whole[row], place[row]
            begin = place - np.minimum(most[row], low + span - 1)
            end = place - np.maximum(least[row], low) + length
            core = hashes.of(place - low, place - low - span + 1 + length, 5)
            raw = data.tobytes()
            columns = {
                "anchor": (core ^ mix(names[whole] + low.astype(np.uint64), 6)).view(np.int64),
                "slice": (hashes.of(begin, end, 2) + (end - begin).astype(np.uint64)).view(np.int64),
                "doc": batch.column("doc").to_numpy()[whole],
                "start": batch.column("start").to_numpy()[whole] + begin - offsets[whole],
                "bytes": [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())],
            }
            yield table(columns, PIECES)

    return written(cuts.select("anchor", "doc", "start", "bytes").mapInArrow(each, PIECES_SQL), "pieces")


def _of_wide(cuts: DataFrame, length: int, gram: int, wide: int) -> DataFrame:
    """Spans removed from the slices of anchors with very many of them."""
    pieces = _pieces(cuts, length, gram)
    first = pieces.groupBy("anchor", "slice").agg(F.min(F.struct("doc", "start", "bytes")).alias("first"), F.count("*").alias("n"))
    first = written(first, "first")
    heads = first.select("anchor", "first.*")
    several = first.where("n > 1").select("anchor", "slice", F.struct("first.doc", "first.start").alias("first"))
    places = pieces.select("anchor", "slice", F.struct("doc", "start").alias("place"), F.octet_length("bytes").alias("size"))
    copies = places.join(several, ["anchor", "slice"]).where("place != first")
    copies = copies.select("place.*", (F.col("place.start") + F.col("size")).alias("end"), F.lit(None).cast("bigint").alias("anchor"))
    met = written(heads.groupBy("anchor").count().where("count > 1"), "met")
    few, many = met.where(F.col("count") <= wide).select("anchor"), met.where(F.col("count") > wide).select("anchor")
    sorted_spans = _sorted_blocks(heads.join(few, "anchor"), max(1, first.count() // BLOCK_SLICES), length)
    return copies.unionByName(sorted_spans).unionByName(_dealt_windows(heads.join(many, "anchor"), length))


def _dealt_windows(cuts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of pieces of which very many meet, by the windows' own hashes."""

    def each(batches):
        for batch in slices(batches, "bytes", SCAN_BYTES // 8):
            data, offsets = utf8(batch.column("bytes"))
            hashes = Hashes(data)
            counts = np.maximum(0, np.diff(offsets) - length + 1)
            owner = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = offsets[:-1][owner] + place
            columns = {
                "one": hashes.of(at, at + length, 3).view(np.int64), "two": hashes.of(at, at + length // 2, 4).view(np.int64),
                "doc": batch.column("doc").to_numpy()[owner],
                "start": batch.column("start").to_numpy()[owner] + place,
            }
            yield table(columns, WINDOWS)

    windows = cuts.select("doc", "start", "bytes").mapInArrow(each, WINDOWS_SQL)
    place = F.struct("doc", "start")
    first = windows.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("one", "two", "first")
    later = windows.join(first, ["one", "two"]).where(place != F.col("first"))
    end = (F.col("start") + length).alias("end")
    return later.select("doc", "start", end, F.lit(None).cast("bigint").alias("anchor"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """Spans (doc, start, end) of bytes to remove, overlapping, of ``docs(key, text)``."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    found = _merged(_entries(docs, max(1, size // BUCKET_BYTES), length, gram), length)
    heads = found.where("anchor is not null")
    cuts = _cut(docs, heads)
    many = heads.groupBy("anchor").count().where(F.col("count") > wide).select("anchor")
    many = written(many, "wide")
    common = cuts.join(many, "anchor", "left_anti")
    blocks = max(1, cuts.count() // BLOCK_SLICES)
    spans = found.where("anchor is null").unionByName(_sorted_blocks(common, blocks, length))
    if many.limit(1).count():
        spans = spans.unionByName(_of_wide(cuts.join(many, "anchor", "left_semi"), length, gram, wide))
    return written(spans, "repeats")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("key"), "doc_id", "text")


def _kept(text: bytes, spans: list[dict]) -> tuple[list[tuple[int, int]], list[bytes]]:
    """Maximal removed runs and the pieces between them."""
    runs: list[list[int]] = []
    for start, end in sorted((s["start"], min(s["end"], len(text))) for s in spans):
        if start < end:
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([start, end])
    edges = [0, *[x for run in runs for x in run], len(text)]
    return [tuple(r) for r in runs], [text[a:b] for a, b in zip(edges[::2], edges[1::2])]


def digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document the bytes, removed bytes, removed runs and the hash of what is left."""

    def rate(batches):
        for batch in slices(batches):
            columns = {name: [] for name in DIGEST.names}
            columns["doc_id"] = batch.column("doc_id")
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            listed = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * len(texts)
            for text, own in zip(texts, listed):
                runs, pieces = _kept(text or b"", own or [])
                columns["n_bytes"].append(len(text or b""))
                columns["n_removed"].append(sum(b - a for a, b in runs))
                columns["n_spans"].append(len(runs))
                columns["kept_sha256"].append(hashlib.sha256(b"".join(pieces)).hexdigest())
            yield table(columns, DIGEST)

    docs = keyed(docs)
    ids = spans.select(F.col("doc").alias("key")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    touched = _of_documents(docs, spans).select("doc_id", "text", "spans").mapInArrow(rate, DIGEST_SQL)
    clean = docs.join(ids, "key", "left_anti").select("doc_id", "text").mapInArrow(rate, DIGEST_SQL)
    return touched.unionByName(clean)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``; broken characters become U+FFFD."""
    schema, key, listed = docs.schema, fresh("_key", docs.columns), fresh("_spans", docs.columns)
    spans = repeated_spans(keyed(docs), length)
    rows = docs.withColumn(key, F.coalesce("doc_id", F.lit(FIRST)))
    grouped = spans.groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(listed))

    def cut(batches):
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            left = [
                None if t is None else b"".join(_kept(t, s or [])[1]).decode("utf-8", "replace")
                for t, s in zip(texts, batch.column(listed).to_pylist())
            ]
            columns = [pa.array(left, pa.string()) if n == "text" else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.join(grouped, key, "left").drop(key).mapInArrow(cut, schema)


def repeats(docs: DataFrame) -> DataFrame:
    return digests(docs, repeated_spans(keyed(docs)))
