"""N-gram Jaccard join by parity sketches.

Documents link when their shingle sets A and B have ``den * |A n B| >= num * |A u B|``.
A set flips one bit of a long parity sketch for each shingle, so the Hamming distance
of two sketches is at most the size of the symmetric difference. The sketch is cut
into stretches of many bits; few bits are set, so a stretch is kept as the XOR of its
bits' hashes, which an even number of flips of one bit leaves as it was. Linked sets
differ in at most d shingles, where d follows from the largest size of their band; a
sketch of the band has m > d stretches, so linked sets agree in at least m - d of
them (pigeonhole).

Stretches that are empty, or hold common shingles only, say little and would bring
unrelated documents together. A set keeps these weak stretches to itself: while one of
two linked sets has fewer than m - d of them, a stretch that is not weak agrees too
(equal stretches are equally weak). Sets with more are cut a second time, into finer
stretches, where the same holds; so documents of one template part as soon as they
have somewhat more than d shingles of their own. The sets that are weak there too
publish all their finer stretches, which meets the case of two such sets. Which
shingles count as common is learned from a bounded sample of the documents; the result
does not depend on it, only the work does.

Equal sets are one class from the start. Classes that share a word meet in hashed
buckets; a small group gives its pairs, a large one only pairs with its first
member. A short parity sketch of both sets, whose Hamming distance is a lower bound of
their difference, drops most pairs that cannot link; the rest are verified on the
whole sets. Large groups whose members are then in several components give each
member's nearest pair across components, twice, and at last all pairs between components that
pass the same bound; so no link is lost and a group of copies never gives all its pairs.
Where the second time all pairs are few for the rows compared, they are taken at
once, and nothing is left for a third. Only components that new links touch are joined anew.
Members of a large group are dealt into blocks of about ``BLOCK_ROWS`` rows and each
pair of blocks is compared in a call of its own; blocks of the group's largest
component only meet the other blocks, and of groups with the same members one is taken.

Cases: null and empty texts, and texts without words, have empty sets and link with
nothing; rows of one doc_id with several texts are judged text by text; a null doc_id gets
the component of its class, null if no other row is in it; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.components import components, sized
from sessionloom.llm.packing import written
from sessionloom.llm.shingles import mix, sets
from sessionloom.llm.workers import cuts, slices, table, utf8

WIDTH, NUM, DEN = 4, 85, 100
BAND, SLACK = 1.25, 0.1
COMMON_DOCUMENTS, COMMON_TIMES, COMMON_KEPT = 2_000, 5, 100_000
FINER = 4
SMALL_GROUP = 8
SHARES = (0, 3, math.inf)
BLOCK_ROWS = 1_000
BUCKET_BYTES = 8 << 20
KEY_BYTES = 5
PARITY_BITS = 1 << 16
BROADCAST_ROWS = 4_000_000
BROADCAST_PAIRS = 1_000_000
SET_BYTES = 1 << 20

FEATURES_SQL = (
    "doc_id bigint, n_shingles bigint, node bigint, parity binary, bucket int, keys binary, nodes binary"
)
FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("parity", pa.binary()),
     ("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary())]
)
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("large", pa.int64())])
PAIRS_SQL = "a bigint, b bigint, large bigint"


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The shingle sets of a batch's texts, a few texts at a time: hashing takes many times their bytes."""
    for part in cuts(batch, SET_BYTES):
        yield from sets(*utf8(part.column("text")), width)


def class_of(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set, the same for equal sets."""
    total = mix(shingles, 3).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))
    return int(mix(total, 4).view(np.int64)[0])


def bands(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, its largest size) for the bands in which a set of ``size`` meets partners.

    Band k holds sizes from ``BAND**k`` to below ``BAND**(k + 1)``; a set also joins
    the later bands that hold sizes with which it may still link.
    """
    top = lambda k: math.ceil(BAND ** (k + 1)) - 1
    own = max(0, int(math.log(size, BAND)) - 1)
    while top(own) < size:
        own += 1
    out = [(own, top(own))]
    while out[-1][1] < size * den // num:
        out.append((out[-1][0] + 1, top(out[-1][0] + 1)))
    return out


def common_shingles(docs: DataFrame, rows: int, width: int) -> np.ndarray:
    """Shingles that several documents of a sample share, at most ``COMMON_KEPT``, sorted."""
    schema = pa.schema([("shingle", pa.int64())])

    def scan(batches):
        for batch in slices(batches):
            for own in _sets(batch, width):
                yield table({"shingle": own.view(np.int64)}, schema)

    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // COMMON_DOCUMENTS))) == 0)
    counted = chosen.select("text").mapInArrow(scan, "shingle bigint").groupBy("shingle").count()
    several = counted.where(F.col("count") >= COMMON_TIMES).orderBy(F.col("count").desc(), "shingle").limit(COMMON_KEPT)
    return np.sort(np.array([r["shingle"] for r in several.collect()], np.int64).view(np.uint64))


def sketch(
    shingles: np.ndarray, band: int, top: int, num: int, den: int, common: np.ndarray = np.zeros(0, np.uint64)
) -> np.ndarray:
    """Join keys of the set's sketch in a band; empty if only equal sets can link there."""
    distance = (den - num) * 2 * top // (den + num)
    if distance == 0:
        return np.zeros(0, np.uint64)
    count = distance + 1 + max(2, math.ceil(SLACK * (distance + 1)))
    value, rare = mix(shingles, 10), np.ones(len(shingles), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rare = common[at] != shingles
    keys = []
    for level in range(2):
        place = ((shingles >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        parity = np.zeros(count, np.uint64)
        np.bitwise_xor.at(parity, place, value)
        weak = np.bincount(place[rare], minlength=count) == 0
        mostly_weak = weak.sum() >= count - distance
        kept = np.ones(count, bool) if mostly_weak and level else ~weak
        stretch = np.arange(count, dtype=np.uint64)[kept] + np.uint64((band << 40) + (level << 32))
        keys.append(mix(parity[kept] ^ mix(stretch, 5), 6))
        if not mostly_weak:
            break
        count *= FINER
    return np.concatenate(keys)


def parity(shingles: np.ndarray) -> bytes:
    """A short sketch: each shingle flips one of at least four bits a shingle."""
    bits = 64
    while bits < min(4 * len(shingles), PARITY_BITS):
        bits *= 2
    place = (mix(shingles, 11) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of the shortest one's length; halves of a longer one add up to it."""
    words = min(map(len, sketches)) // 8
    out = np.zeros((len(sketches), words), np.uint64)
    for row, raw in enumerate(sketches):
        out[row] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), axis=0)
    return out


def may_link(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the Hamming distance leaves room for a link of sets with ``sizes`` shingles together."""
    distance = np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)
    return distance * (den + num) <= (den - num) * sizes


def _features(
    docs: DataFrame, buckets: int, width: int, num: int, den: int, common: np.ndarray = np.zeros(0, np.uint64)
) -> DataFrame:
    """Rows of two kinds: one per document (bucket null), and packed keys per bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON_KEPT numbers

    def scan(batches):
        common = shared.value
        for batch in slices(batches):
            names, sizes, nodes, keys, owners, short = batch.column("doc_id"), [], [], [], [], []
            seen: set[int] = set()
            for own in _sets(batch, width):
                node = class_of(own)
                sizes.append(len(own))
                nodes.append(node)
                short.append(None)
                if len(own) and node not in seen:
                    seen.add(node)
                    short[-1] = parity(own)
                    for band, top in bands(len(own), num, den):
                        here = sketch(own, band, top, num, den, common)
                        keys.append(here)
                        owners.append(np.full(len(here), node, np.int64))
            n = len(sizes)
            yield table(
                {"doc_id": names, "n_shingles": sizes, "node": nodes, "parity": short, "bucket": [None] * n,
                 "keys": [None] * n, "nodes": [None] * n}, FEATURES,
            )
            if keys and sum(map(len, keys)):
                key, owner = np.concatenate(keys), np.concatenate(owners)
                bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                key, owner, bucket = key[order], owner[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.append(cuts[1:], len(key))
                cut = key.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                n = len(cuts)
                yield table(
                    {"doc_id": [None] * n, "n_shingles": [None] * n, "node": [None] * n, "parity": [None] * n,
                     "bucket": bucket[cuts], "keys": [cut[a:b].tobytes() for a, b in zip(cuts, ends)],
                     "nodes": [owner[a:b].tobytes() for a, b in zip(cuts, ends)]}, FEATURES,
                )

    return written(docs.select("doc_id", "text").mapInArrow(scan, FEATURES_SQL), "sketches")


def _cross(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs within groups, given the group start of each sorted row."""
    later = np.arange(len(groups)) - groups
    left = np.repeat(groups, later) + np.arange(int(later.sum())) - np.repeat(np.cumsum(later) - later, later)
    return left, np.repeat(np.arange(len(groups)), later)


def _pairs(keys: DataFrame) -> DataFrame:
    """(a, b, large): candidates of small groups; (first, member, key) of large ones."""

    def meet(key, bucket):
        short = np.frombuffer(b"".join(bucket.column("keys").to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
        owner = np.frombuffer(b"".join(bucket.column("nodes").to_pylist()), np.int64)
        name = np.zeros((len(short), 8), np.uint8)
        name[:, :KEY_BYTES] = short
        name = name.view(np.uint64)[:, 0]
        order = np.lexsort((owner, name))
        name, owner = name[order], owner[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])]
        name, owner = name[new], owner[new]
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        sizes = np.diff(np.append(first, len(name)))
        start = np.repeat(first, sizes)
        size = np.repeat(sizes, sizes)
        small = np.flatnonzero((size > 1) & (size <= SMALL_GROUP))
        place = np.full(len(name), -1)
        place[small] = np.arange(len(small))
        left, right = _cross(place[start[small]])
        a, b = owner[small][left], owner[small][right]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield table({"a": both[:, 0], "b": both[:, 1], "large": pa.nulls(len(both), pa.int64())}, PAIRS)
        large = np.flatnonzero((size > SMALL_GROUP) & (np.arange(len(name)) > start))
        group = (name[large] ^ (np.uint64(key[0].as_py()) << np.uint64(40))).view(np.int64)
        yield table({"a": owner[start[large]], "b": owner[large], "large": group}, PAIRS)

    return written(keys.groupBy("bucket").applyInArrow(_tabled(meet, PAIRS), PAIRS_SQL), "pairs")


def _tabled(function, schema: pa.Schema):
    """A grouped function that yields record batches, as one that returns a table."""

    def call(key, group):
        return pa.Table.from_batches(list(function(key, group)), schema)

    return call


def _few(rows: DataFrame, most: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` of a few numbers each, broadcast when their number, or ``most``, is bounded."""
    return F.broadcast(rows) if (rows.count() if most is None else most) <= limit else rows


def _short(shingles: np.ndarray) -> bytes:
    """The low ``KEY_BYTES`` of each hash: enough to tell the shingles of two sets apart."""
    return np.ascontiguousarray(shingles.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _long(raw: pa.Buffer) -> np.ndarray:
    few = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(few), 8), np.uint8)
    out[:, :KEY_BYTES] = few
    return np.sort(out.view(np.uint64)[:, 0])


def _candidates(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that may link by their sizes and short sketches."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(
            classes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("parity").alias(f"p{side}")), side
        )
    fits = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (F.col("a") != F.col("b"))
    ends = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bounded(batches):
        for batch in slices(batches, "pa"):
            rows = batch.to_pylist()
            kept = [
                bool(may_link(*folded([r["pa"], r["pb"]]), np.int64(r["na"] + r["nb"]), num, den)) for r in rows
            ]
            found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=ends)
            yield found.filter(pa.array(kept, pa.bool_()))

    both = both.where(fits).select("a", "b", "na", "nb", "pa", "pb").mapInArrow(bounded, "a bigint, b bigint")
    return written(both, "candidates")


def _verified(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, num: int, den: int, repeated_ids: bool
) -> DataFrame:
    """Linked pairs (a, b) of classes among distinct stored ``pairs(a, b)``, judged on the whole sets."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    asked = written(classes.join(_few(asked), "node", "left_semi").select("doc_id"), "asked")

    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def collect(batches):
        for batch in slices(batches):
            own = list(_sets(batch, width))
            yield table({"node": [class_of(s) for s in own], "shingles": [_short(s) for s in own]}, schema)

    texts = docs.select("doc_id", "text").join(_few(asked), "doc_id", "left_semi")
    found = texts.mapInArrow(collect, "node bigint, shingles binary")
    if repeated_ids:
        found = found.groupBy("node").agg(F.first("shingles").alias("shingles"))
    found = written(found, "sets")
    pairs = _few(pairs, limit=BROADCAST_PAIRS)
    joined = found.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).join(pairs, "a")
    joined = joined.join(found.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for batch in batches:
            kept = []
            for left, right in zip(batch.column("sa"), batch.column("sb")):
                left, right = _long(left.as_buffer()), _long(right.as_buffer())
                place = np.searchsorted(left, right)
                shared = int((left[np.minimum(place, len(left) - 1)] == right).sum())
                kept.append(den * shared >= num * (len(left) + len(right) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=linked).filter(pa.array(kept, pa.bool_()))

    return written(joined.select("a", "b", "sa", "sb").mapInArrow(compare, "a bigint, b bigint"), "links")


def _blocks(named: DataFrame, most: int | None = None) -> DataFrame:
    """``named(large, node, component)`` of groups with several components, once for each
    pair of blocks (``low``, ``high``) that the row's own block, ``cell``, is in.

    Every two members of different components are in one pair of blocks at least.
    There are at most ``most`` groups, if given.
    """
    here = F.xxhash64("node")
    parts = named.groupBy("large", "component").agg(F.count("*").alias("n"), F.bit_xor(here).alias("mark"))
    groups = parts.groupBy("large").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("in_main"),
        F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"), F.count("*").alias("parts"),
    ).where("parts > 1")
    groups = groups.groupBy("n", "mark").agg(F.min_by(F.struct("large", "main", "in_main"), "large").alias("one"))
    cut = lambda rows: F.ceil(rows / F.lit(BLOCK_ROWS)).cast("int")
    groups = groups.select(
        "one.large", "one.main", cut(F.col("one.in_main")).alias("mains"), cut(F.col("n") - F.col("one.in_main")).alias("rest")
    )
    rows = named.join(_few(written(groups, "groups") if most is None else groups, most), "large")
    in_main = F.col("component") == F.col("main")
    rows = rows.withColumn("cell", F.when(in_main, F.col("rest") + F.pmod(here, "mains")).otherwise(F.pmod(here, "rest")).cast("int"))
    others = F.when(in_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return rows.select(
        "large", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", "node", "component"
    )


def _members(pairs: DataFrame) -> DataFrame:
    """(large, node): the members of large groups.

    Groups with one first member are taken together, as one group of all their members,
    where that takes no more comparisons than they take one by one.
    """
    large = pairs.where("large is not null")
    apart = large.groupBy("a", "large").agg((F.count("*") + 1).cast("double").alias("n"))
    apart = apart.groupBy("a").agg(F.sum(F.col("n") * F.col("n")).alias("apart"), F.count("*").alias("groups"))
    together = large.select("a", "b").distinct().groupBy("a").agg((F.count("*") + 1).cast("double").alias("n"))
    merged = apart.where("groups > 1").join(together, "a").where("n * n <= apart").select("a", F.xxhash64("a").alias("all"))
    named = large.join(_few(merged, large.count() // SMALL_GROUP), "a", "left").withColumn("large", F.coalesce("all", "large"))
    members = named.select("large", F.col("b").alias("node")).unionByName(named.select("large", F.col("a").alias("node")))
    return written(members.distinct(), "members")


def _met(
    members: DataFrame, groups: int, parts: DataFrame, classes: DataFrame, num: int, den: int, share: float
) -> DataFrame:
    """Pairs (large, node, other) between different components inside large groups that may link.

    A pair of blocks gives all its pairs (``whole``) if they are at most ``share`` for each of
    its rows. Else every member that has such pairs gives only the one with the nearest
    sketch, which is enough to join most of what belongs together.
    Members that give none have no pair later either, as components only grow.
    There are at most ``groups`` large groups.
    """
    named = members.join(_few(parts), "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = pa.schema([("large", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("distance", pa.int64()), ("whole", pa.bool_())])

    def cross(key, group):
        cell, part = group.column("cell").to_numpy(), group.column("component").to_numpy()
        node, size = group.column("node").to_numpy(), group.column("n_shingles").to_numpy()
        short = folded(group.column("parity").to_pylist())
        left, right = np.flatnonzero(cell == key[1].as_py()), np.flatnonzero(cell == key[2].as_py())
        far = np.iinfo(np.int64).max
        apart = np.full((len(left), len(right)), far)
        for row, at in enumerate(left):
            near = may_link(short[at], short[right], size[at] + size[right], num, den) & (part[right] != part[at])
            near &= np.minimum(size[at], size[right]) * den >= np.maximum(size[at], size[right]) * num
            other = right[near]
            apart[row, near] = np.bitwise_count(short[other] ^ short[at]).sum(axis=1, dtype=np.int64)
        if not apart.size:
            return found.empty_table()
        whole = bool((apart < far).sum() <= share * sum(apart.shape))
        if not whole:  # the nearest of each row on the left, then of each on the right
            rows, columns = np.arange(len(left)), np.arange(len(right))
            a, b = np.r_[rows, apart.argmin(axis=0)], np.r_[apart.argmin(axis=1), columns]
            own, other = np.r_[left, right], np.r_[right[b[: len(rows)]], left[a[len(rows) :]]]
        else:
            a, b = np.nonzero(apart < far)
            own, other = left[a], right[b]
        met = apart[a, b] < far
        own, other = own[met], other[met]
        return pa.table(
            {"large": np.full(len(own), key[0].as_py()), "node": node[own], "other": node[other], "distance": apart[a, b][met],
             "whole": np.full(len(own), whole)}, found
        )

    mixed = _blocks(named, groups).join(classes.select("node", "n_shingles", "parity"), "node")
    mixed = mixed.select("large", "low", "high", "cell", "node", "component", "n_shingles", "parity")
    met = mixed.groupBy("large", "low", "high").applyInArrow(cross, "large bigint, node bigint, other bigint, distance bigint, whole boolean")
    return written(met, "met")


def _left_over(met: DataFrame, tried: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of ``met`` not yet tried; of a member whose pairs are not whole the nearest only."""
    one = met.where("not whole").groupBy("large", "node").agg(F.min_by("other", F.struct("distance", "other")).alias("other"))
    met = met.where("whole").select("large", "node", "other").unionByName(one)
    found_pairs = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found_pairs.join(known, ["a", "b"], "left_anti")


def _grown(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts(node, component)`` after further ``links(a, b)``: components of components."""
    nodes = parts.count()
    known = _few(parts, nodes)
    for side in ("a", "b"):
        own = known.select(F.col("node").alias(side), F.col("component").alias("_own"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("_own", side)).drop("_own")
    moved = written(components(written(links, "edges")), "moved")
    new = moved.select("node", F.col("node").alias("component"))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    grown = parts.unionByName(new).distinct().join(_few(to), "component", "left")
    grown = grown.select("node", F.coalesce("_to", "component").alias("component"))
    return written(sized(grown, nodes + moved.count()), "parts")


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs(doc_id, text)``."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    common = common_shingles(docs, size["rows"], width)
    features = _features(docs, max(1, (size["n"] or 0) // BUCKET_BYTES), width, num, den, common)
    rows = features.where("bucket is null").select("doc_id", "n_shingles", "node", "parity")
    classes = rows.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
        F.first("parity", ignorenulls=True).alias("parity"),
    )
    classes = written(classes, "classes")
    pairs = _pairs(features.where("bucket is not null").select("bucket", "keys", "nodes"))
    distinct = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    seen = rows.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    verify = lambda p: _verified(p, classes, docs, width, num, den, seen["n"] > seen["ids"])
    parts = written(components(verify(_candidates(distinct, classes, num, den))), "parts")
    # Nearest pairs first; the last round takes all pairs that are then left.
    tried, members = pairs.select("a", "b"), _members(pairs)
    groups = members.count() // SMALL_GROUP
    for share in SHARES:
        met = _met(members, groups, parts, classes, num, den, share)
        if not met.count():
            break
        more = written(_left_over(met, tried), "more")
        links = verify(more) if more.count() else more
        if links.count():
            parts = _grown(parts, links)
        if not met.where("not whole").limit(1).count():
            break
        tried, members = tried.unionByName(more), met.select("large", "node").distinct()
    # From classes to documents: a component is named by its smallest doc_id.
    first = classes.select("node", F.col("doc_id").alias("_first"))
    known = _few(parts)
    names = first.join(known, "node").groupBy("component").agg(F.min("_first").alias("component_id"))
    named = _few(parts.join(names, "component").select("node", "component_id"), parts.count())
    joined = rows.drop("parity").join(first, "node", "left").join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "_first")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one document of each component: the one of smallest doc_id.

    Of rows that share a doc_id one stays. Rows without a doc_id all stay.
    """
    parts = near_duplicates(docs, width, num, den)
    stays = F.col("doc_id") == F.col("component_id")
    ids = written(parts.where(stays).select("doc_id"), "stay")
    unique = ids.distinct()
    known = docs.where("doc_id is not null").join(_few(unique), "doc_id", "left_semi")
    if ids.count() > unique.count():
        known = known.dropDuplicates(["doc_id"])
    return known.select(*docs.columns).unionByName(docs.where("doc_id is null"))
