"""How the word use of sources differs: iceberg prefix refinement, then exact shares.

Which terms occur in enough documents of a language is found without ever counting
every term. Documents become stored chunks once: per chunk and language its different
terms in byte order, and for each document the places of its terms there. Then byte
prefixes grow level by level (two bytes, doubled each time; a term ends with a zero
byte, which no term contains). A level counts, for each prefix of its length whose
own prefix survived the level before, the documents that hold it. Documents are whole
within a chunk and their terms lie in order, so a document's equal prefixes are
neighbours and count once; chunks send one row per prefix, and these are added up. A
prefix in fewer documents than the threshold is discarded with all terms that begin
with it; prefixes that reach their zero byte are kept terms; the loop ends when no
open prefix is left, after about log2 of the longest kept term's bytes.

The survivors of a level reach the chunks as a bitmap of their hashes, 4 MB at any
size of the corpus. Two prefixes on one bit can only let a discarded one be counted
once more; the count, which is exact, discards it again at the next level.

Occurrences are then counted for kept terms alone. Shares are whole numbers
(1 + floor of SCALE times (count + SMOOTH) over (total + SMOOTH times terms), in
decimals, so nothing overflows). Pairs of sources are compared in blocks of about
1,024 terms and at most 256 by 256 sources, as a small dense matrix each in which
missing terms have the share of a count of zero; the parts are added up.

Cases: null text, language or source count as empty; texts without terms, and null ones,
still make their source occur; very long texts are one document, and a term may be
as long as it likes; each row is a document, so repeated rows count again; equal
values rank by the smaller name in UTF-8 order; a language without kept terms has
pairs of value 0 and no terms; one source has no pairs; no rows give no rows; only
text, lang and source are read, so clashing columns do no harm.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.packing import written
from sessionloom.llm.workers import slices, table

LEAST_DOCUMENTS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
FIRST_LENGTH = 2
#: Text of one chunk (or one longer document); bits of the bitmap of survivors.
CHUNK_BYTES, FILTER_BITS = 32 << 20, 1 << 25
TERMS_A_BLOCK, SOURCES_A_BLOCK, ROWS_A_BATCH = 1_024, 256, 100_000
TERM = re.compile(rb"[a-z\x80-\xff]+")
END = b"\x00"

CHUNKS = pa.schema(
    [("lang", pa.string()), ("sources", pa.list_(pa.string())), ("terms", pa.binary()), ("ids", pa.binary()),
     ("counts", pa.binary()), ("doc_terms", pa.binary()), ("doc_source", pa.binary())]
)
CHUNKS_SQL = (
    "lang string, sources array<string>, terms binary, ids binary, counts binary, doc_terms binary, doc_source binary"
)
PREFIXES = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("n", pa.int64())])
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64())])


class _Chunk:
    """Documents of one language: their terms, how often, and whose they are."""

    def __init__(self):
        self.places: dict[bytes, int] = {}
        self.sources: dict[str, int] = {}
        self.ids, self.counts, self.doc_terms, self.doc_source = array("I"), array("I"), array("I"), array("I")

    def add(self, source: str, text: bytes) -> None:
        terms, places = Counter(TERM.findall(text.lower())), self.places
        self.ids.extend([places.setdefault(t, len(places)) for t in terms])
        self.counts.extend(terms.values())
        self.doc_terms.append(len(terms))
        self.doc_source.append(self.sources.setdefault(source, len(self.sources)))

    def row(self, lang: str) -> pa.RecordBatch:
        """Terms in byte order, and each document's terms in that order."""
        terms = sorted(self.places)
        rank = np.zeros(len(terms), np.uint32)
        rank[[self.places[t] for t in terms]] = np.arange(len(terms))
        ids, counts = rank[np.array(self.ids, np.uint32)], np.array(self.counts, np.uint32)
        doc = np.repeat(np.arange(len(self.doc_terms)), np.array(self.doc_terms, np.int64))
        order = np.argsort(doc << 32 | ids)
        columns = {
            "lang": [lang], "sources": [list(self.sources)], "terms": [b"".join([t + END for t in terms])],
            "ids": [ids[order].tobytes()], "counts": [counts[order].tobytes()],
            "doc_terms": [self.doc_terms.tobytes()], "doc_source": [self.doc_source.tobytes()],
        }
        return table(columns, CHUNKS)


def chunks(docs: DataFrame) -> DataFrame:
    """The stored chunks of all documents."""

    def gather(batches):
        held, size = {}, 0
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("lang", "source")]
            for lang, source, text in zip(*columns, batch.column("text").cast(pa.large_binary()).to_pylist()):
                held.setdefault(lang, _Chunk()).add(source, text)
                size += len(text)
            if size >= CHUNK_BYTES:
                yield from [chunk.row(lang) for lang, chunk in held.items()]
                held, size = {}, 0
        yield from [chunk.row(lang) for lang, chunk in held.items()]

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return written(docs.select(*named).mapInArrow(gather, CHUNKS_SQL), "chunks")


def _hash(lang: Column, prefix: Column) -> Column:
    return F.xxhash64(F.concat(F.encode(lang, "utf-8"), F.lit(END), prefix))


def survivors(kept: DataFrame) -> np.ndarray:
    """Bitmap of the hashes of (lang, prefix): FILTER_BITS bits, whatever their number."""
    bit = F.pmod(_hash(F.col("lang"), F.col("prefix")), F.lit(FILTER_BITS)) + 1
    parts = kept.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.collect():  # at most FILTER_BITS / 32,768 rows of 4 KB
        start = (row["part"] - 1) * len(row["bits"])
        bitmap[start : start + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def _alive(lang: str, terms: list[bytes], length: int, bitmap: np.ndarray | None) -> np.ndarray:
    """Which terms are longer than ``length`` bytes, their end included, and had a surviving prefix of it."""
    alive = np.ones(len(terms), bool)
    if bitmap is None:
        return alive
    start, before, known = lang.encode() + END, None, False
    for n, term in enumerate(terms):
        if len(term) < length:
            alive[n] = False
            continue
        prefix = term[:length]
        if prefix != before:
            bit = xxhash.xxh64_intdigest(start + prefix, 42) & FILTER_BITS - 1
            before, known = prefix, bool(bitmap[bit >> 3] >> (bit & 7) & 1)
        alive[n] = known
    return alive


def _terms(packed: bytes) -> list[bytes]:
    return packed.split(END)[:-1]


def _batches(schema: pa.Schema, columns: dict):
    whole = table(columns, schema)
    for start in range(0, whole.num_rows, ROWS_A_BATCH):
        yield whole.slice(start, ROWS_A_BATCH)


def level(stored: DataFrame, length: int, before: int, bitmap) -> DataFrame:
    """(lang, prefix, n): documents that hold each prefix of ``length`` bytes, partly added up.

    Only terms longer than ``before`` bytes whose prefix of that length is in ``bitmap`` count.
    """

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lang, terms = row["lang"], _terms(row["terms"])
                alive = np.flatnonzero(_alive(lang, terms, before, bitmap and bitmap.value))
                if not len(alive):
                    continue
                prefixes = [(terms[n] + END)[:length] for n in alive]
                new = np.array([True, *[a != b for a, b in zip(prefixes, prefixes[1:])]])
                group = np.full(len(terms), -1, np.int64)
                group[alive] = np.cumsum(new) - 1
                sizes = np.frombuffer(row["doc_terms"], np.uint32)
                held = group[np.frombuffer(row["ids"], np.uint32)]
                doc = np.repeat(np.arange(len(sizes)), sizes)[held >= 0]
                held = held[held >= 0]
                first = np.ones(len(held), bool)
                first[1:] = (held[1:] != held[:-1]) | (doc[1:] != doc[:-1])
                firsts = [p for p, f in zip(prefixes, new) if f]
                n = np.bincount(held[first], minlength=len(firsts))
                yield from _batches(PREFIXES, {"lang": [lang] * len(firsts), "prefix": firsts, "n": n})

    return stored.select("lang", "terms", "ids", "doc_terms").mapInArrow(count, "lang string, prefix binary, n bigint")


def kept_terms(stored: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, prefix, documents): kept terms with their end byte, refined level by level."""
    context = stored.sparkSession.sparkContext
    done, bitmap, before, length = [], None, 0, FIRST_LENGTH
    while True:
        partial = level(stored, length, before, bitmap)
        counted = partial.groupBy("lang", "prefix").agg(F.sum("n").alias("documents"))
        kept = written(counted.where(F.col("documents") >= least), "prefixes")
        ended = F.expr("substring(prefix, -1, 1) = x'00'")
        done.append(kept.where(ended))
        still_open = kept.where(~ended)
        if still_open.isEmpty():
            break
        bitmap, before, length = context.broadcast(survivors(still_open)), length, length * 2
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def counts(stored: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of kept terms, where there are any."""
    bitmap = stored.sparkSession.sparkContext.broadcast(survivors(kept))

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                terms, start = _terms(row["terms"]), row["lang"].encode() + END
                bits = np.array([xxhash.xxh64_intdigest(start + t + END, 42) & FILTER_BITS - 1 for t in terms], np.int64)
                alive = (bitmap.value[bits >> 3] >> (bits & 7) & 1).astype(bool)
                ids = np.frombuffer(row["ids"], np.uint32)
                wanted = alive[ids]
                source = np.frombuffer(row["doc_source"], np.uint32)
                source = np.repeat(source, np.frombuffer(row["doc_terms"], np.uint32))[wanted]
                key, which = np.unique(source.astype(np.int64) * len(terms) + ids[wanted], return_inverse=True)
                n = np.bincount(which, np.frombuffer(row["counts"], np.uint32)[wanted], len(key)).astype(np.int64)
                columns = {
                    "lang": [row["lang"]] * len(key), "source": [row["sources"][s] for s in key // max(len(terms), 1)],
                    "term": [terms[t] for t in key % max(len(terms), 1)], "n": n,
                }
                yield from _batches(COUNTED, columns)

    partial = stored.mapInArrow(count, "lang string, source string, term binary, n bigint")
    summed = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    exact = kept.select("lang", F.expr("substring(prefix, 1, octet_length(prefix) - 1)").alias("term"))
    return summed.join(exact, ["lang", "term"], "left_semi")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)); null without terms."""
    above = f"cast({SCALE} as decimal(10, 0)) * cast({count} + {SMOOTH} as decimal(20, 0))"
    return F.expr(f"if({terms} > 0, 1 + ({above}) div cast({total} + {SMOOTH} * {terms} as decimal(20, 0)), null)")


def _parts(keys, rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of terms for each pair of sources of two blocks of sources."""
    lang, _, low, high = keys
    sources = sources.sort_values("number")
    numbers = sources["number"].to_numpy()
    terms, term = np.unique(rows["term"].to_numpy(dtype=object), return_inverse=True) if len(rows) else ((), [])
    shares = np.repeat(sources["zero"].fillna(0).to_numpy(np.int64)[None, :], len(terms), axis=0)
    if len(rows):
        shares[term, np.searchsorted(numbers, rows["number"].to_numpy())] = rows["share"].to_numpy(np.int64)
    block = numbers // SOURCES_A_BLOCK
    out = []
    for a in np.flatnonzero(block == low):
        others = np.flatnonzero((block == high) & (numbers > numbers[a]))
        values = np.abs(shares[:, others] - shares[:, a : a + 1]).sum(axis=0)
        out.append(pd.DataFrame({"lang": lang, "a": numbers[a], "b": numbers[others], "value": values, "seen": len(terms)}))
    empty = pd.DataFrame({"lang": [], "a": [], "b": [], "value": [], "seen": []})
    return pd.concat(out) if out else empty


def pairs(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each two sources of a language, in both orders.

    ``counted`` has lang, source, term, share; ``groups`` has lang, source, terms (of the
    language) and zero (share of a count of zero).
    """
    by_source, of_lang = Window.partitionBy("lang").orderBy("source"), Window.partitionBy("lang")
    numbered = groups.withColumns(
        {"number": F.row_number().over(by_source) - 1, "last": F.floor((F.count("*").over(of_lang) - 1) / SOURCES_A_BLOCK)}
    ).withColumns(
        {"own": F.floor(F.col("number") / SOURCES_A_BLOCK), "blocks": F.floor(F.col("terms") / TERMS_A_BLOCK) + 1}
    )
    met = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("met")
    ends = [F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high")]
    rows = counted.join(numbered.select("lang", "source", "number", "own", "last", "blocks"), ["lang", "source"])
    rows = rows.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", "number", "share", "own", met)
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    held = numbered.select("lang", "number", "zero", "own", "last", each).select("lang", "block", "number", "zero", "own", met)
    keys = ["lang", "block", "low", "high"]
    summed = (
        rows.select("lang", "block", *ends, "term", F.col("number").alias("number"), "share").groupBy(*keys)
        .cogroup(held.select(F.col("lang").alias("lang"), "block", *ends, "number", "zero").groupBy(*keys))
        .applyInPandas(_parts, "lang string, a bigint, b bigint, value bigint, seen bigint")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    )
    side = numbered.select("lang", "source", "number", "zero", "terms")
    first = side.withColumnsRenamed({"number": "a", "source": "source_a", "zero": "zero_a"})
    second = side.drop("terms").withColumnsRenamed({"number": "b", "source": "source_b", "zero": "zero_b"})
    unseen = F.abs(F.col("zero_a") - F.col("zero_b")) * (F.col("terms") - F.col("seen"))
    found = summed.join(first, ["lang", "a"]).join(second, ["lang", "b"])
    both = F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")),
    )
    return found.select("lang", F.inline(both), (F.col("value") + F.coalesce(unseen, F.lit(0))).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances of sources and their most overused terms."""
    stored = chunks(docs)
    kept = kept_terms(stored, least)
    counted = written(counts(stored, kept), "counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("bigint")
    groups = stored.select("lang", F.explode("sources").alias("source")).distinct()
    groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("terms", none).alias("terms"), F.coalesce("total", none).alias("total")
    )
    groups = written(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shared = counted.join(groups, ["lang", "source"]).withColumn("share", share("n", "total", "terms"))
    distances = pairs(
        shared.select("lang", "source", "term", "share"), groups.withColumn("zero", share("0", "total", "terms"))
    )
    everywhere = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    over = (
        shared.join(everywhere, ["lang", "term"]).join(langs, "lang")
        .withColumn("value", F.col("share") - share("lang_n", "lang_total", "terms")).where(F.col("value") > 0)
        .select("lang", "source", F.col("term").alias("item"), "value")
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    terms = over.withColumn("rank", rank).where(F.col("rank") <= top)
    terms = terms.withColumn("item", F.col("item").cast("string"))
    kinds = [distances.withColumn("rank", rank).withColumn("part", F.lit("pair")), terms.withColumn("part", F.lit("term"))]
    return kinds[0].unionByName(kinds[1]).select("lang", "source", "part", "item", "value", "rank")
