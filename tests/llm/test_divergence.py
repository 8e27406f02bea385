"""Source divergence against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionloom.llm import divergence
from sessionloom.llm.queries import ORACLE, QUERIES
from checking import database

SCHEMA = "text string, lang string, source string, term int, n string"


def plain(rows, least=30, top=50):
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        groups[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = []
    for lang in held.keys() | {g[0] for g in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)

        def share(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = {s: share(c) for (g, s), c in groups.items() if g == lang}
        every = share(sum((c for (g, _), c in groups.items() if g == lang), Counter()))
        for s, p in own.items():
            found = [("pair", o, sum(abs(p[t] - q[t]) for t in kept)) for o, q in own.items() if o != s]
            over = [("term", t, p[t] - every[t]) for t in kept if groups[lang, s][t] and p[t] > every[t]]
            for part in (found, over):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
            out += [(lang, s, *r, k) for part, limit in ((found, None), (over, top)) for k, r in enumerate(part[:limit], 1)]
    return sorted(out)


def compare(spark, rows, least=30, parts=4):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    got = divergence.audit(df, least)
    assert got.dtypes == [
        ("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")
    ]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least)


def generated(seed, size):
    rng = random.Random(seed)
    vocabulary = ["a", "ab", "abc", "abd", "abcd" * 3, "abcd" * 3 + "e", "Zoë", "zoë", "ZOE", "中文", "中", "x" * 300, "don't", "b" * 17]
    vocabulary += [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for _ in range(size):
        words = rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 25))
        rows.append((" ".join(words), rng.choice(["en", "en", "de", None, "q"]), rng.choice(["s1", "s1", "s2", "Ü", None, "s10"])))
    return rows


@pytest.mark.parametrize("seed, least", [(1, 30), (2, 3), (3, 1)])
def test_matches_plain_counting(spark, seed, least):
    compare(spark, generated(seed, 400), least)


def test_small_chunks_blocks_and_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 500)
    monkeypatch.setattr(divergence, "TERMS_A_BLOCK", 7)
    monkeypatch.setattr(divergence, "SOURCES_A_BLOCK", 2)
    compare(spark, generated(4, 300), 5)


def test_a_full_bitmap_discards_nothing_wrongly(spark, monkeypatch):
    """With one bit in 32,768 set more than once, counts still decide."""
    monkeypatch.setattr(divergence, "FILTER_BITS", 1 << 15)
    rng = random.Random(5)
    letters = "abcdefghij"
    rows = [(" ".join("".join(rng.choices(letters, k=5)) for _ in range(60)), "en", f"s{k % 3}") for k in range(600)]
    compare(spark, rows, 2)


def test_odd_rows(spark, odd_rows):
    rows = [(t, "xx", f"s{i % 3}") for i, t in odd_rows] + [(None, None, None), (None, "only", "nulls"), ("", "only", "empty"), ("one word", "alone", "s")]
    rows += [("twice told", "xx", "s1")] * 40 + [("Twice Told tail", "alone", "s")] * 40
    compare(spark, rows)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_do_not_overflow(spark):
    n, total, terms = 4 * 10**15, 9 * 10**15, 10**9
    df = spark.createDataFrame([(n, total, terms), (0, 0, 0)], "n bigint, total bigint, terms bigint")
    got = [r[0] for r in df.select(divergence.share("n", "total", "terms")).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * terms), None]


def test_bitmap_is_that_of_the_workers(spark):
    rows = [("en", f"wört{k}".encode()) for k in range(500)] + [("", b"x"), ("中", b"ab\x00")]
    bitmap = divergence.survivors(spark.createDataFrame(rows, "lang string, prefix binary"))
    assert bitmap.nbytes * 8 == divergence.FILTER_BITS
    bits = {xxhash.xxh64_intdigest(lang.encode() + b"\x00" + p, 42) & divergence.FILTER_BITS - 1 for lang, p in rows}
    assert set(np.flatnonzero(np.unpackbits(bitmap, bitorder="little")).tolist()) == bits


def test_levels_discard_before_terms_are_whole(spark, monkeypatch):
    """A rare long term is never counted in whole: its prefix goes first."""
    seen = []
    level = divergence.level

    def watched(stored, length, *rest):
        made = level(stored, length, *rest)
        seen.append((length, {bytes(r["prefix"]) for r in made.select(F.col("prefix")).collect()}))
        return made

    monkeypatch.setattr(divergence, "level", watched)
    rows = [("common words here", "en", "s")] * 40 + [("zzzzrareandlong", "en", "s")] * 3
    compare(spark, rows)
    assert [length for length, _ in seen] == [2, 4, 8]
    assert b"zz" in seen[0][1]
    assert not any(p.startswith(b"zz") for _, prefixes in seen[1:] for p in prefixes)


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    ours = sorted(tuple(r) for r in QUERIES["op12_source_divergence"](spark, folder).collect())
    theirs = sorted(database(folder).execute(ORACLE["op12_source_divergence"]).fetchall())
    assert ours == theirs and len(ours) > 50
