"""The manifest against a plain tree, and what a changed row does to it."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import merkle
from checking import database
from sessionloom.llm.queries import ORACLE, QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    out = ""
    for field in FIELDS:
        value = row[field]
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(out)


def plain_tree(nodes):
    """(root, siblings of every node level by level), runs of eight."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    beside = []
    for place in range(len(nodes)):
        steps = []
        for level in levels[:-1]:
            run = range(place - place % 8, min(place - place % 8 + 8, len(level)))
            steps.append(([level[i] for i in run if i < place], [level[i] for i in run if i > place]))
            place //= 8
        beside.append(steps)
    return levels[-1][0], beside


def plain_manifest(rows, later):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    made = {}
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        made[name] = plain_tree([plain_leaf(r) for r in trees[name]])
    root, above = plain_tree([made[n][0] for n in names])
    out = []
    for name, over in zip(names, above):
        for row, steps in zip(trees[name], made[name][1]):
            node = plain_leaf({**row, "text": later(row)})
            for left, right in steps + over:
                node = sha("".join(left) + node + "".join(right))
            proof = sha("".join("".join(a + b) for a, b in steps + over))
            out.append((row["doc_id"], plain_leaf(row), made[name][0], root, proof, node, node == root))
    return sorted(out, key=str)


def lowered(row):
    hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
    if not hit or row["text"] is None:
        return row["text"]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])


def later_text():
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"text": F.when(hit, lower).otherwise(F.col("text"))}


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, root string, block int"


def compare(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = merkle.prove(df, now=later_text())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    named = [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_manifest(named, lowered)


@pytest.mark.parametrize("sizes", [[1], [8], [9], [64, 65], [5, 1, 72], [1] * 19, [513, 4]])
def test_matches_a_plain_tree(spark, sizes):
    rows = [
        (k * 7, f"s{k % 3}", None if g == 0 else f"l{g}", k, f"Text {k} of Group {g}")
        for g, n in enumerate(sizes) for k in range(n)
    ]
    compare(spark, rows)


@pytest.mark.parametrize("sizes", [[8], [9], [64, 65, 1], [600, 3], [1] * 70])
def test_small_superblocks_of_several_tiers(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(k, "s", f"l{g:03}", k, f"Text {k} Of {g}") for g, n in enumerate(sizes) for k in range(n)]
    compare(spark, rows)


def test_odd_rows(spark, odd_rows):
    rows = [(i, None, "xx" if i % 2 else "", None, t) for i, t in odd_rows]
    rows += [(3, "a", None, 1, "Twice"), (3, "a", None, 1, "Twice"), (3, "a", None, 1, "Other"), (None, "a", None, 2, "No Id"), (None, None, None, None, None)]
    rows += [(k, "é", "日本", 1, "Öl AB") for k in range(20)] + [(2**60 + k, "s", "日", 1, "Big") for k in range(9)]
    compare(spark, rows)


def test_no_rows(spark):
    assert merkle.prove(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_changed_verifies_everywhere(spark):
    rows = [(k, "s", "l", 1, f"T{k}", "x", 1) for k in range(30)]
    assert all(r["verified"] for r in merkle.prove(spark.createDataFrame(rows, SCHEMA)).collect())


def test_query_against_the_plain_tree(spark):
    folder = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op11_manifest"](spark, folder).collect()]
    assert sorted(got, key=str) == plain_manifest(rows, lowered)


def test_sql_gives_the_plain_tree(spark):
    """The checking SQL on the sample and on trees of one, nine and many leaves."""
    db = database("/root/testdata/sf0.001")
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(db.execute(ORACLE["op11_manifest"]).fetchall(), key=str) == plain_manifest(rows, lowered)
    odd = [(k, "s", None if k < 1 else "a" if k < 10 else "b", k, None if k == 3 else f"Text {k} Ü") for k in range(600)]
    db.execute("CREATE TABLE odd (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO odd VALUES (?, ?, ?, ?, ?)", odd)
    db.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM odd")
    named = [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in odd]
    assert sorted(db.execute(ORACLE["op11_manifest"]).fetchall(), key=str) == plain_manifest(named, lowered)
