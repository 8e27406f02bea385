"""Registered queries against plain versions on a small table, and the pipeline as a whole."""

import json
import re
import zlib
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from checking import _multiset, database

import __spark_entry__ as contract
import corpus_pipeline
from sessionloom.llm import pii, quality
from sessionloom.llm.queries import ORACLE, QUERIES
from test_decontam import brute as brute_hits
from test_near import brute as brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cursor = database(SF).execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert _multiset(df.columns, [tuple(r) for r in df.collect()]) == _multiset(columns, cursor.fetchall())


def test_every_operator_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == {str(n) for n in range(1, 11)}
    assert "pipeline" in names and set(contract.oracle_sql()) <= names


def test_decontamination_query(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_hits([(i, r["text"]) for i, r in documents.items()], items, 10)
    for r in QUERIES["op4_decontamination"](spark, SF).collect():
        n_words, n_hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n_words, n_hit, len(found), n_hit > 0)


def test_near_duplicate_query(spark, documents):
    want = brute_components([(i, r["text"]) for i, r in documents.items()], 4, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_near_duplicates"](spark, SF).collect()}
    assert got == want


def test_quality_query(spark, documents):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op3_quality"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(documents)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.5)
    known = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in known) >= 0.9 * len(known)


def test_pipeline_equals_plain_stages(spark, documents):
    """Every stage but the classifier is done again by its definition."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(quality.sample(docs, labels.where(quality.share(labels["doc_id"], 3) != 1)))
    kept = {r["doc_id"]: r["text"] for r in quality.score(docs, model).where("score >= 0.5").collect()}
    parts = brute_components(list(kept.items()), 5, 80, 100)
    kept = {i: t for i, t in kept.items() if parts[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits(list(kept.items()), items, 10)
    spans = pii.finder()
    kept = {i: pii.masked(t, spans(t)) for i, t in kept.items() if hits[i][1] == 0}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert set(pieces) == set(kept)
    for i, own in pieces.items():
        ids = b"".join(raw for _, raw in sorted(own))
        want = [*library.encode(kept[i], add_special_tokens=False).ids, 1]
        assert ids == b"".join(n.to_bytes(4, "little") for n in want)


def test_stages_keep_columns_and_take_odd_documents(spark, odd_docs, no_docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() <= max(docs.count(), 1) or name == "packing"


def test_clean_documents_stay(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in good) >= 0.97 * len(good)


def test_entry_works_without_the_package(tmp_path):
    """With the folders and the pipeline gone the other queries are still there."""
    import shutil
    import subprocess
    import sys

    root = Path(contract.__file__).parent
    shutil.copytree(root / "sessionloom", tmp_path / "sessionloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(contract.__file__, tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps([len(e.queries()), len(e.oracle_sql())]))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k == "JAVA_HOME"})
    queries, oracle = json.loads(said.stdout.strip().splitlines()[-1])
    assert queries >= 80 and oracle >= 80
