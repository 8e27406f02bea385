"""Every named query against its SQL, and plan shapes that must hold at scale."""

import duckdb
import pytest

from checking import ORACLE, QUERIES, database, differences
import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, db, name):
    rows, names, ours, theirs = differences(spark, db, SF, name)
    assert not names
    assert not ours and not theirs, (list(ours)[:3], list(theirs)[:3])


def test_every_query_is_checked_or_tested_otherwise():
    assert set(QUERIES) == set(ORACLE)


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name, columns",
    [("document_frequency", "text"), ("redact_documents", "doc_id,text"), ("run_lookup", "ts"), ("merge_model_failures", "event_id,user_id,event_type,value,props")],
)
def test_scans_read_only_what_they_need(spark, name, columns):
    text = plan(spark, name)
    schemas = [part.split(">")[0] for part in text.split("ReadSchema: struct<")[1:]]
    assert schemas
    for schema in schemas:
        assert {field.split(":")[0] for field in schema.split(",")} <= set(columns.split(","))


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan(spark, "merge_model_failures")


@pytest.fixture
def spilling(spark):
    """Every sort puts its rows on disk four at a time and merges them."""
    conf = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf()
    name = "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "4")
    yield
    conf.remove(name)


@pytest.mark.parametrize("name", ["file_snapshot_entries", "file_json_entries", "run_documents"])
def test_written_files_keep_their_order_when_sorts_spill(spark, db, spilling, name):
    rows, names, ours, theirs = differences(spark, db, SF, name)
    assert rows and not names
    assert not ours and not theirs, (len(ours), len(theirs))


def test_snapshots_of_documents_without_a_source_or_a_text(spark, tmp_path):
    rows = [(1, "a", None), (2, "b", ""), (3, None, "s"), (4, "", "s"), (5, "}\\\\\"{", "s"), (None, "c", "s"), (None, "d", "s"), (7, "e", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    documents = duckdb.connect()
    documents.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(spark, documents, str(tmp_path), "file_snapshot_entries") == (6, set(), {}, {})
