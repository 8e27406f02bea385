"""Reading log files of several formats into one entry table with a file report."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.schema import ENTRY_COLUMNS, ENTRY_ORDER
from sessionloom.functions.text import computed_once, trim_all
from sessionloom.session import cut_lineage
from sessionloom.sources import jsonsplits, records

# File name endings of database side files that are never logs.
SKIPPED_NAMES = r"\.(db|db-wal|db-shm|pb)$"


@dataclass(frozen=True)
class Harness:
    """One log source.

    ``layout`` applies to JSON: "lines" reads record-per-line files, "array" reads
    each file as one JSON array (both split by split, a file may have any size),
    "auto" looks at how each file begins first (one extra pass over the text).
    """

    name: str
    path: str
    format: str
    layout: str = "auto"
    table: str | None = None
    # A file with invalid UTF-8 is dropped whole; False keeps its readable lines.
    drop_undecodable: bool = True


def _reader(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", True)


def _is_log(column: Column) -> Column:
    return ~F.lower(column).rlike(SKIPPED_NAMES)


def _lines(spark: SparkSession, paths) -> DataFrame:
    meta = F.col("_metadata")
    raw = _reader(spark).text(paths, lineSep="\n")
    kept = raw.where(_is_log(meta["file_name"]))
    # Unique and increasing along each file; no shuffle is spent on line numbers.
    key = _key(meta["file_block_start"], F.monotonically_increasing_id())
    return kept.select(
        "value", meta["file_path"].alias("source_path"),
        meta["file_modification_time"].alias("mtime"), key.alias("_key"),
    )


def as_path(address: str) -> str:
    """A file's address as a path for a reader: unescaped, and free of wildcards."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(address))


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """Log files under ``path``; only names are read, never contents."""
    files = _reader(spark).format("binaryFile").load(path)
    # Named as the text readers name them: escaped characters are escaped here too.
    return files.where(_is_log(F.col("_metadata.file_name"))).select(F.col("_metadata.file_path").alias("source_path"))


def _key(split, row, item=0) -> Column:
    """Where a record stands in its file: split, row, and item inside the row."""
    as_long = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("bigint")
    return F.struct(as_long(split).alias("split"), as_long(row).alias("row"), as_long(item).alias("item"))


def _judged(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, per-file counts) of ``parsed`` (good, bad, decodable): written once, read twice."""
    stored = cut_lineage(parsed)
    status = stored.groupBy("source_path").agg(
        F.count_if("good").alias("good"), F.count_if("bad").alias("bad"),
        F.count_if(~F.col("decodable")).alias("undecodable"),
    )
    return stored.where("good").drop("good", "bad", "decodable"), status


def _text_entries(spark: SparkSession, harness: Harness, markdown: bool) -> tuple[DataFrame, DataFrame]:
    trimmed = _lines(spark, harness.path).withColumn("_text", trim_all(F.col("value")))
    wanted = F.col("_text") != ""
    if markdown:
        wanted = wanted & ~F.col("_text").startswith("#")
    parsed = trimmed.select(
        "source_path", "_key", *records.line_columns(F.col("_text"), F.col("mtime")), wanted.alias("good"),
        F.lit(False).alias("bad"), F.is_valid_utf8("value").alias("decodable"),
    )
    return _judged(parsed.where(F.col("good") | ~F.col("decodable")))


def _json_line_entries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    filled = lines.where(trim_all(F.col("value")) != "").select(
        "*", computed_once(records.strict_json(F.col("value"))).alias("_record")
    )
    good = F.col("_record").isNotNull()
    return _judged(
        filled.select(
            "source_path", "_key", *records.entry_columns(F.col("_record"), F.col("mtime")), good.alias("good"),
            (~good).alias("bad"), F.is_valid_utf8("value").alias("decodable"),
        )
    )


# Fixed value: what JSON takes as white space.
JSON_SPACE = r"[ \t\n\r]*"


def _json_array_entries(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Arrays cut into pieces of whole elements; a file is one array if all its pieces are sound."""
    cut = jsonsplits.pieces(spark, paths, _is_log(F.col("_metadata.file_name")), depth=1)
    begun = cut.withColumn("_begun", F.regexp_replace("text", f"^{JSON_SPACE}", ""))
    bare = ~F.col("first") & F.col("last") & F.col("_begun").rlike(f"^\\]{JSON_SPACE}$")
    inner = F.expr("substring(_begun, 2)")
    ended = F.regexp_replace(inner, f"\\]{JSON_SPACE}$", "")
    marks = F.col("_begun").startswith(F.when(F.col("first"), "[").otherwise(","))
    closed = ~F.col("last") | inner.rlike(f"\\]{JSON_SPACE}$")
    body = F.when(marks & closed & ~bare, F.when(F.col("last"), ended).otherwise(inner))
    itemised = begun.select(
        "source_path", "mtime", "key", "first", "last", "decodable", bare.alias("bare"),
        computed_once(records.strict_json_array(F.concat(F.lit("["), body, F.lit("]")))).alias("_items"),
    )
    filled = (F.size("_items") > 0) | (F.col("first") & F.col("last"))
    stored = cut_lineage(itemised.withColumn("sound", F.col("bare") | (F.col("_items").isNotNull() & filled)))
    status = stored.groupBy("source_path").agg(
        F.sum(F.coalesce(F.size("_items"), F.lit(0))).cast("bigint").alias("good"),
        F.when(F.bool_and("sound") & F.bool_or("first") & F.bool_or("last"), 0).otherwise(1).cast("bigint").alias("bad"),
        F.count_if(~F.col("decodable")).alias("undecodable"),
    )
    status = cut_lineage(status.withColumn("good", F.when(F.col("bad") == 0, F.col("good")).otherwise(F.lit(0))))
    items = stored.where(F.col("_items").isNotNull()).select(
        "source_path", "mtime", "key", F.posexplode("_items").alias("_pos", "_record")
    )
    rows = items.select(
        "source_path", _key(F.col("key.split"), F.col("key.row"), F.col("_pos")).alias("_key"),
        *records.entry_columns(F.col("_record"), F.col("mtime")),
    )
    return rows.join(status.where("bad = 0").select("source_path"), "source_path", "left_semi"), status


def _json_entries(spark: SparkSession, harness: Harness) -> tuple[DataFrame, DataFrame]:
    if harness.layout == "array":
        return _json_array_entries(spark, harness.path)
    lines = _lines(spark, harness.path)
    if harness.layout == "lines":
        return _json_line_entries(lines)
    first = lines.where(trim_all(F.col("value")) != "").groupBy("source_path").agg(
        F.min_by(F.left(trim_all(F.col("value")), F.lit(1)), "_key").alias("head")
    )
    # File names only, the same list Spark's own file index keeps on the driver.
    bracketed = [as_path(row.source_path) for row in first.where(F.col("head") == "[").toLocalIterator()]
    if not bracketed:
        return _json_line_entries(lines)
    array_rows, array_status = _json_array_entries(spark, bracketed)
    # A bracketed file that is not one array is read line by line after all.
    arrays = array_status.where(F.col("bad") == 0)
    line_rows, line_status = _json_line_entries(
        lines.join(arrays.select("source_path"), "source_path", "left_anti")
    )
    return array_rows.unionByName(line_rows), arrays.unionByName(line_status)


# Fixed value: the shape of a project snapshot.
SNAPSHOT = (
    "tree string, files array<struct<metadata:struct<relative_path:string,size_bytes:bigint,line_count:bigint,"
    "modified_unix:bigint,sha256:string>,content:string>>"
)


def _snapshot_entries(spark: SparkSession, harness: Harness) -> tuple[DataFrame, DataFrame]:
    """Project snapshots: ``{tree, files: [{metadata, content}]}`` documents, cut between files.

    A document whose other fields close braces at the same depth is put together again.
    """
    cut = jsonsplits.pieces(spark, harness.path, _is_log(F.col("_metadata.file_name")), depth=2)
    opened = F.concat(F.lit('{"files":['), F.regexp_replace("text", f"^{JSON_SPACE},", ""))
    begun = F.when(F.col("first"), F.col("text")).when(
        F.col("text").rlike(f"^{JSON_SPACE},"), opened
    ).when(F.col("last"), F.concat(F.lit('{"files":['), F.col("text")))
    document = F.when(F.col("last"), begun).otherwise(F.concat(begun, F.lit("]}")))

    def parsed(rows: DataFrame) -> DataFrame:
        strict = computed_once(F.when(records.strict_json(F.col("document")).isNotNull(), F.from_json("document", SNAPSHOT)))
        return rows.select("source_path", "key", "decodable", "first", "last", strict.alias("doc"))

    stored = cut_lineage(cut.withColumn("document", document))
    pieces = cut_lineage(parsed(stored))
    whole = pieces.groupBy("source_path").agg(
        (F.bool_and(F.col("doc.files").isNotNull()) & F.bool_or("first") & F.bool_or("last")).alias("sound")
    )
    apart = cut_lineage(whole.where(~F.col("sound")).select("source_path"))
    again = stored.join(apart, "source_path", "left_semi").groupBy("source_path").agg(
        F.min("key").alias("key"), F.bool_and("decodable").alias("decodable"), F.lit(True).alias("first"), F.lit(True).alias("last"),
        F.array_join(F.array_sort(F.collect_list(F.struct("key", "text")))["text"], "").alias("document"),
    )
    docs = pieces.join(apart, "source_path", "left_anti").unionByName(parsed(again))
    items = docs.select("source_path", "key", F.posexplode("doc.files").alias("_pos", "_file"))
    meta = F.col("_file.metadata")
    rows = items.where(meta.isNotNull()).select(
        "source_path", _key(F.col("key.split"), F.col("key.row"), F.col("_pos")).alias("_key"),
        F.timestamp_seconds(meta["modified_unix"]).alias("ts"), F.col("_file.content").alias("content"),
        # Fixed value: how a snapshot file is named as provider.
        F.concat(F.lit("bound:"), meta["relative_path"]).alias("provider"),
    )
    listed = F.size(F.filter("doc.files", lambda f: f["metadata"].isNotNull()))
    status = docs.groupBy("source_path").agg(
        F.sum(F.coalesce(listed, F.lit(0))).cast("bigint").alias("good"),
        F.count_if(F.col("doc.files").isNull()).alias("bad"), F.count_if(~F.col("decodable")).alias("undecodable"),
    )
    return rows, status


def table_entries(logs: DataFrame, harness: str, harness_idx: int = 0) -> DataFrame:
    """Entries from a ``logs(ts seconds, feedback_log_body)`` table, e.g. read over JDBC."""
    ts = F.col("ts").cast("bigint")
    in_range = ts.between(-8_334_601_228_800, 8_210_266_876_799)
    rows = logs.where(F.col("feedback_log_body").isNotNull() & in_range).select(
        F.timestamp_seconds(ts).alias("ts"), F.col("feedback_log_body").alias("content"),
        F.lit("openai").alias("provider"), F.lit(None).cast("string").alias("source_path"),
        _key(0, F.monotonically_increasing_id()).alias("_key"),
    )
    return _finish(rows, harness, harness_idx)


def _finish(rows: DataFrame, harness: str, harness_idx: int) -> DataFrame:
    """Fill absent columns, name the harness and derive a stable id."""
    defaults = {
        "model": F.lit(None).cast("string"), "provider": F.lit(None).cast("string"),
        "tool_calls": F.expr("array()").cast("array<struct<tool_name:string,parameters:string,result:string,duration_ms:bigint>>"),
        "user_messages": F.lit(0).cast("bigint"), "assistant_messages": F.lit(0).cast("bigint"),
    }
    for name, value in defaults.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    place = F.concat_ws("|", F.lit(harness), F.coalesce("source_path", F.lit("")), F.to_json("_key"))
    return (
        rows.withColumn("harness", F.lit(harness))
        .withColumn("harness_idx", F.lit(harness_idx))
        .withColumn("line_key", F.col("_key"))
        .withColumn("id", F.sha2(place, 256))
        .select(*ENTRY_COLUMNS)
    )


READERS = {
    "json": _json_entries,
    "plain": lambda spark, harness: _text_entries(spark, harness, markdown=False),
    "markdown": lambda spark, harness: _text_entries(spark, harness, markdown=True),
    "snapshot": _snapshot_entries,
}

STATUS_SCHEMA = (
    "harness string, path string, source_path string, seen bigint, failed bigint, "
    "accepted bigint, warning string"
)


def _missing(spark: SparkSession, harness: Harness) -> DataFrame:
    return spark.range(1).select(
        F.lit(harness.name).alias("harness"), F.lit(harness.path).alias("path"),
        F.lit(None).cast("string").alias("source_path"), F.lit(0).cast("bigint").alias("seen"),
        F.lit(0).cast("bigint").alias("failed"), F.lit(0).cast("bigint").alias("accepted"),
        F.lit(f"log path does not exist: {harness.path}").alias("warning"),
    )


def read_harness(spark: SparkSession, harness: Harness, idx: int = 0) -> tuple[DataFrame | None, DataFrame]:
    """Entries and per-file status of one source; a bad file never stops the others."""
    if harness.format == "sqlite_table":
        entries = table_entries(spark.table(harness.table or harness.path), harness.name, idx)
        status = entries.agg(F.count("*").alias("accepted")).select(
            F.lit(harness.name).alias("harness"), F.lit(harness.path).alias("path"),
            F.lit(harness.path).alias("source_path"), F.lit(1).cast("bigint").alias("seen"),
            F.lit(0).cast("bigint").alias("failed"), "accepted", F.lit(None).cast("string").alias("warning"),
        )
        return entries, status
    try:
        listed = _listing(spark, harness.path)
        rows, status = READERS[harness.format](spark, harness)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None, _missing(spark, harness)
    failed = (F.col("undecodable") > 0) | ((F.col("good") == 0) & (F.col("bad") > 0))
    judged = status.withColumn("_failed", failed)
    reason = F.when(F.col("undecodable") > 0, "file is not valid UTF-8").otherwise(
        F.concat(F.lit("no valid records; rejected "), F.col("bad"), F.lit(" malformed records"))
    )
    files = listed.join(judged, "source_path", "left").select(
        F.lit(harness.name).alias("harness"), F.lit(harness.path).alias("path"), "source_path",
        F.lit(1).cast("bigint").alias("seen"),
        F.coalesce(F.col("_failed"), F.lit(False)).cast("bigint").alias("failed"),
        F.when(F.col("_failed"), 0).otherwise(F.coalesce("good", F.lit(0))).cast("bigint").alias("accepted"),
        F.when(F.col("_failed"), F.concat("source_path", F.lit(": "), reason)).alias("warning"),
    )
    if harness.drop_undecodable:
        # Written, so that Spark knows how small it is before it joins the rows with it.
        broken = cut_lineage(judged.where(F.col("undecodable") > 0).select("source_path"))
        rows = rows.join(broken, "source_path", "left_anti")
    return _finish(rows, harness.name, idx), files


def read_logs(spark: SparkSession, harnesses: list[Harness]) -> tuple[DataFrame, DataFrame]:
    """All entries (unsorted; see ``in_time_order``) and the per-file status table."""
    read = [read_harness(spark, harness, i) for i, harness in enumerate(harnesses)]
    entries = [e for e, _ in read if e is not None]
    status = reduce(DataFrame.unionByName, [s for _, s in read])
    if not entries:
        empty = spark.range(0).select(
            F.lit(None).cast(T.TimestampType()).alias("ts"), F.lit("").alias("content"),
            F.lit("").alias("source_path"),
            _key(0, F.col("id")).alias("_key"),
        )
        return _finish(empty, "", 0), status
    return reduce(DataFrame.unionByName, entries), status


def in_time_order(entries: DataFrame) -> DataFrame:
    """Global order by time; equal instants keep harness, file and line order."""
    return entries.orderBy(*ENTRY_ORDER)


def ingestion_report(file_status: DataFrame) -> DataFrame:
    """Counts per harness plus a grand total (harness NULL)."""
    return file_status.rollup("harness").agg(
        F.sum("seen").cast("bigint").alias("files_seen"),
        F.sum("failed").cast("bigint").alias("files_failed"),
        F.sum("accepted").cast("bigint").alias("entries_accepted"),
        F.count("warning").alias("warnings"),
    )


def ingestion_warnings(file_status: DataFrame) -> DataFrame:
    return file_status.where(F.col("warning").isNotNull()).select("harness", "path", "warning")
