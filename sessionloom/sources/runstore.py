"""The run history: run documents, and stores in which a run replaces only itself."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.schema import RUN_HEADER
from sessionloom.session import cut_lineage
from sessionloom.sources.files import as_path


def _replace_partitions(rows: DataFrame, *keys: str):
    """A writer that replaces the partitions it writes to and leaves all others alone."""
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)


def append_runs(runs: DataFrame, path: str) -> None:
    """Store runs under ``date`` and ``run_id``; other runs stay, a repeated run replaces itself."""
    _replace_partitions(runs, "date", "run_id").parquet(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Stored runs; filters on ``date`` and ``run_id`` (both text) choose folders, not rows."""
    found = schema or spark.read.parquet(path).schema
    texts = [T.StructField(f.name, T.StringType() if f.name in ("date", "run_id") else f.dataType) for f in found]
    return spark.read.schema(T.StructType(texts)).parquet(path)


def newest_run(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """The newest run of a date, or of the newest date: one date's folders are read."""
    stored = read_runs(spark, path)
    if date is None:
        # Dates are folder names, so no file is opened for this.
        date = stored.agg(F.max("date")).first()[0]
    chosen = stored.where(F.col("date") == date)
    return chosen.orderBy(F.desc("generated_at"), F.desc("run_id")).limit(1)


def read_run_documents(
    spark: SparkSession, path: str | list[str], schema: T.StructType = RUN_HEADER, names: str = "*.json"
) -> tuple[DataFrame, DataFrame]:
    """(readable run documents, unreadable file paths) from folders of JSON documents.

    Unreadable are files that are no run, and those that Spark cannot read to the end.
    """
    kept = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    docs = (
        _forgiving(spark, names).schema(kept)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path, multiLine=True)
        .withColumn("source_path", F.col("_metadata.file_path"))
    )
    # A run document has an id and a time; other JSON in the folder is not a run.
    is_run = F.col("_corrupt").isNull() & F.col("id").isNotNull() & F.col("generated_at").isNotNull()
    found = docs.where(is_run).drop("_corrupt")
    return found, _listed(spark, path, names).select("source_path").join(found.select("source_path"), "source_path", "left_anti")


def classify_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_path, readable, is_run) for every JSON file under the distinct folders.

    A file is readable when Spark gets to its end without an error; the listing
    itself looks at names and sizes only.
    """
    folders = sorted(set(paths))
    lines = _forgiving(spark).text(folders).select(F.col("_metadata.file_path").alias("source_path"))
    read = lines.groupBy("source_path").agg(F.count("*").alias("_lines"))
    runs, _ = read_run_documents(spark, folders)
    joined = _listed(spark, folders).drop("modified").join(read, "source_path", "left").join(
        runs.select("source_path", F.lit(True).alias("_run")), "source_path", "left"
    )
    readable = F.col("_lines").isNotNull() | (F.col("length") == 0)
    return joined.select("source_path", readable.alias("readable"), F.coalesce("_run", F.lit(False)).alias("is_run"))


LEDGER = "source_path string, length bigint, modified timestamp, readable boolean, is_run boolean"


def sync(spark: SparkSession, folders: list[str], ledger: str) -> tuple[DataFrame, int]:
    """(verdict on every file there is now, files read for it), with a ledger of earlier verdicts.

    The ledger is a table of (path, length, modified, verdict) that only grows. A file
    is read when it has no entry for its present length and time of change, and its
    verdict is recorded even if it could not be read; a file that is gone has none.
    """
    key = ["source_path", "length", "modified"]
    try:
        entries = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        entries = spark.createDataFrame([], LEDGER)
    listed = cut_lineage(_listed(spark, sorted(set(folders))))
    unknown = cut_lineage(listed.join(entries, key, "left_anti"))
    # File names only, as Spark's own file index keeps them on the driver.
    paths = [as_path(row.source_path) for row in unknown.select("source_path").toLocalIterator()]
    if paths:
        verdicts = classify_files(spark, paths)
        unknown.join(verdicts, "source_path").select(*key, "readable", "is_run").write.mode("append").parquet(ledger)
        entries = spark.read.schema(LEDGER).parquet(ledger)
    return listed.join(entries, key).select("source_path", "readable", "is_run"), len(paths)


def _listed(spark: SparkSession, folders: str | list[str], names: str = "*.json") -> DataFrame:
    """(source_path, length, modified) of the files; contents are not read."""
    named = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    # Named as other readers name them: characters that an address escapes are escaped here too.
    return named.format("binaryFile").load(folders).select(
        F.col("_metadata.file_path").alias("source_path"), "length", F.col("modificationTime").alias("modified")
    )


def _forgiving(spark: SparkSession, names: str = "*.json"):
    """A reader of JSON files that leaves out files it cannot read."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names)
        .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    )


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_backlog(backlog: DataFrame, folder: str, run_id: str) -> None:
    """``active`` is replaced; in ``history`` a run replaces only itself."""
    backlog.write.mode("overwrite").json(f"{folder}/active")
    _replace_partitions(backlog.withColumn("run_id", F.lit(run_id)), "run_id").json(f"{folder}/history")


def write_project_backlogs(backlog: DataFrame, projects: DataFrame, folder: str, run_id: str) -> None:
    """A run's backlog and the distinct project paths it goes to, each written once.

    Every project has the same backlog, so the two tables are stored side by side, a
    folder for each run, and ``read_project_backlog`` puts a project's rows together.
    """
    for name, rows in (("projects", projects.select("path").distinct()), ("backlog", backlog)):
        _replace_partitions(rows.withColumn("run_id", F.lit(run_id)), "run_id").json(f"{folder}/{name}")


def read_project_backlog(spark: SparkSession, folder: str, path: str, run_id: str) -> DataFrame:
    """A run's backlog for one project; no rows for a path that the run did not register."""

    def of_run(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("run_id").cast("string") == run_id).drop("run_id")

    known = of_run(spark.read.schema("path string, run_id string").json(f"{folder}/projects")).where(F.col("path") == path)
    rows = of_run(spark.read.json(f"{folder}/backlog")).withColumn("path", F.lit(path))
    return rows.join(known, "path", "left_semi")
