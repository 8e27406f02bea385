"""Session settings and lineage cutting shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app: str = "sessionloom") -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def widen(df: DataFrame) -> DataFrame:
    """Spread rows before per-row heavy work when the scan has fewer splits than cores.

    A large table has many splits and passes through unchanged; only an input
    of a few row groups is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one is made only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table survives executor loss, is computed once (a checkpoint
    computes its plan twice), is column-pruned by later readers, and pins down
    values that depend on how rows were partitioned (see ``operators.ordered``).
    """
    path = f"{shared_folder(df.sparkSession)}/sessionloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``cut_lineage`` that also counts rows meeting ``condition`` during the write."""
    seen = Observation()
    rows = cut_lineage(df.observe(seen, F.count_if(condition).alias("n")))
    return rows, seen.get["n"]
