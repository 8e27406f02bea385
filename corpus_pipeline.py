"""Documents to packed training sequences, one written stage after another.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each group of linked documents (five-word shingles, 0.8) the
   one of smallest doc_id stays.
3. decontamination: documents that hold ten consecutive words of a benchmark go.
4. pii: personal data in the texts is masked; ``n_chars`` follows the new text.
5. packing: the texts become sequences of 2048 token ids.

All stages but the last return the columns of their input. Rows without a doc_id
cannot be told apart by the second and third stage and pass them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import decontam, near, packing, pii, quality

ORACLE_SQL = None


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.where(quality.share(F.col("doc_id"), 3) != 1)
    model = quality.fit(quality.sample(docs.select("doc_id", "text"), known))
    name = "_score" + "_" * max(map(len, docs.columns))
    return quality.score(docs, model, name).where(F.col(name) >= 0.5).select(*docs.columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs, width=5, num=80, den=100)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("pii", _pii),
    ("packing", _packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = packing.written(docs, name)
    return docs
