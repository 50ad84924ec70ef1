"""A corpus in five stages: quality rules, line dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents. A text that line or substring dedup shortens gets its new
n_chars; a row whose text becomes empty stays, and later stages treat it as an empty document.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.llm.common import delete, prepare, shared_folder, table
from framelark.llm.line_dedup import dedup_lines
from framelark.llm.near_dedup import drop_near_duplicates
from framelark.llm.packing import pack
from framelark.llm.quality import drop_low_quality
from framelark.llm.substring_dedup import dedup_substrings

#: Passages of this many words or more that an earlier document holds are cut out.
PASSAGE_WORDS = 50


def _recounted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of before, with n_chars of the text as it is now (null for null text)."""
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in before.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_low_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _recounted(dedup_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_near_duplicates(docs, 5, 80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _recounted(dedup_substrings(docs, PASSAGE_WORDS), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Robust covariance and byte-pair encoding have no SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's output is deleted once the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return docs
