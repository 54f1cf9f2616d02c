"""Corpus pipeline over ``documents``: rules, near duplicates, leaks, secrets, packing.

Each stage takes what its predecessor kept, as Parquet, and all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm import decontamination, ngram_join, packing, quality_rules, secret_scan
from glimmer.llm.shared import materialize, new_path, small_side, table
from glimmer.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep; of rows with one doc_id each is judged by itself."""
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    judged = quality_rules.judge(docs.select("doc_id", "text", own.alias("own")), table(spark, sf_dir, "labels"), keys=["doc_id", "own"])
    rejected = judged.where("not kept").select(F.col("doc_id").alias("rejected_id"), F.col("own").alias("rejected_own")).distinct()
    rejected = small_side(materialize(rejected, "rejected"), 16)
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["rejected_id"]) & (own == rejected["rejected_own"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the least doc_id."""
    return ngram_join.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of five words or more: fewer words stand in clean texts too."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), short=False).select("doc_id").distinct()
    return docs.join(small_side(materialize(found, "leaking"), 8), "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    pieces = packing.pack(docs, tokenizer_path(), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("decontamination", leaks), ("secret_scan", secrets), ("packing", pack)]
#: The learned rules, the tokenizer and the packing have no SQL form; run() is tested against a brute-force chain (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
