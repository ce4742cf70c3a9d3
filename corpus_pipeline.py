"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing, tokenising; each stage's table is written and read again.

In every stage rows are judged one by one: null and repeated ids are rows like others, null and blank texts fail the quality rules, very long texts are taken
whole, ties are broken by the text's hash, an empty table gives an empty table, and columns besides those of ``documents`` are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.llm import bpe, minhash, mixing, quality_rules, secret_scan
from provloom.llm.common import remove, shared_folder
from provloom.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that break a rule leave the others' texts, with n_chars following."""
    kept = quality_rules.apply_rules(docs).where("kept")
    changed = F.col("n_lines_removed") > 0
    return kept.withColumns({
        "text": F.col("clean_text"), "n_chars": F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    }).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least id: five words, similarity 0.8."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; documents without are as they were."""
    masked = secret_scan.redact(docs.withColumn("_was", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("_was"))
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixed stream: part files hold ranges of slots, sorted, so that file and row give the order."""
    return mixing.mixed_stream(docs.select(*COLUMNS)).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and its place in the mixed stream: ``mix_part``, the number of the file that it was read from, and ``mix_row``
    there; both are null for documents that aren't read from files."""
    part, row = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int"), F.col("_metadata.row_index")
    if not docs.inputFiles():
        part, row = F.lit(None).cast("int"), F.lit(None).cast("long")
    placed = docs.select(*COLUMNS, part.alias("mix_part"), row.alias("mix_row"))
    encoded = bpe.encode_documents(placed, vocabulary())
    return encoded.select("doc_id", "lang", "source", "n_chars", "mix_part", "mix_row", "n_tokens", "token_ids")


STAGES = [("quality_rules", clean), ("near_dedup", dedup), ("secret_scan", mask_secrets), ("mixing", mix), ("bpe", tokenize)]

#: Near-duplicate groups and byte-pair merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole ``documents``. Tables between stages go to the shared folder, so lost executors cost no stage; a table goes
    when the next one is written. The last one is read by the result and stays until the folder is cleared."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
