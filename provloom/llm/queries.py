"""The registered queries of the training-data operators; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, imatch, kneser_ney, masked_lm, minhash, mixing, oracles, quality_rules, secret_scan, sharding, toxicity, url_reputation, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sha(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def vocabulary() -> str:
    """The vocabulary file; the package that holds it is installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", bpe.encode_decode(F.col("text"), vocabulary()).alias("bpe"))
    return docs.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("bpe.ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha(F.col("bpe.decoded")).alias("decoded_sha256"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels' numbers are read as the pages': a labelled page fails if it is of low quality or toxic."""
    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("failing"))
    return url_reputation.judge(_table(spark, sf_dir, "pages"), outcomes)


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.compare_edits(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"),
        imatch.fingerprint_text(F.col("fingerprint")).alias("fingerprint"),
        imatch.fingerprint_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = [r.kind for r in secret_scan.BASE_RULES]
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter(spans, of(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, _sha(secret_scan.span_list(spans, base)).alias("base_sha256"), secret_scan.span_list(spans).alias("spans")
    )


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = found.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_bpe": op2_bpe,
        "op3_minhash": op3_minhash,
        "op4_shards": op4_shards,
        "op5_kneser_ney": op5_kneser_ney,
        "op6_url_reputation": op6_url_reputation,
        "op7_imatch": op7_imatch,
        "op8_quality_rules": op8_quality_rules,
        "op9_secret_scan": op9_secret_scan,
        "op10_masked_lm": op10_masked_lm,
        "op11_filter_audit": op11_filter_audit,
        "op12_whitening": op12_whitening,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
