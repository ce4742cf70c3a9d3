"""Contiguous shards of equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, order_ranges, shuffle_partitions

#: Bytes that a row costs besides its text.
ROW_BYTES = 8


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` contiguous ranges of ``id_col`` order with near-equal bytes.

    Rows are dealt into ranges of the id by quantile cuts; each range's total of bytes and rows goes to a
    small table (one row a range) whose running sums are the ranges' global offsets. With its running sum
    inside the range, each row knows where it begins among all bytes, and the shard is where its middle
    falls when all bytes are cut at equal targets. No task sees more than one range, and only ids, sizes
    and checksums are shuffled.

    Returns id, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``shard`` and ``slot`` (place in
    the shard, gapless from 0). Defined results: a null text counts as empty; null ids come first; equal or null ids
    are ordered by a hash of checksum and size, by which many of them are dealt into ranges, so repeated rows are interchangeable; an empty table gives no rows; a
    row larger than a target leaves the shards that it covers without other rows; columns besides the id and
    the text are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = checkpoint(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    slim = slim.withColumn("_tie", F.xxhash64("text_crc32", "size"))
    slim = slim.withColumn("_range", order_ranges(slim, F.col("_id"), F.col("_tie"), 4 * shuffle_partitions(docs.sparkSession)))

    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        slim.groupBy("_range")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_range",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(everything).alias("_total"),
        )
    )
    inside = Window.partitionBy("_range").orderBy(F.col("_id").asc_nulls_first(), "_tie", "text_crc32", "size")
    placed = (
        slim.withColumns({
            "_end": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_row": F.row_number().over(inside).cast("long") - 1,
        })
        .join(F.broadcast(offsets), "_range")  # one row a range
        .withColumns({
            "_middle": 2 * (F.col("_bytes_before") + F.col("_end")) - F.col("size"),
            "_row": F.col("_rows_before") + F.col("_row"),
        })
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"_middle * {shards} div (2 * _total)")).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` under ``path``/shard=N, one sorted run a shard; ValueError if an id is null or occurs twice, as rows
    meet their places by it. Input columns named shard or slot are not written."""
    placed = checkpoint(assign_shards(docs, shards, id_col, text_col).select(id_col, "shard", "slot"))
    if not placed.groupBy(id_col).agg(F.count("*").alias("n")).where(f"n > 1 or `{id_col}` is null").isEmpty():
        raise ValueError("ids must be unique and not null")
    columns = [c for c in docs.columns if c not in ("shard", "slot") or c == id_col]
    (
        docs.select(*columns).join(placed, id_col)
        .repartitionByRange(max(shards, shuffle_partitions(docs.sparkSession)), "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite").partitionBy("shard").parquet(path)
    )
