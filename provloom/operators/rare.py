"""Minimal rare itemsets of any size, from the border of the frequent ones, and the rules that always hold from them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, shared_folder
from .subsets import BLOCK, SubsetIndex


def measured(ctx: DataFrame, sets: DataFrame, block: int | None = None) -> DataFrame:
    """(items, support, closure) of each itemset (array ``items``) that some object has: how many have it, and what all of these have in common.

    A batch of objects gives, for each set that one of them has, their number and their common items. Numbers are added up; an item is common to all if it is
    common to each batch that has the set at all. No objects are joined; sets go to the tasks ``block`` at a time.
    """
    spark = ctx.sparkSession
    baskets = ctx.groupBy("object").agg(F.collect_set("attribute").alias("has"))
    blocks = max(1, -(-sets.count() // (block or BLOCK)))

    def one(part: DataFrame) -> DataFrame:
        wanted = [list(r[0]) for r in part.select("items").distinct().collect()]  # a block
        index = SubsetIndex(wanted)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("has")
                names = pc.unique(lists.flatten()).to_pylist()
                every = SubsetIndex([], names).bits(lists)
                found = [(wanted[numbers[0]], len(rows), [sorted(names)[i] for i in np.flatnonzero(every[rows].all(axis=0))]) for numbers, rows in index.visit(index.bits(lists)) if len(rows)]
                kind = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], kind)], ["items", "n", "common"])

        return baskets.mapInArrow(task, "items array<string>, n long, common array<string>")

    if blocks == 1:
        parts = checkpoint(one(sets))
    else:
        folder = f"{shared_folder(spark)}/measured-{uuid.uuid4().hex}"
        for b in range(blocks):
            one(sets.where(F.pmod(F.xxhash64("items"), F.lit(blocks)) == b)).write.parquet(f"{folder}/block={b}")
        parts = spark.read.parquet(folder).drop("block")
    totals = parts.groupBy("items").agg(F.sum("n").alias("support"), F.count("*").alias("batches"))
    items = parts.select("items", F.explode("common").alias("item")).groupBy("items", "item").agg(F.count("*").alias("seen"))
    common = items.join(totals, "items").where("seen = batches").groupBy("items").agg(F.array_sort(F.collect_list("item")).alias("closure"))
    return totals.join(common, "items").select("items", "support", "closure")


def border(ctx: DataFrame, sets: DataFrame) -> DataFrame:
    """The itemsets that aren't frequent but all of whose parts are: single items, and by level what two frequent sets make that differ in their last item.

    ``sets`` (items, support) are all frequent sets. Candidates meet on the rest of their items; one is left if each of its parts is frequent.
    """
    single = ctx.select(F.array("attribute").alias("items")).distinct().join(sets.select("items"), "items", "left_anti")
    n = F.size("items")
    rest = sets.select(F.slice("items", F.lit(1), n - 1).alias("rest"), F.element_at("items", -1).alias("last")).where(F.col("last").isNotNull())
    pairs = rest.join(rest.withColumnRenamed("last", "other"), "rest").where("last < other").select(F.concat("rest", F.array("last", "other")).alias("items"))
    fresh = checkpoint(pairs.join(sets.select("items"), "items", "left_anti"))
    parts = fresh.select("items", F.explode("items").alias("drop")).select("items", F.expr("array_remove(items, drop)").alias("part"))
    whole = parts.join(sets.select(F.col("items").alias("part")), "part").groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") == F.size("items"))
    return single.union(whole.select("items"))


def rare_itemsets(ctx: DataFrame, sets: DataFrame, block: int | None = None) -> DataFrame:
    """(items, support, closure): the minimal rare itemsets that occur, of any size, with what always comes with them."""
    return measured(ctx, border(ctx, sets), block)


def rare_rules_of_any_size(ctx: DataFrame, sets: DataFrame, block: int | None = None) -> DataFrame:
    """(x, y, support, lift): rules that always hold, from a minimal rare itemset to the rest of its closure; none where it is closed.

    ``sets`` are the frequent itemsets: rare is what isn't among them. Lift is n over the support of y.
    """
    n = ctx.agg(F.count_distinct("object").alias("n"))
    found = checkpoint(rare_itemsets(ctx, sets, block).select(F.col("items").alias("x"), F.array_except("closure", "items").alias("y"), "support").where("size(y) > 0"))
    sides = measured(ctx, found.select(F.col("y").alias("items")).distinct(), block).select(F.col("items").alias("y"), F.col("support").alias("sy"))
    return found.join(sides, "y").join(F.broadcast(n), F.lit(True)).select("x", "y", "support", (F.col("n") / F.col("sy")).alias("lift"))  # one row
