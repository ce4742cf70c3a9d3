"""How filters act on each other: for every order of the filters, what each step removes, keeps and loses, by part of the corpus.

A document is reduced to the mask of the filters that it fails. A mask decides what happens to its document in each of the k! orders at each of the k
steps, so it stands for one big integer whose fields hold all these outcomes as 0 or 1. A part's integers are added up, times the number of documents
that share the mask, and the sum is cut into its fields again. A field is 64 bits wide and counts documents of one part, of which there are fewer
than 2^63, so no field runs over into the next.

Shuffles hold a few numbers a document, never texts; sums are made before the shuffle by (part, mask, labels), so a part with a third of all rows is a few rows a task.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, remove, shared_folder

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is counted at each step of each order.
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text. A: under 200 words; B: fewer than half of the words are distinct; C: more than 2 in 100 characters are
    A-Z; D: it holds a symbol of ``#$%&*|``. A null text is an empty one: it fails A alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail the same filters, bit i for the i-th of ``FILTERS``.

    E fails for texts that a smaller ``doc_id`` has too, anywhere in the table, null and empty being one text. A null id comes after all others; rows
    repeated with the same id don't fail E for each other. A null source is the part ''. Of several labels of a document the worse counts as toxic
    and the better as good; null labels are neither. Other columns aren't read. Nothing comes of an empty table.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    failed = text_failures(F.col("text"))
    bits = functools.reduce(lambda a, b: a + b, (F.when(failed[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS) if f in failed))
    last = F.lit(2**63 - 1)
    docs.select(
        F.coalesce("doc_id", last).alias("id"), F.coalesce("source", F.lit("")).alias("part"), bits.alias("bits"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("same"),
    ).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    first = rows.groupBy(F.col("same").alias("first_same")).agg(F.min("id").alias("first_id"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    copy = F.when(F.col("first_id").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    # the id is part of the key, so the rows of one text, however many, are dealt by their ids
    joined = rows.join(first, (F.col("same") == F.col("first_same")) & (F.col("id") == F.col("first_id")), "left").select("id", "part", (F.col("bits") + copy).alias("mask"))
    joined = joined.join(known, F.col("id") == F.col("labelled"), "left")
    counted = joined.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))
    counted.write.parquet(f"{folder}/counts")
    remove(spark, f"{folder}/rows")
    return spark.read.parquet(f"{folder}/counts")


@functools.lru_cache(maxsize=4)
def orders(names: str) -> tuple[str, ...]:
    return tuple("".join(p) for p in itertools.permutations(names))


@functools.lru_cache(maxsize=1024)
def packed(names: str, mask: int, good: bool, toxic: bool) -> int:
    """The big integer of a document: a 64-bit field for each outcome of each step of each order, then one for each filter that it alone fails."""
    found = np.zeros((len(orders(names)), len(names), len(OUTCOMES)), "<u8")
    for row, order in zip(found, orders(names)):
        gone = False
        for step, name in zip(row, order):
            fails = bool(mask >> names.index(name) & 1)
            here = fails and not gone
            step[:] = not gone and not fails, here, fails and gone, here and good, here and toxic
            gone = gone or fails
    alone = np.array([mask == 1 << i for i in range(len(names))], "<u8")
    return int.from_bytes(np.concatenate([found.ravel(), alone]).tobytes(), "little")


def unpacked(names: str, total: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The counts by (order, step, outcome) and by filter that are in a sum of packed integers."""
    fields = np.frombuffer(total, "<u8").astype("int64")
    steps = fields[: -len(names)].reshape(len(orders(names)), len(names), len(OUTCOMES))
    return steps, fields[-len(names) :]


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step, of what ``failure_masks`` counts: a part has at most 4 * 2^k rows of it, so a sum is small work.

    ``kept``: passed this step and all before; ``removed``: gone here; ``redundant``: fails this filter, gone before; ``unique_fails``: fails this
    filter alone; ``good_lost``, ``toxic_lost``: removed here with that label; ``shapley``: removed by this filter, summed over all orders.
    """
    width = 8 * (len(orders(names)) * len(names) * len(OUTCOMES) + len(names))

    @F.pandas_udf("binary")
    def summed(mask: pd.Series, good: pd.Series, toxic: pd.Series, n: pd.Series) -> bytes:
        return sum(int(c) * packed(names, int(m), bool(g), bool(t)) for m, g, t, c in zip(mask, good, toxic, n)).to_bytes(width, "little")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = orders(names)
        at = np.array([[names.index(x) for x in order] for order in every])
        for batch in batches:
            for part, total in zip(batch["part"], batch["total"]):
                steps, alone = unpacked(names, total)
                shapley = np.array([steps[..., 1][at == i].sum() for i in range(len(names))])
                yield pd.DataFrame({"part": part, "filter_order": np.repeat(every, len(names)), "step": np.tile(np.arange(1, len(names) + 1), len(every)).astype("int32")}
                                   | {name: steps[..., i].ravel() for i, name in enumerate(OUTCOMES)} | {"unique_fails": alone[at].ravel(), "shapley": shapley[at].ravel()})

    columns = ", ".join(f"{c} long" for c in (*OUTCOMES, "unique_fails", "shapley"))
    return masks.groupBy("part").agg(summed("mask", "good", "toxic", "n").alias("total")).mapInPandas(spread, f"part string, filter_order string, step int, {columns}")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failure_masks(docs, labels))
