"""Which of many itemsets an object has: a prefix tree over bit columns of the items, walked once for a batch of objects.

The sets that are asked for are a stated table; its size is counted before it goes to the tasks. ``BLOCK`` sets at most are sent at once; a larger table
goes block by block, each block's result written, so neither the driver nor a task ever holds all of it. Objects aren't joined or shuffled for a lookup: a
batch's rows that have a prefix are an index array, which only shrinks down the tree, so the work is the number of prefixes that objects have.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Itemsets that are sent to the tasks at once, at most.
BLOCK = 100_000


class SubsetIndex:
    """A prefix tree of itemsets; ``items`` are all items of the sets, and others named in ``more``."""

    def __init__(self, sets: list[list[str]], more: list[str] = ()) -> None:
        self.items = sorted({i for s in sets for i in s} | set(more))
        self.number = {item: n for n, item in enumerate(self.items)}
        self.root: dict = {}
        for at, one in enumerate(sets):
            node = self.root
            for item in sorted(set(one), key=self.number.get):
                node = node.setdefault(self.number[item], {})
            node.setdefault(-1, []).append(at)

    def bits(self, baskets: pa.ListArray) -> np.ndarray:
        """One row an object, one column an item, true where the object has it."""
        has = np.zeros((len(baskets), len(self.items)), bool)
        if self.items and len(baskets):
            flat = pc.index_in(baskets.flatten(), value_set=pa.array(self.items, pa.string()))
            rows = np.repeat(np.arange(len(baskets)), np.asarray(pc.fill_null(pc.list_value_length(baskets), 0)))
            known = np.asarray(pc.is_valid(flat))
            has[rows[known], np.asarray(pc.fill_null(flat, 0))[known]] = True
        return has

    def visit(self, has: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
        """The numbers of equal sets, with the rows that have all their items; sets that no row has don't come."""
        pending = [(self.root, np.arange(len(has)))]
        while pending:
            node, rows = pending.pop()
            for item, below in node.items():
                if item < 0:
                    yield below, rows
                elif len(kept := rows[has[rows, item]]):
                    pending.append((below, kept))


def look_up(
    ctx: DataFrame, sets: DataFrame, of: str, fold: Callable[[SubsetIndex, dict[str, list], np.ndarray, np.ndarray], list], columns: dict[str, str], merge: dict[str, Callable[[str], Column]],
    more: str | None = None, block: int | None = None,
) -> DataFrame:
    """For each object of a context, what ``fold`` makes of the sets (array column ``of``) that it has.

    ``fold(index, table, has, own)`` gets the rows of the sets as columns, the bit rows of a batch of objects and the numbers of all their attributes; it
    gives one array for each of ``columns`` (name: type). ``merge`` puts the columns of several blocks of sets together. ``more`` names a column of
    ``sets`` with further items to have bits for. Objects are all of the context's; null attributes are none.
    """
    spark = ctx.sparkSession
    baskets = ctx.groupBy("object").agg(F.collect_set("attribute").alias("has"))
    size = block or BLOCK
    blocks = max(1, -(-sets.count() // size))
    names = list(columns)
    kind = dict(ctx.dtypes)["object"]
    schema = ", ".join([f"object {kind}", *(f"{c} {t}" for c, t in columns.items())])

    def one(part: DataFrame) -> DataFrame:
        rows = part.collect()  # a block, ``size`` rows or few more
        table = {c: [r[c] for r in rows] for c in part.columns}
        index = SubsetIndex([list(s) for s in table[of]], [x for x in table[more] if x is not None] if more else [])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("has")
                found = fold(index, table, index.bits(lists), np.asarray(pc.list_value_length(lists)))
                yield pa.RecordBatch.from_arrays([batch.column("object"), *(x if isinstance(x, pa.Array) else pa.array(x) for x in found)], ["object", *names])

        return baskets.mapInArrow(task, schema)

    if blocks == 1:
        return one(sets)
    folder = f"{shared_folder(spark)}/subsets-{uuid.uuid4().hex}"
    for b in range(blocks):
        one(sets.where(F.pmod(F.xxhash64(of), F.lit(blocks)) == b)).write.parquet(f"{folder}/block={b}")
    return spark.read.parquet(folder).groupBy("object").agg(*[merge[c](c).alias(c) for c in names])
