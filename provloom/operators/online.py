"""Learners that score each record by what came before it, and renew themselves with it.

AVF and RASP need only counts of earlier records: running sums by ranges of the order, so no task sees more than a range, however few attributes or
streams there are. KL-stream decides record by record which cluster takes it; that is a fold with its clusters as state, one stream a key. The online forest
keeps its trees and renews the number of rows in each leaf with every window.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .detectors import log2
from .forest import _c, grow
from .running import ranges, running


def earlier_counts(cells: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Of cells (object, order, attribute), each object at one place of the order: the records (object, order, own, n, all) with the number of earlier records
    and their cells, and the cells with ``f``, how many earlier records have the attribute."""
    cells = ranges(cells.select("object", order, "attribute"), order)
    records = cells.groupBy("object", order, "_range").agg(F.count("attribute").alias("own")).withColumn("_one", F.lit(1))
    counted = running(records, ["_one"], [order, "object"], F.lit(1), "n")
    counted = running(counted, ["_one"], [order, "object"], F.col("own"), "all")
    before = counted.select("object", order, "own", (F.col("n") - 1).alias("n"), (F.col("all") - F.col("own")).alias("all"))
    seen = running(cells.where("attribute is not null"), ["attribute"], [order, "object"], F.lit(1), "f")
    return before, seen.select("object", "attribute", (F.col("f") - 1).alias("f"))


def avf_online(cells: DataFrame, order: str, attributes: int | None = None) -> DataFrame:
    """(object, score): attribute value frequency by the records before, with one record of each kind assumed: p = (f + 1) / (n + 2), low is odd.

    Absent attributes add 1 - p; they are never made: over all attributes that is A - (all + A) / (n + 2), to which a present one adds 2 p - 1.
    ``attributes`` is A, how many there are; by default those of the cells. A record without attributes is one cell with a null attribute.
    """
    records, seen = earlier_counts(cells, order)
    a = attributes if attributes is not None else cells.agg(F.count_distinct("attribute")).head()[0]
    weight = (F.col("n") + 2).cast("double")
    own = seen.groupBy("object").agg(F.sum("f").alias("f"))
    joined = records.join(own, "object", "left")
    present = 2 * (F.coalesce("f", F.lit(0)) + F.col("own")) / weight - F.col("own")
    return joined.select("object", (F.lit(a) - (F.col("all") + F.lit(a)) / weight + present).alias("score"))


def rasp_online(cells: DataFrame, order: str) -> DataFrame:
    """(object, score): code length of the present attributes and an end symbol by the counts before. An attribute that no record before had costs the one
    symbol that is kept for new ones. High is odd."""
    records, seen = earlier_counts(cells, order)
    joined = seen.join(records, "object", "right")
    total = (F.col("n") + F.col("all") + 2).cast("double")
    bits = F.when(F.col("attribute").isNull(), 0.0).when(F.col("f") > 0, -log2((F.col("f") + 1) / (total + 2))).otherwise(log2(total))
    return joined.groupBy("object").agg((F.sum(bits) + F.max(-log2((F.col("n") + 1) / total))).alias("score"))


class Clusters:
    """The state of KL-stream: clusters with counts of attributes, and a model of nothing known, which costs a bit an attribute."""

    def __init__(self, attributes: list[str], text: str | None = None) -> None:
        self.number = {a: i for i, a in enumerate(attributes)}
        held = json.loads(text) if text else {"n": [], "f": [], "seen": 0}
        self.n, self.seen = held["n"], held["seen"]
        self.f = np.array(held["f"], float).reshape(len(self.n), len(attributes))

    def text(self) -> str:
        return json.dumps({"n": self.n, "f": self.f.astype(int).tolist(), "seen": self.seen})

    def take(self, items: list[str]) -> tuple[float, int]:
        """Bits of a record and the cluster that it goes to: the one that codes it best, or a new one where none is better than knowing nothing."""
        x = np.zeros(len(self.number), bool)
        x[[self.number[i] for i in items if i in self.number]] = True
        cheapest, cluster = float(len(x)), len(self.n)
        if self.n:
            p = (self.f + 1) / (np.array(self.n)[:, None] + 2)
            costs = -np.log2(np.where(x, p, 1 - p)).sum(axis=1)
            if costs.min() < cheapest:
                cheapest, cluster = float(costs.min()), int(costs.argmin())
        k = len(self.n)  # clusters are opened by records that none coded well, so there are as many of those
        bits = -math.log2(((k if cluster == k else self.n[cluster]) + 1) / (self.seen + 2 * k + 1))
        if cluster == k:
            self.n.append(0)
            self.f = np.vstack([self.f, np.zeros(len(x))])
        self.n[cluster] += 1
        self.f[cluster] += x
        self.seen += 1
        return bits + cheapest, cluster


class ClusterStore(StatefulProcessor):
    """The clusters of a stream's key."""

    def __init__(self, attributes: list[str]) -> None:
        self.attributes = attributes

    def init(self, handle) -> None:  # noqa: ANN001
        self.held = handle.getValueState("clusters", "clusters string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        clusters = Clusters(self.attributes, self.held.get()[0] if self.held.exists() else None)
        frame = pd.concat(list(rows)).sort_values("seq")
        found = [(seq, *clusters.take(list(items))) for seq, items in zip(frame["seq"].tolist(), frame["items"], strict=True)]
        self.held.update((clusters.text(),))
        yield pd.DataFrame(found, columns=["seq", "bits", "cluster"]).assign(part=key[0])[["part", "seq", "bits", "cluster"]]

    def close(self) -> None:
        pass


def kl_stream(records: DataFrame, part: str, seq: str, items: str, attributes: list[str]) -> DataFrame:
    """(part, seq, bits, cluster) of a stream of records: each is coded by the cluster that does it in the fewest bits and joins it, or opens one.

    ``attributes`` are known beforehand, others aren't coded. A part is a stream of its own and keeps as many clusters as it opens. Rows come in order from
    batch to batch and are sorted within one. Null items are none.
    """
    rows = records.select(F.col(part).alias("part"), F.col(seq).cast("long").alias("seq"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))
    kind = dict(rows.dtypes)["part"]
    return rows.groupBy("part").transformWithStateInPandas(ClusterStore(attributes), f"part {kind}, seq long, bits double, cluster long", "append", "None")


# Online isolation forest


def leaves(tree: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf that each row falls into, numbered in the tree's order, and its depth."""
    at, depth = np.zeros(len(x), int), np.zeros(len(x), int)
    number = 0
    pending = [(tree, np.arange(len(x)), 0)]
    while pending:
        node, rows, level = pending.pop()
        if len(node) == 1:
            at[rows], depth[rows] = number, level
            number += 1
        else:
            left = x[rows, node[0]] < node[1]
            pending += [(node[3], rows[~left], level + 1), (node[2], rows[left], level + 1)]
    return at, depth


def leaf_sizes(tree: tuple) -> list[int]:
    """The rows of each leaf when the tree was grown, in the order of ``leaves``."""
    out, pending = [], [tree]
    while pending:
        node = pending.pop()
        if len(node) == 1:
            out.append(node[0])
        else:
            pending += [node[3], node[2]]
    return out


def online_forest(rows: DataFrame, order: str, features: list[str], window: int = 10_000, trees: int = 50, sample: int = 256, seed: int = 7) -> DataFrame:
    """(order, window, score): an isolation forest whose leaves' sizes are those of the window of rows before; its trees are grown once, from the first window.

    Rows are numbered in the order (its values are distinct) and dealt into windows of ``window`` rows. A window is scored by one task beside the leaf counts of the
    window before it, a row of ``trees`` arrays; the first window by the sizes at growing. Scores are 2^(-mean path / c(sample)); high is odd. A window and
    the sample are the bounds of what a task or the driver holds. Null features count as 0.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(order).alias("at"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    dealt = ranges(known, "at").withColumn("_one", F.lit(1))
    numbered = running(dealt, ["_one"], ["at"], F.lit(1), "n").withColumn("window", F.floor((F.col("n") - 1) / window).cast("long")).select("at", "window", *features)
    first = numbered.where("window = 0").orderBy(F.xxhash64("at"), "at").limit(sample * 4).toPandas()
    if not len(first):
        return spark.createDataFrame([], f"`{order}` {dict(rows.dtypes)[order]}, window long, score double")
    x = first[features].to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    grown = [grow(x[rng.choice(len(x), size, replace=False)], limit, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(grown)  # trees x sample leaves at most
    widths = [len(leaf_sizes(t)) for t in grown]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The leaf counts of a batch's windows, one flat array for all trees."""
        for part in batches:
            for w, own in part.groupby("window"):
                at = [np.bincount(leaves(t, own[features].to_numpy(float))[0], minlength=k) for t, k in zip(shared.value, widths, strict=True)]
                yield pd.DataFrame({"window": [w + 1], "masses": [np.concatenate(at)]})

    def scored(key: tuple, own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        values = own[features].to_numpy(float)
        masses = np.sum(np.stack(before["masses"]), axis=0) if len(before) else None
        total, start = np.zeros(len(own)), 0
        for t, k in zip(shared.value, widths, strict=True):
            at, depth = leaves(t, values)
            sizes = np.array(leaf_sizes(t)) if masses is None else masses[start : start + k]
            total += depth + np.array([_c(float(s)) for s in sizes])[at]
            start += k
        return pd.DataFrame({order: own["at"], "window": key[0], "score": 2.0 ** (-total / len(widths) / max(_c(size), 1e-9))})

    masses = numbered.mapInPandas(counted, "window long, masses array<long>")
    kind = dict(rows.dtypes)[order]
    return numbered.groupBy("window").cogroup(masses.groupBy("window")).applyInPandas(scored, f"`{order}` {kind}, window long, score double").where(F.col(order).isNotNull())
