"""Connected components of a link table by union-find and star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def union_find(links: list[tuple]) -> dict:
    """Each linked value's root: the least value of its component."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


#: Links that one union-find takes in at once; their forest replaces them.
CHUNK_LINKS = 200_000


#: Links of forests up to this many are finished by one task, in about 100 MB; more go through the rounds.
ONE_TASK_LINKS = 300_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    found = list(union_find(links).items())
    for k in range(0, len(found), 50_000):
        part = found[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.binary()), pa.array([r for _, r in part], pa.binary())], ["node", "root"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def forest(links):
        found = union_find(links)
        at = [(x, r) for x, r in found.items() if x != r]
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.binary()), pa.array([r for _, r in part], pa.binary())], ["a", "b"])

    links: list[tuple] = []
    for batch in batches:
        links += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(links) >= CHUNK_LINKS:
            yield from forest(links)
            links = []
    yield from forest(links)


def components(links: DataFrame, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b), binary keys: the root is the component's least node.

    Each partition's links are first replaced by a union-find forest. If these are counted to be few, one task finishes them. Else large-star and small-star rounds
    alternate until every node hangs on its root; each round is two aggregations with partial minima and joins
    that Spark may split at a busy node, so no task holds a component. Each round's links are written to the checkpoint folder.
    """
    edges = checkpoint(links.select("a", "b").where("a <> b").mapInArrow(_contract, "a binary, b binary").distinct())
    if edges.count() <= one_task_links:
        return checkpoint(edges.coalesce(1).mapInArrow(_finish, "node binary, root binary"))
    before = None
    while True:
        # Large star: larger neighbours of a node hang on the least of it and its neighbours.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its lesser neighbours hang on the least of these.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        kept = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(kept.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
