"""Entity resolution: collapsing events, remapping ids, removing duplicates, ordering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def collapse_events(events: DataFrame, keys: list[str], kind: str, seq: str, nanos: str, gap_nanos: int = 10_000_000_000, gap_records: int = 10_000, most: int = 100, compat: bool = False) -> DataFrame:
    """Runs of one kind with the same keys as single events.

    A run ends with a change of kind, after a pause of ``gap_nanos`` or ``gap_records``, or at ``most`` merged. Gives keys, kind, first and last seq, merged,
    earliest and latest; with ``compat`` the latest is the least time too.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    fresh = (
        F.lag(kind).over(w).isNull() | (F.lag(kind).over(w) != F.col(kind))
        | (F.col(nanos) - F.lag(nanos).over(w) > gap_nanos) | (F.col(seq) - F.lag(seq).over(w) > gap_records)
    )
    runs = events.withColumn("_fresh", fresh.cast("int"))
    runs = runs.withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy(*keys, "_run").orderBy(seq)
    runs = runs.withColumn("_part", F.floor((F.row_number().over(inside) - 1) / most))
    latest = F.min(nanos) if compat else F.max(nanos)
    return runs.groupBy(*keys, kind, "_run", "_part").agg(
        F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("merged"), F.min(nanos).alias("earliest"), latest.alias("latest")
    ).drop("_run", "_part")


def remap_roots(merges: DataFrame) -> DataFrame:
    """(id, root) of a table of merges (id, into): pointers are followed to their end by doubling, each round halves what is left.

    An id has one ``into``; the last by ``into`` wins where it has several. A chain of n merges ends after log2(n) + 1 rounds; if pointers still move
    then, they are in a cycle, and ValueError is raised.
    """
    table = checkpoint(merges.groupBy("id").agg(F.max("into").alias("root")))
    for _ in range(table.count().bit_length() + 1):
        ahead = table.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = table.select("id", "root").join(ahead, "root", "left")
        table = checkpoint(joined.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not table.where("id = root").isEmpty():
            break
        if table.where("moved").isEmpty():
            return table.select("id", "root")
    raise ValueError("a cycle of merges")


def remap_edges(edges: DataFrame, roots: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends resolved, without doubles, and the nodes to synthesise for ends that no record described."""
    def end(df: DataFrame, name: str) -> DataFrame:
        r = roots.select(F.col("id").alias(name), F.col("root").alias("_r"))
        return df.join(r, name, "left").withColumn(name, F.coalesce("_r", name)).drop("_r")

    resolved = end(end(edges, "src"), "dst").distinct()
    ends = resolved.select(F.col("src").alias("id")).union(resolved.select("dst")).distinct()
    return resolved, ends.join(nodes.select("id"), "id", "left_anti")


def first_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row a key, the earliest."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(seq))).where("_n = 1").drop("_n")


def edges_after_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes, with the place at which all three have been seen."""
    n = nodes.groupBy("id").agg(F.min("seq").alias("at"))
    a, b = n.select(F.col("id").alias("src"), F.col("at").alias("_a")), n.select(F.col("id").alias("dst"), F.col("at").alias("_b"))
    return edges.join(a, "src").join(b, "dst").withColumn("ready", F.greatest("seq", "_a", "_b")).drop("_a", "_b")


def conflicting(records: DataFrame, key: str, seq: str, content: list[str]) -> DataFrame:
    """Later records of a key whose content differs from the first one's."""
    w = Window.partitionBy(key).orderBy(seq)
    now = F.struct(*content)
    return records.withColumn("_first", F.first(now).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(~F.col("_first").eqNullSafe(now)).drop("_first")


def running_clock(rows: DataFrame, host: str, seq: str, nanos: str) -> DataFrame:
    """The greatest time so far on each host."""
    return rows.withColumn("clock", F.max(nanos).over(Window.partitionBy(host).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def guarded_clock(rows: DataFrame, host: str, seq: str, nanos: str, most_jump: int, trusted_from: int = 1_400_000_000_000_000_000) -> DataFrame:
    """As ``running_clock``, but a jump ahead of more than ``most_jump`` is not taken once the clock is past ``trusted_from``.

    What is taken depends on what was taken before, a fold that windows can't express: each host is folded in order in chunks that carry the clock on.
    """
    kinds = dict(rows.dtypes)
    schema = f"{host} {kinds[host]}, {seq} {kinds[seq]}, clock bigint"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clocks: dict = {}
        for part in batches:
            out = []
            for h, t in zip(part[host], part[nanos], strict=True):
                now = clocks.get(h, 0)
                if t > now and (now < trusted_from or t - now <= most_jump):
                    clocks[h] = now = int(t)
                out.append(now)
            yield pd.DataFrame({host: part[host], seq: part[seq], "clock": out})

    dealt = rows.select(host, seq, nanos).repartition(host).sortWithinPartitions(host, seq)
    return dealt.mapInPandas(fold, schema)


def upconvert(frames: dict[int, DataFrame], renames: dict[int, dict[str, str]], defaults: dict[str, Column], columns: list[str]) -> DataFrame:
    """Records of several versions in the columns of the newest: each version's renames are applied from its own on, missing fields get defaults."""
    out = None
    for version in sorted(frames):
        df = frames[version]
        for v in sorted(r for r in renames if r > version):
            df = df.withColumnsRenamed({a: b for a, b in renames[v].items() if a in df.columns})
        df = df.select(*[F.col(c) if c in df.columns else defaults.get(c, F.lit(None)).alias(c) for c in columns], F.lit(version).alias("from_version"))
        out = df if out is None else out.unionByName(df)
    return out


def record_filter(spec: dict, compat: bool = False) -> Column:
    """The filter of a JSON specification: property, label, edge, and, or, not. ``compat`` swaps and with or, as old specifications expect."""
    kind, value = next(iter(spec.items()))
    if kind == "hasProperty":
        column = F.col(value["key"])
        return column.isNotNull() if value.get("value") is None else F.coalesce(column.cast("string") == str(value["value"]), F.lit(False))
    if kind == "hasLabel":
        return F.col("label") == value
    if kind == "hasEdge":
        return F.array_contains("edge_labels", value)
    if kind == "not":
        return ~record_filter(value, compat)
    parts = [record_filter(v, compat) for v in value]
    both = (kind == "and") != compat
    found = F.lit(both)
    for p in parts:
        found = (found & p) if both else (found | p)
    return found


def suffix_fold(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The distinct strings of each key without those that end another one: strings are reversed and sorted, so that a suffix
    is a prefix of the strings that follow it, of the next one already.
    """
    back = rows.select(key, F.reverse(text).alias("_b")).distinct()
    nxt = F.lead("_b").over(Window.partitionBy(key).orderBy("_b"))
    return back.withColumn("_n", nxt).where("_n is null or not startswith(_n, _b)").select(key, F.reverse("_b").alias(text))


def text_uuids(rows: DataFrame, key: str, text: str, roots: DataFrame) -> DataFrame:
    """(key, uuid): the distinct uuids that texts name in any case, each as what ``roots`` (id, root) resolves it to, or itself."""
    pattern = F.lit(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
    found = rows.select(key, F.explode(F.regexp_extract_all(text, pattern, F.lit(0))).alias("id")).select(key, F.lower("id").alias("id")).distinct()
    return found.join(roots, "id", "left").select(key, F.coalesce("root", "id").alias("uuid")).distinct()
