"""Reports of alarms by process, merged and shortened tries, and elements as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import PROPERTIES
from .novelty import from_leaves, leaves


def eliminate_level(tree: DataFrame, level: int) -> DataFrame:
    """A snapshot without the keys of one level: what was below them is merged below their parents. Counts add up and probabilities are renewed; a leaf
    of that level is counted at its parent alone."""
    key = F.concat(F.slice("prefix", 1, level - 1), F.slice("prefix", level + 1, F.greatest(F.size("prefix") - level, F.lit(0))))
    return from_leaves(leaves(tree).select("tree", F.when(F.size("prefix") >= level, key).otherwise(F.col("prefix")).alias("key"), "count"))


def merge_trees(tree: DataFrame, name: str) -> DataFrame:
    """The snapshots of all trees of a frame, one for each host say, as one: counts of equal prefixes added up, probabilities renewed."""
    return from_leaves(leaves(tree).select(F.lit(name).alias("tree"), F.col("prefix").alias("key"), "count"))


def process_reports(alarm_rows: DataFrame, process: Column, nanos: str, width: int, k: int = 20) -> DataFrame:
    """(process, interval, alarms, least, novel): for each process and reporting interval, how many alarms, their least local probability, and the k least
    expected of them as text, ties by text. The k best of a task are taken before rows move, so a process with most alarms is no burden."""
    rows = alarm_rows.select(process.alias("process"), F.expr(f"{nanos} - {nanos} % {width}").alias("interval"), "local_prob", F.array_join("key", " ").alias("action"))
    totals = rows.groupBy("process", "interval").agg(F.count("*").alias("alarms"), F.min("local_prob").alias("least"))
    order = Window.partitionBy("process", "interval").orderBy("local_prob", "action")
    best = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    novel = best.groupBy("process", "interval").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "action"))), lambda x: x["action"]).alias("novel"))  # k entries
    return totals.join(novel, ["process", "interval"])


def vertex_json(vertices: DataFrame, properties: tuple[str, ...] = PROPERTIES) -> DataFrame:
    """(id, json) of vertices of any label: type, label, and each property that is there as a list of one value; numbers and truth values stay such."""
    held = [F.when(F.col(p).isNotNull(), F.array(F.struct(F.col(p).alias("value")))).alias(p) for p in properties]
    return vertices.select("id", F.to_json(F.struct("id", F.lit("vertex").alias("type"), "label", F.struct(*held).alias("properties"))).alias("json"))


def edge_json(edges: DataFrame) -> DataFrame:
    """(id, json) of edges: type, label and both ends."""
    return edges.select("id", F.to_json(F.struct("id", F.lit("edge").alias("type"), "label", F.col("dst").alias("inV"), F.col("src").alias("outV"))).alias("json"))


def result_json(rows: DataFrame) -> DataFrame:
    """Rows of any query as JSON objects, lists and maps inside them included; null fields are left out."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("json"))
