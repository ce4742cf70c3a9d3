"""Sinks for streams: graph elements in batches, with edges that wait for their ends, and alarm reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "id string, label string, src string, dst string, properties map<string,string>"
NIL = "00000000-0000-0000-0000-000000000000"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder's rows, none where nothing was written yet; the file system is Hadoop's, so any store works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def graph_sink(folder: str, order: str | None = None, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer of elements (id, label, src, dst, properties; vertices have no src).

    Each batch adds vertices under ``vertices/batch=N``, of equal ids the first by the column ``order`` where one is named, and edges whose two ends are known under
    ``edges/batch=N``; the others wait under ``parked/batch=N`` and are tried again with every later batch. Ids alone are kept by ``buckets`` of their
    hash under ``ids``, and a batch reads the buckets that it asks for, not the vertices written before. Elements of the nil uuid are skipped. Every
    folder is overwritten if a batch is run again, so a restart writes nothing twice.
    """
    columns = ["id", "label", "src", "dst", "properties"]
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")

    def known(spark: SparkSession, asked: DataFrame, upto: int) -> DataFrame:
        """Those of the asked ids that are written."""
        held = [r[0] for r in asked.select(bucket("id").alias("b")).distinct().collect()]  # ``buckets`` numbers at most
        ids = _read(spark, f"{folder}/ids", "id string, batch int, bucket int")
        return ids.where(F.col("bucket").isin(held) & (F.col("batch") <= upto)).select("id").join(asked, "id", "left_semi").distinct()

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(~F.coalesce("src", "id").isin(NIL) & ~F.coalesce("dst", "id").isin(NIL))
        vertices = rows.where("src is null")
        if order is None:
            first = vertices.dropDuplicates(["id"]).select(*columns)
        else:
            first = vertices.groupBy("id").agg(F.min_by(F.struct(*columns[1:]), order).alias("v")).select("id", "v.*")
        fresh = first.join(known(spark, first.select("id"), number - 1), "id", "left_anti")
        fresh.select(*columns).write.mode("overwrite").parquet(f"{folder}/vertices/batch={number}")
        written = _read(spark, f"{folder}/vertices/batch={number}", ELEMENT)
        written.select("id", bucket("id").alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/ids/batch={number}")
        waiting = _read(spark, f"{folder}/parked", f"{ELEMENT}, batch int").where(F.col("batch") == number - 1).drop("batch")
        edges = rows.where("src is not null").select(*columns).unionByName(waiting).dropDuplicates(["id"])
        there = known(spark, edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), number)
        ends = edges.join(there.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(there.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
        ready = F.col("_s").isNotNull() & F.col("_d").isNotNull()
        ends.where(~ready).select(*columns).write.mode("overwrite").parquet(f"{folder}/parked/batch={number}")
        ends.where(ready).select(*columns).write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")

    return write


def finish_graph(spark: SparkSession, folder: str) -> None:
    """At the stream's end: vertices ``AdmSynthesized`` for the ends that no element described, and the edges that waited for them."""
    vertices, _, parked = graph_tables(spark, folder)
    ends = parked.select(F.col("src").alias("id")).union(parked.select("dst")).distinct().join(vertices.select("id"), "id", "left_anti")
    made = ends.select("id", F.lit("AdmSynthesized").alias("label"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.create_map().cast("map<string,string>").alias("properties"))
    made.write.mode("overwrite").parquet(f"{folder}/vertices/batch=2000000000")
    parked.write.mode("overwrite").parquet(f"{folder}/edges/batch=2000000000")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/parked")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, edges and the edges that still wait, as written by ``graph_sink``."""
    parked = _read(spark, f"{folder}/parked", f"{ELEMENT}, batch int")
    last = parked.agg(F.max("batch").alias("batch"))
    return _read(spark, f"{folder}/vertices", ELEMENT), _read(spark, f"{folder}/edges", ELEMENT), parked.join(F.broadcast(last), "batch", "left_semi").drop("batch")  # one row


def alarm_line(form: str, tree: Column, key: Column, local_prob: Column, nanos: Column) -> Column:
    """An alarm as a line of a log, of a console report, or as the JSON event of an HTTP collector."""
    at = F.format_string("%s", F.timestamp_seconds(nanos / 1_000_000_000).cast("string"))
    if form == "log":
        return F.concat_ws("\t", at, tree, F.array_join(key, " / "), F.round(local_prob, 6).cast("string"))
    if form == "console":
        return F.concat(tree, F.lit(": "), F.element_at(key, -1), F.lit(" after "), F.array_join(F.slice(key, 1, F.size(key) - 1), ", "))
    if form == "collector":
        event = F.struct(tree.alias("tree"), key.alias("key"), F.round(local_prob, 6).alias("localProb"))
        return F.to_json(F.struct((nanos.cast("double") / 1e9).alias("time"), event.alias("event")))
    raise ValueError(f"no form {form!r}")


def write_alarms(alarm_rows: DataFrame, path: str, form: str, nanos: str = "nanos") -> None:
    """Alarm lines as text files, one task a part of the alarms."""
    alarm_rows.select(alarm_line(form, F.col("tree"), F.col("key"), F.col("local_prob"), F.col(nanos)).alias("value")).write.mode("overwrite").text(path)


def write_context(ctx: DataFrame, path: str) -> None:
    """(object, attribute) as CSV with a header."""
    ctx.select("object", "attribute").write.mode("overwrite").option("header", True).csv(path)
