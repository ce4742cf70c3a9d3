"""Structured Streaming forms of the order-aware operators; run to the end of what is there, they give the batch results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import MICROS
from ..session import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 8) -> DataFrame:
    """The events as a stream of files; in production a message topic takes the reader's place."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.expr(MICROS) * 1000).alias("nanos"), F.col("user_id").alias("subject"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("object"), "value")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote: appended files, or the last complete table."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").option("path", f"{folder}/out").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def renewed(counts: DataFrame, folder: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A small table that every batch of a stream computes anew from counts that the stream's own state keeps up to date; gives the last one.

    ``counts`` is an aggregation, given out whole with each batch, so nothing that came before is read again. A batch that is run again overwrites its own.
    """

    def batch(df: DataFrame, number: int) -> None:
        compute(df).write.mode("overwrite").parquet(f"{folder}/found/batch={number}")

    counts.writeStream.option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    found = counts.sparkSession.read.parquet(f"{folder}/found")
    last = found.agg(F.max("batch").alias("batch"))
    return found.join(F.broadcast(last), "batch", "left_semi").drop("batch")  # one row


def daily_counts(events: DataFrame) -> DataFrame:
    """Tumbling windows by event time, with a watermark that drops what is over thirty days late."""
    return events.withWatermark("ts", "30 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a subject's events without a pause of ``gap``."""
    return events.withWatermark("ts", "30 days").groupBy(F.session_window("ts", gap), "subject").agg(F.count("*").alias("n"))


def prefix_counts(events: DataFrame) -> DataFrame:
    """The trie's counters kept up to date."""
    key = F.array(F.col("subject").cast("string"), F.col("event_type"), F.col("object").cast("string"))
    rows = events.where("object is not null").select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"), key.alias("key"))
    return rows.groupBy("level", F.array_join(F.expr("slice(key, 1, level)"), "|").alias("prefix")).agg(F.count("*").alias("n"))


def first_sightings(events: DataFrame) -> DataFrame:
    """Pairs of subject and object when they are first seen; state is kept for thirty days of event time."""
    return events.where("object is not null").withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["subject", "object"]).select("subject", "object")


def first_then_later(events: DataFrame, first: str, later: str) -> DataFrame:
    """The earliest ``first`` event of an object with every ``later`` one after it; the earliest is the state of the object."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["nanos", "event_id"])
        out = []
        for kind, nanos, ident in zip(rows["event_type"], rows["nanos"], rows["event_id"], strict=True):
            if opened is not None and kind == later and (nanos, ident) > opened[:2]:
                out.append((key[0], opened[1], ident))
            if opened is None and kind == first:
                opened = (int(nanos), int(ident))
        if opened is not None:
            state.update(opened)
        yield pd.DataFrame(out, columns=["object", "first_event_id", "later_event_id"])

    return events.where("object is not null").select("object", "event_type", "nanos", "event_id").groupBy("object").applyInPandasWithState(
        step, "object long, first_event_id long, later_event_id long", "nanos long, event_id long", "append", "NoTimeout"
    )


def online_code_length(events: DataFrame, parts: int = 8) -> DataFrame:
    """Each event coded by the counts before it in its part; the counts are the state."""
    import json
    import math

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        counts = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["nanos", "event_id"])
        total, out = sum(counts.values()), []
        for kind, ident in zip(rows["event_type"], rows["event_id"], strict=True):
            out.append((int(ident), -math.log2((counts.get(kind, 0) + 1) / (total + 2))))
            counts[kind] = counts.get(kind, 0) + 1
            total += 1
        state.update((json.dumps(counts),))
        yield pd.DataFrame(out, columns=["event_id", "bits"])

    dealt = events.select((F.col("subject") % parts).alias("part"), "event_type", "nanos", "event_id")
    return dealt.groupBy("part").applyInPandasWithState(step, "event_id long, bits double", "counts string", "append", "NoTimeout")
