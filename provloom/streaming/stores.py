"""Keyed stores with state in RocksDB: runs that expire by time and by records, and graph elements that wait for what they point at.

Both are ``transformWithStateInPandas`` jobs: state is a row or a list a key, timers follow the watermark, and a restart goes on from the checkpoint. Work and
memory of a batch are those of its rows and keys; what earlier batches wrote is never read again.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.resolve import remap_edges, remap_roots

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which these jobs need; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an appending stream over all that is there, from where the folder's checkpoint ends; gives all that it has written so far."""
    spark = stream.sparkSession
    with rocksdb(spark):
        stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").outputMode("append").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def held(spark: SparkSession, folder: str, name: str, keys: list[str], column: str = "value") -> DataFrame:
    """What a state variable holds, with the keys as columns."""
    state = spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state")
    names = state.schema["key"].dataType.names
    return state.select(*[F.col(f"key.{n}").alias(k) for n, k in zip(names, keys, strict=True)], f"{column}.*")


# Runs of events


RUN = "kind string, first_seq long, last_seq long, merged long, earliest long, latest long"


class RunStore(StatefulProcessor):
    """A key's open run. It is given out by the row that doesn't fit, or by a timer when the watermark is past its pause."""

    def __init__(self, keys: list[str], gap_nanos: int, gap_records: int, most: int) -> None:
        self.keys, self.gap_nanos, self.gap_records, self.most = keys, gap_nanos, gap_records, most

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.run = handle.getValueState("run", RUN)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        run = list(self.run.get()) if self.run.exists() else None
        out = []
        frame = pd.concat(list(rows)).sort_values("seq")
        for kind, seq, nanos in zip(frame["kind"], frame["seq"].tolist(), frame["nanos"].tolist(), strict=True):
            # the record counter is the distance of sequence numbers, so it counts what other keys got in between
            if run and kind == run[0] and nanos - run[6] <= self.gap_nanos and seq - run[2] <= self.gap_records and run[3] < self.most:
                run = [kind, run[1], seq, run[3] + 1, min(run[4], nanos), max(run[5], nanos), nanos]
            else:
                if run:
                    out.append((*key, *run[:6]))
                run = [kind, seq, seq, 1, nanos, nanos, nanos]
        self.run.update(tuple(run))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((run[5] + self.gap_nanos) // 1_000_000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        run = tuple(self.run.get())
        self.run.clear()
        yield self._frame(key, [(*key, *run[:6])])

    def _frame(self, key: tuple, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.keys, "kind", "first_seq", "last_seq", "merged", "earliest", "latest"])

    def close(self) -> None:
        pass


RUN += ", last long"  # the time of the last row, from which the pause counts


def collapse_stream(events: DataFrame, keys: list[str], kind: str, seq: str, nanos: str, ts: str, gap_nanos: int = 10_000_000_000, gap_records: int = 10_000, most: int = 100, late: str = "1 hour") -> DataFrame:
    """``resolve.collapse_events`` as a stream: a run ends after a pause of ``gap_nanos`` or ``gap_records``, with another kind, or at ``most`` merged.

    Rows of a key come in order from batch to batch; within one they are sorted. ``ts`` is the event time of the watermark; what is over ``late`` behind is
    dropped by Spark. Runs that are open at the end are in the state ``run``, see ``open_runs``.
    """
    rows = events.withWatermark(ts, late).select(*keys, F.col(kind).alias("kind"), F.col(seq).alias("seq"), F.col(nanos).alias("nanos"), ts)
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "kind string, first_seq long, last_seq long, merged long, earliest long, latest long"])
    return rows.groupBy(*keys).transformWithStateInPandas(RunStore(keys, gap_nanos, gap_records, most), schema, "append", "EventTime")


def open_runs(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The runs that a stream left open, in the columns of its output."""
    return held(spark, folder, "run", keys).drop("last")


# Graph elements


#: An element on its way: a vertex or an edge at one of its ends (``end``), or a pointer from ``id`` to ``into``.
ITEM = "id string, what string, end string, into string, element string, label string, src string, dst string, payload string, seq long"
#: What comes out: vertices, edges with both ends resolved, synthesised vertices, and edges on their way to another key.
FOUND = "what string, id string, end string, into string, element string, label string, src string, dst string, payload string, seq long"
BLOCKED = "end string, element string, label string, src string, dst string, payload string, seq long"


class ElementStore(StatefulProcessor):
    """What is known of an id: a vertex, where it points to, or the edges that wait for either.

    An edge comes to its source's key, then to its target's. At a key that points elsewhere it is sent on, at a vertex's key its end is resolved, else it waits.
    The first vertex of an id counts, the first pointer too. With ``expiry_ms``, an id that edges wait for so long is given a synthesised vertex.
    """

    COLUMNS = ("what", "id", "end", "into", "element", "label", "src", "dst", "payload", "seq")

    def __init__(self, expiry_ms: int | None) -> None:
        self.expiry_ms = expiry_ms

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.into = handle.getValueState("into", "into string")
        self.known = handle.getValueState("known", "element string")
        self.blocked = handle.getListState("blocked", BLOCKED)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        ident = key[0]
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out: list[tuple] = []
        into = self.into.get()[0] if self.into.exists() else None
        known = self.known.exists()
        moved = False
        for row in frame[frame["what"] != "edge"].itertuples():
            if row.what == "pointer" and into is None and row.into != ident:
                into = row.into
                self.into.update((into,))
                moved = True
            elif row.what == "vertex" and not known:
                known = moved = True
                self.known.update((row.element,))
                out.append(("vertex", ident, None, None, row.element, row.label, None, None, row.payload, row.seq))
        edges = [(r.end, r.element, r.label, r.src, r.dst, r.payload, r.seq) for r in frame[frame["what"] == "edge"].itertuples()]
        if moved and self.blocked.exists():
            edges = [*(tuple(x) for x in self.blocked.get()), *edges]
            self.blocked.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if into is not None or known:
            out += [self._moved(ident, into, e) for e in edges]
        elif edges:
            if self.expiry_ms is not None and not self.blocked.exists():  # an expiry that is set stays, whatever comes after
                self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.expiry_ms)
            self.blocked.appendList(edges)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        ident = key[0]
        edges = [tuple(x) for x in self.blocked.get()]
        self.blocked.clear()
        self.known.update((ident,))
        out = [("synthesized", ident, None, None, ident, None, None, None, None, None), *(self._moved(ident, None, e) for e in edges)]
        yield pd.DataFrame(out, columns=self.COLUMNS)

    @staticmethod
    def _moved(ident: str, into: str | None, edge: tuple) -> tuple:
        """An edge sent on to where the id points, or, resolved here, to its other end or out."""
        end, element, label, src, dst, payload, seq = edge
        if into is not None:
            return "forward", into, end, None, element, label, src, dst, payload, seq
        if end == "src":
            return "forward", dst, "dst", None, element, label, ident, dst, payload, seq
        return "edge", None, None, None, element, label, src, ident, payload, seq

    def close(self) -> None:
        pass


def resolve_stream(items: DataFrame, ts: str, folder: str, expiry_ms: int | None = None, late: str = "1 hour", most_rounds: int = 10_000) -> None:
    """Runs the element store over all items that are there, from where the folder's checkpoint ends.

    What is sent on to another key is written beside the output and read by the same query as its second source, in a later batch: an edge whose end is n
    pointers away takes n + 2 batches. A batch is written by one overwriting write, so one that is run again writes nothing twice.
    """
    spark = items.sparkSession
    columns = ITEM.replace(" string", "").replace(" long", "").split(", ")
    sent = spark.readStream.schema(FOUND.replace("what string, ", "")).parquet(f"{folder}/found/batch=*/what=forward").withColumns({"what": F.lit("edge"), ts: F.lit(None).cast("timestamp")})
    # rows without an event time are never late, however far the watermark has gone
    both = items.withWatermark(ts, late).select(*columns, ts).unionByName(sent.select(*columns, ts))
    found = both.groupBy("id").transformWithStateInPandas(ElementStore(expiry_ms), FOUND, "append", "EventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("what").parquet(f"{folder}/found/batch={number}")

    for _ in range(most_rounds):
        with rocksdb(spark):
            query = found.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
            query.awaitTermination()
        if not sum(int(p["numInputRows"]) for p in query.recentProgress):
            return
    raise RuntimeError(f"edges are still on their way after {most_rounds} rounds")


def written(spark: SparkSession, folder: str, what: str) -> DataFrame:
    """What has come out so far: ``vertex``, ``edge`` or ``synthesized``."""
    return spark.read.schema(f"{FOUND}, batch int").option("basePath", f"{folder}/found").parquet(f"{folder}/found").where(F.col("what") == what).drop("batch", "what", "end", "into")


def waiting(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that still wait, with the id that they wait for."""
    state = spark.read.format("statestore").option("stateVarName", "blocked").load(f"{folder}/state")
    return state.select(F.col(f"key.{state.schema['key'].dataType.names[0]}").alias("at"), "list_element.*")


def resolve_rest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """At the stream's end: the edges that still wait, resolved by all pointers in the state, and the vertices to synthesise for their ends."""
    pointers, known = held(spark, folder, "into", ["id"]), held(spark, folder, "known", ["id"])
    left = waiting(spark, folder)
    edges = left.select(F.when(F.col("end") == "src", F.col("at")).otherwise(F.col("src")).alias("src"), F.when(F.col("end") == "dst", F.col("at")).otherwise(F.col("dst")).alias("dst"))
    return remap_edges(edges, remap_roots(pointers), known.select("id"))
