"""Segmentation of the graph and diagnosis over labelled paths."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def radius(seeds: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(seg, node, hops): nodes up to k undirected hops from each seed, with the least hops. Each hop is one join, and only new nodes go
    on; hops after the first are written to the shared folder, as each is read twice."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = checkpoint(both) if k > 1 else both
    found = front = seeds.select(F.col("id").alias("seg"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct()
    for n in range(1, k + 1):
        near = front.join(both, F.col("node") == F.col("src")).select("seg", F.col("dst").alias("node")).distinct()
        front = near.join(found.select("seg", "node"), ["seg", "node"], "left_anti").withColumn("hops", F.lit(n))
        front = checkpoint(front) if n < k else front
        found = found.union(front)
    return found


def disjoint(members: DataFrame) -> DataFrame:
    """Members without the nodes that are in two or more segments."""
    shared = members.groupBy("node").agg(F.count_distinct("seg").alias("n")).where("n > 1").select("node")
    return members.join(shared, "node", "left_anti")


def by_time(rows: DataFrame, nanos: str, width: int) -> DataFrame:
    """Tumbling segments: t - t % width."""
    return rows.withColumn("seg", F.col(nanos) - F.col(nanos) % width)


def intersected(one: DataFrame, other: DataFrame) -> DataFrame:
    """Segments of two specifications crossed: (seg_a, seg_b, node) for nodes in both."""
    return one.select(F.col("seg").alias("seg_a"), "node").join(other.select(F.col("seg").alias("seg_b"), "node"), "node").select("seg_a", "seg_b", "node")


def segment_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different segments whose members are linked, with the least and greatest time and number."""
    a, b = members.select(F.col("seg").alias("from_seg"), F.col("node").alias("src")), members.select(F.col("seg").alias("to_seg"), F.col("node").alias("dst"))
    linked = edges.join(a, "src").join(b, "dst").where("from_seg <> to_seg")
    return linked.groupBy("from_seg", "to_seg").agg(F.count("*").alias("links"), F.min("nanos").alias("first"), F.max("nanos").alias("last"))


def fixed_size(nodes: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """Segments of up to k nodes in id order inside each group."""
    return nodes.withColumn("seg", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / k))


def segment_features(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, inner edges and density of each segment."""
    nodes = members.groupBy("seg").agg(F.count_distinct("node").alias("nodes"))
    a, b = members.select("seg", F.col("node").alias("src")), members.select("seg", F.col("node").alias("dst"))
    inner = edges.select("src", "dst").distinct().join(a, "src").join(b, ["seg", "dst"]).groupBy("seg").agg(F.count("*").alias("edges"))
    joined = nodes.join(inner, "seg", "left").na.fill(0)
    return joined.withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0)))


def reads_after_writes(writes: DataFrame, reads: DataFrame, width: int) -> DataFrame:
    """(writer, reader, object), once each, where someone else read an object at most ``width`` after a write. ``writes`` are (writer, object, at), ``reads``
    (reader, object, nanos).

    A time bucket in the join key keeps the range join from meeting all pairs of an object. Only a writer's last write before a read meets the reader's first
    read after it, so one who wrote or read an object once is in one pair at most: these pairs, most by far, go out as they are joined, and only pairs of
    a writer and a reader who both came back to the object are made distinct.
    """
    own = lambda who: Window.partitionBy("object", who)
    w = writes.withColumns({"next": F.lead("at").over(own("writer").orderBy("at")), "writes": F.count("*").over(own("writer"))})
    r = reads.withColumns({"last": F.lag("nanos").over(own("reader").orderBy("nanos")), "reads": F.count("*").over(own("reader"))})
    w = w.withColumn("b", F.explode(F.array(F.expr(f"at div {width}"), F.expr(f"at div {width} + 1"))))
    r = r.withColumn("b", F.expr(f"nanos div {width}"))

    def met(some: str, others: str) -> DataFrame:
        pairs = w.where(some).join(r.where(others), ["object", "b"])
        near = pairs.where(f"nanos > at and nanos - at <= {width} and writer <> reader and (next is null or next >= nanos) and (last is null or last <= at)")
        return near.select("writer", "reader", "object")

    return met("writes = 1", "true").union(met("writes > 1", "reads = 1")).union(met("writes > 1", "reads > 1").distinct())


# Grammar over labelled paths. A pattern is a frame of matches (path, first, last) of a table of steps (path, pos, label).


def terminal(steps: DataFrame, label: str) -> DataFrame:
    return steps.where(F.col("label") == label).select("path", F.array("pos").alias("at"))


def sequence(*parts: DataFrame) -> DataFrame:
    """Matches of the parts one after the other, with gaps between."""

    def then(one: DataFrame, two: DataFrame) -> DataFrame:
        right = two.select("path", F.col("at").alias("_at"))
        return one.join(right, "path").where(F.coalesce(F.try_element_at("_at", F.lit(1)) > F.try_element_at("at", F.lit(-1)), F.lit(True))).select("path", F.concat("at", "_at").alias("at"))

    return reduce(then, parts)


def choice(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts).distinct()


def optional_sequence(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first alone, or followed by the second."""
    return first.union(sequence(first, second)).distinct()


def one_or_more(part: DataFrame, most: int | None = None) -> DataFrame:
    """Matches of the part in a row, one or more; rounds go on until none can be put behind another, or to ``most`` in a row."""
    last = checkpoint(part)
    found, first = last, last
    for n in count(2):
        if most is not None and n > most:
            break
        last = checkpoint(sequence(last, first))
        if last.isEmpty():
            break
        found = found.union(last)
    return found.distinct()


def nothing(steps: DataFrame) -> DataFrame:
    """The empty match of every path."""
    return steps.select("path").distinct().withColumn("at", F.array().cast(dict(terminal(steps, "").dtypes)["at"]))


def optional(steps: DataFrame, part: DataFrame) -> DataFrame:
    """The part, or nothing."""
    return part.union(nothing(steps)).distinct()


def zero_or_more(steps: DataFrame, part: DataFrame, most: int | None = None) -> DataFrame:
    return one_or_more(part, most).union(nothing(steps)).distinct()


def forward_states(nodes: DataFrame, edges: DataFrame, pattern: list[str], most: int | None = None) -> DataFrame:
    """How far along a pattern of labels the best path into each node of a DAG has come: levels of joins, the maximum over parents.

    A node's own label takes the next step of the pattern if it matches; else the state is its best parent's.
    Rounds go on until no state changes, and are written to the checkpoint folder; if ``most`` rounds aren't enough, RuntimeError.
    """
    wanted = F.array(*map(F.lit, pattern))

    def advance(state: Column) -> Column:
        return state + F.when(F.get(wanted, state.cast("int")) == F.col("label"), 1).otherwise(0)

    state = nodes.select("id", "label", F.lit(0).alias("in_state")).withColumn("state", advance(F.col("in_state")))
    state = checkpoint(state)
    for done in count():
        if done == most:
            raise RuntimeError(f"states still change after {most} rounds")
        up = edges.join(state.select(F.col("id").alias("src"), F.col("state").alias("s")), "src").groupBy(F.col("dst").alias("id")).agg(F.max("s").alias("s"))
        state = state.select("id", "label", F.col("state").alias("old")).join(up, "id", "left").withColumn("in_state", F.coalesce("s", F.lit(0))).withColumn("state", advance(F.col("in_state")))
        state = checkpoint(state.select("id", "label", "old", "state"))
        if state.where("state <> old").isEmpty():
            return state.select("id", "state")


def paths_through(edges: DataFrame, node: str, most: int | None = None) -> DataFrame:
    """All source-to-sink paths through a node: predecessor paths and successor paths, put together. Rounds go on until no path
    grows, and are written to the checkpoint folder; if ``most`` rounds aren't enough, RuntimeError."""
    steps = checkpoint(edges.select("src", "dst").distinct())

    def grow(here: str, there: str) -> DataFrame:
        done = None
        walked = edges.sparkSession.createDataFrame([(node, [node])], "at string, path array<string>")
        e = steps.select(F.col(here).alias("_h"), F.col(there).alias("_t"))
        for n in count():
            if n == most:
                raise RuntimeError(f"paths still grow after {most} rounds")
            ends = walked.join(e, F.col("at") == F.col("_h"), "left_anti")
            done = ends if done is None else done.union(ends)
            step = walked.join(e, F.col("at") == F.col("_h")).where(~F.array_contains("path", F.col("_t")))
            walked = checkpoint(step.select(F.col("_t").alias("at"), F.concat("path", F.array("_t")).alias("path")))
            if walked.isEmpty():
                return done

    back = grow("dst", "src").select(F.reverse("path").alias("before"))
    ahead = grow("src", "dst").select(F.expr("slice(path, 2, size(path))").alias("after"))
    return back.join(ahead, F.lit(True)).select(F.concat("before", "after").alias("path"))


def top_without_better_parent(scores: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k best nodes that have no parent of at least their score; ties by id."""
    parent = edges.join(scores.select(F.col("id").alias("src"), F.col("score").alias("p")), "src").select(F.col("dst").alias("id"), "p")
    beaten = scores.join(parent, "id").where("p >= score").select("id").distinct()
    return scores.join(beaten, "id", "left_anti").orderBy(F.desc("score"), "id").limit(k)
