"""Policy queries over the graph, and integrity invariants."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .graph import Graph


def allowed_principals(flows: DataFrame, events: DataFrame, owners: DataFrame, allowed: Column) -> DataFrame:
    """Flows with, for each, the principals behind its events and whether all are allowed: flow, event, subject, principal by joins."""
    joined = flows.join(events, "flow").join(owners, "subject")
    return joined.groupBy("flow").agg(F.count_distinct("principal").alias("principals"), F.min(allowed.cast("int")).alias("ok"))


def other_flows_outside(flow: Column, events: DataFrame, inside: Column) -> DataFrame:
    """Subjects of a flow and their other flows that are outside a range."""
    subjects = events.where(flow).select("subject").distinct()
    return events.where(~flow).join(subjects, "subject").where(~inside).select("subject", "flow").distinct()


def writes_near(writes: DataFrame, tags: DataFrame, width: int) -> DataFrame:
    """Writes with a tagged event of the same subject within ``width`` nanoseconds before: a bucket in the key bounds the range join."""
    bucket = F.expr(f"nanos div {width}")
    w = writes.select(F.col("event_id").alias("write"), "subject", F.col("nanos").alias("at"), F.explode(F.array(bucket, bucket - 1)).alias("b"))
    t = tags.select(F.col("event_id").alias("tag"), "subject", "nanos", bucket.alias("b"))
    return w.join(t, ["subject", "b"]).where(f"at >= nanos and at - nanos <= {width}").groupBy("write").agg(F.max("nanos").alias("tagged"))


def tag_chain(writes: DataFrame, tags: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(write, steps, kinds): what the provenance tags of each write lead back to: how many tags are behind it, and the sorted kinds of the objects that those name.

    ``writes``: (write, tag), a row a tag, the tag null where there is none; ``tags``: (tag, prev, object), each with the tag before it or null; ``sources``: (object, kind).
    A write without tags, or whose tags name no known object, has no kinds: there isn't enough to judge it by. Chains are followed to their end in rounds that
    are written to the checkpoint folder; a tag counts once a write, so a cycle ends as well.
    """
    front = checkpoint(writes.where("tag is not null").select("write", "tag").distinct())
    found = front
    for n in count():
        if n == most:
            raise RuntimeError(f"tags still lead on after {most} rounds")
        step = front.join(tags.where("prev is not null").select("tag", "prev"), "tag").select("write", F.col("prev").alias("tag")).distinct()
        front = checkpoint(step.join(found, ["write", "tag"], "left_anti"))
        if front.isEmpty():
            break
        found = checkpoint(found.union(front))
    named = found.join(tags.select("tag", "object"), "tag").join(sources, "object", "left")
    known = named.groupBy("write").agg(F.count_distinct("tag").alias("steps"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return writes.select("write").distinct().join(known, "write", "left").select("write", F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def backward_reach(events: DataFrame, target: str, stop: Column, most: int | None = None) -> DataFrame:
    """(node, latest): what could have flowed into the target, no later than it was passed on.

    From (target, end of time) backwards along edges (src, dst, nanos) that are not later than the bound of their dst; each node
    keeps its latest bound, and nodes that ``stop`` holds for are not passed. Each round joins the nodes whose bound has
    grown, and is written to the checkpoint folder; rounds go on until none grows. If ``most`` rounds aren't enough, RuntimeError.
    """
    spark = events.sparkSession
    front = spark.createDataFrame([(target, 2**62)], "node string, latest long")
    found = front
    for n in count():
        if n == most:
            raise RuntimeError(f"bounds still grow after {most} rounds")
        ahead = front.where(~stop)
        step = events.join(ahead, F.col("dst") == F.col("node")).where("nanos <= latest").groupBy(F.col("src").alias("node")).agg(F.max("nanos").alias("latest"))
        known = found.select("node", F.col("latest").alias("old"))
        front = checkpoint(step.join(known, "node", "left").where("old is null or latest > old").select("node", "latest"))
        if front.isEmpty():
            return found
        found = checkpoint(found.union(front).groupBy("node").agg(F.max("latest").alias("latest")))


def violations(graph: Graph) -> DataFrame:
    """(rule, id) of elements that break an invariant of the graph."""
    v, e = graph.vertices, graph.edges

    def without(label: str, edge: str, rule: str) -> DataFrame:
        some = e.where(F.col("label") == edge).select(F.col("src").alias("id")).distinct()
        return v.where(F.col("label") == label).select("id").join(some, "id", "left_anti").select(F.lit(rule).alias("rule"), "id")

    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    kinds = e.where("label = 'predicateObject'").select(F.col("dst").alias("id")).distinct().join(v.select("id", "label"), "id")
    rules = [
        v.groupBy("uuid").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate uuid").alias("rule"), F.col("uuid").alias("id")),
        ends.join(v.select("id"), "id", "left_anti").select(F.lit("dangling edge").alias("rule"), "id"),
        without("AdmEvent", "subject", "event without subject").join(v.where("eventType = 'EVENT_ADD_OBJECT_ATTRIBUTE'").select("id"), "id", "left_anti").select("rule", "id"),
        without("AdmEvent", "predicateObject", "event without object"),
        without("AdmSubject", "parentSubject", "subject without parent"),
        without("AdmSubject", "localPrincipal", "subject without principal"),
        kinds.where("label <> 'AdmFileObject'").select(F.lit("object of wrong kind").alias("rule"), "id"),
        v.where("label = 'AdmEvent' and eventType in ('EVENT_READ', 'EVENT_WRITE') and value is null").select(F.lit("size missing").alias("rule"), "id"),
        v.where("label = 'AdmEvent' and (earliestTimestampNanos is null or earliestTimestampNanos > latestTimestampNanos)").select(F.lit("bad time").alias("rule"), "id"),
    ]
    parents = e.where("label = 'parentSubject'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"))
    units = e.where("label = 'unitDependency'").select("id", "src", "dst")
    of = lambda end: parents.select(F.col("id").alias(end), F.col("parent").alias(f"_{end}"))
    units = units.join(of("src"), "src", "left").join(of("dst"), "dst", "left").where(~F.coalesce(F.col("_src") == F.col("_dst"), F.lit(False)))
    second = e.where("label = 'predicateObject2'").select(F.col("src").alias("id"))
    flows = v.where("label = 'AdmEvent' and eventType = 'EVENT_ADD_OBJECT_ATTRIBUTE'").select("id").join(second, "id", "left_anti")
    events = v.where("label = 'AdmEvent'").agg(F.count_if(F.coalesce(F.col("eventType") != "EVENT_OTHER", F.lit(False))).alias("known"), F.count("*").alias("n"))
    rules += [
        units.select(F.lit("units of different parents").alias("rule"), "id"), flows.select(F.lit("attribute without a second object").alias("rule"), "id"),
        events.where("n > 0 and known = 0").select(F.lit("no event but EVENT_OTHER").alias("rule"), F.lit("graph").alias("id")),
    ]
    return reduce(DataFrame.union, rules)
