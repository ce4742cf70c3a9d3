"""The property graph: vertex and edge frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: What an event of the driver's table stands for; fixed values.
EVENT_KINDS = {"click": "EVENT_READ", "view": "EVENT_EXECUTE", "purchase": "EVENT_WRITE", "signup": "EVENT_FORK", "error": "EVENT_UNLINK"}
#: Microseconds of a time stamp without zone, whatever the session's zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
#: Properties of vertices in key order.
PROPERTIES = ("uuid", "namespace", "eventType", "cid", "earliestTimestampNanos", "latestTimestampNanos", "path", "username", "hostName", "value")


@dataclass(frozen=True)
class Graph:
    """``vertices``: id, label and a column a property, null where absent; ``edges``: id, src, label, dst."""

    vertices: DataFrame
    edges: DataFrame


def kind_of(event_type: F.Column) -> F.Column:
    return F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])[event_type]


def event_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as provenance: nanos, subject, kind and object; (nanos, event_id) is a total order."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.expr(MICROS) * 1000).alias("nanos"),
        F.col("user_id").alias("subject"),
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("object"),
        "value",
    )


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Vertices e<event>, u<user>, k<object>, c<customer>, n<nation>; edges subject, predicateObject, parentSubject, localPrincipal, host."""
    events = event_frame(spark, sf_dir)
    subjects = events.select("subject").distinct()
    customers = table(spark, sf_dir, "customer").join(subjects, F.col("c_custkey") == F.col("subject"), "left_semi")
    nations = table(spark, sf_dir, "nation")
    types = {"cid": "long", "earliestTimestampNanos": "long", "latestTimestampNanos": "long", "value": "double"}

    def vertices(df: DataFrame, ident: F.Column, label: str, **props: F.Column) -> DataFrame:
        columns = [props.get(p, F.lit(None)).cast(types.get(p, "string")).alias(p) for p in PROPERTIES if p != "uuid"]
        return df.select(ident.alias("id"), F.lit(label).alias("label"), ident.alias("uuid"), *columns)

    def edges(df: DataFrame, src: F.Column, label: str, dst: F.Column) -> DataFrame:
        return df.select(F.concat_ws("|", src, F.lit(label), dst).alias("id"), src.alias("src"), F.lit(label).alias("label"), dst.alias("dst"))

    e, u, k = (F.concat(F.lit(p), F.col(c)) for p, c in (("e", "event_id"), ("u", "subject"), ("k", "object")))
    v = (
        vertices(events, e, "AdmEvent", eventType=kind_of(F.col("event_type")), earliestTimestampNanos=F.col("nanos"), latestTimestampNanos=F.col("nanos"), value=F.col("value"))
        .union(vertices(subjects, u, "AdmSubject", cid=F.col("subject")))
        .union(vertices(events.select("object").where("object is not null").distinct(), k, "AdmFileObject", path=F.concat(F.lit("/k/"), F.col("object"))))
        .union(vertices(customers, F.concat(F.lit("c"), F.col("c_custkey")), "AdmPrincipal", username=F.col("c_name")))
        .union(vertices(nations, F.concat(F.lit("n"), F.col("n_nationkey")), "AdmHost", hostName=F.col("n_name")))
    )
    parent = F.concat(F.lit("u"), F.expr("subject div 2"))
    c = F.concat(F.lit("c"), F.col("c_custkey"))
    all_edges = (
        edges(events, e, "subject", u)
        .union(edges(events.where("object is not null"), e, "predicateObject", k))
        .union(edges(subjects.where("subject > 0"), u, "parentSubject", parent))
        .union(edges(customers, F.concat(F.lit("u"), F.col("c_custkey")), "localPrincipal", c))
        .union(edges(customers, c, "host", F.concat(F.lit("n"), F.col("c_nationkey"))))
    )
    return Graph(v, all_edges)
