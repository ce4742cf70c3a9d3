"""Entity resolution and scalar functions on the tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import resolve
from ..operators.graph import event_frame, kind_of
from ..session import table
from ..sources import versions
from .registry import query
from .sql import EV


def seq_events(spark, sf_dir) -> DataFrame:
    return event_frame(spark, sf_dir).withColumns({"kind": kind_of(F.col("event_type")), "host": F.col("subject") % 10})


_RUNS = EV + """, l AS (SELECT *, subject % 10 AS host, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind OR nanos - lag(nanos) OVER w > 36000000000000 OR event_id - lag(event_id) OVER w > 60 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY subject % 10 ORDER BY event_id)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY event_id) AS run FROM l), p AS (SELECT *, (row_number() OVER (PARTITION BY host, run ORDER BY event_id) - 1) // 2 AS part FROM r)"""


def _collapse(name: str, compat: bool) -> None:
    sql = f"WITH {_RUNS} SELECT host, kind, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS merged, min(nanos) AS earliest, {'min' if compat else 'max'}(nanos) AS latest FROM p GROUP BY host, kind, run, part"
    query(name, sql)(lambda spark, sf_dir: resolve.collapse_events(seq_events(spark, sf_dir), ["host"], "kind", "event_id", "nanos", 36_000_000_000_000, 60, 2, compat))


_collapse("event_collapse", False)
_collapse("event_collapse_compat", True)


@query("uuid_remap", f"WITH RECURSIVE {EV}, su AS (SELECT DISTINCT subject AS id FROM ev WHERE subject > 1), up(id, a_) AS (SELECT id, id // 2 FROM su UNION ALL SELECT id, a_ // 2 FROM up WHERE a_ > 1) SELECT id, min(a_) AS root FROM up GROUP BY id")
def uuid_remap(spark, sf_dir):
    ids = event_frame(spark, sf_dir).select(F.col("subject").alias("id")).distinct().where("id > 1")
    return resolve.remap_roots(ids.withColumn("into", F.expr("id div 2")))


_ORDERS = "n AS (SELECT c_custkey AS id, c_custkey AS seq FROM customer WHERE c_custkey % 3 <> 0), e AS (SELECT o_orderkey AS src, o_custkey AS dst, o_orderkey AS seq FROM orders), m AS (SELECT c_custkey AS id, c_custkey // 5 * 5 + 1 AS into_ FROM customer WHERE c_custkey % 5 = 2)"


def _remapped(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nodes = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"))
    nodes = nodes.union(o.select("o_orderkey", "o_orderkey").where("false"))
    roots = c.where("c_custkey % 5 = 2").select(F.col("c_custkey").alias("id"), F.expr("c_custkey div 5 * 5 + 1").alias("root"))
    edges = o.select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return edges, roots, nodes


@query("edge_remap", f"WITH {_ORDERS} SELECT DISTINCT 'o' || src AS src, CAST(coalesce(into_, dst) AS VARCHAR) AS dst FROM e LEFT JOIN m ON m.id = e.dst")
def edge_remap(spark, sf_dir):
    edges, roots, nodes = _remapped(spark, sf_dir)
    as_text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return resolve.remap_edges(as_text(edges), as_text(roots), as_text(nodes))[0]


@query("synthesized_nodes", f"WITH {_ORDERS} SELECT id FROM (SELECT DISTINCT CAST(coalesce(into_, dst) AS VARCHAR) AS id FROM e LEFT JOIN m ON m.id = e.dst UNION SELECT 'o' || src FROM e) WHERE id NOT IN (SELECT CAST(id AS VARCHAR) FROM n)")
def synthesized_nodes(spark, sf_dir):
    edges, roots, nodes = _remapped(spark, sf_dir)
    as_text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return resolve.remap_edges(as_text(edges), as_text(roots), as_text(nodes))[1]


@query("dedup_first_wins", f"WITH {EV} SELECT subject, object, min(event_id) AS event_id FROM ev WHERE object IS NOT NULL GROUP BY 1, 2")
def dedup_first_wins(spark, sf_dir):
    return resolve.first_wins(event_frame(spark, sf_dir).where("object is not null").select("subject", "object", "event_id"), ["subject", "object"], "event_id")


@query("edges_after_ends", f"WITH {EV}, n AS (SELECT subject, min(event_id) AS at FROM ev WHERE kind = 'EVENT_READ' GROUP BY 1), k AS (SELECT object, min(event_id) AS at FROM ev WHERE kind = 'EVENT_WRITE' GROUP BY 1) SELECT event_id AS seq, greatest(event_id, n.at, k.at) AS ready FROM ev JOIN n USING (subject) JOIN k USING (object)")
def edges_after_ends(spark, sf_dir):
    ev = event_frame(spark, sf_dir)
    u, k = F.concat(F.lit("u"), "subject"), F.concat(F.lit("k"), "object")
    nodes = ev.where("event_type = 'click'").select(u.alias("id"), F.col("event_id").alias("seq")).union(ev.where("event_type = 'purchase' and object is not null").select(k, "event_id"))
    edges = ev.where("object is not null").select(u.alias("src"), k.alias("dst"), F.col("event_id").alias("seq"))
    return resolve.edges_after_ends(nodes, edges).select("seq", "ready")


@query("conflicting_uuids", f"WITH {EV}, f AS (SELECT *, first_value(event_type) OVER (PARTITION BY subject, object ORDER BY event_id) AS ft FROM ev WHERE object IS NOT NULL) SELECT event_id FROM f WHERE ft <> event_type")
def conflicting_uuids(spark, sf_dir):
    ev = event_frame(spark, sf_dir).where("object is not null").withColumn("key", F.concat_ws("-", "subject", "object"))
    return resolve.conflicting(ev, "key", "event_id", ["event_type"]).select("event_id")


@query("monotone_clock", f"WITH {EV} SELECT event_id, max(nanos) OVER (PARTITION BY subject % 10 ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clock FROM ev")
def monotone_clock(spark, sf_dir):
    ev = seq_events(spark, sf_dir).withColumn("s", F.struct("value", "event_id"))
    return resolve.running_clock(ev, "host", "s", "nanos").select("event_id", "clock")


@query("guarded_clock", f"""WITH RECURSIVE {EV}, r AS (SELECT subject % 10 AS host, event_id, nanos, row_number() OVER (PARTITION BY subject % 10 ORDER BY event_id) AS n FROM ev),
 g(host, event_id, n, clock) AS (SELECT host, event_id, n, greatest(nanos, 0) FROM r WHERE n = 1
 UNION ALL SELECT r.host, r.event_id, r.n, CASE WHEN nanos > clock AND (clock < 1400000000000000000 OR nanos - clock <= 14400000000000) THEN nanos ELSE clock END FROM g JOIN r ON r.host = g.host AND r.n = g.n + 1)
 SELECT host, event_id, clock FROM g""")
def guarded_clock(spark, sf_dir):
    """The clock of each host, that no jump of over four hours moves once it is past the year 2014."""
    return resolve.guarded_clock(seq_events(spark, sf_dir), "host", "event_id", "nanos", 14_400_000_000_000)


@query("upconvert_versions", f"WITH {EV} SELECT event_id, kind, CASE WHEN event_id % 4 IN (2, 3) THEN 'h' || (subject % 10) ELSE '0' END AS host_id, CASE event_id % 4 WHEN 3 THEN value END AS size, CAST(17 + event_id % 4 AS INT) AS from_version FROM ev")
def upconvert_versions(spark, sf_dir):
    ev = seq_events(spark, sf_dir)
    v = {i: ev.where(f"event_id % 4 = {i}") for i in range(4)}
    frames = {
        17: v[0].select(F.col("event_id").alias("id"), F.col("kind").alias("type")), 18: v[1].select(F.col("event_id").alias("id"), "kind"),
        19: v[2].select("event_id", "kind", F.concat(F.lit("h"), "host").alias("host_id")), 20: v[3].select("event_id", "kind", F.concat(F.lit("h"), "host").alias("host_id"), F.col("value").alias("size")),
    }
    return resolve.upconvert(frames, {18: {"type": "kind"}, 19: {"id": "event_id"}}, {"host_id": F.lit("0")}, ["event_id", "kind", "host_id", "size"])


@query("upconvert_records", f"""SELECT 's' || s_suppkey AS uuid, CASE WHEN v < 19 THEN '{versions.NO_HOST}' ELSE 'n' || s_nationkey END AS host, '10.0.0.' || s_nationkey AS localAddress, 80 AS localPort,
 CASE WHEN v = 20 THEN CAST(s_suppkey AS BIGINT) END AS initTcpSeqNum, CAST(v AS INT) AS from_version FROM (SELECT *, 17 + s_suppkey % 4 AS v FROM supplier)""")
def upconvert_records(spark, sf_dir):
    """Suppliers as network flows written by four schema versions."""
    flows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("s"), "s_suppkey").alias("uuid"), F.concat(F.lit("n"), "s_nationkey").alias("host"), F.concat(F.lit("10.0.0."), "s_nationkey").alias("localAddress"),
        F.lit(80).alias("localPort"), F.col("s_suppkey").alias("initTcpSeqNum"),
    )
    lacks = {17: ("host", "initTcpSeqNum"), 18: ("host", "initTcpSeqNum"), 19: ("initTcpSeqNum",), 20: ()}
    frames = {v: flows.where(F.col("s_suppkey") % 4 == v - 17).drop("s_suppkey", *lacks[v]) for v in lacks}
    return versions.to_newest(frames, "NetFlowObject").select("uuid", "host", "localAddress", "localPort", "initTcpSeqNum", "from_version")


_SPEC = {"and": [{"or": [{"hasLabel": "EVENT_WRITE"}, {"hasLabel": "EVENT_READ"}]}, {"not": {"hasProperty": {"key": "object", "value": 5}}}, {"hasEdge": "subject"}]}


@query("record_filter", f"WITH {EV} SELECT event_id FROM ev WHERE kind IN ('EVENT_WRITE', 'EVENT_READ') AND coalesce(object, 0) <> 5")
def record_filter(spark, sf_dir):
    ev = seq_events(spark, sf_dir).withColumnRenamed("kind", "label").withColumn("edge_labels", F.array(F.lit("subject")))
    return ev.where(resolve.record_filter(_SPEC)).select("event_id")


@query("record_filter_compat", f"WITH {EV} SELECT event_id FROM ev WHERE kind IN ('EVENT_WRITE', 'EVENT_READ') AND coalesce(object, 0) <> 5")
def record_filter_compat(spark, sf_dir):
    swapped = {"or": [{"and": _SPEC["and"][0]["or"]}, *_SPEC["and"][1:]]}
    ev = seq_events(spark, sf_dir).withColumnRenamed("kind", "label").withColumn("edge_labels", F.array(F.lit("subject")))
    return ev.where(resolve.record_filter(swapped, compat=True)).select("event_id")


@query("suffix_fold", "WITH s AS (SELECT DISTINCT p_size AS k, p_type AS t FROM part UNION SELECT DISTINCT p_size, regexp_extract(p_type, '[^ ]*$') FROM part) SELECT a.k, a.t FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND b.t <> a.t AND ends_with(b.t, a.t))")
def suffix_fold(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_size").alias("k"), F.col("p_type").alias("t")).union(part.select("p_size", F.regexp_extract("p_type", "[^ ]*$", 0)))
    return resolve.suffix_fold(rows, "k", "t")


_U3 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS BIGINT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("name_uuids", f"WITH x AS (SELECT p_partkey, md5('/' || p_brand || '/' || p_name) AS h FROM part) SELECT p_partkey, {_U3} AS uuid, 'cdm_ta_' || {_U3} AS raw, {_U3} AS plain FROM x")
def name_uuids(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    u = fn.name_uuid(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_name"))
    return part.select("p_partkey", u.alias("uuid"), fn.rendered(F.lit("ta"), u, True).alias("raw"), fn.rendered(F.lit(""), u).alias("plain"))


@query("rendered_round_trip", f"WITH x AS (SELECT p_partkey, md5(p_name) AS h FROM part) SELECT p_partkey, 'ns' || (p_partkey % 3) AS namespace, {_U3} AS uuid FROM x")
def rendered_round_trip(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    back = fn.from_rendered(fn.rendered(F.concat(F.lit("ns"), F.col("p_partkey") % 3), fn.name_uuid(F.col("p_name")), True))
    return part.select("p_partkey", back.alias("b")).select("p_partkey", "b.namespace", "b.uuid")


@query("flow_identity", f"WITH f AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey % 50), x AS (SELECT a, b, md5('10.0.0.' || a || ':' || '80' || '10.0.1.' || b || ':' || 'None') AS h FROM f) SELECT a, b, {_U3} AS uuid FROM x")
def flow_identity(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    flows = c.join(s, F.col("c_custkey") % 50 == F.col("s_suppkey") % 50).select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()
    return flows.withColumn("uuid", fn.name_uuid(F.concat(F.lit("10.0.0."), "a", F.lit(":80"), F.lit("10.0.1."), "b", F.lit(":None"))))


@query("time_units", f"WITH {EV}, t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN nanos WHEN 1 THEN nanos // 1000 WHEN 2 THEN nanos // 1000000 ELSE nanos // 1000000000 END AS t FROM ev) SELECT event_id, CASE WHEN t BETWEEN 1000000000 AND 9999999999 THEN t * 1000000000 WHEN t BETWEEN 1000000000000 AND 9999999999999 THEN t * 1000000 WHEN t BETWEEN 1000000000000000 AND 9999999999999999 THEN t * 1000 ELSE t END AS nanos FROM t")
def time_units(spark, sf_dir):
    ev = event_frame(spark, sf_dir)
    t = F.expr("CASE event_id % 4 WHEN 0 THEN nanos WHEN 1 THEN nanos div 1000 WHEN 2 THEN nanos div 1000000 ELSE nanos div 1000000000 END")
    return ev.select("event_id", fn.nanos_of(t).alias("nanos"))


@query("normalized_paths", "SELECT p_partkey, '/' || p_brand || '/' || replace(p_name, ' ', '_') AS path, '\\windows\\' || lower(p_brand) AS windows FROM part")
def normalized_paths(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    raw = F.concat(F.lit(" /"), "p_brand", F.lit("/./"), F.lit("x/../"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(" --x /y"))
    win = F.concat(F.lit('"C:\\Temp\\..\\%SystemRoot%\\'), "p_brand", F.lit('" -v'))
    return part.select("p_partkey", fn.normalized_path(raw).alias("path"), fn.normalized_path(win, True).alias("windows"))


@query("cidr_members", "SELECT c_custkey, (c_custkey % 256) BETWEEN 64 AND 127 AS inside FROM customer")
def cidr_members(spark, sf_dir):
    ip = F.concat(F.lit("10.1.2."), F.col("c_custkey") % 256)
    return table(spark, sf_dir, "customer").select("c_custkey", fn.in_cidr(ip, "10.1.2.64/26").alias("inside"))


@query("ip_numbers", "SELECT c_custkey, CASE WHEN c_custkey % 300 < 256 THEN ((10 * 256 + 1) * 256 + 2) * 256 + c_custkey % 300 END AS number FROM customer")
def ip_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fn.ipv4_number(F.concat(F.lit("10.1.2."), F.col("c_custkey") % 300)).alias("number"))


@query("keyword_matches", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'economy') OR contains(lower(p_type), 'small')")
def keyword_matches(spark, sf_dir):
    return table(spark, sf_dir, "part").where(fn.keyword_match(F.col("p_type"), ["ECONOMY", "small"])).select("p_partkey")


@query("night_events", f"WITH {EV} SELECT event_id FROM ev WHERE (nanos // 1000000000) // 3600 % 24 >= 20 OR (nanos // 1000000000) // 3600 % 24 < 6")
def night_events(spark, sf_dir):
    return event_frame(spark, sf_dir).where(fn.at_night(F.expr("nanos div 1000000000"), 0)).select("event_id")


@query("day_events", f"WITH {EV}, d AS (SELECT min(nanos) // 1000000000 AS d FROM ev) SELECT event_id FROM ev, d WHERE abs(nanos // 1000000000 - d) <= 86400")
def day_events(spark, sf_dir):
    ev = event_frame(spark, sf_dir)
    day = ev.agg(F.min(F.expr("nanos div 1000000000"))).head()[0]
    return ev.where(fn.in_day(F.expr("nanos div 1000000000"), day)).select("event_id")


@query("attack_uuids", f"WITH {EV}, su AS (SELECT DISTINCT subject AS s FROM ev), x AS (SELECT s, md5('u' || s) AS h FROM su), t AS (SELECT s, {_U3} AS uuid FROM x), r AS (SELECT t.s, t.uuid, coalesce(p.uuid, t.uuid) AS resolved FROM t LEFT JOIN t p ON p.s = t.s // 2 AND t.s > 0) SELECT 'line ' || s AS line, resolved AS uuid FROM r UNION SELECT 'line ' || (s + 1), resolved FROM r WHERE s + 1 IN (SELECT s FROM su)")
def attack_uuids(spark, sf_dir):
    """Uuids in the lines of a report, each line naming two, as they are after resolution."""
    ids = event_frame(spark, sf_dir).select("subject").distinct().withColumn("uuid", fn.name_uuid(F.concat(F.lit("u"), "subject")))
    before = ids.select((F.col("subject") + 1).alias("subject"), F.col("uuid").alias("last"))
    lines = ids.join(before, "subject", "left").select(F.concat(F.lit("line "), "subject").alias("line"), F.concat_ws(",", F.lit("attack"), "uuid", F.upper("last")).alias("text"))
    parents = ids.select(F.col("subject").alias("up"), F.col("uuid").alias("root"))
    merges = ids.where("subject > 0").withColumn("up", F.expr("subject div 2")).join(parents, "up").select(F.col("uuid").alias("id"), "root")
    return resolve.text_uuids(lines, "line", "text", merges)


@query("weekend_events", f"WITH {EV} SELECT event_id FROM ev WHERE isodow(make_timestamp(nanos // 1000)) >= 6")
def weekend_events(spark, sf_dir):
    return event_frame(spark, sf_dir).where(fn.at_weekend(F.expr("nanos div 1000000000"))).select("event_id")
