"""Policies, invariants, statistics and reports on the tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import measures, policy, reports
from ..operators.detectors import top_share
from ..operators.graph import event_frame, event_graph, kind_of
from ..session import checkpoint, table
from .registry import query
from .sql import EDGES, EV


@query("table_counts", "SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS n_{t}" for t in ("events", "orders", "documents", "labels", "pages")))
def table_counts(spark, sf_dir):
    from functools import reduce

    one = [table(spark, sf_dir, t).agg(F.count("*").alias(f"n_{t}")) for t in ("events", "orders", "documents", "labels", "pages")]
    return reduce(lambda a, b: a.join(b, F.lit(True)), one)


@query("policy_principals", f"WITH {EV} SELECT object AS flow, count(DISTINCT c_custkey) AS principals, min(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS ok FROM ev JOIN customer ON c_custkey = subject WHERE object IS NOT NULL GROUP BY 1")
def policy_principals(spark, sf_dir):
    ev = event_frame(spark, sf_dir).where("object is not null").select(F.col("object").alias("flow"), "subject")
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_custkey").alias("principal"), "c_acctbal")
    return policy.allowed_principals(ev.select("flow").distinct(), ev, owners, F.col("c_acctbal") > 0)


@query("policy_other_flows", f"WITH {EV} SELECT DISTINCT subject, object AS flow FROM ev WHERE object <> 7 AND object >= 64 AND subject IN (SELECT subject FROM ev WHERE object = 7)")
def policy_other_flows(spark, sf_dir):
    from ..functions.scalar import in_cidr

    ev = event_frame(spark, sf_dir).where("object is not null").select("subject", F.col("object").alias("flow"))
    inside = in_cidr(F.concat(F.lit("10.0.0."), F.col("flow")), "10.0.0.0/26")
    return policy.other_flows_outside(F.col("flow") == 7, ev, inside)


@query("policy_writes_near", f"WITH {EV} SELECT w.event_id AS write, max(t.nanos) AS tagged FROM ev w JOIN ev t ON t.subject = w.subject AND t.nanos <= w.nanos AND w.nanos - t.nanos <= 3600000000000 WHERE w.kind = 'EVENT_WRITE' AND t.kind = 'EVENT_FORK' GROUP BY 1")
def policy_writes_near(spark, sf_dir):
    ev = event_frame(spark, sf_dir)
    return policy.writes_near(ev.where("event_type = 'purchase'"), ev.where("event_type = 'signup'"), 3_600_000_000_000)


_FLOW = f"""{EV}, fl AS (SELECT CASE WHEN kind IN ('EVENT_WRITE', 'EVENT_UNLINK') THEN 'u' || subject ELSE 'k' || object END AS src, CASE WHEN kind IN ('EVENT_WRITE', 'EVENT_UNLINK') THEN 'k' || object ELSE 'u' || subject END AS dst, nanos FROM ev WHERE object IS NOT NULL)"""


@query("policy_backward_reach", f"WITH RECURSIVE {_FLOW}, b(node, latest) AS (SELECT 'k5', CAST(4611686018427387904 AS BIGINT) UNION SELECT src, nanos FROM b JOIN fl ON dst = node AND nanos <= latest WHERE NOT (starts_with(node, 'k') AND ends_with(node, '0'))) SELECT node, max(latest) AS latest FROM b GROUP BY 1")
def policy_backward_reach(spark, sf_dir):
    ev = event_frame(spark, sf_dir).where("object is not null")
    u, k = F.concat(F.lit("u"), "subject"), F.concat(F.lit("k"), "object")
    out = F.col("event_type").isin("purchase", "error")
    flows = ev.select(F.when(out, u).otherwise(k).alias("src"), F.when(out, k).otherwise(u).alias("dst"), "nanos")
    return policy.backward_reach(flows, "k5", F.col("node").rlike("^k.*0$"))


@query("invariant_violations", f"""WITH RECURSIVE {EDGES}, sb AS (SELECT DISTINCT subject FROM ev) SELECT 'subject without parent' AS rule, 'u' || subject AS id FROM sb WHERE subject = 0
 UNION ALL SELECT 'subject without principal', 'u' || subject FROM sb WHERE subject NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'event without object', 'e' || event_id FROM ev WHERE object IS NULL UNION ALL SELECT 'size missing', 'e' || event_id FROM ev WHERE kind IN ('EVENT_READ', 'EVENT_WRITE') AND value IS NULL
 UNION ALL SELECT DISTINCT 'dangling edge', 'u' || (subject // 2) FROM sb WHERE subject > 0 AND subject // 2 NOT IN (SELECT subject FROM sb)""")
def invariant_violations(spark, sf_dir):
    return policy.violations(event_graph(spark, sf_dir))


@query("label_counts", f"WITH {EV} SELECT event_type, count(*) AS n, min(nanos) AS first, max(nanos) AS last FROM ev WHERE nanos > 0 GROUP BY 1")
def label_counts(spark, sf_dir):
    return event_frame(spark, sf_dir).where("nanos > 0").groupBy("event_type").agg(F.count("*").alias("n"), F.min("nanos").alias("first"), F.max("nanos").alias("last"))


@query("status_shares", f"WITH {EV} SELECT subject % 4 AS shard, round(100.0 * count(*) / (SELECT count(*) FROM ev), 6) AS percent FROM ev GROUP BY 1")
def status_shares(spark, sf_dir):
    counts = event_frame(spark, sf_dir).groupBy((F.col("subject") % 4).alias("shard")).agg(F.count("*").alias("n"))
    return counts.select("shard", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


@query("population_rates", f"WITH {EV} SELECT event_type, event_id // 1000 AS bucket, count(*) AS n FROM ev GROUP BY 1, 2")
def population_rates(spark, sf_dir):
    return measures.population(event_frame(spark, sf_dir), "event_type", "event_id", 1000)


@query("edge_degrees", f"WITH {EDGES} SELECT dst AS id, count(*) AS degree FROM ed WHERE label = 'subject' GROUP BY 1")
def edge_degrees(spark, sf_dir):
    return event_graph(spark, sf_dir).edges.where("label = 'subject'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))


@query("process_times", f"WITH {EV} SELECT subject, min(nanos) AS started, max(nanos) FILTER (kind = 'EVENT_UNLINK') AS ended FROM ev GROUP BY 1")
def process_times(spark, sf_dir):
    return event_frame(spark, sf_dir).groupBy("subject").agg(F.min("nanos").alias("started"), F.max(F.when(F.col("event_type") == "error", F.col("nanos"))).alias("ended"))


@query("process_summary", f"WITH {EV} SELECT subject, count(*) AS events, count(DISTINCT object) FILTER (kind = 'EVENT_EXECUTE') AS execs, count(DISTINCT object) AS files, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, (SELECT count(DISTINCT c.subject) FROM ev c WHERE c.subject // 2 = ev.subject AND c.subject > 0) AS children FROM ev GROUP BY subject")
def process_summary(spark, sf_dir):
    ev = event_frame(spark, sf_dir).withColumn("kind", kind_of(F.col("event_type")))
    kids = ev.where("subject > 0").select(F.expr("subject div 2").alias("parent"), "subject").distinct().groupBy(F.col("parent").alias("subject")).agg(F.count("*").alias("children"))
    own = ev.groupBy("subject").agg(
        F.count("*").alias("events"), F.count_distinct(F.when(F.col("kind") == "EVENT_EXECUTE", F.col("object"))).alias("execs"),
        F.count_distinct("object").alias("files"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
    )
    return own.join(kids, "subject", "left").na.fill(0, ["children"])


@query("view_statistics", f"WITH {EV} SELECT event_type, round(avg(value), 5) AS mean, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 5) AS deviation, min(value) AS least, max(value) AS most FROM ev GROUP BY 1")
def view_statistics(spark, sf_dir):
    found = measures.statistics(event_frame(spark, sf_dir), "event_type", "value")
    return found.select("event_type", F.round("mean", 5).alias("mean"), F.round("variance", 4).alias("variance"), F.round("deviation", 5).alias("deviation"), "least", "most")


@query("view_histogram", f"WITH {EV}, m AS (SELECT min(value) AS lo, max(value) AS hi FROM ev) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM ev, m WHERE value IS NOT NULL GROUP BY 1")
def view_histogram(spark, sf_dir):
    """Ten bins of equal width, the last one closed."""
    return measures.histogram(event_frame(spark, sf_dir), "value")


@query("feature_operations", f"""WITH {EV}, a AS (SELECT subject, min(nanos) FILTER (kind = 'EVENT_READ') AS a, max(nanos) FILTER (kind = 'EVENT_WRITE') AS b, min(nanos) AS t0, max(nanos) AS t1, count(*) AS n, sum(value) AS v FROM ev GROUP BY 1)
 SELECT subject, trunc((b - a) / 1e9)::BIGINT AS sub_time, greatest(0, coalesce(trunc((b - a) / 1e9)::BIGINT, 0)) AS relu_time, round(n / nullif((t1 - t0) / 1e9, 0), 6) AS per_second, round(v / nullif((t1 - t0) / 1e9, 0), 6) AS size_per_second, round((t1 - t0) / 1e9 / n, 4) AS seconds_each FROM a""")
def feature_operations(spark, sf_dir):
    """From a process's first read to its last write, which may be before it, and rates over its whole time."""
    read, write = F.when(F.col("event_type") == "click", F.col("nanos")), F.when(F.col("event_type") == "purchase", F.col("nanos"))
    a = event_frame(spark, sf_dir).groupBy("subject").agg(F.min(read).alias("a"), F.max(write).alias("b"), F.min("nanos").alias("t0"), F.max("nanos").alias("t1"), F.count("*").alias("n"), F.sum("value").alias("v"))
    return a.select(
        "subject", measures.sub_time(F.col("b"), F.col("a")).alias("sub_time"), measures.relu_time(F.col("b"), F.col("a")).alias("relu_time"),
        F.round(measures.per_time(F.col("n"), F.col("t1"), F.col("t0")), 6).alias("per_second"), F.round(measures.per_time(F.col("v"), F.col("t1"), F.col("t0")), 6).alias("size_per_second"),
        F.round(measures.time_per(F.col("t1"), F.col("t0"), F.col("n")), 4).alias("seconds_each"),
    )


@query("time_between", f"WITH {EV}, f AS (SELECT subject, min(nanos) AS at FROM ev WHERE kind = 'EVENT_FORK' GROUP BY 1) SELECT ev.subject, min(nanos - at) AS delay FROM ev JOIN f ON f.subject = ev.subject WHERE kind = 'EVENT_WRITE' AND nanos > at GROUP BY 1".replace(" AS at ", " AS t0 ").replace("nanos - at", "nanos - t0").replace("> at", "> t0"))
def time_between(spark, sf_dir):
    ev = event_frame(spark, sf_dir)
    return measures.time_between(ev, "subject", "nanos", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query("high_score_edges", f"WITH {EV}, sc AS (SELECT subject AS s, count(*) AS score FROM ev GROUP BY 1), m AS (SELECT avg(score) AS m FROM sc) SELECT p.s AS parent, c.s AS child FROM sc c JOIN sc p ON p.s = c.s // 2 AND c.s > 0, m WHERE p.score > m AND c.score > m")
def high_score_edges(spark, sf_dir):
    """Processes and their children that both have more events than the mean."""
    sc = event_frame(spark, sf_dir).groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("score"))
    edges = sc.where("id > 0").select(F.expr("id div 2").alias("src"), F.col("id").alias("dst"))
    return measures.high_edges(edges, sc).select(F.col("src").alias("parent"), F.col("dst").alias("child"))


@query("top_percent", f"WITH {EV}, r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM ev) SELECT event_id FROM r WHERE n <= least(ceil(c * 0.05), 500)")
def top_percent(spark, sf_dir):
    scores = event_frame(spark, sf_dir).select("event_type", F.col("event_id").alias("object"), F.col("value").alias("score"))
    return top_share(scores, ["event_type"], 0.05, 500).select(F.col("object").alias("event_id"))


@query("alarm_time_series", f"WITH {EV}, t AS (SELECT min(nanos) AS t0 FROM ev), b AS (SELECT CAST(round_even((nanos - t0) / 86400e9, 0) AS BIGINT) AS bucket, kind = 'EVENT_UNLINK' AS bad FROM ev, t), n AS (SELECT max(bucket) AS m FROM b) SELECT i AS bucket, count(*) FILTER (bad) AS malicious, count(*) FILTER (NOT bad) AS benign FROM range(0, (SELECT m + 1 FROM n)) r(i) LEFT JOIN b ON b.bucket = i GROUP BY 1")
def alarm_time_series(spark, sf_dir):
    ev = event_frame(spark, sf_dir)
    start, end = ev.agg(F.min("nanos"), F.max("nanos")).head()
    day = 86_400 * 10**9
    buckets = ev.select(F.bround((F.col("nanos") - start) / float(day), 0).cast("long").alias("bucket"), (F.col("event_type") == "error").alias("bad"))
    counts = buckets.groupBy("bucket").agg(F.count_if("bad").alias("malicious"), F.count_if(~F.col("bad")).alias("benign"))
    last = buckets.agg(F.max("bucket")).head()[0]
    return spark.range(last + 1).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)


@query("nearest_in_time", f"WITH {EV}, a AS (SELECT event_id, nanos, nanos // 60000000000 AS m FROM ev WHERE kind = 'EVENT_UNLINK'), r AS (SELECT event_id AS ref, nanos AS t, nanos // 60000000000 AS m FROM ev WHERE kind = 'EVENT_FORK') SELECT a.event_id, coalesce(max_by(t, ref), max(a.nanos)) AS repaired FROM a LEFT JOIN r ON abs(a.m - r.m) < 2 GROUP BY 1")
def nearest_in_time(spark, sf_dir):
    """Deletions take the time of the last fork near them."""
    ev = event_frame(spark, sf_dir)
    return measures.repaired_times(ev.where("event_type = 'error'"), ev.where("event_type = 'signup'"), "event_id", "nanos", "event_id").select("event_id", "repaired")


@query("attack_coverage", f"WITH {EV}, al AS (SELECT event_id, 'attack' || (object % 4) AS attack, kind FROM ev WHERE kind IN ('EVENT_UNLINK', 'EVENT_FORK') AND object IS NOT NULL) SELECT attack, count(*) AS alarms, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM al GROUP BY 1")
def attack_coverage(spark, sf_dir):
    al = event_frame(spark, sf_dir).where("event_type in ('error', 'signup') and object is not null")
    found = measures.coverage(al.select(F.concat(F.lit("attack"), F.col("object") % 4).alias("attack"), kind_of(F.col("event_type")).alias("kind")), "attack", "kind")
    return found.withColumn("kinds", F.array_join("kinds", ","))


@query("threshold_search", f"""WITH {EV}, al AS (SELECT 'attack' || (object % 4) AS attack, value / 100.0 AS p FROM ev WHERE kind = 'EVENT_UNLINK' AND object IS NOT NULL) SELECT round(max(m), 6) AS threshold FROM (SELECT attack, min(p) AS m FROM al GROUP BY 1)""")
def threshold_search(spark, sf_dir):
    """The least threshold on the local probability at which every attack still raises an alarm."""
    al = event_frame(spark, sf_dir).where("event_type = 'error' and object is not null")
    found = measures.least_threshold(al.select(F.concat(F.lit("attack"), F.col("object") % 4).alias("attack"), (F.col("value") / 100.0).alias("p")), "attack", "p")
    return found.select(F.round("threshold", 6).alias("threshold"))


@query("stitched_observations", f"WITH {EV}, nm AS (SELECT c_custkey AS s, c_name FROM customer) SELECT event_id, kind, 'u' || subject AS subject, c_name AS subject_name, 'k' || object AS object, '/k/' || object AS object_path FROM ev LEFT JOIN nm ON s = subject WHERE object IS NOT NULL")
def stitched_observations(spark, sf_dir):
    """(event, subject, object) with path names where they are known: the edge frames joined by label."""
    g = event_graph(spark, sf_dir)
    e, v = g.edges, g.vertices
    sub = e.where("label = 'subject'").select(F.col("src").alias("event"), F.col("dst").alias("subject"))
    obj = e.where("label = 'predicateObject'").select(F.col("src").alias("event"), F.col("dst").alias("object"))
    own = e.where("label = 'localPrincipal'").select(F.col("src").alias("subject"), F.col("dst").alias("principal"))
    names = v.where("label = 'AdmPrincipal'").select(F.col("id").alias("principal"), F.col("username").alias("subject_name"))
    paths = v.where("label = 'AdmFileObject'").select(F.col("id").alias("object"), F.col("path").alias("object_path"))
    kinds = v.where("label = 'AdmEvent'").select(F.col("id").alias("event"), F.col("eventType").alias("kind"))
    return (
        kinds.join(sub, "event").join(obj, "event").join(own.join(names, "principal"), "subject", "left").join(paths, "object", "left")
        .select(F.expr("cast(substring(event, 2) as bigint)").alias("event_id"), "kind", "subject", "subject_name", "object", "object_path")
    )


@query("parent_child_pseudo_events", f"WITH {EV}, st AS (SELECT subject AS s, min(nanos) AS t0 FROM ev GROUP BY 1) SELECT 'PSEUDO_EVENT_PARENT_SUBJECT' AS kind, p.s AS parent, c.s AS child, p.t0 AS earliest, c.t0 AS latest FROM st c JOIN st p ON p.s = c.s // 2 AND c.s > 0")
def parent_child_pseudo_events(spark, sf_dir):
    st = event_frame(spark, sf_dir).groupBy("subject").agg(F.min("nanos").alias("t0"))
    child = st.where("subject > 0").select(F.col("subject").alias("child"), F.col("t0").alias("latest"), F.expr("subject div 2").alias("parent"))
    return child.join(st.select(F.col("subject").alias("parent"), F.col("t0").alias("earliest")), "parent").select(F.lit("PSEUDO_EVENT_PARENT_SUBJECT").alias("kind"), "parent", "child", "earliest", "latest")


@query("merge_tables_outer", "SELECT coalesce(c_custkey, o_custkey) AS k, c_mktsegment, n FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c_custkey = o_custkey")
def merge_tables_outer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return c.join(o, "k", "full")


@query("event_matrix", "SELECT event_id, " + ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS has_{c}" for c in ("ts", "user_id", "event_type", "value", "props")) + " FROM events")
def event_matrix(spark, sf_dir):
    return measures.presence_matrix(table(spark, sf_dir, "events"), "event_id", "event_id", ["ts", "user_id", "event_type", "value", "props"])


@query("ground_truth_uuids", "SELECT doc_id, len(regexp_extract_all(text, '[0-9a-f]{24,}')) AS found FROM documents")
def ground_truth_uuids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9a-f]{24,}"), F.lit(0))).cast("long").alias("found"))


@query("load_limit", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 500 OFFSET 100")
def load_limit(spark, sf_dir):
    """A range of the source in its total order: start inclusive, end exclusive."""
    return measures.crop(table(spark, sf_dir, "events"), ["ts", "event_id"], 100, 600).select("event_id")


@query("source_merge", "SELECT 0 AS source_ord, o_orderkey AS k FROM orders UNION ALL SELECT 1, c_custkey FROM customer UNION ALL SELECT 2, s_suppkey FROM supplier")
def source_merge(spark, sf_dir):
    keys = (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))
    return measures.merge_sources([table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in keys])


@query("parse_errors", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE object END AS object, event_id % 10 = 3 AS bad FROM ev")
def parse_errors(spark, sf_dir):
    """Records that can't be parsed are kept apart by a flag, and the rest goes on."""
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("props"))
    return measures.parse_records(raw, "props", "k long").select("event_id", F.col("record.k").alias("object"), "bad")


def _vertex(label: str, rows: str, ident: str, **properties: str) -> str:
    """Vertices as JSON, their properties in the order of the graph's."""
    parts = "".join(f""" || ',"{k}":[{{"value":' || {v} || '}}]'""" for k, v in properties.items())
    return f"""SELECT {ident} AS id, '{{"id":"' || {ident} || '","type":"vertex","label":"{label}","properties":{{"uuid":[{{"value":"' || {ident} || '"}}]'{parts} || '}}}}' AS json FROM {rows}"""


_QUOTED = "'\"' || {} || '\"'"
_JSON = " UNION ALL ".join([
    _vertex("AdmEvent", "ev", "'e' || event_id", eventType=_QUOTED.format("kind"), earliestTimestampNanos="nanos", latestTimestampNanos="nanos", value="value"),
    _vertex("AdmSubject", "su", "'u' || subject", cid="subject"),
    _vertex("AdmFileObject", "(SELECT DISTINCT object FROM ev WHERE object IS NOT NULL) o", "'k' || object", path=_QUOTED.format("'/k/' || object")),
    _vertex("AdmPrincipal", "(SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT subject FROM su)) c", "'c' || c_custkey", username=_QUOTED.format("c_name")),
    _vertex("AdmHost", "nation", "'n' || n_nationkey", hostName=_QUOTED.format("n_name")),
])


@query("vertex_json", f"WITH {EDGES} {_JSON}")
def vertex_json(spark, sf_dir):
    return reports.vertex_json(event_graph(spark, sf_dir).vertices)


@query("edge_json", f"""WITH {EDGES} SELECT src || '|' || label || '|' || dst AS id, '{{"id":"' || src || '|' || label || '|' || dst || '","type":"edge","label":"' || label || '","inV":"' || dst || '","outV":"' || src || '"}}' AS json FROM ed""")
def edge_json(spark, sf_dir):
    return reports.edge_json(event_graph(spark, sf_dir).edges)


@query("delayed_names", f"""WITH {EV}, nm AS (SELECT subject, '/bin/' || object AS name, min(event_id) AS seen FROM ev WHERE kind = 'EVENT_EXECUTE' AND object IS NOT NULL GROUP BY 1, 2)
 SELECT ev.event_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS names FROM ev LEFT JOIN nm ON nm.subject = ev.subject AND seen <= event_id + 1000 GROUP BY 1""")
def delayed_names(spark, sf_dir):
    """Events with all names of their process that come up to a thousand records later: a process is named by what it executes."""
    ev = event_frame(spark, sf_dir)
    names = ev.where("event_type = 'view'").select("subject", "event_id", F.concat(F.lit("/bin/"), F.col("object")).alias("name"))
    found = measures.name_sets(ev.select("event_id", "subject"), names, "subject", "event_id", "name", 1000)
    return found.select("event_id", F.array_join("names", ",").alias("names"))


@query("policy_tag_chain", f"""WITH RECURSIVE {EV}, tg AS (SELECT event_id AS tag, lag(event_id) OVER (PARTITION BY subject, object ORDER BY nanos, event_id) AS prev, subject, kind FROM ev WHERE object IS NOT NULL),
 ch(write, tag) AS (SELECT tag, tag FROM tg WHERE kind = 'EVENT_WRITE' UNION ALL SELECT write, prev FROM ch JOIN tg USING (tag) WHERE prev IS NOT NULL)
 SELECT write, count(*) AS steps, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment), '') AS kinds FROM ch JOIN tg USING (tag) LEFT JOIN customer ON c_custkey = subject GROUP BY 1""")
def policy_tag_chain(spark, sf_dir):
    """Writes by the tags behind them: each event on an object is a tag, the one before it its process's last event there, and names the process's account."""
    ev = event_frame(spark, sf_dir).where("object is not null")
    before = Window.partitionBy("subject", "object").orderBy("nanos", "event_id")
    tags = checkpoint(ev.select(F.col("event_id").alias("tag"), F.lag("event_id").over(before).alias("prev"), F.col("subject").alias("object"), "event_type"))
    writes = tags.where("event_type = 'purchase'").select(F.col("tag").alias("write"), "tag")
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object"), F.col("c_mktsegment").alias("kind"))
    return policy.tag_chain(writes, tags.drop("event_type"), sources).withColumn("kinds", F.array_join("kinds", ","))
