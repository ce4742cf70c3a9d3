"""Segmentation and diagnosis on the tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as sg
from ..operators.graph import event_frame, event_graph, kind_of
from .registry import query
from .sql import EDGES, EV


def _tree(spark, sf_dir):
    return event_graph(spark, sf_dir).edges.where("label in ('parentSubject', 'localPrincipal')")


TREE = EDGES + """, te AS (SELECT src, dst FROM ed WHERE label IN ('parentSubject', 'localPrincipal')), un AS (SELECT src, dst FROM te UNION SELECT dst, src FROM te),
sd AS (SELECT DISTINCT 'u' || subject AS id FROM ev WHERE subject % 20 = 3), wk(seg, node, hops) AS (SELECT id, id, 0 FROM sd UNION SELECT seg, dst, hops + 1 FROM wk JOIN un ON src = node WHERE hops < 2),
mem AS (SELECT seg, node, min(hops) AS hops FROM wk GROUP BY 1, 2)"""


def members(spark, sf_dir):
    seeds = event_frame(spark, sf_dir).where("subject % 20 = 3").select(F.concat(F.lit("u"), "subject").alias("id"))
    return sg.radius(seeds, _tree(spark, sf_dir), 2)


@query("radius_segments", f"WITH RECURSIVE {TREE} SELECT seg, node, hops FROM mem")
def radius_segments(spark, sf_dir):
    return members(spark, sf_dir)


@query("disjoint_segments", f"WITH RECURSIVE {TREE} SELECT seg, node FROM mem WHERE node NOT IN (SELECT node FROM mem GROUP BY 1 HAVING count(DISTINCT seg) > 1)")
def disjoint_segments(spark, sf_dir):
    return sg.disjoint(members(spark, sf_dir)).select("seg", "node")


@query("time_segments", f"WITH {EV} SELECT nanos - nanos % 86400000000000 AS seg, count(*) AS n FROM ev GROUP BY 1")
def time_segments(spark, sf_dir):
    return sg.by_time(event_frame(spark, sf_dir), "nanos", 86_400_000_000_000).groupBy("seg").agg(F.count("*").alias("n"))


@query("intersected_segments", f"WITH {EV} SELECT subject % 5 AS seg_a, nanos - nanos % 604800000000000 AS seg_b, event_id AS node FROM ev WHERE subject % 5 < 2")
def intersected_segments(spark, sf_dir):
    ev = event_frame(spark, sf_dir).withColumn("node", F.col("event_id"))
    one = ev.where("subject % 5 < 2").withColumn("seg", F.col("subject") % 5)
    return sg.intersected(one, sg.by_time(ev, "nanos", 604_800_000_000_000))


@query("segment_edges", f"WITH {EV} SELECT subject % 6 AS from_seg, object % 4 + 10 AS to_seg, count(*) AS links, min(nanos) AS first, max(nanos) AS last FROM ev WHERE object IS NOT NULL GROUP BY 1, 2")
def segment_edges(spark, sf_dir):
    ev = event_frame(spark, sf_dir).where("object is not null")
    u, k = F.concat(F.lit("u"), "subject"), F.concat(F.lit("k"), "object")
    mem = ev.select((F.col("subject") % 6).alias("seg"), u.alias("node")).union(ev.select(F.col("object") % 4 + 10, k)).distinct()
    return sg.segment_edges(mem, ev.select(u.alias("src"), k.alias("dst"), "nanos"))


@query("fixed_size_segments", f"WITH {EV} SELECT event_id, subject, CAST((row_number() OVER (PARTITION BY subject ORDER BY event_id) - 1) // 7 AS BIGINT) AS seg FROM ev")
def fixed_size_segments(spark, sf_dir):
    return sg.fixed_size(event_frame(spark, sf_dir).select("event_id", "subject"), "subject", "event_id", 7)


@query("segment_features", f"WITH RECURSIVE {TREE} SELECT n.seg, nodes, coalesce(edges, 0) AS edges, round(CASE WHEN nodes > 1 THEN coalesce(edges, 0) / CAST(nodes * (nodes - 1) AS DOUBLE) ELSE 0 END, 6) AS density FROM (SELECT seg, count(*) AS nodes FROM mem GROUP BY 1) n LEFT JOIN (SELECT a.seg, count(*) AS edges FROM te JOIN mem a ON a.node = src JOIN mem b ON b.node = dst AND a.seg = b.seg GROUP BY 1) e ON e.seg = n.seg")
def segment_features(spark, sf_dir):
    return sg.segment_features(members(spark, sf_dir), _tree(spark, sf_dir)).withColumn("density", F.round("density", 6))


STEPS = EV + ", st AS (SELECT subject AS path, event_id AS pos, kind AS label FROM ev)"


def steps(spark, sf_dir):
    ev = event_frame(spark, sf_dir)
    return ev.select(F.col("subject").alias("path"), F.col("event_id").alias("pos"), kind_of(F.col("event_type")).alias("label"))


def grammar(name, build, sql):
    query(f"grammar_{name}", f"WITH {STEPS} {sql}")(lambda spark, sf_dir: build(steps(spark, sf_dir)).select("path", F.array_join(F.col("at").cast("array<string>"), ",").alias("places")))


def _t(kind):
    return lambda s: sg.terminal(s, f"EVENT_{kind}")


R, W, X, U = map(_t, ("READ", "WRITE", "EXECUTE", "UNLINK"))
grammar("terminal", W, "SELECT path, CAST(pos AS VARCHAR) AS places FROM st WHERE label = 'EVENT_WRITE'")
grammar("sequence", lambda s: sg.sequence(W(s), X(s), U(s)), "SELECT a.path, a.pos || ',' || b.pos || ',' || c.pos AS places FROM st a JOIN st b ON a.path = b.path AND b.pos > a.pos JOIN st c ON c.path = b.path AND c.pos > b.pos WHERE a.label = 'EVENT_WRITE' AND b.label = 'EVENT_EXECUTE' AND c.label = 'EVENT_UNLINK'")
grammar("choice", lambda s: sg.choice(W(s), R(s)), "SELECT path, CAST(pos AS VARCHAR) AS places FROM st WHERE label IN ('EVENT_WRITE', 'EVENT_READ')")
grammar("optional_sequence", lambda s: sg.optional_sequence(W(s), U(s)), "SELECT path, CAST(pos AS VARCHAR) AS places FROM st WHERE label = 'EVENT_WRITE' UNION ALL SELECT a.path, a.pos || ',' || b.pos FROM st a JOIN st b ON a.path = b.path AND b.pos > a.pos WHERE a.label = 'EVENT_WRITE' AND b.label = 'EVENT_UNLINK'")
grammar("one_or_more", lambda s: sg.one_or_more(U(s), 2), "SELECT path, CAST(pos AS VARCHAR) AS places FROM st WHERE label = 'EVENT_UNLINK' UNION ALL SELECT a.path, a.pos || ',' || b.pos FROM st a JOIN st b ON a.path = b.path AND b.pos > a.pos WHERE a.label = 'EVENT_UNLINK' AND b.label = 'EVENT_UNLINK'")


grammar("optional", lambda s: sg.sequence(W(s), sg.optional(s, X(s)), U(s)), "SELECT a.path, a.pos || ',' || c.pos AS places FROM st a JOIN st c ON a.path = c.path AND c.pos > a.pos WHERE a.label = 'EVENT_WRITE' AND c.label = 'EVENT_UNLINK' UNION ALL SELECT a.path, a.pos || ',' || b.pos || ',' || c.pos FROM st a JOIN st b ON a.path = b.path AND b.pos > a.pos JOIN st c ON c.path = b.path AND c.pos > b.pos WHERE a.label = 'EVENT_WRITE' AND b.label = 'EVENT_EXECUTE' AND c.label = 'EVENT_UNLINK'")
grammar("zero_or_more", lambda s: sg.zero_or_more(s, U(s), 2), "SELECT DISTINCT path, '' AS places FROM st UNION ALL SELECT path, CAST(pos AS VARCHAR) FROM st WHERE label = 'EVENT_UNLINK' UNION ALL SELECT a.path, a.pos || ',' || b.pos FROM st a JOIN st b ON a.path = b.path AND b.pos > a.pos WHERE a.label = 'EVENT_UNLINK' AND b.label = 'EVENT_UNLINK'")


@query("forward_states", f"""WITH RECURSIVE {EV}, su AS (SELECT DISTINCT subject AS s FROM ev), lb AS (SELECT s, CASE s % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS label FROM su),
 f(s, state) AS (SELECT s, CASE WHEN label = 'a' THEN 1 ELSE 0 END FROM lb WHERE s = 0 UNION ALL SELECT lb.s, f.state + CASE WHEN (['a', 'b', 'c'])[f.state + 1] = lb.label THEN 1 ELSE 0 END FROM f JOIN lb ON lb.s // 2 = f.s AND lb.s > 0)
 SELECT 'u' || s AS id, CAST(state AS INT) AS state FROM f""")
def forward_states(spark, sf_dir):
    ids = event_frame(spark, sf_dir).select("subject").distinct()
    nodes = ids.select(F.concat(F.lit("u"), "subject").alias("id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("subject") % 3 + 1).cast("int")).alias("label"))
    edges = ids.where("subject > 0").select(F.expr("concat('u', subject div 2)").alias("src"), F.concat(F.lit("u"), "subject").alias("dst"))
    return sg.forward_states(nodes, edges, ["a", "b", "c"]).withColumn("state", F.col("state").cast("int"))


@query("paths_through_node", f"""WITH RECURSIVE {EDGES}, te AS (SELECT dst AS src, src AS dst FROM ed WHERE label = 'parentSubject'),
 b(at_, path) AS (SELECT 'u9', 'u9' UNION ALL SELECT src, src || '>' || path FROM b JOIN te ON dst = at_), a(at_, path) AS (SELECT 'u9', '' UNION ALL SELECT dst, path || '>' || dst FROM a JOIN te ON src = at_)
 SELECT b.path || a.path AS path FROM b, a WHERE b.at_ NOT IN (SELECT dst FROM te) AND a.at_ NOT IN (SELECT src FROM te)""")
def paths_through_node(spark, sf_dir):
    edges = event_graph(spark, sf_dir).edges.where("label = 'parentSubject'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return sg.paths_through(edges, "u9").select(F.array_join("path", ">").alias("path"))


@query("top_without_better_parent", f"WITH {EV}, sc AS (SELECT subject AS s, count(*) AS score FROM ev GROUP BY 1) SELECT 'u' || a.s AS id, a.score FROM sc a LEFT JOIN sc p ON p.s = a.s // 2 AND a.s > 0 WHERE p.score IS NULL OR p.score < a.score ORDER BY a.score DESC, 'u' || a.s LIMIT 10")
def top_without_better_parent(spark, sf_dir):
    scores = event_frame(spark, sf_dir).groupBy(F.concat(F.lit("u"), "subject").alias("id")).agg(F.count("*").alias("score"))
    edges = event_graph(spark, sf_dir).edges.where("label = 'parentSubject'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return sg.top_without_better_parent(scores, edges, 10)


@query("process_reads_file", f"WITH {EV} SELECT DISTINCT 'u' || subject AS process, 'k' || object AS file FROM ev WHERE kind = 'EVENT_READ' AND object IS NOT NULL")
def process_reads_file(spark, sf_dir):
    ev = event_frame(spark, sf_dir).where("event_type = 'click' and object is not null")
    return ev.select(F.concat(F.lit("u"), "subject").alias("process"), F.concat(F.lit("k"), "object").alias("file")).distinct()


@query("process_reads_file_after_write", f"WITH {EV} SELECT DISTINCT w.subject AS writer, r.subject AS reader, r.object FROM ev w JOIN ev r ON w.object = r.object AND r.nanos > w.nanos AND r.nanos - w.nanos <= 21600000000000 WHERE w.kind = 'EVENT_WRITE' AND r.kind = 'EVENT_READ' AND w.subject <> r.subject")
def process_reads_file_after_write(spark, sf_dir):
    """Writers and readers of a file within six hours."""
    ev = event_frame(spark, sf_dir).where("object is not null")
    writes = ev.where("event_type = 'purchase'").select(F.col("subject").alias("writer"), "object", F.col("nanos").alias("at"))
    reads = ev.where("event_type = 'click'").select(F.col("subject").alias("reader"), "object", "nanos")
    return sg.reads_after_writes(writes, reads, 21_600_000_000_000)
