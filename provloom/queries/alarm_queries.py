"""Alarm reports, data-quality trees, flattened paths, delays and sinks, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import measures, novelty, reports
from ..operators.graph import event_frame, event_graph, kind_of
from ..session import shared_folder, table
from ..sources import sinks
from ..streaming import jobs
from .novelty_queries import OBS, alarm_rows
from . import detector_queries  # noqa: F401  its twins come first
from .registry import ORACLES, QUERIES, query
from .sql import EDGES, EV

DAY = 86_400_000_000_000


def _alarms(spark, sf_dir):
    return alarm_rows(spark, sf_dir).select("tree", "nanos", "event_id", "key", "local_prob")


@query("alarm_batches", f"WITH {OBS} SELECT tree, nanos - nanos % {DAY} AS batch, count(*) AS alarms, round(min(lp), 6) AS least, round(avg(lp), 6) AS mean, min(nanos) AS first, max(nanos) AS last FROM al GROUP BY 1, 2")
def alarm_batches(spark, sf_dir):
    found = novelty.batches(_alarms(spark, sf_dir), "tree", "nanos", DAY)
    return found.withColumns({"least": F.round("least", 6), "mean": F.round("mean", 6)})


@query("alarm_spans", f"WITH {OBS}, sp AS (SELECT 's' || i AS name, 1704067200000000000 + i * 3 * {DAY} AS a, 1704067200000000000 + i * 3 * {DAY} + {DAY} AS b FROM range(0, 8) r(i)) SELECT event_id, name FROM al JOIN sp ON nanos BETWEEN a AND b")
def alarm_spans(spark, sf_dir):
    """Alarms within the days of a list of attacks: every third day from the first on."""
    begin = F.lit(1_704_067_200_000_000_000) + F.col("id") * (3 * DAY)
    spans = spark.range(8).select(F.concat(F.lit("s"), F.col("id")).alias("name"), begin.alias("start"), (begin + DAY).alias("end"))
    return novelty.within_spans(_alarms(spark, sf_dir), spans, "nanos", DAY).select("event_id", "name")


@query("alarm_log_lines", f"WITH {OBS} SELECT event_id, tree || ': ' || k3 || ' after ' || k1 || ', ' || k2 AS line FROM al")
def alarm_log_lines(spark, sf_dir):
    line = sinks.alarm_line("console", F.col("tree"), F.col("key"), F.col("local_prob"), F.col("nanos"))
    return _alarms(spark, sf_dir).select("event_id", line.alias("line"))


@query("alarm_collector_events", f"""WITH {OBS} SELECT event_id, tree, k1 || '|' || k2 || '|' || k3 AS key, round(lp, 6) AS local_prob FROM al""")
def alarm_collector_events(spark, sf_dir):
    """The collector's JSON, parsed again."""
    line = sinks.alarm_line("collector", F.col("tree"), F.col("key"), F.col("local_prob"), F.col("nanos"))
    read = F.from_json(line, "time double, event struct<tree:string,key:array<string>,localProb:double>")
    return _alarms(spark, sf_dir).withColumn("r", read).select("event_id", F.col("r.event.tree").alias("tree"), F.array_join("r.event.key", "|").alias("key"), F.col("r.event.localProb").alias("local_prob"))


@query("data_quality_tree", """SELECT kind, field, state, count(*) AS n FROM (SELECT event_type AS kind, unnest(['value', 'props', 'user_id']) AS field,
 unnest([CASE WHEN value IS NULL THEN 'missing' ELSE 'present' END, CASE WHEN props IS NULL THEN 'missing' ELSE 'present' END, CASE WHEN user_id IS NULL THEN 'missing' ELSE 'present' END]) AS state FROM events) GROUP BY 1, 2, 3""")
def data_quality_tree(spark, sf_dir):
    """How often each field of each kind of record is there: the counts of the tree's leaves."""
    keys = novelty.quality_keys(table(spark, sf_dir, "events"), "event_type", ["value", "props", "user_id"])
    leaves = novelty.leaves(novelty.snapshot(keys.withColumn("tree", F.lit("quality"))))
    return leaves.select(*[F.col("prefix")[i].alias(c) for i, c in enumerate(("kind", "field", "state"))], "count").withColumnRenamed("count", "n")


@query("flattened_paths", f"WITH {EV}, s AS (SELECT subject, object % 3 AS g, list_sort(list_distinct(list('/k/' || object))) AS ps FROM ev WHERE object IS NOT NULL AND kind <> 'EVENT_FORK' GROUP BY 1, 2), p AS (SELECT subject, CASE WHEN subject % 4 = 0 THEN [NULL] ELSE ['/bin/' || subject, '/usr/' || subject] END AS ss FROM (SELECT DISTINCT subject FROM ev)) SELECT subject, g, subject_path, unnest(ps) AS object_path FROM (SELECT s.subject, g, unnest(ss) AS subject_path, ps FROM s JOIN p ON p.subject = s.subject)")
def flattened_paths(spark, sf_dir):
    ev = event_frame(spark, sf_dir).where("object is not null").where(kind_of(F.col("event_type")) != "EVENT_FORK")
    s = F.col("subject").cast("string")
    own = F.when(F.col("subject") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("/bin/"), s), F.concat(F.lit("/usr/"), s)))
    sets = ev.groupBy("subject", (F.col("object") % 3).alias("g")).agg(F.collect_set(F.concat(F.lit("/k/"), F.col("object"))).alias("objects"))
    return novelty.flatten(sets.withColumn("subjects", own), "subjects", "objects")


@query("option_keys", f"WITH {EV} SELECT event_id, CASE WHEN object % 3 = 0 OR object IS NULL THEN kind ELSE kind || '[' || object || ']' END AS key FROM ev")
def option_keys(spark, sf_dir):
    ev = event_frame(spark, sf_dir)
    return ev.select("event_id", novelty.option_text(kind_of(F.col("event_type")), F.when(F.col("object") % 3 != 0, F.col("object").cast("string"))).alias("key"))


@query("delayed_release", f"WITH {EV} SELECT event_id, min(nanos) OVER (PARTITION BY subject ORDER BY nanos RANGE BETWEEN {DAY} FOLLOWING AND UNBOUNDED FOLLOWING) AS released FROM ev")
def delayed_release(spark, sf_dir):
    return novelty.delayed(event_frame(spark, sf_dir), "nanos", "subject", DAY, "event_id").select("event_id", "released")


@query("delayed_by_records", f"WITH {EV} SELECT event_id, lead(event_id, 100) OVER (ORDER BY event_id) AS released FROM ev")
def delayed_by_records(spark, sf_dir):
    return novelty.delayed_by_records(event_frame(spark, sf_dir), "event_id", 100).select("event_id", "released")


@query("time_sorted", f"WITH {EV}, s AS (SELECT event_id, row_number() OVER (ORDER BY nanos, event_id) AS n FROM ev) SELECT event_id, n FROM s")
def time_sorted(spark, sf_dir):
    """Every record's place in the order of time: counts by range and running numbers inside, no task sorts all."""
    from ..operators.running import ranges, running

    rows = ranges(event_frame(spark, sf_dir).withColumn("all", F.lit(1)), "nanos")
    return running(rows, ["all"], ["nanos", "event_id"], F.lit(1).cast("long"), "n").select("event_id", "n")


@query("lowest_scores", f"SELECT * FROM ({ORACLES['avf']}) ORDER BY score, object LIMIT 5000")
def lowest_scores(spark, sf_dir):
    """The 5,000 users' days whose attributes are the rarest."""
    return measures.lowest(QUERIES["avf"](spark, sf_dir), 5000)


@query("linear_thresholds", f"WITH {OBS}, q AS (SELECT unnest([1.0, 5.0, 25.0]) AS percent) SELECT tree, CAST(percent AS DOUBLE) AS percent, round(CASE percent WHEN 1.0 THEN quantile_cont(lp, 0.01) WHEN 5.0 THEN quantile_cont(lp, 0.05) ELSE quantile_cont(lp, 0.25) END, 6) AS threshold FROM al, q GROUP BY tree, percent")
def linear_thresholds(spark, sf_dir):
    return measures.linear_percentiles(alarm_rows(spark, sf_dir), (1.0, 5.0, 25.0)).withColumn("threshold", F.round("threshold", 6))


@query("time_span", f"WITH {EV} SELECT kind, count(*) AS n, min(nanos) AS first, max(nanos) AS last FROM ev GROUP BY 1")
def time_span(spark, sf_dir):
    return event_frame(spark, sf_dir).groupBy(kind_of(F.col("event_type")).alias("kind")).agg(F.count("*").alias("n"), F.min("nanos").alias("first"), F.max("nanos").alias("last"))


@query("stream_graph_sink", f"WITH {EDGES}, vs AS (SELECT 'u' || subject AS id FROM su UNION SELECT 'k' || object FROM ev WHERE object % 5 <> 0 UNION SELECT 'e' || event_id FROM ev) SELECT label, count(*) FILTER (src IN (SELECT id FROM vs) AND dst IN (SELECT id FROM vs)) AS written, count(*) FILTER (NOT (src IN (SELECT id FROM vs) AND dst IN (SELECT id FROM vs))) AS parked FROM ed WHERE label IN ('subject', 'predicateObject') GROUP BY 1")
def stream_graph_sink(spark, sf_dir):
    """Elements of a stream of events in three batches of files: edges to objects that no vertex describes stay parked."""
    events = event_frame(spark, sf_dir)
    e, u, k = F.concat(F.lit("e"), "event_id"), F.concat(F.lit("u"), "subject"), F.concat(F.lit("k"), "object")
    none, props = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    row = lambda i, label, src, dst: F.struct(i.alias("id"), F.lit(label).alias("label"), src.alias("src"), dst.alias("dst"), props.alias("properties"))
    made = [row(F.concat(e, F.lit("s")), "subject", e, u), row(F.concat(e, F.lit("o")), "predicateObject", e, k), row(e, "AdmEvent", none, none), row(u, "AdmSubject", none, none)]
    made.append(F.when(F.col("object") % 5 != 0, row(k, "AdmFileObject", none, none)))
    elements = events.select(F.explode(F.array_compact(F.array(*made))).alias("x")).select("x.*").where("label <> 'predicateObject' or dst is not null")
    folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    elements.repartition(3, "id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(elements.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sinks.graph_sink(f"{folder}/out")).start().awaitTermination()
    _, edges, parked = sinks.graph_tables(spark, f"{folder}/out")
    return edges.select("label", F.lit(1).alias("w"), F.lit(0).alias("p")).union(parked.select("label", F.lit(0), F.lit(1))).groupBy("label").agg(F.sum("w").alias("written"), F.sum("p").alias("parked"))


@query("graph_by_label", f"WITH {EDGES} SELECT label, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM ed GROUP BY 1")
def graph_by_label(spark, sf_dir):
    """Edges as written by label and read back."""
    folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    event_graph(spark, sf_dir).edges.write.partitionBy("label").parquet(folder)
    return spark.read.parquet(folder).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query("stream_thresholds", f"""WITH {OBS}, rp AS (SELECT tree, CASE WHEN lp >= 0.3 THEN round(lp, 1) ELSE lp END AS p FROM al), np AS (SELECT tree, p, count(*) AS n FROM rp GROUP BY 1, 2),
 cp AS (SELECT tree, p, sum(n) OVER (PARTITION BY tree ORDER BY p) AS upto, sum(n) OVER (PARTITION BY tree) AS total FROM np), q AS (SELECT unnest([1.0, 5.0, 25.0]) AS percent)
 SELECT tree, CAST(percent AS DOUBLE) AS percent, round(coalesce(max(CASE WHEN upto <= percent / 100 * total THEN p END), 1.0), 6) AS threshold FROM cp CROSS JOIN q GROUP BY 1, 2""")
def stream_thresholds(spark, sf_dir):
    """Thresholds renewed with every batch of a stream of alarms; the last batch's stand for all alarms."""
    folder = f"{shared_folder(spark)}/thresholds-{uuid.uuid4().hex}"
    _alarms(spark, sf_dir).select("tree", "local_prob").repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("tree string, local_prob double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = jobs.renewed(novelty.threshold_counts(stream), folder, lambda df: novelty.histogram_thresholds(df, (1.0, 5.0, 25.0)))
    return found.withColumn("threshold", F.round("threshold", 6))


@query("alarm_process_reports", f"""WITH {OBS}, r AS (SELECT k1 AS process, nanos - nanos % {7 * DAY} AS interval, lp, k1 || ' ' || k2 || ' ' || k3 AS action FROM al),
 n AS (SELECT *, row_number() OVER (PARTITION BY process, interval ORDER BY lp, action) AS n FROM r)
 SELECT process, interval, count(*) AS alarms, round(min(lp), 6) AS least, string_agg(action, ';' ORDER BY n) FILTER (n <= 20) AS novel FROM n GROUP BY 1, 2""")
def alarm_process_reports(spark, sf_dir):
    """Weekly reports: each process's alarms and the twenty least expected of them."""
    found = reports.process_reports(alarm_rows(spark, sf_dir), F.get("key", F.lit(0)), "nanos", 7 * DAY)
    return found.select("process", "interval", "alarms", F.round("least", 6).alias("least"), F.array_join("novel", ";").alias("novel"))
