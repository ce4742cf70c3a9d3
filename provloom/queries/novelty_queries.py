"""Tries, alarms, thresholds, two-phase and cross-host joins on the tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import novelty, reports
from ..operators.graph import event_frame, kind_of
from ..session import table
from .registry import query
from .sql import EV

SEQ = ("nanos", "event_id")


def observations(spark, sf_dir) -> DataFrame:
    """Every event as [user, kind, object] in the tree of its user's parity."""
    ev = event_frame(spark, sf_dir).where("object is not null")
    key = F.array(F.concat(F.lit("u"), "subject"), kind_of(F.col("event_type")), F.concat(F.lit("k"), "object"))
    return ev.select(F.concat(F.lit("t"), F.col("subject") % 2).alias("tree"), "nanos", "event_id", key.alias("key"))


def levels_sql(order: str) -> str:
    """Counters, children and alarms of the observations ``obs`` (tree, k1, k2, k3) in a total order."""
    w = lambda by: f"OVER (PARTITION BY {by} ORDER BY {order})"
    return f"""c AS (SELECT *, row_number() {w("tree")} AS c0, row_number() {w("tree, k1")} AS c1, row_number() {w("tree, k1, k2")} AS c2, row_number() {w("tree, k1, k2, k3")} AS c3 FROM obs),
s AS (SELECT *, sum(CASE WHEN c1 = 1 THEN 1 ELSE 0 END) {w("tree")} AS s1, sum(CASE WHEN c2 = 1 THEN 1 ELSE 0 END) {w("tree, k1")} AS s2,
 sum(CASE WHEN c3 = 1 THEN 1 ELSE 0 END) {w("tree, k1, k2")} AS s3 FROM c),
al AS (SELECT *, CASE WHEN c2 <> 1 THEN s3 / CAST(s3 + c2 AS DOUBLE)
 WHEN c1 = 1 THEN CASE WHEN c0 = 1 THEN 1.0 ELSE (s1 - 1) / CAST(s1 - 1 + c0 - 1 AS DOUBLE) END
 ELSE s2 / CAST(s2 + c1 AS DOUBLE) END AS lp, CASE WHEN c2 <> 1 THEN 3 WHEN c1 = 1 THEN 1 ELSE 2 END AS dp FROM s WHERE c3 = 1)"""


OBS = EV + f""", obs AS (SELECT 't' || (subject % 2) AS tree, nanos, event_id, 'u' || subject AS k1, kind AS k2, 'k' || object AS k3 FROM ev WHERE object IS NOT NULL),
{levels_sql("nanos, event_id")}"""


def alarm_rows(spark, sf_dir) -> DataFrame:
    return novelty.observed_alarms(observations(spark, sf_dir), SEQ)


@query("trie_alarms", f"WITH {OBS} SELECT tree, event_id, k1 || '|' || k2 || '|' || k3 AS key, round(lp, 6) AS local_prob, round(1.0 / c0, 6) AS global_prob, dp AS depth FROM al")
def trie_alarms(spark, sf_dir):
    found = alarm_rows(spark, sf_dir)
    return found.select("tree", "event_id", F.array_join("key", "|").alias("key"), F.round("local_prob", 6).alias("local_prob"), F.round("global_prob", 6).alias("global_prob"), "depth")


@query("trie_levels", f"""WITH {OBS} SELECT event_id, 0 AS level, c0 AS count, CAST(NULL AS BIGINT) AS parent_count FROM c UNION ALL SELECT event_id, 1, c1, c0 FROM c
 UNION ALL SELECT event_id, 2, c2, c1 FROM c UNION ALL SELECT event_id, 3, c3, c2 FROM c""")
def trie_levels(spark, sf_dir):
    return novelty.observe(observations(spark, sf_dir), seq=SEQ).select("event_id", "level", "count", "parent_count")


@query("trie_alarms_below_threshold", f"WITH {OBS} SELECT event_id, round(lp, 6) AS local_prob FROM al WHERE lp <= 0.25")
def trie_alarms_below_threshold(spark, sf_dir):
    return alarm_rows(spark, sf_dir).where("local_prob <= 0.25").select("event_id", F.round("local_prob", 6).alias("local_prob"))


SNAP = OBS + """, n AS MATERIALIZED (SELECT tree, '' AS path, 0 AS level, count(*) AS count, count(DISTINCT k1) AS children FROM obs GROUP BY tree
 UNION ALL SELECT tree, k1, 1, count(*), count(DISTINCT k2) FROM obs GROUP BY tree, k1
 UNION ALL SELECT tree, k1 || '|' || k2, 2, count(*), count(DISTINCT k3) FROM obs GROUP BY tree, k1, k2
 UNION ALL SELECT tree, k1 || '|' || k2 || '|' || k3, 3, count(*), 0 FROM obs GROUP BY tree, k1, k2, k3),
sn AS MATERIALIZED (SELECT a.*, CASE WHEN a.level = 0 THEN 1.0 ELSE a.count / CAST(b.count AS DOUBLE) END AS lp, a.count / CAST(r.count AS DOUBLE) AS gp
 FROM n a JOIN n r ON a.tree = r.tree AND r.level = 0
 LEFT JOIN n b ON a.tree = b.tree AND b.level = a.level - 1 AND b.path = CASE WHEN a.level = 1 THEN '' ELSE regexp_replace(a.path, '\\|[^|]*$', '') END)"""


def _shown(tree: DataFrame) -> DataFrame:
    return tree.select("tree", F.array_join("prefix", "|").alias("path"), "level", "count", "children", F.round("local_prob", 6).alias("local_prob"), F.round("global_prob", 6).alias("global_prob"))


SHOWN = "SELECT tree, path, level, count, children, round(lp, 6) AS local_prob, round(gp, 6) AS global_prob FROM sn"


@query("trie_snapshot", f"WITH {SNAP} {SHOWN}")
def trie_snapshot(spark, sf_dir):
    return _shown(novelty.snapshot(observations(spark, sf_dir)))


@query("trie_question_nodes", f"WITH {SNAP} SELECT tree, CASE WHEN level = 0 THEN '_?_' ELSE path || '|_?_' END AS path, children AS count, round(children / CAST(count AS DOUBLE), 6) AS local_prob, round(children / CAST(count AS DOUBLE) * gp, 6) AS global_prob FROM sn WHERE children > 0")
def trie_question_nodes(spark, sf_dir):
    q = novelty.question_nodes(novelty.snapshot(observations(spark, sf_dir)))
    return q.select("tree", F.array_join("prefix", "|").alias("path"), "count", F.round("local_prob", 6).alias("local_prob"), F.round("global_prob", 6).alias("global_prob"))


@query("trie_counts", f"WITH {SNAP} SELECT tree, count(*) AS nodes, count(*) FILTER (children = 0) AS leaves, CAST(sum(count) FILTER (children = 0) AS BIGINT) AS observed FROM sn GROUP BY tree")
def trie_counts(spark, sf_dir):
    tree = novelty.snapshot(observations(spark, sf_dir))
    leaf = F.col("children") == 0
    return tree.groupBy("tree").agg(F.count("*").alias("nodes"), F.count(F.when(leaf, 1)).alias("leaves"), F.sum(F.when(leaf, F.col("count"))).alias("observed"))


@query("trie_truncate", f"WITH {SNAP} SELECT tree, path, level, count, CASE WHEN level = 2 THEN 0 ELSE children END AS children, round(lp, 6) AS local_prob, round(gp, 6) AS global_prob FROM sn WHERE level <= 2")
def trie_truncate(spark, sf_dir):
    return _shown(novelty.truncate(novelty.snapshot(observations(spark, sf_dir)), 2))


@query("trie_subtree", f"WITH {SNAP} {SHOWN} WHERE path = 'u7' OR starts_with(path, 'u7|')")
def trie_subtree(spark, sf_dir):
    return _shown(novelty.subtree(novelty.snapshot(observations(spark, sf_dir)), ["u7"]))


@query("trie_merge", f"WITH {SNAP}, m AS (SELECT path, level, CAST(sum(count) AS BIGINT) AS count, CAST(CASE WHEN level = 0 THEN (SELECT count(DISTINCT k1) FROM obs) ELSE sum(children) END AS BIGINT) AS children FROM n GROUP BY path, level) SELECT path, level, count, children, round(count / CAST((SELECT count(*) FROM obs) AS DOUBLE), 6) AS global_prob FROM m")
def trie_merge(spark, sf_dir):
    tree = novelty.snapshot(observations(spark, sf_dir))
    return _shown(novelty.merge(tree.where("tree = 't0'"), tree.where("tree = 't1'"))).drop("tree", "local_prob")


@query("trie_hang_and_renormalize", f"WITH {SNAP} SELECT 'host' || CASE WHEN level = 0 THEN '' ELSE '|' || path END AS path, level + 1 AS level, round(gp, 6) AS global_prob FROM sn WHERE tree = 't0' AND level <= 1")
def trie_hang_and_renormalize(spark, sf_dir):
    tree = novelty.renormalize(novelty.truncate(novelty.snapshot(observations(spark, sf_dir)).where("tree = 't0'"), 1))
    return novelty.under(tree, "host", "hosts").select(F.array_join("prefix", "|").alias("path"), "level", F.round("global_prob", 6).alias("global_prob"))


@query("trie_most_novel", f"WITH {SNAP} SELECT path, round(lp, 6) AS local_prob FROM sn WHERE children = 0 ORDER BY lp, path LIMIT 30")
def trie_most_novel(spark, sf_dir):
    return novelty.most_novel(novelty.snapshot(observations(spark, sf_dir)), 30).select(F.array_join("prefix", "|").alias("path"), F.round("local_prob", 6).alias("local_prob"))


@query("trie_below_local", f"WITH {SNAP} SELECT tree, path, count FROM sn WHERE children = 0 AND lp < 0.12")
def trie_below_local(spark, sf_dir):
    return novelty.below_probability(novelty.snapshot(observations(spark, sf_dir)), "local_prob", 0.12).select("tree", F.array_join("prefix", "|").alias("path"), "count")


@query("trie_below_global", f"WITH {SNAP} SELECT tree, path, count FROM sn WHERE children = 0 AND gp < 0.0003")
def trie_below_global(spark, sf_dir):
    return novelty.below_probability(novelty.snapshot(observations(spark, sf_dir)), "global_prob", 0.0003).select("tree", F.array_join("prefix", "|").alias("path"), "count")


@query("trie_preorder", f"WITH {SNAP} SELECT replace(path, '|', '∫') AS path, level, regexp_extract(path, '([^|]*)$', 1) AS key, count FROM sn WHERE tree = 't0'")
def trie_preorder(spark, sf_dir):
    return novelty.to_preorder(novelty.snapshot(observations(spark, sf_dir)).where("tree = 't0'")).select("path", "level", "key", "count")


@query("trie_equal_siblings", f"""WITH {SNAP}, g AS (SELECT tree, regexp_replace(path, '\\|[^|]*$', '') AS parent, count, list_sort(list(regexp_extract(path, '([^|]*)$', 1))) AS keys FROM sn WHERE children = 0 GROUP BY 1, 2, 3)
 SELECT tree, parent, count, CASE WHEN len(keys) <= 5 THEN array_to_string(keys, ', ') ELSE len(keys) || ' items like ' || keys[1] END AS keys, count * len(keys) AS total FROM g""")
def trie_equal_siblings(spark, sf_dir):
    return novelty.merge_equal_siblings(novelty.snapshot(observations(spark, sf_dir))).withColumn("parent", F.array_join("parent", "|"))


@query("trie_collapse_unary", f"""WITH {EV}, o AS (SELECT 'o' || (subject % 40) AS k1, 'q' || (subject % 40 // 2) AS k2, kind AS k3 FROM ev),
 a AS (SELECT k1, k2, count(DISTINCT k3) AS n2, count(*) AS c FROM o GROUP BY 1, 2)
 SELECT CAST((SELECT count(*) FROM o) AS BIGINT) AS count, '' AS path WHERE (SELECT count(DISTINCT k1) FROM o) <> 1
 UNION ALL SELECT c, k1 || ' ∫ ' || k2 FROM a WHERE n2 > 1
 UNION ALL SELECT count(*), CASE WHEN n2 = 1 THEN k1 || ' ∫ ' || k2 || ' ∫ ' || k3 ELSE k1 || ' ∫ ' || k2 || '/' || k3 END FROM o JOIN a USING (k1, k2) GROUP BY k1, k2, k3, n2""")
def trie_collapse_unary(spark, sf_dir):
    ev = event_frame(spark, sf_dir)
    part = F.col("subject") % 40
    key = F.array(F.concat(F.lit("o"), part), F.concat(F.lit("q"), F.floor(part / 2)), kind_of(F.col("event_type")))
    tree = novelty.snapshot(ev.select(F.lit("t").alias("tree"), key.alias("key")))
    top = tree.where("level = 0 and children <> 1").select("count", F.lit("").alias("path"))
    return novelty.collapse_unary(tree).select("count", F.array_join("path", "/").alias("path")).union(top)


@query("trie_thresholds", f"""WITH {OBS}, p AS (SELECT tree, CASE WHEN lp >= 0.3 THEN round(lp, 1) ELSE lp END AS p, count(*) AS n FROM al GROUP BY 1, 2),
 u AS (SELECT *, sum(n) OVER (PARTITION BY tree ORDER BY p) AS upto, sum(n) OVER (PARTITION BY tree) AS total FROM p)
 SELECT tree, percent, round(coalesce(max(CASE WHEN upto <= percent / 100 * total THEN p END), 1.0), 6) AS threshold FROM u CROSS JOIN (SELECT unnest([0.1, 1.0, 5.0, 20.0]::DOUBLE[]) AS percent) GROUP BY 1, 2""")
def trie_thresholds(spark, sf_dir):
    return novelty.thresholds(alarm_rows(spark, sf_dir), (0.1, 1.0, 5.0, 20.0)).withColumn("threshold", F.round("threshold", 6))


@query("alarm_page", f"WITH {OBS} SELECT event_id, k1 || '|' || k2 || '|' || k3 AS key FROM al WHERE k1 = 'u8' AND event_id <= 8000 ORDER BY event_id DESC LIMIT 20")
def alarm_page(spark, sf_dir):
    page = novelty.alarm_page(alarm_rows(spark, sf_dir), ["u8"], "event_id", 8000, False, 20)
    return page.select("event_id", F.array_join("key", "|").alias("key"))


@query("alarm_ratings", f"WITH {OBS}, l AS (SELECT k1 || '|' || k2 || '|' || k3 AS key, event_id % 3 AS ns, max_by(event_id % 4, event_id) AS rating FROM obs GROUP BY 1, 2) SELECT a.event_id, coalesce(string_agg('n' || ns || '=' || rating, ',' ORDER BY ns) FILTER (rating <> 0), '') AS ratings FROM al a JOIN l ON l.key = k1 || '|' || k2 || '|' || k3 WHERE a.k1 = 'u3' GROUP BY 1")
def alarm_ratings(spark, sf_dir):
    rated = observations(spark, sf_dir).select("key", F.concat(F.lit("n"), F.col("event_id") % 3).alias("namespace"), (F.col("event_id") % 4).alias("rating"), F.col("event_id").alias("seq"))
    found = novelty.rate(novelty.subtree(alarm_rows(spark, sf_dir).withColumnRenamed("key", "prefix"), ["u3"]).withColumnRenamed("prefix", "key"), rated)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("ratings")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("event_id", F.coalesce(shown, F.lit("")).alias("ratings"))


@query("alarm_exclusions", f"WITH {OBS} SELECT event_id FROM al WHERE k1 NOT IN ('u1', 'u2') AND k3 NOT IN ('k5')")
def alarm_exclusions(spark, sf_dir):
    return alarm_rows(spark, sf_dir).where(~F.arrays_overlap("key", F.array(*map(F.lit, ("u1", "u2", "k5"))))).select("event_id")


def partial(name: str, first: str, later: str, key: str, extra: str = "TRUE") -> None:
    """A two-phase tree: the first event of one kind on a key, then every later one of another kind, as observations."""
    sql = f"""WITH {EV}, f AS (SELECT {key} AS k, min_by(event_id, (nanos, event_id)) AS fe, min((nanos, event_id)) AS t0, min_by(subject, (nanos, event_id)) AS fs FROM ev WHERE kind IN ({first}) AND {key} IS NOT NULL GROUP BY 1)
 SELECT k AS key, fe AS first_event_id, event_id AS later_event_id FROM f JOIN ev ON {key} = k AND kind IN ({later}) AND (nanos, event_id) > t0 WHERE {extra.replace("first_subject", "fs").replace("later_subject", "subject")}"""

    def run(spark, sf_dir):
        ev = event_frame(spark, sf_dir).withColumn("kind", kind_of(F.col("event_type")))
        found = novelty.first_then_later(ev, F.expr(f"kind in ({first})"), F.expr(f"kind in ({later})"), key, SEQ, ["event_id", "subject"], ["event_id", "subject"])
        return found.where(extra).select(F.col(key).alias("key"), "first_event_id", "later_event_id")

    query(name, sql)(run)


partial("file_execute_delete", "'EVENT_EXECUTE'", "'EVENT_UNLINK'", "object")
partial("file_written_then_executed", "'EVENT_WRITE'", "'EVENT_EXECUTE'", "object")
partial("communication_through_object", "'EVENT_WRITE'", "'EVENT_READ'", "object", "first_subject <> later_subject")
partial("write_soon_after_read", "'EVENT_READ'", "'EVENT_WRITE'", "subject")


def host_flows(spark, sf_dir) -> DataFrame:
    """Lines meet orders last, by the order, so equal flows are already together."""
    orders = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate")).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    found = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return found.select(F.col("c_nationkey").alias("host"), F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"), "d", F.col("o_orderkey").alias("seq")).distinct()


@query("cross_host_flows", """WITH f AS (SELECT DISTINCT c_nationkey AS host, c_nationkey AS a, s_nationkey AS b, CAST(o_orderdate AS DATE) AS d, o_orderkey AS seq FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)
 SELECT x.host, y.host AS other_host, x.seq AS emitted, y.seq AS other_seq FROM f x JOIN f y ON x.a = y.b AND x.b = y.a AND x.d = y.d AND x.host <> y.host AND x.seq > y.seq""")
def cross_host_flows(spark, sf_dir):
    """Orders as flows from the customer's host to the supplier's; a flow has a day, as a socket has a port, which both ends know."""
    return novelty.cross_host(host_flows(spark, sf_dir), ["a", "d"], ["b", "d"], "host", "seq", [])


@query("directory_keys", "SELECT p_partkey, '/,' || p_brand || ',' || p_type AS keys FROM part")
def directory_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name")
    return part.select("p_partkey", F.array_join(novelty.directory_keys(path), ",").alias("keys"))


TREES = {
    # Subject-object trees: which events they take, and the keys below the subject.
    "process_file_touches": ("kind IN ('EVENT_READ', 'EVENT_WRITE')", "['u' || subject, 'k' || object]"),
    "files_touched_by_processes": ("kind IN ('EVENT_READ', 'EVENT_WRITE')", "['k' || object, 'u' || subject]"),
    "files_executed_by_processes": ("kind = 'EVENT_EXECUTE'", "['k' || object, 'u' || subject]"),
    "process_directory_touches": ("kind IN ('EVENT_READ', 'EVENT_WRITE')", "['u' || subject, '/', 'd' || (object % 7)]"),
    "summarized_process_activity": ("TRUE", "['u' || subject, kind, 'k' || object]"),
    "parent_child_processes": ("kind = 'EVENT_FORK'", "['u' || subject // 2, 'u' || subject]"),
    "process_network_activity": ("kind IN ('EVENT_READ', 'EVENT_WRITE') AND object % 10 = 0", "['u' || subject, 'a' || (object % 3), 'p' || object]"),
    "processes_changing_principal": ("kind = 'EVENT_EXECUTE' AND subject % 5 <> object % 5", "['u' || subject, 'r' || (subject % 5), 'r' || (object % 5)]"),
    "sudo_commands": ("kind = 'EVENT_EXECUTE' AND subject % 10 = 0", "['u' || subject, 'k' || object]"),
}


def tree(name: str, take: str, keys: str) -> None:
    depth = keys.count(",") + 1
    order = "ORDER BY nanos, event_id"
    counts = ", ".join(f"row_number() OVER (PARTITION BY list_slice(k, 1, {j}) {order}) AS c{j}" for j in range(depth + 1))
    siblings = ", ".join(f"sum(CASE WHEN c{j} = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY list_slice(k, 1, {j - 1}) {order}) AS s{j}" for j in range(1, depth + 1))
    new = " ".join(f"WHEN c{j} = 1 THEN s{j} / CAST(s{j} + c{j - 1} AS DOUBLE)" for j in range(2, depth + 1))
    sql = f"""WITH {EV}, o AS (SELECT nanos, event_id, {keys} AS k FROM ev WHERE object IS NOT NULL AND {take}), c AS (SELECT *, {counts} FROM o), s AS (SELECT *, {siblings} FROM c)
 SELECT event_id, array_to_string(k, '|') AS key, round(CASE WHEN c{depth - 1} <> 1 THEN s{depth} / CAST(s{depth} + c{depth - 1} AS DOUBLE) WHEN c1 = 1 THEN CASE WHEN c0 = 1 THEN 1.0 ELSE (s1 - 1) / CAST(s1 - 1 + c0 - 1 AS DOUBLE) END {new} END, 6) AS local_prob, round(1.0 / c0, 6) AS global_prob FROM s WHERE c{depth} = 1"""

    def run(spark, sf_dir):
        ev = event_frame(spark, sf_dir).where("object is not null").withColumn("kind", kind_of(F.col("event_type"))).where(take)
        key = F.expr("array(" + keys[1:-1].replace(" // 2", " div 2") + ")")
        obs = ev.select(F.lit(name).alias("tree"), *SEQ, key.alias("key"))
        found = novelty.alarms(novelty.observe(obs, seq=SEQ), SEQ)
        return found.select("event_id", F.array_join("key", "|").alias("key"), F.round("local_prob", 6).alias("local_prob"), F.round("global_prob", 6).alias("global_prob"))

    query(f"tree_{name}", sql)(run)


for _name, (_take, _keys) in TREES.items():
    tree(_name, _take, _keys)


@query("event_class_summary", f"""WITH {EV} SELECT subject, CASE kind WHEN 'EVENT_READ' THEN 'ReadEvents' WHEN 'EVENT_WRITE' THEN 'WriteEvents' WHEN 'EVENT_EXECUTE' THEN 'ExecutionEvents' WHEN 'EVENT_FORK' THEN 'ProcessTreeEvents' ELSE 'Unlink' END AS class, count(*) AS n,
 round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY subject) AS DOUBLE), 6) AS share FROM ev GROUP BY 1, 2""")
def event_class_summary(spark, sf_dir):
    ev = event_frame(spark, sf_dir).withColumn("class", novelty.event_class(kind_of(F.col("event_type"))))
    counts = ev.groupBy("subject", "class").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("subject")), 6))


@query("process_summaries")
def process_summaries(spark, sf_dir):
    """Every process's summary; nested merging is beyond a query, tests hold it against a walk over the tree."""
    found = novelty.summarize(novelty.snapshot(observations(spark, sf_dir)))
    return found.select("tree", F.array_join("path", "/").alias("path"), "count", F.round("share", 6).alias("share"))


@query("summarizable_processes", f"WITH {SNAP} SELECT tree, path, count, round(gp, 6) AS global_prob FROM sn WHERE level = 1")
def summarizable_processes(spark, sf_dir):
    found = novelty.summarizable(novelty.snapshot(observations(spark, sf_dir)))
    return found.select("tree", F.array_join("prefix", "|").alias("path"), "count", F.round("global_prob", 6).alias("global_prob"))


@query("most_novel_actions", f"WITH {SNAP} SELECT replace(substr(path, 4), '|', ' ') AS action, round(lp, 6) AS local_prob FROM sn WHERE children = 0 AND starts_with(path, 'u5|') ORDER BY lp, path LIMIT 10")
def most_novel_actions(spark, sf_dir):
    found = novelty.novel_actions(novelty.snapshot(observations(spark, sf_dir)), ["u5"], 10)
    return found.withColumn("local_prob", F.round("local_prob", 6))


@query("alarm_tree", f"WITH {OBS}, pr AS (SELECT tree, lp, unnest([k1, k1 || '|' || k2, k1 || '|' || k2 || '|' || k3]) AS path FROM al) SELECT tree, path, count(*) AS alarms, round(min(lp), 6) AS least FROM pr GROUP BY 1, 2")
def alarm_tree(spark, sf_dir):
    found = novelty.alarm_tree(alarm_rows(spark, sf_dir))
    return found.select("tree", F.array_join("prefix", "|").alias("path"), "alarms", F.round("least", 6).alias("least"))


def _shortened(name: str, make, obs: str) -> None:
    """A snapshot of two keys; ``obs`` gives its observations (tree, a, b)."""
    sql = f"""WITH {EV}, obs AS ({obs}), n AS (SELECT tree, '' AS path, 0 AS level, count(*) AS count, count(DISTINCT a) AS children FROM obs GROUP BY 1
 UNION ALL SELECT tree, a, 1, count(*), count(DISTINCT b) FROM obs GROUP BY 1, 2 UNION ALL SELECT tree, a || '|' || b, 2, count(*), 0 FROM obs GROUP BY 1, a, b)
 SELECT tree, path, level, count, children, round(count / CAST((SELECT p.count FROM n p WHERE p.tree = n.tree AND p.level = 0) AS DOUBLE), 6) AS global_prob FROM n"""

    def run(spark, sf_dir):
        found = make(novelty.snapshot(observations(spark, sf_dir)))
        return found.select("tree", F.array_join("prefix", "|").alias("path"), "level", "count", "children", F.round("global_prob", 6).alias("global_prob"))

    query(name, sql)(run)


_shortened("trie_eliminate_children", lambda t: reports.eliminate_level(t, 2), "SELECT 't' || (subject % 2) AS tree, 'u' || subject AS a, 'k' || object AS b FROM ev WHERE object IS NOT NULL")
_shortened("trie_merged_hosts", lambda t: reports.eliminate_level(reports.merge_trees(t, "all"), 1), "SELECT 'all' AS tree, kind AS a, 'k' || object AS b FROM ev WHERE object IS NOT NULL")
