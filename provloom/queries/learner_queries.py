"""Diagnosis by fuzzy matching, online learners, rare rules, fitted percentiles and mean-shift on the tables; SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnosis, fits, online, rare
from ..operators import detectors as d
from ..operators.graph import event_frame, kind_of
from ..session import checkpoint, shared_folder
from ..streaming import jobs, stores
from .detector_queries import CTX, RANKS, ctx, ranks
from .registry import query
from .sql import EV

PATTERN = ["EVENT_READ", "EVENT_EXECUTE", "EVENT_WRITE"]

#: Processes of the tree by what they do most: the kind's share is its confidence.
PROCESSES = EV + """, kc AS (SELECT subject AS s, kind, count(*) AS n FROM ev GROUP BY 1, 2),
pr AS (SELECT s, max_by(kind, (n, kind)) AS label, round(max(n) / CAST(sum(n) AS DOUBLE), 4) AS c FROM kc GROUP BY 1)"""


def processes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    kinds = event_frame(spark, sf_dir).groupBy("subject", kind_of(F.col("event_type")).alias("kind")).agg(F.count("*").alias("n"))
    most = kinds.groupBy("subject").agg(F.max(F.struct("n", "kind")).alias("m"), F.sum("n").alias("all"))
    nodes = most.select(F.concat(F.lit("u"), "subject").alias("id"), F.col("m.kind").alias("label"), F.round(F.col("m.n") / F.col("all"), 4).alias("confidence"))
    edges = most.where("subject > 0").select(F.expr("concat('u', subject div 2)").alias("src"), F.concat(F.lit("u"), "subject").alias("dst"))
    return nodes, edges


def _step_sql(v: list[str]) -> str:
    """Scores of a node from those of its only parent: columns f* with the label unused, u* with it used."""
    on = lambda x, by: f"CASE WHEN {x} > 0.05 THEN {x} * {by} ELSE 0 END"
    met = lambda i, x: f"CASE WHEN label = '{PATTERN[i]}' THEN {on(x, 'c')} ELSE 0 END"
    one = f"SELECT s, label, c, {', '.join(f'{x} AS v{i}' for i, x in enumerate(v, 1))}, greatest({v[0]}, 0.1) AS f1 FROM "
    return one + f"""{{rows}}""", [
        f"SELECT *, greatest(f1, {met(0, '1.0')}) AS u1, greatest(v2, {on('f1', '0.1')}) AS f2 FROM ({{inner}})",
        f"SELECT *, greatest(f2, {met(1, 'f1')}, {on('u1', '0.1')}) AS u2, greatest(v3, {on('f2', '0.1')}) AS f3 FROM ({{inner}})",
        f"SELECT s, u1, u2, greatest(f3, {met(2, 'f2')}, {on('u2', '0.1')}) AS u3 FROM ({{inner}})",
    ]


def _walk_sql(v: list[str], rows: str) -> str:
    start, steps = _step_sql(v)
    out = start.format(rows=rows)
    for step in steps:
        out = step.format(inner=out)
    return out


_ROOTS = "(SELECT * FROM pr WHERE s = 0 OR s // 2 NOT IN (SELECT s FROM pr))"
_CHILDREN = "(SELECT pr.*, t.u1, t.u2, t.u3 FROM t JOIN pr ON pr.s // 2 = t.s AND pr.s > 0)"
FUZZY = f"{PROCESSES}, t(s, u1, u2, u3) AS ({_walk_sql(['CAST(0 AS DOUBLE)'] * 3, _ROOTS)} UNION ALL {_walk_sql(['u1', 'u2', 'u3'], _CHILDREN)})"


@query("fuzzy_states", f"WITH RECURSIVE {FUZZY} SELECT 'u' || s AS id, round(u1, 6) AS first, round(u2, 6) AS second, round(u3, 6) AS score FROM t")
def fuzzy_states(spark, sf_dir):
    """How well each process and what led to it match read, execute, write, with jumps."""
    found = diagnosis.fuzzy_states(*processes(spark, sf_dir), PATTERN)
    return found.select("id", F.round(F.get("state", F.lit(1)), 6).alias("first"), F.round(F.get("state", F.lit(2)), 6).alias("second"), F.round("score", 6).alias("score"))


_MATCHES = " UNION ALL ".join([
    f"SELECT a.c * b.c * d.c AS score, ['u' || a.s, 'u' || b.s, 'u' || d.s] AS path FROM up x JOIN up y ON x.s = y.a JOIN pr a ON a.s = x.a JOIN pr b ON b.s = x.s JOIN pr d ON d.s = y.s WHERE a.label = '{PATTERN[0]}' AND b.label = '{PATTERN[1]}' AND d.label = '{PATTERN[2]}'",
    f"SELECT a.c * b.c * 0.1, ['u' || a.s, 'u' || b.s, ''] FROM up x JOIN pr a ON a.s = x.a JOIN pr b ON b.s = x.s WHERE a.label = '{PATTERN[0]}' AND b.label = '{PATTERN[1]}'",
    f"SELECT a.c * b.c * 0.1, ['u' || a.s, '', 'u' || b.s] FROM up x JOIN pr a ON a.s = x.a JOIN pr b ON b.s = x.s WHERE a.label = '{PATTERN[0]}' AND b.label = '{PATTERN[2]}'",
    f"SELECT a.c * b.c * 0.1, ['', 'u' || a.s, 'u' || b.s] FROM up x JOIN pr a ON a.s = x.a JOIN pr b ON b.s = x.s WHERE a.label = '{PATTERN[1]}' AND b.label = '{PATTERN[2]}'",
])


@query("ranked_diagnoses", f"WITH RECURSIVE {PROCESSES}, up(s, a) AS (SELECT s, s // 2 FROM pr WHERE s > 0 AND s // 2 IN (SELECT s FROM pr) UNION ALL SELECT up.s, up.a // 2 FROM up WHERE up.a > 0 AND up.a // 2 IN (SELECT s FROM pr)), m AS ({_MATCHES}), r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS rank FROM m WHERE score > 0.05) SELECT CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, array_to_string(path, '>') AS path FROM r WHERE rank <= 20")
def ranked_diagnoses(spark, sf_dir):
    """The twenty best ways through the process tree that read, execute and write; an empty place was jumped."""
    found = diagnosis.ranked_diagnoses(*processes(spark, sf_dir), PATTERN, k=20)
    return found.select("rank", F.round("score", 6).alias("score"), F.array_join("path", ">", "").alias("path"))


# Online learners


def cells(spark, sf_dir) -> DataFrame:
    """Events as records of several attributes: kind, object, band of value, and whether data moved."""
    ev = event_frame(spark, sf_dir)
    band = F.when(F.col("value") < 15, "v0").when(F.col("value") < 60, "v1").otherwise("v2")
    moves = F.when(F.col("event_type").isin("click", "purchase"), "io")
    items = F.array_compact(F.array(kind_of(F.col("event_type")), F.concat(F.lit("k"), F.col("object")), band, moves))
    return ev.select(F.col("event_id").alias("object"), F.col("event_id").alias("seq"), F.explode_outer(F.array_distinct(items)).alias("attribute"))


CELLS = EV + """, ce AS (SELECT event_id AS object, unnest(list_distinct(list_filter([kind, 'k' || object, CASE WHEN value < 15 THEN 'v0' WHEN value < 60 THEN 'v1' ELSE 'v2' END, CASE WHEN kind IN ('EVENT_READ', 'EVENT_WRITE') THEN 'io' END], lambda x: x IS NOT NULL))) AS attribute FROM ev),
oc AS (SELECT object, count(*) AS own FROM ce GROUP BY 1), rc AS (SELECT object, own, row_number() OVER (ORDER BY object) - 1 AS n, sum(own) OVER (ORDER BY object) - own AS total FROM oc),
fc AS (SELECT object, attribute, row_number() OVER (PARTITION BY attribute ORDER BY object) - 1 AS f FROM ce), aa AS (SELECT count(DISTINCT attribute) AS a FROM ce)"""


@query("avf_online", f"WITH {CELLS} SELECT rc.object, round(max(a - (total + a) / CAST(n + 2 AS DOUBLE)) + sum(2 * (f + 1) / CAST(n + 2 AS DOUBLE) - 1), 6) AS score FROM rc JOIN fc USING (object) CROSS JOIN aa GROUP BY 1")
def avf_online(spark, sf_dir):
    return online.avf_online(cells(spark, sf_dir), "seq").select("object", F.round("score", 6).alias("score"))


@query("rasp_online", f"WITH {CELLS} SELECT rc.object, round(sum(CASE WHEN f > 0 THEN -ln((f + 1) / CAST(n + total + 4 AS DOUBLE)) ELSE ln(CAST(n + total + 2 AS DOUBLE)) END) / ln(2.0) + max(-ln((n + 1) / CAST(n + total + 2 AS DOUBLE)) / ln(2.0)), 6) AS score FROM rc JOIN fc USING (object) GROUP BY 1")
def rasp_online(spark, sf_dir):
    return online.rasp_online(cells(spark, sf_dir), "seq").select("object", F.round("score", 6).alias("score"))


#: The attributes that KL-stream codes.
ATTRIBUTES = ["EVENT_EXECUTE", "EVENT_FORK", "EVENT_READ", "EVENT_UNLINK", "EVENT_WRITE", "io", "v0", "v1", "v2"]


@query("stream_kl_clusters")
def stream_kl_clusters(spark, sf_dir):
    """Each host's events coded by the clusters that its stream has opened; a fold, tested beside a plain one."""
    ev = jobs.event_stream(spark, sf_dir)
    band = F.when(F.col("value") < 15, "v0").when(F.col("value") < 60, "v1").otherwise("v2")
    items = F.array_compact(F.array(kind_of(F.col("event_type")), band, F.when(F.col("event_type").isin("click", "purchase"), "io")))
    rows = ev.select((F.col("subject") % 10).alias("host"), "event_id", items.alias("items"))
    folder = f"{shared_folder(spark)}/kl-{uuid.uuid4().hex}"
    return stores.run_to_end(online.kl_stream(rows, "host", "event_id", "items", ATTRIBUTES), folder)


@query("online_forest")
def online_forest(spark, sf_dir):
    """Events scored by a forest whose leaf counts are those of the thousand events before; tested beside a plain fold."""
    ev = event_frame(spark, sf_dir).select("event_id", "value", (F.col("nanos") / 3_600_000_000_000 % 24).alias("hour"), F.col("object").cast("double").alias("object"))
    return online.online_forest(ev, "event_id", ["value", "hour", "object"], window=1000, trees=25, sample=128)


# Rare rules, percentiles, clusters


LEAST = 0.1
_FREQUENT = f"""{CTX}, th AS (SELECT CAST(ceil({LEAST} * n) AS BIGINT) AS least FROM nn), ob AS (SELECT object, list(attribute) AS has FROM ctx GROUP BY 1),
sz(items, objects) AS (SELECT [attribute], list(object) FROM ctx GROUP BY attribute UNION ALL
 SELECT list_append(items, attribute), list(x) FROM (SELECT items, unnest(objects) AS x FROM sz WHERE len(objects) >= (SELECT least FROM th)) e JOIN ctx ON object = x AND attribute > items[-1] GROUP BY items, attribute),
al AS MATERIALIZED (SELECT items, objects, len(objects) AS support FROM sz), fq AS (SELECT items FROM al, th WHERE support >= least), ra AS (SELECT items, objects, support FROM al, th WHERE support < least),
mi AS MATERIALIZED (SELECT * FROM ra WHERE len(items) = 1 OR (SELECT count(*) FROM (SELECT unnest(items) AS d) u WHERE list_filter(items, lambda i: i <> d) IN (SELECT items FROM fq)) = len(items)),
cl AS (SELECT items, support, list_sort(list(attribute)) AS closure FROM (SELECT m.items, m.support, attribute FROM (SELECT items, support, unnest(objects) AS object FROM mi) m JOIN ctx USING (object) GROUP BY 1, 2, 3 HAVING count(*) = support) GROUP BY 1, 2)"""


def frequent(spark, sf_dir) -> DataFrame:
    return checkpoint(d.itemsets(ctx(spark, sf_dir), LEAST))


@query("rare_itemsets", f"WITH RECURSIVE {_FREQUENT} SELECT array_to_string(items, ',') AS items, support, array_to_string(closure, ',') AS closure FROM cl")
def rare_itemsets(spark, sf_dir):
    """Minimal itemsets that fewer than a tenth of the users' days have, of any size, with their closures."""
    found = rare.rare_itemsets(ctx(spark, sf_dir), frequent(spark, sf_dir))
    return found.select(F.array_join("items", ",").alias("items"), "support", F.array_join("closure", ",").alias("closure"))


@query("rare_rules_of_any_size", f"WITH RECURSIVE {_FREQUENT}, ru AS (SELECT items AS x, list_filter(closure, lambda i: NOT list_contains(items, i)) AS y, support FROM cl), yy AS (SELECT DISTINCT y FROM ru WHERE len(y) > 0), sy AS (SELECT y, count(*) AS s FROM yy JOIN ob ON list_has_all(has, y) GROUP BY 1) SELECT array_to_string(x, ',') AS x, array_to_string(y, ',') AS y, support, round((SELECT n FROM nn) / CAST(s AS DOUBLE), 6) AS lift FROM ru JOIN sy USING (y)")
def rare_rules_of_any_size(spark, sf_dir):
    found = rare.rare_rules_of_any_size(ctx(spark, sf_dir), frequent(spark, sf_dir))
    return found.select(F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"), "support", F.round("lift", 6).alias("lift"))


@query("fitted_percentiles")
def fitted_percentiles(spark, sf_dir):
    """Users' scores of three models as percentiles of the best fitting distribution; tested beside numeric fits."""
    found = fits.fitted_percentiles(ranks(spark, sf_dir).select("model", F.col("object").cast("string").alias("object"), "score"))
    return found.withColumn("percentile", F.round("percentile", 6))


@query("user_clusters")
def user_clusters(spark, sf_dir):
    """Users by mean value and number of events, on a common scale, clustered by mean-shift; tested beside a plain version."""
    users = event_frame(spark, sf_dir).groupBy("subject").agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("events"))
    scale = users.agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("ms"), F.avg("events").alias("e"), F.stddev_pop("events").alias("es"))
    points = users.join(F.broadcast(scale), F.lit(True)).select("subject", F.try_divide(F.col("mean") - F.col("m"), F.col("ms")).alias("mean"), F.try_divide(F.col("events") - F.col("e"), F.col("es")).alias("events"))  # one row
    return fits.mean_shift(points, "subject", ["mean", "events"], 1.0)
