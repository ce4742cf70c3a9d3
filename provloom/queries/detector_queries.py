"""Detectors, combination, evaluation, itemsets and rules on the tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors as d
from ..operators.forest import code_length_clusters, isolation_forest
from ..operators.graph import event_frame, kind_of
from ..session import checkpoint, table
from .registry import query
from .sql import EV


def ctx(spark, sf_dir) -> DataFrame:
    """Users' days and what their events were: kinds, objects modulo 4, bands of value and whether data moved."""
    ev = event_frame(spark, sf_dir).withColumn("o", F.concat_ws(":", F.col("subject").cast("string"), F.expr("nanos div 86400000000000").cast("string")))
    band = F.when(F.col("value") < 15, "v0").when(F.col("value") < 60, "v1").otherwise("v2")
    moves = F.when(F.col("event_type").isin("click", "purchase"), "io")  # what reads and writes have in common
    items = F.array(kind_of(F.col("event_type")), F.concat(F.lit("k"), (F.col("object") % 4).cast("string")), band, moves)
    return d.context(ev.select("o", F.explode(items).alias("a")), "o", "a")


CTX = EV + """, ctx AS (SELECT DISTINCT o AS object, a AS attribute FROM (SELECT subject || ':' || (nanos // 86400000000000) AS o,
 unnest([kind, 'k' || (object % 4), CASE WHEN value < 15 THEN 'v0' WHEN value < 60 THEN 'v1' ELSE 'v2' END, CASE WHEN kind IN ('EVENT_READ', 'EVENT_WRITE') THEN 'io' END]) AS a FROM ev) WHERE a IS NOT NULL),
nn AS (SELECT count(DISTINCT object) AS n FROM ctx), fr AS (SELECT attribute, count(*) AS f FROM ctx GROUP BY 1)"""


def score(name: str, f, sql: str) -> None:
    query(name, f"WITH {CTX} {sql}")(lambda spark, sf_dir: f(ctx(spark, sf_dir)).select("object", F.round("score", 6).alias("score")))


GRID = "FROM (SELECT DISTINCT object FROM ctx) o CROSS JOIN fr CROSS JOIN nn LEFT JOIN ctx c ON c.object = o.object AND c.attribute = fr.attribute GROUP BY 1"
score("avf", d.avf, f"SELECT o.object, round(sum(CASE WHEN c.object IS NULL THEN 1 - f / CAST(n AS DOUBLE) ELSE f / CAST(n AS DOUBLE) END), 6) AS score {GRID}")
score("avc", d.avc, f"SELECT o.object, round(sum(-ln(CASE WHEN c.object IS NULL THEN 1 - (f + 1) / (n + 2.0) ELSE (f + 1) / (n + 2.0) END) / ln(2.0)), 6) AS score {GRID}")
score("rasp", d.rasp, "SELECT c.object, round(sum(-ln(f / CAST((SELECT count(*) FROM ctx) + n AS DOUBLE)) / ln(2.0)) + max(-ln(n / CAST((SELECT count(*) FROM ctx) + n AS DOUBLE)) / ln(2.0)), 6) AS score FROM ctx c JOIN fr USING (attribute) CROSS JOIN nn GROUP BY 1")


@query("avc_online", f"WITH {EV} SELECT event_id, round(-ln((row_number() OVER (PARTITION BY subject % 8, kind ORDER BY nanos, event_id)) / CAST(row_number() OVER (PARTITION BY subject % 8 ORDER BY nanos, event_id) + 1 AS DOUBLE)) / ln(2.0), 6) AS bits FROM ev")
def avc_online(spark, sf_dir):
    ev = event_frame(spark, sf_dir).withColumns({"kind": kind_of(F.col("event_type")), "part": F.col("subject") % 8})
    return d.prequential(ev, ["nanos", "event_id"], "kind", ["part"]).select("event_id", F.round("bits", 6).alias("bits"))


@query("context_dense", f"WITH {CTX} SELECT object, count(*) FILTER (attribute = 'k1') AS k1, count(*) FILTER (attribute = 'k2') AS k2, count(*) FILTER (attribute = 'v2') AS v2 FROM ctx GROUP BY 1")
def context_dense(spark, sf_dir):
    return d.dense(ctx(spark, sf_dir), ["k1", "k2", "v2"])


@query("context_join", f"WITH {CTX} SELECT object, 'X0_' || attribute AS attribute FROM ctx UNION ALL SELECT DISTINCT subject || '', 'X1_' || kind FROM ev")
def context_join(spark, sf_dir):
    kinds = d.context(event_frame(spark, sf_dir).select(F.col("subject").cast("string").alias("subject"), kind_of(F.col("event_type")).alias("kind")), "subject", "kind")
    return d.join_contexts(ctx(spark, sf_dir), kinds)


@query("event_type_matrix", f"WITH {EV} SELECT subject, count(*) FILTER (kind = 'EVENT_READ') AS EVENT_READ, count(*) FILTER (kind = 'EVENT_WRITE') AS EVENT_WRITE, count(*) FILTER (kind = 'EVENT_FORK') AS EVENT_FORK, count(*) FILTER (kind = 'EVENT_UNLINK') AS EVENT_UNLINK, count(*) FILTER (kind = 'EVENT_EXECUTE') AS EVENT_EXECUTE FROM ev GROUP BY 1")
def event_type_matrix(spark, sf_dir):
    ev = event_frame(spark, sf_dir).withColumn("kind", kind_of(F.col("event_type")))
    return ev.groupBy("subject").pivot("kind", ["EVENT_READ", "EVENT_WRITE", "EVENT_FORK", "EVENT_UNLINK", "EVENT_EXECUTE"]).count().na.fill(0)


@query("event_type_shares", f"WITH {EV} SELECT subject, round(count(*) FILTER (kind = 'EVENT_READ') / CAST(count(*) AS DOUBLE), 6) AS reads, round(count(*) FILTER (kind = 'EVENT_WRITE') / CAST(count(*) AS DOUBLE), 6) AS writes FROM ev GROUP BY 1")
def event_type_shares(spark, sf_dir):
    m = event_type_matrix(spark, sf_dir)
    total = sum((F.col(c) for c in m.columns[1:]), F.lit(0))
    return m.select("subject", F.round(F.col("EVENT_READ") / total, 6).alias("reads"), F.round(F.col("EVENT_WRITE") / total, 6).alias("writes"))


def ranks(spark, sf_dir) -> DataFrame:
    """Users ranked by count of events, by sum and by greatest value; the last ranks only every other user."""
    by = event_frame(spark, sf_dir).groupBy(F.col("subject").alias("object")).agg(F.count("*").cast("double").alias("count"), F.round(F.sum("value"), 2).alias("sum"), F.max("value").alias("most"))
    parts = [by.select(F.lit(m).alias("model"), "object", F.col(m).alias("score")).where("object % 2 = 0" if m == "most" else "true") for m in ("count", "sum", "most")]
    return d.ranked(parts[0].union(parts[1]).union(parts[2]), ["model"])


RANKS = EV + """, b AS (SELECT subject AS object, CAST(count(*) AS DOUBLE) AS c, round(sum(value), 2) AS s, max(value) AS m FROM ev GROUP BY 1),
sc AS (SELECT 'count' AS model, object, c AS score FROM b UNION ALL SELECT 'sum', object, s FROM b UNION ALL SELECT 'most', object, m FROM b WHERE object % 2 = 0),
ra AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, object) AS rank FROM sc),
sz AS (SELECT model, count(*) AS missing FROM ra GROUP BY 1),
fu AS (SELECT o.object, sz.model, CAST(coalesce(ra.rank, missing) AS DOUBLE) AS rank FROM (SELECT DISTINCT object FROM ra) o CROSS JOIN sz LEFT JOIN ra ON ra.object = o.object AND ra.model = sz.model)"""


@query("score_ranks", f"WITH {RANKS} SELECT model, object, CAST(rank AS INT) AS rank FROM ra")
def score_ranks(spark, sf_dir):
    return ranks(spark, sf_dir).select("model", "object", "rank")


for _how, _value in {
    "uniform": "avg(rank)", "weighted": "sum(CASE WHEN model = 'sum' THEN 3.0 ELSE 1.0 END * rank) / sum(CASE WHEN model = 'sum' THEN 3.0 ELSE 1.0 END)",
    "geometric": "exp(avg(ln(rank)))", "median": "quantile_cont(rank, 0.5)", "minrank": "min(rank)",
}.items():
    query(f"combine_{_how}", f"WITH {RANKS} SELECT object, round({_value}, 6) AS score FROM fu GROUP BY 1")(
        lambda spark, sf_dir, how=_how: d.combine(ranks(spark, sf_dir), how, {"sum": 3.0} if how == "weighted" else None).select("object", F.round("score", 6).alias("score"))
    )
for _how, _value in {"average": "avg(score)", "maxscore": "max(score)"}.items():
    query(f"combine_{_how}", f"WITH {RANKS} SELECT object, round({_value}, 6) AS score FROM sc GROUP BY 1")(
        lambda spark, sf_dir, how=_how: d.combine(ranks(spark, sf_dir), how).select("object", F.round("score", 6).alias("score"))
    )


@query("ndcg_auc", f"""WITH {RANKS}, t AS (SELECT DISTINCT subject AS object FROM ev WHERE kind = 'EVENT_UNLINK' AND object % 17 = 3),
 n AS (SELECT model, CAST(count(*) AS DOUBLE) AS n FROM ra GROUP BY 1),
 h AS (SELECT ra.model, n, count(*) AS hits, sum(ln(2.0) / ln(rank + 1)) AS dcg, sum(greatest(0, n - rank)) AS area FROM ra JOIN t USING (object) JOIN n ON n.model = ra.model GROUP BY 1, 2)
 SELECT model, hits, round(dcg / (SELECT sum(ln(2.0) / ln(i + 1)) FROM range(1, hits + 1) r(i)), 6) AS ndcg, round(area / (hits * n), 6) AS auc FROM h""")
def ndcg_auc(spark, sf_dir):
    truth = event_frame(spark, sf_dir).where("event_type = 'error' and object % 17 = 3").select(F.col("subject").alias("object"))
    found = d.evaluate(ranks(spark, sf_dir), truth)
    return found.select("model", "hits", F.round("ndcg", 6).alias("ndcg"), F.round("auc", 6).alias("auc"))


@query("tp_fp_curve", f"""WITH {RANKS}, t AS (SELECT DISTINCT subject AS object FROM ev WHERE kind = 'EVENT_UNLINK' AND object % 17 = 3), th AS (SELECT i / 20.0::DOUBLE AS thr FROM range(1, 20) r(i)),
 p AS (SELECT model, object, rank / CAST(count(*) OVER (PARTITION BY model) AS DOUBLE) AS share FROM ra)
 SELECT p.model, CAST(round(thr * 20) AS INT) AS step, count(*) FILTER (t.object IS NOT NULL) AS tp, count(*) FILTER (t.object IS NULL) AS fp FROM p JOIN th ON share <= thr + 1e-9 LEFT JOIN t ON t.object = p.object GROUP BY 1, 2""")
def tp_fp_curve(spark, sf_dir):
    """True and false alarms at each threshold: each alarm counts from the first threshold that it passes on."""
    truth = event_frame(spark, sf_dir).where("event_type = 'error' and object % 17 = 3").select(F.col("subject").alias("object")).distinct().withColumn("true", F.lit(1))
    r = ranks(spark, sf_dir)
    n = r.groupBy("model").agg(F.count("*").alias("n"))
    first = F.greatest(F.lit(1), F.ceil(F.col("rank") / F.col("n") * 20 - 1e-7)).cast("int")
    seen = r.join(n, "model").join(truth, "object", "left").where(F.col("rank") / F.col("n") <= 0.95 + 1e-9)
    return (
        seen.withColumn("step", F.explode(F.sequence(first, F.lit(19))))
        .groupBy("model", "step").agg(F.count("true").alias("tp"), F.count(F.when(F.col("true").isNull(), 1)).alias("fp"))
    )


#: Frequent sets by growing each by a greater item, with the lists of objects that have them.
ITEMS = "RECURSIVE " + CTX + """, ls AS (SELECT ceil(SHARE * n) AS least FROM nn), ob AS (SELECT object, list_sort(list(attribute)) AS has FROM ctx GROUP BY 1),
v1 AS MATERIALIZED (SELECT attribute AS a, list_sort(list(object)) AS objs FROM ctx GROUP BY 1 HAVING count(*) >= (SELECT least FROM ls)),
gr AS (SELECT [a] AS items, objs FROM v1 UNION ALL SELECT items, objs FROM (SELECT list_append(g.items, v.a) AS items, list_intersect(g.objs, v.objs) AS objs FROM gr g JOIN v1 v ON v.a > g.items[-1]) WHERE len(objs) >= (SELECT least FROM ls)),
st AS MATERIALIZED (SELECT items, len(objs) AS support FROM gr),
cl AS MATERIALIZED (SELECT items, support FROM st a WHERE NOT EXISTS (SELECT 1 FROM st b WHERE b.support = a.support AND len(b.items) > len(a.items) AND list_has_all(b.items, a.items)))"""
SHARE, CONFIDENCE = 0.04, 0.6
ITEMS = ITEMS.replace("SHARE", str(SHARE))


def sets(spark, sf_dir) -> DataFrame:
    return checkpoint(d.itemsets(ctx(spark, sf_dir), SHARE))  # each use of the sets would mine them again


def objects(spark, sf_dir) -> int:
    return ctx(spark, sf_dir).select("object").distinct().count()


@query("itemsets", f"WITH {ITEMS} SELECT array_to_string(items, ',') AS items, support FROM st")
def itemsets(spark, sf_dir):
    return d.itemsets(ctx(spark, sf_dir), SHARE).select(F.array_join("items", ",").alias("items"), "support")


@query("closed_itemsets", f"WITH {ITEMS} SELECT array_to_string(items, ',') AS items, support FROM cl")
def closed_itemsets(spark, sf_dir):
    return d.closed(sets(spark, sf_dir)).select(F.array_join("items", ",").alias("items"), "support")


RULES = ITEMS + f""", ru AS (SELECT list_filter(s.items, lambda q: q <> y) AS x, y, s.support, l.support AS sx, r.support AS sy, (SELECT CAST(n AS DOUBLE) FROM nn) AS n
 FROM (SELECT items, support, unnest(items) AS y FROM st WHERE len(items) > 1) s JOIN st l ON l.items = list_filter(s.items, lambda q: q <> y) JOIN st r ON len(r.items) = 1 AND r.items[1] = y
 WHERE s.support / CAST(l.support AS DOUBLE) > {CONFIDENCE})"""
_MEASURES = {
    "confidence": "support / CAST(sx AS DOUBLE)", "lift": "support / n / (sx / n * sy / n)", "leverage": "support / n - sx / n * sy / n", "jaccard": "support / (sx + sy - support + 0.0)",
    "kulczynski": "(support / CAST(sx AS DOUBLE) + support / CAST(sy AS DOUBLE)) / 2", "klosgen": "sqrt(support / n) * (support / CAST(sx AS DOUBLE) - sy / n)",
    "imbalance": "abs(sx / n - sy / n) / (sx / n + sy / n - support / n)", "rpf": "(support / n) * (support / n) / (sx / n)", "cosine": "support / n / sqrt(sx / n * sy / n)",
    "added_value": "support / CAST(sx AS DOUBLE) - sy / n", "counter_rate": "1 - (1 - support / CAST(sx AS DOUBLE)) / (support / n)", "lerman": "(support * n - CAST(sx * sy AS DOUBLE)) / n / sqrt(CAST(sx * sy AS DOUBLE))",
    "loevinger": "1 - (sx / n - support / n) / (sx / n * (1 - sy / n))",
}


def found_rules(spark, sf_dir) -> DataFrame:
    return checkpoint(d.rules(sets(spark, sf_dir), CONFIDENCE, objects(spark, sf_dir)))


@query("rules", f"WITH {RULES} SELECT array_to_string(x, ',') AS x, y, support, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _MEASURES.items()) + " FROM ru")
def rules(spark, sf_dir):
    found = d.rules(sets(spark, sf_dir), CONFIDENCE, objects(spark, sf_dir))
    return found.select(F.array_join("x", ",").alias("x"), "y", "support", *[F.round(k, 6).alias(k) for k in _MEASURES])


COVERS = ITEMS + """, pr AS (SELECT a.items AS x, a.support AS sx, b.items AS z, b.support FROM cl a JOIN cl b ON len(b.items) > len(a.items) AND list_has_all(b.items, a.items)),
cv AS MATERIALIZED (SELECT x, list_filter(z, lambda q: NOT list_contains(x, q)) AS y, sx, support FROM pr p WHERE NOT EXISTS (SELECT 1 FROM pr q JOIN pr r ON q.z = r.x WHERE q.x = p.x AND r.z = p.z)),
cr AS MATERIALIZED (SELECT x, y, cv.support, cv.support / CAST(sx AS DOUBLE) AS confidence, cv.support * (SELECT n FROM nn) / CAST(sx * s.support AS DOUBLE) AS lift FROM cv JOIN st s ON s.items = y)"""


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"), "support", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


def _subsumed(rows: str, narrow: bool) -> str:
    right = "list_has_all(a.y, b.y)" if narrow else "list_has_all(b.y, a.y)"
    return f"SELECT array_to_string(x, ',') AS x, array_to_string(y, ',') AS y, support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM {rows} a WHERE NOT EXISTS (SELECT 1 FROM {rows} b WHERE list_has_all(a.x, b.x) AND {right} AND (a.x <> b.x OR a.y <> b.y))"


@query("implications", f"WITH {COVERS}, hi AS MATERIALIZED (SELECT * FROM cr WHERE confidence > 0.5) {_subsumed('hi', False)}")
def implications(spark, sf_dir):
    return _named(d.implications(sets(spark, sf_dir), 0.5, objects(spark, sf_dir)))


@query("anti_implications", f"WITH {COVERS}, lo AS MATERIALIZED (SELECT * FROM cr WHERE confidence < 0.4) {_subsumed('lo', True)}")
def anti_implications(spark, sf_dir):
    return _named(d.anti_implications(sets(spark, sf_dir), 0.4, objects(spark, sf_dir)))


@query("exact_rules", f"""WITH {ITEMS}, ex AS MATERIALIZED (SELECT a.items AS x, list_filter(z.items, lambda q: NOT list_contains(a.items, q)) AS y, a.support FROM st a JOIN cl z ON z.support = a.support AND len(z.items) > len(a.items) AND list_has_all(z.items, a.items))
 SELECT array_to_string(x, ',') AS x, array_to_string(y, ',') AS y, support FROM ex a WHERE NOT EXISTS (SELECT 1 FROM ex b WHERE list_has_all(a.x, b.x) AND list_has_all(b.y, a.y) AND (a.x <> b.x OR a.y <> b.y))""")
def exact_rules(spark, sf_dir):
    return d.exact_rules(sets(spark, sf_dir)).select(F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"), "support")


@query("disjoint_items", f"WITH {ITEMS} SELECT a.items[1] AS x, b.items[1] AS y FROM st a JOIN st b ON len(a.items) = 1 AND len(b.items) = 1 AND a.items[1] < b.items[1] WHERE NOT EXISTS (SELECT 1 FROM st c WHERE c.items = [a.items[1], b.items[1]])".replace(str(SHARE), "0.25"))
def disjoint_items(spark, sf_dir):
    return d.disjoint_items(checkpoint(d.itemsets(ctx(spark, sf_dir), 0.25)))


HELD = RULES


@query("fpof", f"WITH {HELD} SELECT object, round(coalesce(coalesce((SELECT sum(support) FROM st WHERE list_has_all(has, items) AND len(items) < len(has)), 0) / (SELECT CAST(n AS DOUBLE) FROM nn) / (SELECT nullif(count(*), 0) FROM st), 0), 6) AS score FROM ob")
def fpof(spark, sf_dir):
    return d.fpof(ctx(spark, sf_dir), sets(spark, sf_dir)).select("object", F.round("score", 6).alias("score"))


@query("outlier_degree", f"WITH {HELD}, ad AS (SELECT object, count(DISTINCT y) AS more FROM ob JOIN ru ON list_has_all(has, x) AND NOT list_contains(has, y) GROUP BY 1) SELECT object, round(coalesce(more, 0) / CAST(len(has) + coalesce(more, 0) AS DOUBLE), 6) AS score FROM ob LEFT JOIN ad USING (object)")
def outlier_degree(spark, sf_dir):
    return d.outlier_degree(ctx(spark, sf_dir), found_rules(spark, sf_dir)).select("object", F.round("score", 6).alias("score"))


@query("rule_violations", f"WITH {HELD} SELECT object, round(sum(-ln(greatest(1 - support / CAST(sx AS DOUBLE), 1e-9)) / ln(2.0)), 5) AS bits, round(max(support / n / (sx / n * sy / n)), 6) AS lift, count(*) AS rules FROM ob JOIN ru ON list_has_all(has, x) AND NOT list_contains(has, y) GROUP BY 1")
def rule_violations(spark, sf_dir):
    return d.violations(ctx(spark, sf_dir), found_rules(spark, sf_dir)).select("object", F.round("bits", 5).alias("bits"), F.round("lift", 6).alias("lift"), "rules")


@query("cover_cost")
def cover_cost(spark, sf_dir):
    """Each object's code length under a table of the closed sets of two items and more; a fold in each row, tested beside a plain cover."""
    codes = d.closed(sets(spark, sf_dir)).where("size(items) > 1")
    return d.cover_cost(ctx(spark, sf_dir), codes).select("object", F.round("bits", 5).alias("bits"))


@query("isolation_measures", "SELECT n_nationkey + 2 AS n, round(2 * (ln(n_nationkey + 1.0) + 0.5772156649 - (n_nationkey + 1.0) / (n_nationkey + 2.0)), 6) AS c, round(pow(2.0, -3.0 / (2 * (ln(n_nationkey + 1.0) + 0.5772156649 - (n_nationkey + 1.0) / (n_nationkey + 2.0)))), 6) AS score FROM nation")
def isolation_measures(spark, sf_dir):
    n = F.col("n_nationkey") + 2
    return table(spark, sf_dir, "nation").select(n.alias("n"), F.round(d.average_path(n), 6).alias("c"), F.round(d.isolation_score(F.lit(3.0), n), 6).alias("score"))


@query("isolation_forest")
def forest(spark, sf_dir):
    m = event_type_matrix(spark, sf_dir)
    return isolation_forest(m, m, "subject", m.columns[1:])


@query("code_length_clusters")
def clusters(spark, sf_dir):
    return code_length_clusters(ctx(spark, sf_dir), 3)


@query("percentile_scores", f"WITH {RANKS} SELECT model, object, round(percent_rank() OVER (PARTITION BY model ORDER BY score), 6) AS percentile FROM sc")
def percentile_scores(spark, sf_dir):
    return d.percent_ranks(ranks(spark, sf_dir).select("model", "object", "score"), ["model"]).select("model", "object", F.round("percentile", 6).alias("percentile"))
