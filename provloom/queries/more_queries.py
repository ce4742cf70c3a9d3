"""Rare rules, class splits, estimators, recomputed probabilities, forests by group and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as d
from ..operators import forest, novelty
from ..operators.graph import event_frame, kind_of
from ..session import table
from .detector_queries import CTX, ctx, event_type_matrix
from .novelty_queries import OBS, SEQ, SNAP, observations
from .registry import query
from .sql import EV

_RARE = EV + ", cx AS (SELECT DISTINCT subject AS object, kind || object || ':' || (nanos // 3600000000000 % 24) AS attribute FROM ev WHERE object IS NOT NULL), cf AS (SELECT attribute, count(*) AS f FROM cx GROUP BY 1)"


@query("rare_rules", f"WITH {_RARE} SELECT p.x, p.y, support, round((SELECT count(DISTINCT object) FROM cx) / CAST(b.f AS DOUBLE), 6) AS lift FROM (SELECT a.attribute AS x, b.attribute AS y, count(*) AS support FROM cx a JOIN cx b ON a.object = b.object AND a.attribute <> b.attribute GROUP BY 1, 2) p JOIN cf a ON a.attribute = p.x JOIN cf b ON b.attribute = p.y WHERE a.f BETWEEN 2 AND 3 AND support = a.f")
def rare_rules(spark, sf_dir):
    rows = event_frame(spark, sf_dir).where("object is not null")
    attribute = F.concat(kind_of(F.col("event_type")), "object", F.lit(":"), F.expr("nanos div 3600000000000 % 24"))
    found = d.rare_rules(d.context(rows.withColumn("a", attribute), "subject", "a"), 3, 2)
    return found.withColumn("lift", F.round("lift", 6))


@query("split_merge", f"""WITH {CTX}, cl AS (SELECT object, CAST(split_part(object, ':', 1) AS BIGINT) % 3 AS class FROM (SELECT DISTINCT object FROM ctx)), sz AS (SELECT class, count(*) AS n FROM cl GROUP BY 1),
 p AS (SELECT class, attribute, (count(*) + 1) / (max(n) + 2.0) AS p FROM ctx JOIN cl USING (object) JOIN sz USING (class) GROUP BY 1, 2)
 SELECT cl.object, cl.class, round(sum(-ln(CASE WHEN c.object IS NULL THEN 1 - p ELSE p END) / ln(2.0)) - max(ln(n / CAST((SELECT count(*) FROM cl) AS DOUBLE)) / ln(2.0)), 6) AS score
 FROM cl JOIN p ON p.class = cl.class JOIN sz ON sz.class = cl.class LEFT JOIN ctx c ON c.object = cl.object AND c.attribute = p.attribute GROUP BY 1, 2""")
def split_merge(spark, sf_dir):
    c = ctx(spark, sf_dir)
    classes = c.select("object").distinct().withColumn("class", F.split_part("object", F.lit(":"), F.lit(1)).cast("long") % 3)
    return d.split_merge(c, classes).withColumn("score", F.round("score", 6))


@query("trie_estimators", f"""WITH {SNAP}, k AS (SELECT tree, CASE WHEN level = 1 THEN '' ELSE regexp_replace(path, '\\|[^|]*$', '') END AS path, count(*) AS singles FROM sn WHERE level > 0 AND count = 1 GROUP BY 1, 2)
 SELECT sn.tree, sn.path, round(1.0 / (count + children + 1), 6) AS additive, round(1.0 / (count + 1), 6) AS escape_a, round(children / CAST(count AS DOUBLE), 6) AS escape_b, round(children / CAST(count + children AS DOUBLE), 6) AS escape_c, round(coalesce(singles, 0) / CAST(count AS DOUBLE), 6) AS good_turing
 FROM sn LEFT JOIN k ON k.tree = sn.tree AND k.path = sn.path WHERE children > 0""")
def trie_estimators(spark, sf_dir):
    found = d.estimators(novelty.snapshot(observations(spark, sf_dir)))
    return found.select("tree", F.array_join("prefix", "|").alias("path"), *[F.round(c, 6).alias(c) for c in ("additive", "escape_a", "escape_b", "escape_c", "good_turing")])


@query("recomputed_probabilities", f"WITH {OBS} SELECT event_id, round(CASE WHEN c1 = 1 THEN s1 / CAST(s1 + c0 AS DOUBLE) WHEN c2 = 1 THEN s2 / CAST(s2 + c1 AS DOUBLE) ELSE s3 / CAST(s3 + c2 AS DOUBLE) END, 6) AS local_prob FROM s WHERE c3 = 1")
def recomputed_probabilities(spark, sf_dir):
    """For alarms of old files: siblings / (siblings + parent's count) at the first level whose count is 1."""
    levels = novelty.observe(observations(spark, sf_dir), seq=SEQ)
    first = levels.where("level > 0 and count = 1").groupBy("event_id").agg(F.min(F.struct("level", "siblings", "parent_count")).alias("f"))
    leaf = levels.where("level = size(key) and count = 1").select("event_id")
    return first.join(leaf, "event_id").select("event_id", F.round(F.col("f.siblings") / (F.col("f.siblings") + F.col("f.parent_count")), 6).alias("local_prob"))


for _how in ("inner", "left", "right", "full"):
    query(f"merge_tables_{_how}", f"SELECT coalesce(s_nationkey, c_nationkey) AS k, suppliers, customers FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal < 5000 GROUP BY 1) {_how.upper()} JOIN (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY 1) ON s_nationkey = c_nationkey")(
        lambda spark, sf_dir, how=_how: table(spark, sf_dir, "supplier").where("s_acctbal < 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")).join(
            table(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers")), "k", how
        )
    )


@query("forests_by_command")
def forests_by_command(spark, sf_dir):
    return forest.forests_by_group(event_frame(spark, sf_dir).withColumn("hour", F.expr("nanos div 3600000000000 % 24")), "event_type", "event_id", ["value", "object", "hour"])


@query("segment_classes")
def segment_classes(spark, sf_dir):
    """Users by their event counts; whether they move more than the mean of all users is the class, learned from four in five of them and predicted for all."""
    own = event_frame(spark, sf_dir).groupBy("subject").agg(F.avg("value").alias("own"))
    mean = own.agg(F.avg("own").alias("mean"))
    label = own.join(F.broadcast(mean), F.lit(True)).select("subject", (F.col("own") > F.col("mean")).cast("double").alias("label"))  # one row
    m = event_type_matrix(spark, sf_dir).join(label, "subject")
    features = ["EVENT_READ", "EVENT_WRITE", "EVENT_FORK", "EVENT_EXECUTE", "EVENT_UNLINK"]
    return forest.classify_segments(m.where(F.pmod(F.xxhash64("subject"), F.lit(5)) > 0), m, features, "label").select("subject", "label", "predicted")
