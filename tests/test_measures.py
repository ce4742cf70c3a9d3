"""Sources, features, scores and alarms in small cases."""

import pytest
from pyspark.sql import functions as F

from provloom.operators import measures
from provloom.operators.graph import event_frame
from provloom.queries import QUERIES


def test_sources(spark):
    rows = spark.createDataFrame([(i, i % 3, None if i < 3 else "x", None) for i in range(10)], "id long, k long, late string, never string").repartition(3)
    assert [r.id for r in measures.crop(rows, ["k", "id"], 2, 5).collect()] == [6, 9, 1]
    assert measures.crop(rows, ["id"], 8).count() == 2 and measures.crop(rows, ["id"], ingest=False).count() == 0
    assert measures.presence_matrix(rows, "id", "id", ["never", "late", "k"]).columns == ["id", "has_k", "has_late", "has_never"]
    merged = measures.merge_sources([rows.select("id").limit(1), rows.select("k").limit(2)])
    assert sorted((r.source_ord, r.id is None, r.k is None) for r in merged.collect()) == [(0, False, True), (1, True, False), (1, True, False)]
    parsed = measures.parse_records(spark.createDataFrame([('{"a":1}',), ("{no",), (None,)], "t string"), "t", "a int").collect()
    assert [(r.record.a if r.record else None, r.bad) for r in parsed] == [(1, False), (None, True), (None, False)]


def test_names_come_late(spark):
    rows = spark.createDataFrame([(i, 1 + i % 2) for i in range(6)], "seq long, key long")
    names = spark.createDataFrame([(2, 1, "a"), (4, 1, "b"), (5, 1, "a"), (9, 1, "c"), (0, 1, None)], "seq long, key long, name string")
    got = {r.seq: r.names for r in measures.name_sets(rows, names, "key", "seq", "name", 2).collect()}
    assert got == {0: ["a"], 2: ["a", "b"], 4: ["a", "b"], 1: [], 3: [], 5: []}


def test_features(spark):
    df = spark.createDataFrame([(5_000_000_000, 2_000_000_000, 6), (2_000_000_000, 5_500_000_000, 0), (1, 1, 3)], "a long, b long, x long")
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    got = df.select(measures.sub_time(a, b), measures.relu_time(a, b), measures.per_time(x, a, b), measures.time_per(a, b, x)).collect()
    assert [tuple(r) for r in got] == [(3, 3, 2.0, 0.5), (-3, 0, -0.0, None), (0, 0, None, 0.0)]
    assert {(r.bin, r.n) for r in measures.histogram(spark.createDataFrame([(7.0,), (7.0,), (None,)], "v double"), "v").collect()} == {(0, 2)}


def test_repaired_times_take_the_last_reference_of_the_file(spark):
    minute = 60 * 10**9
    alarms = spark.createDataFrame([(1, 5 * minute), (2, 50 * minute)], "id long, nanos long")
    refs = spark.createDataFrame([(1, 6 * minute + 1), (2, 4 * minute), (3, 7 * minute), (4, 60 * minute)], "seq long, nanos long")
    got = {r.id: r.repaired for r in measures.repaired_times(alarms, refs.withColumn("id", F.lit(0)), "id", "nanos", "seq").collect()}
    assert got == {1: 4 * minute, 2: 50 * minute}


def test_scores(spark):
    scores = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 6.0), (4, 0.0)], "id long, score double")
    edges = spark.createDataFrame([(2, 3), (3, 1), (2, 4)], "src long, dst long")
    assert [(r.src, r.dst) for r in measures.high_edges(edges, scores, 1.5).collect()] == [(2, 3)] and measures.high_edges(edges, scores, 2.5).count() == 0
    low = measures.lowest(spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "object string, score double"), 2)
    assert [r.object for r in low.collect()] == ["c", "a"]
    alarms = spark.createDataFrame([("t", p / 10) for p in range(11)], "tree string, local_prob double")
    got = {r.percent: r.threshold for r in measures.linear_percentiles(alarms, (25.0, 50.0)).collect()}
    assert got == pytest.approx({25.0: 0.25, 50.0: 0.5})


def test_edges_just_above_the_mean_are_high(spark, sf):
    """No end is asked for more events than the mean's: edges within two events of it count."""
    n = {r.subject: r.n for r in event_frame(spark, sf).groupBy("subject").agg(F.count("*").alias("n")).collect()}
    high = {s for s in n if n[s] > sum(n.values()) / len(n)}
    want = {(s // 2, s) for s in high if s > 0 and s // 2 in high}
    got = {(r.parent, r.child) for r in QUERIES["high_score_edges"](spark, sf).collect()}
    assert got == want and any(min(n[p], n[c]) <= sum(n.values()) / len(n) + 2 for p, c in got)
