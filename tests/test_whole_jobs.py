"""Jobs that were reworked for large tables, beside their plain forms."""

import math
import random

from provloom.operators import detectors, forest, novelty, segments
from provloom.queries import novelty_queries


def test_observed_alarms_in_columns(spark):
    """Keys of any length, null parts, ties in the first column of the order, several trees; first keys in one task and by ranges."""
    draw = random.Random(3)
    rows = [(draw.choice("xy"), i // 3, i % 3, [draw.choice("abc"[: 1 + j]) if draw.random() > 0.1 else None for j in range(draw.choice([0, 1, 2, 3, 4, 4]))]) for i in range(300)]
    obs = spark.createDataFrame(rows, "tree string, at long, by int, key array<string>").repartition(5)
    seq = ("at", "by")
    want = sorted(map(repr, novelty.alarms(novelty.observe(obs, seq=seq), seq).collect()))
    for together in (novelty.TOGETHER, 40):
        assert sorted(map(repr, novelty.observed_alarms(obs, seq, together=together).collect())) == want
    assert novelty.observed_alarms(obs.limit(0), seq).count() == 0


def test_rows_after_the_last_alarm_are_left_out_early(spark):
    """Many rows of few keys: the alarms are those of all rows, and what comes after the last of them isn't counted."""
    rows = spark.range(5_000).selectExpr("id as at", "cast(least(id, 50) % 7 as string) as a", "cast(id % 3 as string) as b")
    few = novelty.until_last_alarm(rows, "at", ["a", "b"])
    assert few.count() < 200
    alarms = [novelty.observed_alarms(novelty.join_observations(r, "t", ["at"], ["a", "b"]), ("at",)).collect() for r in (few, rows)]
    assert sorted(alarms[0]) == sorted(alarms[1]) and alarms[0]
    assert novelty.until_last_alarm(rows.limit(0), "at", ["a", "b"]).count() == 0


def test_alarms_make_no_row_a_level(spark, sf):
    plan = novelty_queries.alarm_rows(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_equal_baskets_are_covered_once(spark):
    """A cover's bits are the same however many objects share a basket, and the plan holds no fold over the codes in each row."""
    own = [(i, a) for i in range(60) for a in ("ab", "abc", "bd", "d")[i % 4]]
    ctx = spark.createDataFrame(own, "object long, attribute string")
    codes = spark.createDataFrame([(["a", "b"], 30)], "items array<string>, support long")
    found = detectors.cover_cost(ctx, codes)
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    bits = {r.object: round(r.bits, 9) for r in found.collect()}
    assert len(bits) == 60 and all(bits[i] == bits[i % 4] for i in bits)
    uses = {"ab": 30, "c": 15, "b": 15, "d": 30}
    length = {k: -math.log2(n / 90) for k, n in uses.items()}
    assert [round(sum(length[c] for c in cs), 9) for cs in (["ab"], ["ab", "c"], ["b", "d"], ["d"])] == [bits[i] for i in range(4)]


def test_clusters_of_equal_baskets_are_equal(spark):
    """Rounds see each distinct basket once; what a basket gets, all its objects get."""
    ctx = spark.createDataFrame([(i, a) for i in range(90) for a in ("abc", "xyz", "ab")[i % 3]], "object long, attribute string")
    found = forest.code_length_clusters(ctx, 2)
    rows = found.collect()
    assert len(rows) == 90 and len({(r.object % 3, r.cluster, round(r.bits, 9)) for r in rows}) == 3
    assert "Join" in found._jdf.queryExecution().optimizedPlan().toString()  # objects get their basket's cluster after the rounds


def test_forests_in_parts_of_a_group(spark, monkeypatch):
    """A group is judged in parts that tasks hold one at a time; null groups and features too. Scores don't depend on the parts."""
    rows = [(None if i % 5 == 0 else "abc"[i % 3], i, float(i % 17), None if i % 7 == 0 else float(i * 37 % 101)) for i in range(1_500)]
    df = spark.createDataFrame(rows, "g string, i long, a double, b double")
    judged = lambda: sorted((r.i, str(r.g), round(r.score, 9), r.odd) for r in forest.forests_by_group(df, "g", "i", ["a", "b"]).collect())
    whole = judged()
    monkeypatch.setattr(forest, "TOGETHER", 100)
    assert judged() == whole and len(whole) == 1_500


def test_reads_after_writes_once_each(spark):
    draw = random.Random(5)
    writes = [(draw.randrange(6), draw.randrange(3), draw.randrange(400)) for _ in range(120)]
    reads = [(draw.randrange(6), draw.randrange(3), draw.randrange(400)) for _ in range(120)] + [(9, 0, 50), (9, 1, 50)]
    want = sorted({(w, r, o) for w, o, at in writes for r, p, t in reads if o == p and w != r and 0 < t - at <= 10})
    found = segments.reads_after_writes(spark.createDataFrame(writes, "writer long, object long, at long"), spark.createDataFrame(reads, "reader long, object long, nanos long"), 10)
    assert sorted(map(tuple, found.collect())) == want
    single = segments.reads_after_writes(spark.range(8).selectExpr("id as writer", "0L as object", "id as at"), spark.range(8).selectExpr("id as reader", "0L as object", "id as nanos"), 10)
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Aggregate")  # only one branch is made distinct
    assert single.count() == 28
