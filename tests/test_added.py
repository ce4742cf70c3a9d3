"""Rounds of remapping, rules and covers beside plain versions, sinks that are run again, ranges of an order."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provloom.operators import detectors, novelty, resolve, segments
from provloom.operators.running import ranges, running
from provloom.sources import sinks


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_chains_and_cycles_of_merges(spark, n):
    chain = spark.range(n).select("id", (F.col("id") + 1).alias("into"))
    assert {r.root for r in resolve.remap_roots(chain).collect()} == {n}
    with pytest.raises(ValueError, match="cycle"):
        resolve.remap_roots(chain.withColumn("into", F.col("into") % n))


def test_long_chain(spark):
    n = 1 << 14
    roots = resolve.remap_roots(spark.range(n).select("id", (F.col("id") + 1).alias("into")))
    assert roots.count() == n and roots.where(f"root <> {n}").isEmpty()


def rows_of(seed=1, n=120, items="abcdefg"):
    rng = random.Random(seed)
    return [(i, frozenset(x for x in items if rng.random() < 0.6) | ({"c"} if rng.random() < 0.5 else set())) for i in range(n)]


def frequent(rows, least):
    items = sorted(set().union(*(s for _, s in rows)))
    sets = {c: sum(set(c) <= s for _, s in rows) for k in range(1, len(items) + 1) for c in itertools.combinations(items, k)}
    return {c: n for c, n in sets.items() if n >= least}


@pytest.fixture(scope="module")
def context(spark):
    rows = rows_of()
    return rows, spark.createDataFrame([(i, a) for i, s in rows for a in s], "object long, attribute string")


def test_itemsets_of_any_size(context):
    rows, ctx = context
    n = len({i for i, s in rows if s})
    want = frequent(rows, math.ceil(0.1 * n))
    sets = detectors.itemsets(ctx, 0.1)
    assert {tuple(r.items_): r.support for r in sets.withColumnRenamed("items", "items_").collect()} == want
    closed = {c for c, k in want.items() if not any(set(c) < set(d) and k == want[d] for d in want)}
    assert {tuple(r.items_) for r in detectors.closed(sets).withColumnRenamed("items", "items_").collect()} == closed
    assert max(map(len, want)) > 3
    five = detectors.itemsets(ctx.sparkSession.createDataFrame([(i, a) for i in range(5) for a in "abcd"], "object long, attribute string"), 0.5)
    assert [r[0] for r in detectors.closed(five).select("items").collect()] == [["a", "b", "c", "d"]]


def test_exact_rules(spark):
    """Where every object with a has b, and every one with b and c has d, the rules say so and nothing that follows."""
    rows = [(0, "ab"), (1, "abe"), (2, "be"), (3, "bcd"), (4, "bcde"), (5, "ce"), (6, "ec"), (7, "de"), (8, "abcd")]
    ctx = spark.createDataFrame([(i, a) for i, s in rows for a in s], "object long, attribute string")
    sets = detectors.itemsets(ctx, 1 / 9)
    want = frequent([(i, frozenset(s)) for i, s in rows], 1)
    exact = {(x, y) for x in want for y in want if not set(x) & set(y) and want.get(tuple(sorted({*x, *y}))) == want[x]}
    got = {(tuple(r.x), tuple(r.y)) for r in detectors.exact_rules(sets).collect()}
    assert got <= exact and all(any(set(a) <= set(x) and set(y) <= set(b) | set(x) for a, b in got) for x, y in exact)
    assert not any(a != b and set(a[0]) <= set(b[0]) and set(b[1]) <= set(a[1]) for a in got for b in got)


def test_cover_cost(context):
    rows, ctx = context
    codes = [("a", "b", "c"), ("d", "e"), ("c", "f")]
    support = {c: sum(set(c) <= s for _, s in rows) for c in codes}
    used = {}
    for i, s in rows:
        left, own = set(s), []
        for c in sorted(codes, key=lambda c: (-len(c), -support[c], c)):
            if set(c) <= left:
                left -= set(c)
                own.append(c)
        used[i] = own + [(x,) for x in left]
    uses = Counter(c for own in used.values() for c in own)
    total = sum(uses.values())
    table = ctx.sparkSession.createDataFrame([(list(c), k) for c, k in support.items()], "items array<string>, support long")
    got = {r.object: r.bits for r in detectors.cover_cost(ctx, table).collect()}
    assert got.keys() == {i for i, s in rows if s}
    assert all(got[i] == pytest.approx(sum(-math.log2(uses[c] / total) for c in used[i])) for i in got)


def test_running_sums_by_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xyz"), i * 7 % 1000, rng.randrange(5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, t long, v long")
    got = {(r.g, r.t): r.total for r in running(ranges(df, "t", parts=12), ["g"], ["t"], F.col("v"), "total").collect()}
    for g in "xyz":
        total = 0
        for _, t, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total += v
            assert got[g, t] == total
    counts = [r["count"] for r in ranges(df, "t", parts=12).groupBy("_range").count().collect()]
    assert max(counts) <= 2 * 1000 / 12


def test_graph_sink_runs_a_batch_again(spark, tmp_path):
    none = None
    batches = [
        [("a", "V", none, none, {"k": "1"}), ("ab", "E", "a", "b", {}), ("nil", "E", "a", sinks.NIL, {})],
        [("b", "V", none, none, {}), ("bc", "E", "b", "c", {}), ("a", "V", none, none, {"k": "2"})],
        [("d", "V", none, none, {})],
    ]
    write = sinks.graph_sink(str(tmp_path))
    for number, rows in [(0, batches[0]), (1, batches[1]), (1, batches[1]), (2, batches[2])]:
        write(spark.createDataFrame(rows, sinks.ELEMENT), number)
    vertices, edges, parked = sinks.graph_tables(spark, str(tmp_path))
    assert sorted((r.id, r.properties.get("k")) for r in vertices.collect()) == [("a", "1"), ("b", None), ("d", None)]
    assert [r.id for r in edges.collect()] == ["ab"] and [r.id for r in parked.collect()] == ["bc"]


def test_alarm_files(spark, tmp_path):
    df = spark.createDataFrame([("t", ["u", "k"], 0.25, 1_704_067_200_000_000_000)], "tree string, key array<string>, local_prob double, nanos long")
    for form in ("log", "console", "collector"):
        sinks.write_alarms(df, f"{tmp_path}/{form}", form)
    lines = {form: [r.value for r in spark.read.text(f"{tmp_path}/{form}").collect()] for form in ("log", "console", "collector")}
    assert lines["console"] == ["t: k after u"] and lines["log"][0].endswith("\tt\tu / k\t0.25") and '"localProb":0.25' in lines["collector"][0]


def test_summaries_beside_a_walk(spark):
    """Classes, joined chains and merged leaves of a random tree by a recursive walk."""
    rng = random.Random(12)
    kinds = ["EVENT_READ", "EVENT_RECVMSG", "EVENT_WRITE", "EVENT_FORK", "EVENT_EXIT", "EVENT_ODD"]
    keys = [[f"p{rng.randrange(4)}", rng.choice(kinds[: rng.randrange(2, 7)]), f"o{rng.randrange(9)}"] for _ in range(160)] + [["q", "EVENT_MMAP", "only"]] * 3
    classes = {k: c for c, ks in novelty.EVENT_CLASSES.items() for k in ks}

    def nest(rows):
        """A node is its count, or the nodes below it."""
        out = {}
        for key, n in rows:
            if len(key) == 1:
                out[key[0]] = out.get(key[0], 0) + n
            else:
                out.setdefault(key[0], []).append((key[1:], n))
        return {k: nest(v) if isinstance(v, list) else v for k, v in out.items()}

    def chains(node):
        if not isinstance(node, dict):
            return node
        out = {}
        for k, v in node.items():
            v = chains(v)
            if isinstance(v, dict) and len(v) == 1:
                [(low, v)] = v.items()
                k = f"{k} ∫ {low}"
            out[k] = v
        return out

    def alike(node):
        if not isinstance(node, dict):
            return node
        out, same = {}, {}
        for k, v in node.items():
            if isinstance(v, dict):
                out[k] = alike(v)
            else:
                same.setdefault(v, []).append(k)
        for n, ks in same.items():
            out[", ".join(sorted(ks)) if len(ks) <= 5 else f"{len(ks)} items like {min(ks)}"] = n * len(ks)
        return out

    def flat(node, at=()):
        return [(at, node)] if not isinstance(node, dict) else [x for k, v in node.items() for x in flat(v, (*at, k))]

    want = chains(alike(chains(nest([([classes.get(x, x) for x in k], 1) for k in keys]))))
    obs = spark.createDataFrame([("t", k) for k in keys], "tree string, key array<string>")
    got = novelty.summarize(novelty.snapshot(obs)).collect()
    assert sorted((tuple(r.path), r["count"]) for r in got) == sorted(flat(want))
    assert sum(r.share for r in got) == pytest.approx(1)


def test_repetitions_without_bound(spark):
    steps = spark.createDataFrame([("p", i, c) for i, c in enumerate("ABAACA")] + [("q", 0, "B")], "path string, pos int, label string")
    some = segments.zero_or_more(steps, segments.terminal(steps, "A"))
    got = sorted((r.path, tuple(r["at"])) for r in some.collect())
    at = [0, 2, 3, 5]
    assert got == sorted([("p", c) for k in range(5) for c in itertools.combinations(at, k)] + [("q", ())])
