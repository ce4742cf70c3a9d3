"""Diagnosis, online learners, rare rules, fits, clusters and subset lookups beside plain versions."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provloom.operators import detectors, diagnosis, fits, forest, novelty, online, rare, subsets
from provloom.queries import QUERIES
from provloom.queries.learner_queries import ATTRIBUTES
from provloom.streaming import stores


def plain_state(entry, label, confidence, pattern, jump, least):
    out = {(0, False): entry[0]}  # (place, label used) -> score, walked from the left
    for i in range(1, len(pattern) + 1):
        on = lambda s, by: s * by if s > least else 0.0
        out[i, False] = max(entry[i], on(out[i - 1, False], jump))
        met = on(out[i - 1, False], confidence) if label == pattern[i - 1] else 0.0
        out[i, True] = max(out[i, False], met, on(out.get((i - 1, True), 0.0), jump))
    return [entry[0]] + [out[i, True] for i in range(1, len(pattern) + 1)]


def all_matches(nodes, edges, pattern, jump, least):
    """Every match of the pattern along every way of a DAG, with its best score."""
    after = {i: [b for a, b in edges if a == i] for i, *_ in nodes}
    of = {i: (label, c) for i, label, c in nodes}
    best = {}

    def walk(i, ways):
        label, confidence = of[i]
        fresh = set()
        for place, score, path in ways | {(0, 1.0, ())}:
            for a in range(len(pattern) - place + 1):
                s, p, q = score * jump**a, path + (None,) * a, place + a
                fresh.add((q, s, p))
                if q < len(pattern) and pattern[q] == label:
                    fresh |= {(q + 1 + b, s * confidence * jump**b, p + (i,) + (None,) * b) for b in range(len(pattern) - q)}
        fresh = {x for x in fresh if x[1] > least}
        for q, s, p in fresh:
            if q == len(pattern):
                best[p] = max(best.get(p, 0), s)
        for j in after[i]:
            walk(j, fresh)

    for i, *_ in nodes:
        walk(i, set())
    return best


@pytest.mark.parametrize("seed,jump", [(1, 0.0), (1, 0.3), (5, 0.3)])
def test_diagnoses_beside_enumeration(spark, seed, jump):
    rng = random.Random(seed)
    nodes = [(i, rng.choice("abcx"), round(rng.uniform(0.3, 1), 2)) for i in range(12)] + [(50, None, 0.5), (51, "a", None)]
    edges = [(i, j) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.25] + [(50, 3), (3, 99)]
    pattern = ["a", "b", "a", "c"] if seed == 5 else ["a", "b", "c"]
    n, e = spark.createDataFrame(nodes, "id long, label string, confidence double"), spark.createDataFrame(edges, "src long, dst long")
    known = [(i, label, c or 0.0) for i, label, c in nodes]
    inner = [(a, b) for a, b in edges if b != 99]
    want = {}
    for i, label, c in sorted(known, key=lambda x: (x[0] < 50, x[0])):
        entry = [1.0] + [0.0] * len(pattern)
        for a, b in inner:
            if b == i:
                entry = [max(x, y) for x, y in zip(entry, want[a])]
        want[i] = plain_state(entry, label, c, pattern, jump, 0.05)
    forward = diagnosis.fuzzy_states(n, e, pattern, jump, 0.05)
    got = {r.id: r.state for r in forward.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    best = all_matches(known, inner, pattern, jump, 0.05)
    order = sorted(best.items(), key=lambda x: (-round(x[1], 12), tuple(-1 if v is None else v for v in x[0])))[:6]
    rows = diagnosis.ranked_diagnoses(n, e, pattern, 6, jump, 0.05).orderBy("rank").collect()
    assert [tuple(r.path) for r in rows] == [p for p, _ in order] and [r.score for r in rows] == pytest.approx([s for _, s in order])
    through = {r.id: r.score for r in diagnosis.through_scores(forward, diagnosis.backward_states(n, e, pattern, jump, 0.05), n, pattern).collect()}
    for path, score in best.items():
        assert all(through[v] >= score - 1e-12 for v in path if v is not None)
    if best:
        assert max(through.values()) == pytest.approx(max(best.values()))


def records(seed=3, n=200, items="abcdefg"):
    rng = random.Random(seed)
    return [(i, sorted(x for k, x in enumerate(items) if rng.random() < 0.8 - 0.1 * k)) for i in range(n)]


def as_cells(spark, rows):
    return spark.createDataFrame([(i, i, a) for i, s in rows for a in (s or [None])], "object long, seq long, attribute string").repartition(5)


def test_online_frequencies_beside_folds(spark):
    rows = records()
    every = sorted({a for _, s in rows for a in s})
    f, n, avf, rasp = Counter(), 0, {}, {}
    for i, s in rows:
        p = {a: (f[a] + 1) / (n + 2) for a in every}
        avf[i] = sum(p[a] if a in s else 1 - p[a] for a in every)
        total = n + 2 + sum(f.values())
        rasp[i] = sum(-math.log2((f[a] + 1) / (total + 2)) if f[a] else math.log2(total) for a in s) - math.log2((n + 1) / total)
        f.update(s)
        n += 1
    assert {r.object: r.score for r in online.avf_online(as_cells(spark, rows), "seq").collect()} == pytest.approx(avf)
    assert {r.object: r.score for r in online.rasp_online(as_cells(spark, rows), "seq").collect()} == pytest.approx(rasp)


def plain_clusters(rows, attributes):
    """From the definition: a model a cluster, one that knows nothing, and the cost of saying which."""
    models, out = [], []
    for seen, (_, s) in enumerate(rows):
        x = [a in s for a in attributes]
        costs = [sum(-math.log2((f + 1) / (n + 2) if on else 1 - (f + 1) / (n + 2)) for on, f in zip(x, fs)) for n, fs in models]
        cheapest = min([*costs, float(len(attributes))])
        k = len(models)
        cluster = costs.index(cheapest) if cheapest < len(attributes) else k
        share = ((models[cluster][0] if cluster < k else k) + 1) / (seen + 2 * k + 1)
        if cluster == k:
            models.append([0, [0] * len(attributes)])
        models[cluster][0] += 1
        models[cluster][1] = [f + on for f, on in zip(models[cluster][1], x)]
        out.append((cheapest - math.log2(share), cluster))
    return out


def test_cluster_state(spark):
    rows = records(7, 150)
    held = None
    got = []
    for _, s in rows:  # the state is written and read at each step, as between batches
        clusters = online.Clusters(list("abcdefg"), held)
        got.append(clusters.take(s))
        held = clusters.text()
    want = plain_clusters(rows, list("abcdefg"))
    assert [c for _, c in got] == [c for _, c in want] and [b for b, _ in got] == pytest.approx([b for b, _ in want])
    assert len({c for _, c in got}) > 1


def test_kl_stream_query(spark, sf):
    got = {r.seq: r for r in QUERIES["stream_kl_clusters"](spark, sf).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect()
    kinds = {"click": "EVENT_READ", "view": "EVENT_EXECUTE", "purchase": "EVENT_WRITE", "signup": "EVENT_FORK", "error": "EVENT_UNLINK"}
    assert len(got) == len(events)
    for host in range(10):
        own = [e for e in events if e.user_id % 10 == host]
        items = [(e.event_id, [kinds[e.event_type], "v0" if e.value < 15 else "v1" if e.value < 60 else "v2", *(["io"] if e.event_type in ("click", "purchase") else [])]) for e in own]
        for (i, _), (bits, cluster) in zip(items, plain_clusters(items, ATTRIBUTES)):
            assert got[i].part == host and got[i].bits == pytest.approx(bits) and got[i].cluster == cluster


def test_online_forest_beside_a_fold(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 2))
    x[700:720] += 6
    rows = spark.createDataFrame([(10 * i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(9000, None, 0.0)], "at long, a double, b double").repartition(6)
    got = {r["at"]: r for r in online.online_forest(rows, "at", ["a", "b"], window=200, trees=8, sample=64, seed=3).collect()}
    values = np.vstack([x, [[0.0, 0.0]]])
    first = rows.where("at < 2000").withColumn("h", F.xxhash64("at")).orderBy("h", "at").limit(256).select("at").collect()
    sample = np.array([values[r["at"] // 10] for r in first])
    draw = np.random.default_rng(3)
    trees = [forest.grow(sample[draw.choice(len(sample), 64, replace=False)], 6, draw) for _ in range(8)]
    masses = [np.array(online.leaf_sizes(t)) for t in trees]
    fresh = [np.zeros(len(m), int) for m in masses]
    for n in range(901):
        if n and n % 200 == 0:
            masses, fresh = fresh, [np.zeros(len(m), int) for m in masses]
        path = 0.0
        for t, m, f in zip(trees, masses, fresh):
            leaf, depth = online.leaves(t, values[n : n + 1])
            path += depth[0] + forest._c(float(m[leaf[0]]))
            f[leaf[0]] += 1
        assert got[10 * n].score == pytest.approx(2 ** (-path / 8 / forest._c(64))) and got[10 * n].window == n // 200
    assert np.mean([got[10 * i].score for i in range(700, 720)]) > np.mean([r.score for r in got.values()])
    assert online.online_forest(rows.where("false"), "at", ["a", "b"]).count() == 0


def subsets_of(rows, sets):
    return {s: [i for i, own in rows if set(s) <= set(own)] for s in sets}


def test_rare_itemsets_beside_enumeration(spark):
    rows = records(11, 150) + [(900, ["a", "zz", "zy"]), (901, ["zz", "zy"])]
    ctx = spark.createDataFrame([(i, a) for i, s in rows for a in s], "object long, attribute string").repartition(4)
    n = len({i for i, s in rows if s})
    least = math.ceil(0.3 * n)
    every = sorted({a for _, s in rows for a in s})
    holders = subsets_of(rows, [c for k in range(1, len(every) + 1) for c in itertools.combinations(every, k)])
    minimal = {c for c, h in holders.items() if 0 < len(h) < least and all(len(holders[p]) >= least for p in itertools.combinations(c, len(c) - 1) if p)}
    assert max(map(len, minimal)) >= 3
    closure = {c: tuple(sorted(set.intersection(*(set(s) for i, s in rows if i in set(holders[c]))))) for c in minimal}
    sets = detectors.itemsets(ctx, 0.3)
    for block in (None, 3):
        got = {tuple(r["items"]): (r.support, tuple(r.closure)) for r in rare.rare_itemsets(ctx, sets, block).collect()}
        assert got == {c: (len(holders[c]), closure[c]) for c in minimal}
    want = {(c, tuple(x for x in closure[c] if x not in c)): len(holders[c]) for c in minimal if set(closure[c]) != set(c)}
    rules = {(tuple(r.x), tuple(r.y)): r for r in rare.rare_rules_of_any_size(ctx, sets).collect()}
    assert {k: r.support for k, r in rules.items()} == want and want
    for (_, y), r in rules.items():
        assert r.lift == pytest.approx(n / len(holders[y]))


def test_subset_index_in_blocks(spark):
    rows = records(12, 80)
    ctx = spark.createDataFrame([(i, a) for i, s in rows for a in s] + [(500, None)], "object long, attribute string").repartition(3)
    sets = [["a"], ["a", "b"], ["c", "a"], ["q"], [], ["b", "c", "d"], ["a", "b"]]
    table = spark.createDataFrame([(s, n) for n, s in enumerate(sets)], "items array<string>, n int")

    def fold(index, held, has, own):
        out = np.zeros(len(has), "int64")
        for numbers, at in index.visit(has):
            out[at] += sum(10 ** held["n"][k] for k in numbers)
        return [out]

    want = {i: sum(10**n for n, s in enumerate(sets) if set(s) <= set(own)) for i, own in rows if own} | {500: 10**4}
    for block in (None, 2):
        got = {r.object: r.s for r in subsets.look_up(ctx, table, "items", fold, {"s": "long"}, {"s": F.sum}, block=block).collect()}
        assert got == want


def test_outlier_scores_beside_plain_versions(spark):
    rows = records(13, 120)
    ctx = spark.createDataFrame([(i, a) for i, s in rows for a in s], "object long, attribute string")
    sets = detectors.itemsets(ctx, 0.2)
    table = [(set(r["items"]), r.support) for r in sets.collect()]
    n = len({i for i, s in rows if s})
    want = {i: sum(k for s, k in table if s <= set(own) and len(s) < len(own)) / n / len(table) for i, own in rows if own}
    assert {r.object: r.score for r in detectors.fpof(ctx, sets).collect()} == pytest.approx(want)
    found = [(set(r.x), r.y, r.confidence, r.lift) for r in detectors.rules(sets, 0.6, n).collect()]
    rules = spark.createDataFrame([(sorted(x), y, c, l) for x, y, c, l in found], "x array<string>, y string, confidence double, lift double")
    lacks = {i: len({y for x, y, *_ in found if x <= set(own) and y not in own}) for i, own in rows if own}
    assert {r.object: r.score for r in detectors.outlier_degree(ctx, rules).collect()} == pytest.approx({i: lacks[i] / (lacks[i] + len(own)) for i, own in rows if own})
    broken = {i: [(c, l) for x, y, c, l in found if x <= set(own) and y not in own] for i, own in rows}
    got = {r.object: r for r in detectors.violations(ctx, rules).collect()}
    assert got.keys() == {i for i, b in broken.items() if b}
    for i, r in got.items():
        assert r.rules == len(broken[i]) and r.lift == pytest.approx(max(l for _, l in broken[i])) and r.bits == pytest.approx(sum(-math.log2(max(1 - c, 1e-9)) for c, _ in broken[i]))


def likelihood(family, parameters, x):
    h = 1e-5 * x
    return np.log(np.maximum((fits.cdf(family, parameters, x + h) - fits.cdf(family, parameters, x - h)) / (2 * h), 1e-300)).sum()


def test_fits_are_likeliest_and_percentiles_follow(spark):
    rng = np.random.default_rng(8)
    samples = {"g": rng.gamma(2.5, 3.0, 800), "w": 4 * rng.weibull(1.7, 800), "e": 50 + 3 * (rng.exponential(1, 800) ** -0.1 - 1) / 0.1}
    rows = [(m, str(i), float(v)) for m, xs in samples.items() for i, v in enumerate(xs)] + [("flat", str(i), 2.0) for i in range(5)] + [("g", "none", None)] + [("g", "again", float(samples["g"][0]))]
    scores = spark.createDataFrame(rows, "model string, object string, score double").repartition(5)
    fitted = fits.fit_scores(scores)
    assert fitted["flat"] == {} and set(fitted["g"]) == set(fits.FAMILIES)
    for model in ("g", "w"):
        x = np.array([v for m, _, v in rows if m == model and v is not None])
        for family in ("gamma", "weibull"):
            top = likelihood(family, fitted[model][family], x)
            for i, factor in itertools.product((0, 1), (0.98, 1.02)):
                other = list(fitted[model][family])
                other[i] *= factor
                assert likelihood(family, tuple(other), x) < top
    assert fitted["g"]["gamma"] == pytest.approx((2.5, 3.0), rel=0.15) and fitted["w"]["weibull"] == pytest.approx((1.7, 4.0), rel=0.1)
    place, scale, k = fitted["e"]["gev"]
    assert abs(place - 50) < 1 and abs(scale - 3) < 0.5 and abs(k + 0.1) < 0.1
    got = fits.fitted_percentiles(scores).collect()
    assert len(got) == len(rows) - 1

    def anderson(family, parameters, x):
        x = np.sort(x)
        p = np.clip(fits.cdf(family, parameters, x), 1e-300, 1 - 1e-15)
        i = np.arange(1, len(x) + 1)
        return -len(x) - ((2 * i - 1) * (np.log(p) + np.log(1 - p[::-1]))).sum() / len(x)

    for model in samples:
        x = np.array([v for m, _, v in rows if m == model and v is not None])
        best = min(fitted[model], key=lambda f: anderson(f, fitted[model][f], x))
        own = [r for r in got if r.model == model]
        assert {r.family for r in own} == {best}
        assert [r.percentile for r in own] == pytest.approx(fits.cdf(best, fitted[model][best], np.array([r.score for r in own])))
    assert {r.percentile for r in got if r.model == "flat"} == {None}


def test_gamma_function_values():
    x = np.array([0.1, 1.0, 2.5, 8.0, 40.0])
    for shape in (1, 2, 5):
        want = 1 - np.exp(-x) * sum(x**j / math.factorial(j) for j in range(shape))
        assert fits.gamma_cdf(x, float(shape)) == pytest.approx(want, abs=1e-12)
    assert fits.digamma(1.0) == pytest.approx(-fits.EULER) and fits.trigamma(1.0) == pytest.approx(math.pi**2 / 6)


def test_mean_shift_beside_a_plain_version(spark):
    rng = np.random.default_rng(9)
    centres = np.array([[0.0, 0.0], [6.0, 1.0], [2.0, -7.0]])
    x = np.vstack([c + rng.standard_normal((n, 2)) * 0.6 for c, n in zip(centres, (90, 60, 40))] + [centres[:1]] * 5)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(999, None, 1.0)], "id long, a double, b double").repartition(4)
    got = {r["id"]: r.cluster for r in fits.mean_shift(rows, "id", ["a", "b"], 2.0).collect()}
    assert len(got) == len(x)
    seeds = [x[[tuple(np.floor(p / 2.0)) == c for p in x]].mean(axis=0) for c in {tuple(np.floor(p / 2.0)) for p in x}]
    modes = []
    for s in seeds:
        while True:
            near = x[((x - s) ** 2).sum(axis=1) <= 4.0]
            m = near.mean(axis=0)
            if ((m - s) ** 2).sum() <= (2e-3) ** 2:
                break
            s = m
        modes.append((len(near), tuple(m)))
    kept = []
    for _, m in sorted(modes, key=lambda v: (-v[0], v[1])):
        if all(math.dist(m, o) > 2.0 for o in kept):
            kept.append(m)
    far = np.array([[math.dist(p, m) for m in kept] for p in x])
    want = np.where(far.min(axis=1) <= 2.0, far.argmin(axis=1), -1)
    pairs = {(int(w), got[i]) for i, w in enumerate(want)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({g for _, g in pairs}), pairs  # the same classes
    sizes = Counter(got.values())
    assert [sizes[c] for c in sorted(c for c in sizes if c >= 0)] == sorted((n for c, n in sizes.items() if c >= 0), reverse=True) and len(kept) == 3


def test_delays_are_linear_in_one_key(spark):
    def took(n):
        rows = spark.range(n).select(F.col("id"), (F.col("id") * 7 % n).alias("t"), F.lit(1).alias("k"))
        began = time.perf_counter()
        found = novelty.delayed(rows, "t", "k", 100, "id").agg(F.count("released").alias("n"), F.sum(F.col("released") - F.col("t")).alias("s")).head()
        assert (found["n"], found["s"]) == (n - 100, 100 * (n - 100))
        return time.perf_counter() - began

    took(20_000)
    assert took(80_000) < 6 * max(took(20_000), 1.0)


def test_delays_beside_a_search(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("xy"), rng.randint(0, 300)) for i in range(200)]
    got = {r["id"]: r.released for r in novelty.delayed(spark.createDataFrame(rows, "id long, k string, t long"), "t", "k", 40, "id").collect()}
    assert got == {i: min((u for _, l, u in rows if l == k and u >= t + 40), default=None) for i, k, t in rows}


# Stores with state


def store_events(n=120, seed=5):
    rng = random.Random(seed)
    t, rows = 10**9, []
    for seq in range(1, n + 1):
        t += rng.choice([1, 2, 3, 30])
        rows.append((rng.choice([1, 2, 3]), rng.choice(["r", "r", "w"]), seq, t * 10**9))
    return rows


def test_run_store_closes_by_time_records_kind_and_size(spark, tmp_path):
    from provloom.operators.resolve import collapse_events

    rows = store_events()
    df = spark.createDataFrame(rows, "host long, kind string, seq long, nanos long").withColumn("ts", F.timestamp_seconds(F.col("nanos") / 10**9))
    stream = lambda: stores.collapse_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), ["host"], "kind", "seq", "nanos", "ts", 9 * 10**9, 6, 3, late="1 second")
    for n, (low, high) in enumerate(((0, 50), (50, 51), (51, 120))):  # a restart in mid-run each time
        df.where(f"seq > {low} and seq <= {high}").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        out = stores.run_to_end(stream(), f"{tmp_path}/s")
    held = stores.open_runs(spark, f"{tmp_path}/s", ["host"])
    columns = ["host", "kind", "first_seq", "last_seq", "merged", "earliest", "latest"]
    got = sorted(tuple(r[c] for c in columns) for r in out.unionByName(held).collect())
    want = sorted(tuple(r[c] for c in columns) for r in collapse_events(df, ["host"], "kind", "seq", "nanos", 9 * 10**9, 6, 3).collect())
    assert got == want and max(r[4] for r in got) == 3 and held.count() <= 3


def item(ident, what, seq, end=None, into=None, element=None, src=None, dst=None):
    return (ident, what, end, into, element, "l", src, dst, "{}", seq)


def test_element_store_releases_and_synthesises(spark, tmp_path):
    """A pointer that comes late releases what waits; an id that nothing describes is synthesised when the watermark passes its expiry."""
    schema = stores.ITEM + ", ts timestamp"
    edge = lambda n, a, b, seq: item(a, "edge", seq, "src", None, f"e{n}", a, b)
    batches = [
        [edge(1, "a", "b", 1), item("a", "vertex", 2, element="a"), edge(2, "a", "lost", 3)],
        [item("b", "pointer", 4, into="c"), item("c", "pointer", 5, into="d"), item("a", "vertex", 6, element="a again")],
        [item("d", "vertex", 7, element="d"), edge(3, "b", "a", 8)],
        [item("tick", "vertex", 500_000, element="tick")],
        [item("tock", "vertex", 500_001, element="tock"), edge(4, "lost", "d", 500_002)],
    ]
    folder = f"{tmp_path}/s"
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, stores.ITEM).withColumn("ts", F.timestamp_seconds("seq"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        stores.resolve_stream(stream, "ts", folder, expiry_ms=60_000, late="10 seconds")
    edges = {(r.element, r.src, r.dst) for r in stores.written(spark, folder, "edge").collect()}
    assert edges == {("e1", "a", "d"), ("e3", "d", "a"), ("e2", "a", "lost"), ("e4", "lost", "d")}
    assert [r.id for r in stores.written(spark, folder, "synthesized").collect()] == ["lost"]
    assert sorted((r.id, r.element) for r in stores.written(spark, folder, "vertex").collect()) == [("a", "a"), ("d", "d"), ("tick", "tick"), ("tock", "tock")]
    assert stores.waiting(spark, folder).count() == 0


# Values of queries without a twin


def test_code_length_clusters_lower_the_total(spark):
    rng = random.Random(1)
    rows = [(f"o{i}", a) for i in range(90) for a in ("abc" if i < 45 else "xyz") if rng.random() < 0.9]
    ctx = spark.createDataFrame(rows, "object string, attribute string")
    one = forest.code_length_clusters(ctx, 1).agg(F.sum("bits")).head()[0]
    two = forest.code_length_clusters(ctx, 2).collect()
    assert sum(r.bits for r in two) <= one + 1e-6
    held = {}
    for o, a in rows:
        held.setdefault(o, set()).add(a)
    sizes, n = Counter(r.cluster for r in two), len(two)
    assert n == len(held) and set(sizes) <= {0, 1}


def test_forests_by_command_values(spark):
    rng = np.random.default_rng(3)
    rows = [("sh", f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.standard_normal((200, 2)))] + [("sh", "far", 40.0, -40.0)] + [("few", f"q{i}", 0.0, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "command string, process string, a double, b double")
    got = {r.process: r for r in forest.forests_by_group(df, "command", "process", ["a", "b"], least=50).collect()}
    assert set(got) == {p for c, p, *_ in rows if c == "sh"} and all(0 < r.score < 1 for r in got.values())
    assert sum(r.score > got["far"].score for r in got.values()) <= 5


def test_segment_classes_follow_the_labels(spark):
    rows = [(i, float(i % 7), float(i % 5), float((i % 7) > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    got = forest.classify_segments(df.where("id % 2 = 0"), df, ["a", "b"], "label")
    assert got.where("predicted <> label").count() == 0 and got.count() == 200
