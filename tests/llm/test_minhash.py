"""Near-duplicate groups against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provloom.llm import components, minhash, queries


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = [(x, y) for x, (_, a) in enumerate(sets) for y, (_, b) in enumerate(sets[:x]) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    root = components.union_find(links)
    least = {}
    for x, r in root.items():
        if sets[x][0] is not None:
            least[r] = min(least.get(r, sets[x][0]), sets[x][0])
    out = []
    for x, (i, s) in enumerate(sets):
        c = least.get(root[x]) if x in root else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op3_minhash(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=str) == brute(rows, 4)


def test_chains_and_odd_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    rows, i = [], 100
    for _ in range(6):
        text = [word() for _ in range(200)]
        for _ in range(12):  # each is a few words from the last: ends of a chain aren't linked with each other
            rows.append((i, " ".join(text)))
            i -= 1
            text = list(text)
            for _ in range(rng.randrange(1, 6)):
                text[rng.randrange(200)] = word()
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "ONE\ttwo "), (1003, "other words"), (None, "one two"), (None, "null id of its own"), (1005, "É é"), (1006, "é é"), (1005, "É é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).repartition(3)
    got = [tuple(r) for r in minhash.near_duplicates(df, 4).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=str) == brute(rows, 4)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng, errors = np.random.default_rng(2), []
    for n in (3, 40, 500, 3000):
        for _ in range(20):
            both = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
            a, b = both[: n + n // 2], both[n // 2 :]
            sig = minhash.super_minhash([a, b, a])
            assert (sig[0] == sig[2]).all()
            errors.append((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(both))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, x) for x in range(1001, 1100)] + [(x, x + 1) for x in range(2000, 2060)]
    df = spark.createDataFrame([(b"%05d" % a, b"%05d" % b) for a, b in links], "a binary, b binary").repartition(6)
    want = {b"%05d" % x: b"%05d" % r for x, r in components.union_find([x for x in links if x[0] != x[1]]).items()}
    for at_once in (0, 10_000):
        got = {bytes(r.node): bytes(r.root) for r in components.components(df, at_once).collect()}
        assert got == want


@pytest.mark.parametrize("words", [4, 5])
def test_hub_with_outliers(spark, words):
    """Members that aren't linked with the bucket's leader are linked with each other."""
    rng = random.Random(words)
    base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for p in rng.sample(range(120), rng.randrange(6)):
            text[p] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in minhash.near_duplicates(df, words).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=str) == brute(rows, words)


def hub(size, seed=3, length=120, most=12, edits=60):
    """Near copies of one text, similar to each other at 0.5 to 0.9; few are linked with any but the plainest. Edits are of so many words."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**9)}" for _ in range(length)]
    rows = []
    for i in range(size):
        text = list(base)
        for p in rng.sample(range(length), rng.randrange(2, most)):
            text[p] = f"x{rng.randrange(edits)}"
        rows.append((i, " ".join(text)))
    return rows


def test_large_hub_with_odd_ids(spark):
    """600 near copies, a tenth without id, some of one id, and a second hub in the same table."""
    rng = random.Random(9)
    rows = [(None if rng.random() < 0.1 else i if rng.random() < 0.9 else 7, t) for i, t in hub(600)]
    rows += [(5000 + i, t) for i, t in hub(150, 4)]
    got = [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect()]
    assert sorted(got, key=str) == brute(rows, 4)


def test_difference_bound():
    """Linked sets have (s(x) + s(y)) / 2 elements of their differences from any pivot in common, and no others have."""
    rng = random.Random(8)
    for _ in range(300):
        pool = range(40)
        pivot, x, y = (set(rng.sample(pool, rng.randrange(1, 30))) for _ in range(3))
        y = y if rng.random() < 0.5 else (x | {rng.randrange(60)}) - {rng.randrange(40)} or {1}
        for percent in (60, 80, 95):
            s = [(100 + percent) * len(z ^ pivot) - (100 - percent) * len(z) for z in (x, y)]
            linked = 100 * len(x & y) >= percent * len(x | y)
            assert linked == (2 * (100 + percent) * len((x ^ pivot) & (y ^ pivot)) >= sum(s))


def test_few_pairs_are_compared(spark, monkeypatch):
    """Of a group whose nodes mostly aren't linked with its centre, about one pair in a hundred is compared for the rest, not all."""
    made = []
    plain = minhash._by_differences

    def counted(held, open_nodes, texts, done, roots, words, percent, verify):
        def and_count(pairs):
            made.append(pairs.count())
            return verify(pairs)

        return plain(held, open_nodes, texts, done, roots, words, percent, and_count)

    monkeypatch.setattr(minhash, "_by_differences", counted)
    minhash.near_duplicates(spark.createDataFrame(hub(800, edits=100), "doc_id long, text string"), 4).count()
    assert 0 < sum(made) < 800 * 799 / 2 / 100


def test_nodes_give_each_difference_once(spark, monkeypatch):
    """However many sizes of partners there are in a group, a node's elements are keys once, and most are none."""
    made, plain = [], minhash._keys

    def counted(known, scale):
        given = plain(known, scale)
        made.append((given.count(), given.select("region", "node", "h").distinct().count(), known.agg(F.sum(F.size("e"))).head()[0]))
        return given

    monkeypatch.setattr(minhash, "_keys", counted)
    minhash.near_duplicates(spark.createDataFrame(hub(400, edits=100), "doc_id long, text string"), 4).count()
    [(rows, distinct, all_elements)] = made
    assert 0 < rows == distinct < all_elements


def test_rows_are_dropped_one_by_one(spark):
    t = " ".join(f"w{i}" for i in range(100))
    rows = [(5, t, "a"), (None, t + " x", "b"), (None, "a unique text of some words", "c"), (6, t, "d"), (8, "twice the same row", "e"), (8, "twice the same row", "f"), (9, None, "g"), (9, " ", "h"), (None, None, "i"), (8, "another text of that id", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(r.node for r in minhash.drop_near_duplicates(df).collect())
    assert got in (["a", "c", x, "g", "h", "i", "j"] for x in "ef")
    nothing = [(None, t, "a"), (None, t + " y", "b"), (None, t, "c")]
    assert len(minhash.drop_near_duplicates(spark.createDataFrame(nothing, df.schema)).collect()) == 1
    assert minhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{i % 30_011}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short text"), (4, "x" * 300_000)]
    got = [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()]
    assert sorted(got, key=str) == brute(rows, 4)
