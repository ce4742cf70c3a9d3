"""The filter audit, whitening and toxicity beside plain versions."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provloom.llm import filter_audit, oracles, queries, toxicity, whitening
from tests.oracle import connect, differences

DOCS = "doc_id long, text string, source string, n long"
LABELS = "doc_id long, quality int, toxic int"


def fails(text, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": not first,
    }


def plain_audit(docs, labels):
    least, out = {}, defaultdict(Counter)
    key = lambda d: math.inf if d is None else d
    for d, t, *_ in docs:
        least[t or ""] = min(least.get(t or "", math.inf), key(d))
    quality, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {s or "" for _, _, s, _ in docs}:
        for order in orders:
            for step in range(1, 6):
                out[part, order, step] = Counter()
    shapley = Counter()
    for d, t, s, _ in docs:
        f = fails(t or "", key(d) == least[t or ""])
        for order in orders:
            gone = False
            for step, x in enumerate(order, 1):
                c = out[s or "", order, step]
                here = f[x] and not gone
                c["kept"] += not gone and not f[x]
                c["removed"] += here
                c["redundant"] += f[x] and gone
                c["unique_fails"] += f[x] and sum(f.values()) == 1
                c["good_lost"] += here and d in quality
                c["toxic_lost"] += here and d in toxic
                shapley[s or "", x] += here
                gone = gone or f[x]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, n): (*(c[x] for x in names), shapley[p, o[n - 1]]) for (p, o, n), c in out.items()}


def audit_rows(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[x] for x in names) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_by_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "of", "Loud", "SHOUT", "a#b", "x|y", "mild", "word", "more", "text"]
    texts = [" ".join(rng.choice(words[: rng.randint(2, 10)]) + str(rng.randint(0, 300)) for _ in range(rng.choice([3, 150, 260]))) for _ in range(25)]
    texts += ["", None, " \n", "ÄÖ A", "x" * 100_000, "same " * 250]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""]), 1) for i in range(120)] + [(None, texts[0], "s", 1), (None, "only here", "u", 1), (None, "only here", "u", 1), (3, texts[1], "t", 1), (3, texts[1], "t", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    found = filter_audit.filter_audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert audit_rows(found) == plain_audit(docs, labels)
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_audit_fields_do_not_run_over(spark):
    n = 2**61
    rows = [("p", 0b00011, True, False, n), ("p", 0b00001, False, True, n), ("p", 0b00001, True, True, n), ("q", 31, True, True, 1)]
    found = audit_rows(filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean, n long")))
    assert found["p", "ABCDE", 1][:6] == (0, 3 * n, 0, 2 * n, 2 * n, 2 * n) and found["p", "BACDE", 2][:3] == (0, 2 * n, n)
    assert found["p", "CDEAB", 5][:3] == (0, 0, n) and len(found) == 1200


def test_audit_twin(spark, sf):
    assert differences(spark, connect(sf), "op11", queries.op11_filter_audit, oracles.op11(), sf) is None


def plain_whitening(vectors, k=16):
    good = [(i, v) for i, v in vectors if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    d = max(Counter(len(v) for _, v in good).items(), key=lambda x: (x[1], x[0]))[0]
    good = [(i, np.floor(64 * np.array(v, float)).astype(int) + 1_000_000) for i, v in good if len(v) == d]
    x = np.unique(np.stack([v for _, v in good]), axis=0)
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    u, e = u[:, e > 1e-9 * e[0]], e[e > 1e-9 * e[0]]
    return good, n, s, e, u, np.trace(c.T @ c / n)


def check_whitening(spark, vectors, components=16):
    df = spark.createDataFrame([(i, v, "kept", 9) for i, v in vectors], "vec_id long, embedding array<double>, x string, n int")
    got = whitening.whiten(df.repartition(3), components=components).collect()
    good, n, s, e, u, trace = plain_whitening(vectors, components)
    assert len(got) == len(good)
    rows = {r.vec_id: r for r in got}
    w = np.stack([rows[i].whitened for i, _ in good])
    want = np.stack([(n * v - s) / n @ u / np.sqrt(e) for _, v in good])
    sign = np.sign((w * want).sum(axis=0))
    assert w.shape == want.shape and np.abs(w - want * sign).max() < 1e-8
    for i, v in good:
        assert rows[i].n == n and int(rows[i].deviation) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))
        assert np.allclose(rows[i].explained, e / trace, rtol=1e-9) and rows[i].identity_error < 1e-9
    return got


def test_whitening_beside_eigh(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 40)) * np.linspace(3, 0.2, 40) + rng.standard_normal(40)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(50)]
    vectors += [(2000, None), (2001, [None] * 40), (2002, [math.nan] * 40), (2003, [math.inf] + [0.0] * 39), (2004, [1.0, 2.0]), (2005, [])]
    check_whitening(spark, vectors)


def test_whitening_of_dependent_dimensions_and_dominant_directions(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 60)) * 2
    base[:, 50:] = 0.25  # no variance
    base[:, 0] += np.where(rng.random(300) < 0.5, 400.0, -400.0)  # drowns the rest
    base[:, 30:50] = base[:, 10:30]
    check_whitening(spark, [(i, v.tolist()) for i, v in enumerate(base)])
    few = rng.standard_normal((300, 3)) @ rng.standard_normal((3, 20))
    assert len(check_whitening(spark, [(i, np.round(v * 64).tolist()) for i, v in enumerate(few)], 3)[0].whitened) == 3


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        df = whitening.whiten(spark.createDataFrame(rows, schema))
        assert df.count() == 0 and {"deviation", "whitened", "n", "explained", "identity_error"} <= set(df.columns)
    two = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (7, [1.0, 3.0]), (7, [1.0, 3.0])], schema)).collect()
    assert len(two) == 3 and all(len(r.whitened) == 1 and abs(abs(r.whitened[0]) - 1) < 1e-12 and r.explained == [1.0] for r in two)


def test_deviations_beyond_64_bits():
    x = np.array([[2**40, -(2**40)], [1, 2]])
    sums = np.array([5, -7])
    n = 10**6
    assert [int(v) for v in whitening.deviations(x, n, sums).to_pylist()] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, sums)) for r in x]


def folded(spark, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(toxicity.fold(F.col("t"))).collect()]


def test_folding(spark):
    plain, *rest = folded(spark, "idiot stupid", "1D10T\nstup1d", "іdіоt, $TUP!D", "ｉｄｉｏｔ…５tupid", "id​iot-stu­pid", "ID|OT stupid!")
    assert all(x == plain for x in rest)
    assert folded(spark, None, "", " \n,;", "100 % sure! yes") == [" ", " ", " ", " loo % sure yes ".replace("% ", "")]
    assert folded(spark, "Größe")[0] == " größe "


def plain_features(text, lexicon):
    words = text.split()
    spared = set()
    for phrase in lexicon.exceptions:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                spared.update(range(i, i + len(p)))
    hits = {}
    for i, w in enumerate(words):
        fits = [(len(t), weight) for t, weight in lexicon.terms if (w + " ").startswith(t)]
        if fits and i not in spared:
            hits[w] = max(fits)[1]
    return sum(hits.values()), len(set(words)), len(hits), max(hits.values(), default=0.0)


def test_matching_beside_plain_search(spark):
    lexicon = toxicity.Lexicon((("bad", 2.0), ("badge", 1.0), ("bad ", 3.0), ("sc", 0.5)), ("badger", "so bad", "bad bad luck", "scale"))
    rng = random.Random(5)
    pool = ["bad", "badge", "badger", "badges", "so", "luck", "scale", "scales", "scum", "xbad", "a"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["bad" * 1000, "a " * 50_000 + "bad"]
    padded = [f" {t} " if t else " " for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(padded)], "id long, folded string").repartition(4)
    got = {r.id: tuple(r[x] for x in toxicity.FEATURES) for r in toxicity.with_features(docs, lexicon).collect()}
    for i, t in enumerate(padded):
        assert got[i] == pytest.approx(plain_features(t, lexicon))


def labelled(seed=6, n=600):
    rng = random.Random(seed)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["gronk", "GR0NK", "zlurping", "zlurped", "fweb"]))
        if not toxic and rng.random() < 0.3:
            words.insert(0, "zlurpee")  # an innocent word with the same beginning
        docs.append((i, " ".join(words), "en", 5))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_learns_words_beginnings_and_exceptions(spark):
    docs, labels = labelled()
    extra = [(None, "gronk fweb zlurped", "x", 1), (7, docs[7][1], "en", 1), (9000, "", "en", 0), (9001, None, "en", 0), (9002, "gronk " * 2 + "calm " * 3, "en", 1), (9003, "GRONK, fweb! zlurping", "en", 1)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, toxic int").repartition(4)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], LABELS)
    got = toxicity.classify(df, lab).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {d: t for d, _, t in labels}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 9000]
    assert all(r.predicted == truth[r.doc_id] for r in known if r.held_out)
    by = {r.doc_id: r for r in got}
    assert by[9003].predicted == 1 and by[None].predicted == 1 and by[9000].predicted == by[9001].predicted == 0
    model = toxicity.fit(df.select("doc_id", "text"), lab)
    assert any("gronk".startswith(t.strip()) for t, _ in model.lexicon.terms) and "zlurpee" in model.lexicon.exceptions


def test_toxicity_reads_no_held_out_label(spark):
    docs, labels = labelled(8, 300)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n int")
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    one, two = ({r.doc_id: r.score for r in toxicity.classify(df, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert one == two


def test_toxicity_without_labels_or_of_one_class(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert all(r.score == 0 and r.predicted == 0 for r in toxicity.classify(docs, spark.createDataFrame([], LABELS)).collect())
    assert all(r.predicted == 0 for r in toxicity.classify(docs, spark.createDataFrame([(1, 1, 0)], LABELS)).collect())
    assert toxicity.classify(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1, 0), (2, 1, 1)], LABELS)).count() == 0


def test_toxicity_on_held_out_documents(spark, sf):
    larger = sf.replace("0.001", "0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = [(truth[r.doc_id], r.predicted) for r in queries.op13_toxicity(spark, larger).collect() if r.held_out and r.doc_id in truth]
    caught, clean = [p for t, p in rows if t], [p for t, p in rows if not t]
    assert sum(caught) >= 0.8 * len(caught) and sum(clean) <= 0.05 * len(clean)
