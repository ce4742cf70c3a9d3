"""URL reputation, the Kneser-Ney classifier, the masked language model and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provloom.llm import kneser_ney, masked_lm, minhash, mixing, quality_rules, queries, secret_scan, url_reputation


def host_path(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [r for r in url_reputation.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [None, "", "no scheme", "http://", "HTTPS://A.Example.NET/en/x?y://z", "ftp://example.net:80/en/", "http://xexample.com/de/1", "http://example.com/de", "http://example.com/de/", "a://b.org/fr/?q", "x://u@h.org/fr/#f", "http://net/", "http://net", "m://É.NET/\n/en"]


def test_url_rules(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op6_url_reputation(spark, sf).collect()
    odd = url_reputation.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), spark.createDataFrame([], "page_id long, failing boolean"))
    odd = odd.collect()
    assert len(got) == len(pages) and len(odd) == len(URLS)
    for r, url in [*((r, pages[r.page_id]) for r in got), *((r, URLS[r.page_id]) for r in odd)]:
        assert (r.host, r.path) == host_path(url)
        rule = rule_of(*host_path(url))
        assert r.rule == (rule.name if rule else None) and r.verdict in ("allow", "block") and (not rule or r.verdict == rule.verdict)
    assert all(r.verdict == "allow" for r in odd if r.rule is None)


def test_reputation_shrinks(spark):
    rows, bad, i = [], [], 0
    for host, n, fails in (("good.a.com", 200, 4), ("bad.b.com", 200, 180), ("few.c.com", 2, 2), ("new.b.com", 1, None), ("big.d.org", 500, 25), ("x.e.co.uk", 50, 1)):
        for k in range(n):
            rows.append((i, f"http://{host}/p{k}"))
            if fails is not None:
                bad.append((i, k < fails))
            i += 1
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, failing boolean")
    rep = {r.host: r for r in url_reputation.host_reputation(pages, outcomes).collect()}
    assert rep["bad.b.com"].bound > 0.5 and rep["good.a.com"].mean < 0.1 and rep["few.c.com"].mean < 1 and rep["few.c.com"].bound < rep["bad.b.com"].bound
    assert rep["new.b.com"].mean > rep["big.d.org"].mean
    verdicts = {(r.host, r.verdict) for r in url_reputation.judge(pages, outcomes, ()).collect()}
    assert ("bad.b.com", "block") in verdicts and ("good.a.com", "allow") in verdicts and ("big.d.org", "allow") in verdicts
    domain = spark.createDataFrame([("x.e.co.uk",), ("a.b.com",), ("localhost",), ("h.org:8080",)], "h string").select(url_reputation.registered_domain(F.col("h")).alias("d"))
    assert [r.d for r in domain.collect()] == ["e.co.uk", "b.com", "localhost", "h.org"]


SUFFIXES = ["com", "uk", "co.uk", "io", "github.io", "*.ck", "!www.ck", "me.uk", " K12.CA.US ", "us", ""]


def test_suffixes_read_as_data(spark):
    want = {
        "a.b.com": "b.com", "x.github.io": "x.github.io", "y.x.github.io": "x.github.io", "github.io": "github.io", "z.me.uk": "z.me.uk", "w.v.co.uk": "v.co.uk", "q.uk": "q.uk", "a.k12.ca.us": "a.k12.ca.us",
        "b.a.k12.ca.us": "a.k12.ca.us", "p.q.r.ck": "q.r.ck", "r.ck": "r.ck", "s.www.ck": "www.ck", "www.ck": "www.ck", "one.unknown": "one.unknown", "localhost": "localhost", "10.0.0.7:80": "10.0.0.7", "u@h.b.com:8080": "b.com",
    }
    table = spark.createDataFrame([(s, 1) for s in [*SUFFIXES, "com"]], "suffix string, host int")
    hosts = spark.createDataFrame([(h,) for h in want], "host string").repartition(3)
    got = {r.host: r for r in url_reputation.domains_by_table(hosts, table).collect()}
    assert {h: r.domain for h, r in got.items()} == want
    assert got["p.q.r.ck"].suffix == "r.ck" and got["s.www.ck"].suffix == "ck" and got["y.x.github.io"].suffix == "github.io" and got["q.uk"].suffix == "uk"
    pages = spark.createDataFrame([(i, f"http://{h}/{i}") for i in range(40) for h in ("bad.github.io", "good.github.io")][:80], "page_id long, url string").withColumn("page_id", F.monotonically_increasing_id())
    outcomes = pages.select("page_id", F.contains("url", F.lit("bad.")).alias("failing"))
    rep = {r.host: r for r in url_reputation.host_reputation(pages, outcomes, suffixes=table).collect()}
    assert rep["bad.github.io"].domain != rep["good.github.io"].domain and rep["bad.github.io"].bound > 0.5 > rep["good.github.io"].mean
    assert {(r.host, r.verdict) for r in url_reputation.judge(pages, outcomes, (), suffixes=table).collect()} == {("bad.github.io", "block"), ("good.github.io", "allow")}


def test_lower_bounds_are_shares(spark):
    cases = [(m, n) for m in (0.0, 0.001, 0.25, 0.5, 0.999, 1.0) for n in (2.0, 30.0, 1e6)]
    rows = spark.createDataFrame(cases, "m double, n double").select("m", "n", url_reputation.lower_bound(F.col("m"), F.col("n")).alias("b")).collect()
    z = url_reputation.Z
    for r in rows:
        assert 0 <= r.b + 1e-15 and r.b <= r.m + 1e-12
        if r.b > 1e-9:  # the share at which the mean is just z standard deviations above it
            assert abs(r.m - r.b - z * math.sqrt(r.b * (1 - r.b) / r.n)) < 1e-6


def brute_kn(texts):
    """Trigram modified Kneser-Ney from its definition; symbols as strings, None elsewhere."""
    c3 = Counter()
    for t in texts:
        s = [1, 1, *t, 1]
        c3.update(zip(s, s[1:], s[2:], strict=False))
    c2 = Counter((u, w) for _, u, w in c3)
    c1 = Counter(w for _, w in c2)

    def discounts(c):
        n = Counter(min(x, 5) for x in c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[1] and n[k] else 0.5 for k in (1, 2, 3)]
        return [max(0.1, min(k - 0.1, r)) for k, r in zip((1, 2, 3), raw, strict=True)]

    total, size = sum(c1.values()), kneser_ney.SYMBOLS
    p1 = lambda w: (c1[w] + 0.5 / size) / (total + 0.5)

    def order(c, lower):
        d = discounts(c)
        by = {}
        for key, n in c.items():
            t = by.setdefault(key[:-1], [0, 0.0])
            t[0] += n
            t[1] += d[min(n, 3) - 1]

        def p(*key):
            if key[:-1] not in by:
                return lower(*key[1:])
            n, (tot, left) = c[key], by[key[:-1]]
            return ((n - d[min(n, 3) - 1] if n else 0) + left * lower(*key[1:])) / tot

        return p

    return order(c3, order(c2, p1))


def test_kneser_ney_matches_definition(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aab cde") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    trusted = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    alphabets = kneser_ney.find_alphabets(trusted, F.array(F.lit("m")))
    alphabet, table = alphabets["m"], kneser_ney.fit(trusted, alphabets, F.array(F.lit("m")))["m"]
    want = brute_kn([kneser_ney.symbols_of(t, alphabet)[2:-1].tolist() for t in texts])
    for t in ["abc", "eeeee", "zz a", "dcba edc"]:
        ids = kneser_ney.symbols_of(t, alphabet)
        got = table[kneser_ney._trigrams(ids)]
        expected = [math.log(want(*k)) for k in zip(ids.tolist(), ids[1:].tolist(), ids[2:].tolist(), strict=False)]
        assert np.allclose(got, expected, atol=1e-4)
        assert kneser_ney.perplexity(t, alphabet, table) == pytest.approx(math.exp(-sum(expected) / len(expected) + alphabet.other_cost * sum(ids == 0) / len(expected)), rel=1e-3)


def test_thresholds_and_verdicts(spark):
    """Languages of their own scripts and one too rare for a model: thresholds are quantiles of what wasn't trained on, verdicts follow."""
    rng = random.Random(5)
    say = lambda letters, n: "".join(rng.choice(letters) + rng.choice("ab ") for _ in range(n))
    scripts = {"x": "cdefgh", "y": "абвгд", "z": "αβγδ"}
    rows = [(i, say(scripts["xyz"[i % 3]], 60), "xyz"[i % 3]) for i in range(450)] + [(900 + i, say("кнопрст", 60), "y") for i in range(5)]
    rows += [(950, "a" * 50, "q"), (951, None, "x"), (952, "", "x"), (950, say("cdefgh", 9000), "x"), (None, "cadaf", None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(450)] + [(900, 0, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("model", F.lit("clash")), labels).collect()
    assert len(got) == len(rows) and not any(r.kept for r in got if r.doc_id is not None and 900 <= r.doc_id < 905)
    assert all(r.perplexity is None and not r.kept for r in got if r.doc_id in (951, 952))
    held = {r.id for r in spark.range(450).where("pmod(xxhash64(id, 1), 5) = 0").collect()}
    for k, lang in enumerate("xyz"):
        of = [r for r in got if r.doc_id is not None and r.doc_id < 450 and r.doc_id % 3 == k]
        values = sorted(r.perplexity for r in of if r.doc_id in held)
        [limit] = {r.threshold for r in of}
        assert {r.model for r in of} == {lang} and limit in values and limit >= values[int(kneser_ney.QUANTILE * len(values)) - 1]
        assert all(r.kept == (r.perplexity <= limit) for r in of)
    assert kneser_ney.classify(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0


def test_every_trusted_document_is_used(spark, monkeypatch):
    """26,000 trusted documents: all but those held out are trained on, and the threshold is a quantile of all of these."""
    seen = []
    plain = kneser_ney.find_alphabets
    monkeypatch.setattr(kneser_ney, "find_alphabets", lambda trusted, model: seen.append(trusted.count()) or plain(trusted, model))
    docs = spark.range(26_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"), F.lit("x").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = kneser_ney.classify(docs, labels)
    held = docs.where("pmod(xxhash64(doc_id, 1), 5) = 0").select("doc_id")
    n = held.count()
    assert seen == [26_000 - n]
    kept = got.join(held, "doc_id").where("kept").count()
    assert 0 <= kept - kneser_ney.QUANTILE * n < 20


def test_classifier_separates(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_kneser_ney(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got}
    kept = {q: [got[i].kept for i, x in labels.items() if x == q] for q in (0, 1)}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean(kept[1]) > 0.9 and np.mean(kept[0]) < 0.2
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (None, "abc", "qq")], "doc_id long, text string, lang string")
    assert not any(r.kept for r in kneser_ney.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect())


def test_masked_lm(spark, sf):
    rng = random.Random(9)
    make = lambda: " ".join(rng.choice(["a x b", "c y d", "e z f"]) for _ in range(60))
    rows = [(i, make()) for i in range(800)]
    shuffled = rows[0][1].split()
    rng.shuffle(shuffled)
    rows += [(1000, " ".join(shuffled)), (1001, None), (1002, " \n"), (None, "x"), (1000, "word " * 30_000)]
    got = masked_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    plain = np.mean([r.pll_mean for r in got if r.doc_id is not None and r.doc_id < 800])
    mixed = next(r for r in got if r.doc_id == 1000 and r.n_tokens < 1000)
    assert plain > -1.2 and mixed.pll_mean < plain - 0.5  # alone, a token has 9 kinds: log 9 = 2.2
    assert all(r.pll_mean is None and r.pll_sum == 0 for r in got if r.doc_id in (1001, 1002))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    real = queries.op10_masked_lm(spark, sf).collect()
    assert all(r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id])) and (not r.n_tokens or r.pll_mean < 0) for r in real) and len(real) == len(docs)
    assert masked_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_masked_lm_trains_on_every_document(spark):
    ids = [r.id for r in spark.range(1000).where("pmod(xxhash64(id, 2), 16) <> 0").limit(300).collect()]  # none of the former sample
    rows = [(i, "a x b c y d " * 30) for i in ids] + [(None, "e z f " * 60)] * 300
    got = masked_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 600 and min(r.pll_mean for r in got) > -1.5  # both kinds of text are known; untrained weights give about -5.5


def test_masked_lm_tells_words_of_a_class_apart(spark):
    common = [f"c{i}" for i in range(masked_lm.KINDS - masked_lm.OTHERS - 1)]
    tokens = masked_lm.Tokens(common)
    odd = [w for w in (f"w{i}" for i in range(5000)) if tokens.ids(w)[0] == tokens.ids("rare")[0]][:2]
    rows = [(i, " ".join(common)) for i in range(60)] + [(100 + i, odd[0].upper()) for i in range(40)] + [(200, odd[1]), (200, f"c1\t{odd[1]} c2"), (201, f"c1 {odd[0]} c2")]
    got = masked_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_tokens): r.pll_sum for r in got}
    assert by[100, 1] - by[200, 1] == pytest.approx(math.log(41 / 2), abs=1e-4) == pytest.approx(by[201, 3] - by[200, 3], abs=1e-4)
    assert math.exp(by[100, 1]) + math.exp(by[200, 1]) < 1


def test_urls_at_the_edges(spark):
    """Null, odd and very long urls, repeated rows, outcomes of null id, clashing columns, no pages at all."""
    long = "http://" + "a." * 3000 + "example.org/" + "x" * 50_000
    pages = [(1, None, "h"), (2, "no scheme", "h"), (3, "HTTP://User@Sub.Example.NET:80/en/x?q", "h"), (3, "http://a.b.co.uk/", "h"), (None, "http://10.0.0.7/x", "h"), (4, long, "h"), (4, long, "h")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(None, True), (3, True), (3, False), (99, True)], "page_id long, failing boolean")
    got = url_reputation.judge(df, outcomes).collect()
    assert len(got) == len(pages) and sum(r.page_id == 4 for r in got) == 2
    assert all((r.host, r.path, r.rule, r.verdict) == ("", "", None, "allow") for r in got if r.page_id in (1, 2))
    assert {r.host for r in got if r.page_id == 3} == {"user@sub.example.net:80", "a.b.co.uk"}
    assert url_reputation.judge(df.limit(0), outcomes).count() == 0
    hosts = {"a.com.tr": "a.com.tr", "x.b.com.tr": "b.com.tr", "10.0.0.7": "10.0.0.7", "u@h.example.org:8": "example.org", "localhost": "localhost", "co.uk": "co.uk"}
    rows = spark.createDataFrame(list(hosts.items()), "host string, want string").withColumn("got", url_reputation.registered_domain(F.col("host")))
    assert all(r.got == r.want for r in rows.collect())
    assert [r.s for r in rows.select(url_reputation.suffix(F.col("got")).alias("s")).collect()] == ["com.tr", "com.tr", "10.0.0.7", "org", "localhost", "uk"]


def plain_probability(w, around, own):
    """The two-level softmax of one token, step by step."""
    vectors, gates, bias, top, top_bias, low, low_bias = masked_lm.parts(w)
    h = [math.tanh(bias[j] + sum(float(vectors[t][j]) * float(gates[p][j]) for p, t in enumerate(around))) for j in range(masked_lm.WIDTH)]
    logits = lambda m, b: [float(b[k]) + sum(h[j] * float(m[j][k]) for j in range(len(h))) for k in range(len(b))]
    klass, inner = divmod(int(own), masked_lm.CLASS)
    one, two = logits(top, top_bias), logits(low[klass], low_bias[klass])
    return one[klass] - math.log(sum(map(math.exp, one))) + two[inner] - math.log(sum(map(math.exp, two)))


def test_scores_beside_a_plain_softmax(spark, monkeypatch):
    """Every token of every text by a naive loop with the trained weights, and the same scores from other partitions."""
    kept = []
    plain = masked_lm.fit
    monkeypatch.setattr(masked_lm, "fit", lambda rows, tokens: kept.append(plain(rows, tokens)) or kept[-1])
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["red", "green", "Blue", f"w{rng.randrange(900)}", f"v{i}"]) for _ in range(rng.randrange(1, 40)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: r.pll_sum for r in masked_lm.score(df.repartition(n)).collect()} for n in (2, 8))
    assert all(abs(one[i] - two[i]) < 1e-4 for i, _ in rows) and np.abs(kept[0] - kept[1]).max() < 1e-4
    counts = Counter(w for _, t in rows for w in t.lower().split())
    tokens = masked_lm.Tokens(sorted(counts, key=lambda w: (-counts[w], w))[: masked_lm.KINDS - masked_lm.OTHERS - 1])
    of_kind = Counter()
    for w, n in counts.items():
        of_kind[int(tokens.ids(w)[0])] += n
    for i, t in rows[:12]:
        ids = tokens.ids(t.lower())
        near = masked_lm.windows(ids)
        want = sum(plain_probability(kept[0], near[k], ids[k]) + (math.log(counts[w] / of_kind[int(ids[k])]) if ids[k] >= masked_lm.KINDS - masked_lm.OTHERS else 0) for k, w in enumerate(t.lower().split()))
        assert one[i] == pytest.approx(want, abs=1e-2)


def test_gradient():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 20, 64)
    around, w = masked_lm.windows(ids), masked_lm.start()
    before = masked_lm.log_probabilities(w, around, ids).sum()
    for n in range(30):
        w = masked_lm.train(w, around, ids, 0.15, n)
    assert masked_lm.log_probabilities(w, around, ids).sum() > before + 30


def test_pipeline(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    cleaned = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    kept = [(i, r.clean_text) for i, r in cleaned.items() if r.kept]
    from tests.llm.test_minhash import brute
    stays = {i for i, _, _, k in brute(kept, 5) if k}
    assert {r.doc_id for r in got} == stays and len(got) == len(stays)
    library, mask = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "[secret]"
    from tests.llm.test_native import spans_of
    for r in got:
        text = cleaned[r.doc_id].clean_text
        found = spans_of(text)
        if not found:
            assert r.token_ids == library.encode(text, add_special_tokens=False).ids
        else:
            assert mask in library.decode(r.token_ids)
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "", "", 0, 2)], "doc_id long, text string, lang string, source string, n_chars long, node int")
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, rows, sf).count() == rows.count()
        assert corpus_pipeline.clean(spark, rows, sf).count() == 0
