"""Order-aware operators against sequential simulators, and parsers on small fixtures."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provloom.functions import scalar
from provloom.operators import forest, novelty, policy, resolve, segments
from provloom.operators.graph import Graph
from provloom.plans.compiler import Compiler
from provloom.plans.parser import Name, QuerySyntaxError, Step, parse
from provloom.sources import avro, files


def simulate(observations):
    """The trie's nodes one by one: counters and children, alarms at new leaves."""
    root, found = {"n": 0, "kids": {}}, []
    q = lambda s, n: 1.0 if n == 0 else s / (s + n)
    for seq, key in observations:
        before_kids, before_n = len(root["kids"]), root["n"]
        root["n"] += 1
        node, new = root, None
        for level, k in enumerate(key, 1):
            fresh = k not in node["kids"]
            child = node["kids"].setdefault(k, {"n": 0, "kids": {}})
            if fresh and new is None:
                new = (level, q(before_kids, before_n) if level == 1 else q(len(node["kids"]), node["n"]))
            child["n"] += 1
            parent, node = node, child
        if node["n"] == 1:
            if parent["n"] == 1:
                found.append((seq, new[1], 1 / root["n"], new[0]))
            else:
                found.append((seq, q(len(parent["kids"]), parent["n"]), 1 / root["n"], len(key)))
    return found


def test_trie_matches_simulator(spark):
    rng = random.Random(1)
    obs = [(i, [rng.choice("abcd") for _ in range(rng.randrange(1, 5))]) for i in range(600)]
    df = spark.createDataFrame([("t", i, k) for i, k in obs], "tree string, seq long, key array<string>")
    got = sorted((r.seq, round(r.local_prob, 9), round(r.global_prob, 9), r.depth) for r in novelty.alarms(novelty.observe(df)).collect())
    assert got == sorted((s, round(a, 9), round(b, 9), d) for s, a, b, d in simulate(obs))


def test_guarded_clock(spark):
    rng = random.Random(2)
    rows = [(h, i, 10**18 + i * 1000 + (10**15 if rng.random() < 0.05 else rng.randrange(-5000, 5000))) for h in "ab" for i in range(300)]
    got = {(r.host, r.seq): r.clock for r in resolve.guarded_clock(spark.createDataFrame(rows, "host string, seq long, nanos long"), "host", "seq", "nanos", 10**6, 10**17).collect()}
    for h in "ab":
        now = 0
        for _, i, t in (r for r in rows if r[0] == h):
            if t > now and (now < 10**17 or t - now <= 10**6):
                now = t
            assert got[h, i] == now


def test_event_collapse_simulator(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(500):
        t += rng.choice([1, 2, 50])
        rows.append((i, rng.choice("xy"), rng.choice("ab"), t))
    got = resolve.collapse_events(spark.createDataFrame(rows, "seq long, k string, kind string, nanos long"), ["k"], "kind", "seq", "nanos", 20, 15, 4)
    want = []
    for k in "xy":
        run = None
        for i, _, kind, t in (r for r in rows if r[1] == k):
            if run and run[0] == kind and t - run[5] <= 20 and i - run[2] <= 15 and run[3] < 4:
                run = [kind, run[1], i, run[3] + 1, run[4], t]
            elif run and run[0] == kind and t - run[5] <= 20 and i - run[2] <= 15:
                want.append((k, *run))
                run = [kind, i, i, 1, t, t]
            else:
                if run:
                    want.append((k, *run))
                run = [kind, i, i, 1, t, t]
        want.append((k, *run))
    assert sorted((r.k, r.kind, r.first_seq, r.last_seq, r.merged, r.earliest, r.latest) for r in got.collect()) == sorted(want)


PATHS = [
    ("/a/b/../c", "/a/c"), (" /usr//bin/./ls -l /x", "/usr/bin/ls"), ("/..", None), ("", None), ("<unknown>", None), ("unknown", None), ("a/..", None), ("../a", "../a"),
    ('"/my dir/x" -v', "/my dir/x"), (r"/a\ b/c d", r"/a\ b/c"), ("'/q r/s'", "/q r/s"), ("/", "/"), (None, None), ("./x", "x"), ("a/b/../../c", "c"),
]
WINDOWS = [(r"C:\Windows\System32\cmd.exe", r"\windows\system32\cmd.exe"), (r'"C:\a b\c.exe" /k', r"\a b\c.exe"), (r"\Device\HarddiskVolume1\x\..\y", r"\y"), (r"%SystemRoot%\a", r"\windows\a"), (r"\..", None)]


@pytest.mark.parametrize(("windows", "cases"), [(False, PATHS), (True, WINDOWS)])
def test_normalized_path(spark, windows, cases):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p string")
    got = {r.i: r.n for r in df.select("i", scalar.normalized_path(F.col("p"), windows).alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_list_uuid(spark):
    import hashlib
    import uuid

    ids = [str(uuid.UUID(int=i * 7919 + 3)) for i in range(4)]
    raw = b"".join(uuid.UUID(i).bytes[8:] + uuid.UUID(i).bytes[:8] for i in sorted(ids))
    h = bytearray(hashlib.md5(raw).digest())
    h[6], h[8] = h[6] & 0x0F | 0x30, h[8] & 0x3F | 0x80
    got = spark.createDataFrame([(ids,)], "u array<string>").select(scalar.list_uuid(F.col("u")).alias("x")).head().x
    assert got == str(uuid.UUID(bytes=bytes(h)))


def test_parser():
    s = parse("a = [1,2L].toArray(); g.V(a).has('x y', between(1, 'z')).where(_.out().is(neq(3))).order().by(_.values('k'), decr)")
    assert s.statements == (("a", (1, 2)),) and s.result.steps[0] == Step("V", (Name("a"),)) and s.result.steps[1].args[0] == "x y"
    for bad in ("g.V(", "g.V() g", "x = 1", "1", "g.V().has('a'", "g", "g.V(); "):
        with pytest.raises((QuerySyntaxError, IndexError)):
            parse(bad)


def walks(edges, node, forth):
    """All paths from a node to an end, by a plain walk."""
    ahead = [b if forth else a for a, b in edges if (a if forth else b) == node]
    return [[node, *rest] for n in ahead for rest in walks(edges, n, forth)] or [[node]]


def test_dag_queries(spark):
    """A ladder of three diamonds with a dead end and a shortcut, beside walks over the list."""
    dag = [(10 * i + a, 10 * i + b) for i in range(3) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (3, 10))] + [(1, 50), (0, 13)]
    e = spark.createDataFrame([(f"{a}>{b}", str(a), "x", str(b)) for a, b in dag], "id string, src string, label string, dst string")
    from provloom.operators.graph import PROPERTIES

    every = sorted({x for pair in dag for x in pair})
    v = spark.createDataFrame([(str(i), "N") for i in every], "id string, label string").select("id", "label", *[F.lit(None).cast("string").alias(p) for p in PROPERTIES])
    ask = lambda q: sorted(str(r.result) for r in Compiler(Graph(v, e)).run(q).collect())
    assert ask("g.V('10').out().id()") == sorted(str(b) for a, b in dag if a == 10) and ask("g.V('13').in().id()") == sorted(str(a) for a, b in dag if b == 13)
    ends = walks(dag, 0, True)
    assert ask("g.V('0').repeat(_.out()).until(_.hasId('30')).count()") == [str(sum(w[-1] == 30 for w in ends))]
    before = {x for w in walks(dag, 30, False) for x in w[1:]}
    assert ask("g.V('30').repeat(_.in()).emit().times(9).dedup().count()") == [str(len(before))]
    through = sorted(tuple(r.path) for r in segments.paths_through(e, "11", 9).collect())
    want = [tuple(map(str, [*b[::-1], *f[1:]])) for b in walks(dag, 11, False) for f in walks(dag, 11, True)]
    assert through == sorted(want)


@pytest.mark.parametrize("text", ["XYXZY", "XXYYZXYZ", "ZZYX"])
def test_grammar_sequences(spark, text):
    from itertools import combinations

    steps = spark.createDataFrame([("p", i, c) for i, c in enumerate(text)], "path string, pos int, label string")
    t = lambda c: segments.terminal(steps, c)
    got = sorted(tuple(r["at"]) for r in segments.sequence(t("X"), t("Y"), t("Z")).collect())
    assert got == sorted(at for at in combinations(range(len(text)), 3) if "".join(text[i] for i in at) == "XYZ")


def zigzag(n):
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def container(codec):
    schema = {"type": "record", "name": "R", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "l", "type": {"type": "array", "items": "int"}}, {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}}, {"name": "u", "type": {"type": "fixed", "name": "U", "size": 16}}, {"name": "kid", "type": ["null", "R"]}]}
    text = lambda s: zigzag(len(s.encode())) + s.encode()
    body = b""
    for i in (-5, 300):
        leaf = zigzag(i) + zigzag(1) + text("é") + zigzag(2) + zigzag(7) + zigzag(-8) + zigzag(0) + zigzag(1) + text("k") + struct.pack("<d", 1.5) + zigzag(0) + zigzag(1) + bytes(range(16))
        body += leaf + zigzag(1) + zigzag(9) + zigzag(0) + zigzag(0) + zigzag(0) + zigzag(0) + bytes(16) + zigzag(0)
    if codec == "deflate":
        z = zlib.compressobj(wbits=-15)
        body = z.compress(body) + z.flush()
    meta = zigzag(2) + text("avro.schema") + text(json.dumps(schema)) + text("avro.codec") + text(codec) + zigzag(0)
    return avro.MAGIC + meta + b"S" * 16 + zigzag(2) + zigzag(len(body)) + body + b"S" * 16


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro(spark, tmp_path, codec):
    (tmp_path / "a.avro").write_bytes(container(codec))
    (tmp_path / "b.avro").write_bytes(container(codec)[:-30])
    rows = avro.read_avro(spark, str(tmp_path)).orderBy("path", "pos").collect()
    good = [json.loads(r.json) for r in rows if r.path.endswith("a.avro")]
    assert [g["id"] for g in good] == [-5, 300] and good[0]["l"] == [7, -8] and good[0]["m"] == {"k": 1.5} and good[0]["e"] == "B" and good[0]["kid"]["id"] == 9
    assert good[0]["u"] == "00010203-0405-0607-0809-0a0b0c0d0e0f" and any(r.error for r in rows if r.path.endswith("b.avro"))
    by = avro.read_versions(spark, f"{tmp_path}/a.avro", {20: "nothing string", 19: "id long, s string"})
    assert by[20].count() == 0 and by[19].count() == 2


def test_text_formats(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ID,A,B,C\r1,1,0,1\r2,0,0,1\r")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(files.read_context_csv(spark, f"{tmp_path}/c.csv")) == [("1", "A"), ("1", "C"), ("2", "C")]
    (tmp_path / "c.cxt").write_text("B\n\n2\n3\no1\no2\nA\nB\nC\nX.X\n..X\n")
    assert pairs(files.read_cxt(spark, f"{tmp_path}/c.cxt")) == [("o1", "A"), ("o1", "C"), ("o2", "C")]
    (tmp_path / "c.dat").write_text("1 3\n3\n")
    assert pairs(files.read_fimi(spark, f"{tmp_path}/c.dat")) == [("0", "1"), ("0", "3"), ("1", "3")]
    ctx = files.read_cxt(spark, f"{tmp_path}/c.cxt")
    assert pairs(files.to_fimi(ctx)) == [("o1", "1 2"), ("o2", "2")] and "1 1" in [r.value for r in files.to_rcf(ctx).collect()]
    lines = [r.value for r in files.to_rcf(ctx).orderBy("part", "object").collect()]
    assert lines[0] == "[Relational Context]" and lines[4].split(" | ") == sorted({r.object for r in ctx.collect()}) and lines[-1] == "[END Relational Context]"
    cxt = tmp_path / "again.cxt"
    cxt.write_text("\n".join(r.value for r in files.to_cxt(ctx).orderBy("part", "object").collect()) + "\n")
    assert {tuple(r) for r in files.read_cxt(spark, str(cxt)).collect()} == {tuple(r) for r in ctx.collect()}
    (tmp_path / "t.ttl").write_text('<http://a> <http://p> <http://b> .\n# no\n<http://a> <http://q> "x \\"y"@en .\n')
    assert [tuple(r) for r in files.read_turtle(spark, f"{tmp_path}/t.ttl").orderBy("predicate").collect()] == [("http://a", "http://p", "http://b", None), ("http://a", "http://q", None, 'x \\"y')]


def test_trie_and_alarm_round_trips(spark):
    obs = spark.createDataFrame([("t", ["a", "b"]), ("t", ["a", "c"]), ("t", ["d", "e"])], "tree string, key array<string>")
    tree = novelty.snapshot(obs)
    from pyspark.sql import Window

    lines = files.trie_csv(tree).withColumn("pos", F.row_number().over(Window.partitionBy("tree").orderBy("order")))
    back = files.read_trie_csv(lines)
    same = lambda df: sorted((tuple(r.prefix), r["count"]) for r in df.collect())
    assert same(back) == same(tree)
    alarms = spark.createDataFrame([(["a"], 1, 2, [("a", 0.5, 0.25, 1)], {"n": 1})], files.ALARM)
    assert files.alarms_from_json(files.alarms_to_json(alarms)).collect() == alarms.collect()
    spec = files.load_spec('{"context specification": {"query": "q", "objects": "o", "attributes": ["a"], "counts": true}}')
    rows = spark.createDataFrame([("x", "1"), ("x", "1"), ("y", "2")], "o string, a string")
    assert sorted(map(tuple, files.extract_context(rows, spec).collect())) == [("x", "1", 2), ("y", "2", 1)]


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(400)] + [(1000 + i, 9.0 + i, -9.0, 9.0) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id: r.score for r in forest.isolation_forest(df, df, "id", ["a", "b", "c"]).collect()}
    assert {i for i, _ in sorted(got.items(), key=lambda x: -x[1])[:3]} == {1000, 1001, 1002}


def test_remap_cycle_raises(spark):
    merges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, into long")
    with pytest.raises(ValueError, match="cycle"):
        resolve.remap_roots(merges)


def test_library_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "provloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_walks_go_to_their_end(spark):
    n = 20
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i) for i in range(n)], "src string, dst string, nanos long")
    nodes = spark.createDataFrame([(f"n{i}", {0: "a", 10: "b", n: "c"}.get(i, "x")) for i in range(n + 1)], "id string, label string")
    reach = policy.backward_reach(chain, f"n{n}", F.lit(False)).collect()
    assert {(r.node, r.latest) for r in reach} == {(f"n{i}", i) for i in range(n)} | {(f"n{n}", 2**62)}
    states = {r.id: r.state for r in segments.forward_states(nodes, chain, ["a", "b", "c"]).collect()}
    assert states == {f"n{i}": 1 + (i >= 10) + (i == n) for i in range(n + 1)}
    [path] = segments.paths_through(chain, "n9").collect()
    assert path.path == [f"n{i}" for i in range(n + 1)]
    for short in (lambda: policy.backward_reach(chain, f"n{n}", F.lit(False), 5), lambda: segments.forward_states(nodes, chain, ["a", "b", "c"], 5), lambda: segments.paths_through(chain, "n9", 5)):
        with pytest.raises(RuntimeError):
            short()
