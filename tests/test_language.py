"""Walks of any length, cycles, bags, uuids of 36 characters, the graph sink's order and end, shortened tries and reports."""

import pytest
from pyspark.sql import functions as F

from provloom.functions.scalar import at_weekend
from provloom.operators import novelty, reports
from provloom.operators.graph import PROPERTIES, Graph
from provloom.plans.compiler import Compiler
from provloom.session import checkpoint, release_rounds
from provloom.sources import sinks

TYPES = {"cid": "long", "earliestTimestampNanos": "long", "latestTimestampNanos": "long", "value": "double"}


def graph(spark, vertices, edges):
    """Vertices (id, cid, uuid) and edges (src, dst) of one label each."""
    v = spark.createDataFrame(vertices, "id string, cid long, uuid string")
    v = v.select("id", F.lit("AdmSubject").alias("label"), *[F.col(p) if p in ("cid", "uuid") else F.lit(None).cast(TYPES.get(p, "string")).alias(p) for p in PROPERTIES])
    e = spark.createDataFrame(edges, "src string, dst string").select(F.concat_ws("|", "src", "dst").alias("id"), "src", F.lit("next").alias("label"), "dst")
    return Graph(v, e)


def test_walks_of_more_than_64_rounds(spark):
    n = 68
    g = graph(spark, [(f"v{i}", i, f"v{i}") for i in range(n + 1)], [(f"v{i}", f"v{i + 1}") for i in range(n)])
    found = Compiler(g).run(f"g.V('v0').repeat(_.out('next')).until(_.has('cid',{n})).id()")
    assert [r.result for r in found.collect()] == [f"v{n}"]


def test_endless_cycles_are_told(spark):
    g = graph(spark, [(f"v{i}", i, f"v{i}") for i in range(4)], [("v0", "v1"), ("v1", "v2"), ("v2", "v0")])
    with pytest.raises(RecursionError, match="cycle"):
        Compiler(g).run("g.V('v0').repeat(_.out('next')).until(_.has('cid',9)).id()").collect()
    simple = Compiler(g).run("g.V('v0').emit().repeat(_.out('next').simplePath()).id()")
    assert sorted(r.result for r in simple.collect()) == ["v0", "v1", "v2"]


def test_bags(spark):
    g = graph(spark, [(f"v{i}", i, f"v{i}") for i in range(4)], [("v0", "v1"), ("v1", "v2"), ("v2", "v3")])
    run = lambda text: sorted(r.result for r in Compiler(g).run(text).collect())
    assert run("g.V('v0').out('next').aggregate('x').out('next').id()") == ["v2"]
    assert run("a = g.V('v0').out('next').aggregate('x').out('next'); g.V(x).id()") == ["v1"]
    assert run("a = g.V().out('next').aggregate('x'); g.V().where(within('x')).id()") == ["v1", "v2", "v3"]
    assert run("a = g.V('v1').values('cid').aggregate('x'); g.V().values('cid').is(within(x))") == [1]


def test_a_bare_uuid_stands_for_every_namespace(spark):
    uuid = "01234567-89ab-cdef-0123-456789abcdef"
    g = graph(spark, [("a", 1, f"cdm_host_{uuid}"), ("b", 2, uuid), ("c", 3, uuid.replace("0", "1")), ("d", 4, None)], [("a", "b")])
    run = lambda text: sorted(r.result for r in Compiler(g).run(text).collect())
    assert run(f"g.V().has('uuid','{uuid.upper()}').id()") == ["a", "b"]
    assert run(f"g.V().has('uuid','cdm_host_{uuid}').id()") == ["a"]


def test_rounds_are_released(spark):
    df = checkpoint(spark.range(5))
    path = df.inputFiles()[0]
    release_rounds(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


def test_graph_sink_takes_the_first_and_synthesises(spark, tmp_path):
    schema = f"{sinks.ELEMENT}, seq int"
    vertex = lambda i, n, seq: (i, "V", None, None, {"n": n}, seq)
    edge = lambda a, b: (f"{a}{b}", "E", a, b, {}, 0)
    batches = [[vertex("a", "late", 9), vertex("a", "first", 2), edge("a", "b"), edge("a", "lost")], [vertex("a", "again", 1), vertex("b", "b", 3), edge("b", "b")], [edge("b", "a")]]
    write = sinks.graph_sink(f"{tmp_path}", order="seq", buckets=4)
    for n, rows in enumerate(batches):
        for _ in range(2 if n == 1 else 1):  # a batch that is run again writes nothing twice
            write(spark.createDataFrame(rows, schema), n)
    vertices, edges, parked = sinks.graph_tables(spark, f"{tmp_path}")
    assert sorted((r.id, r.properties["n"]) for r in vertices.collect()) == [("a", "first"), ("b", "b")]
    assert sorted(r.id for r in edges.collect()) == ["ab", "ba", "bb"] and [r.id for r in parked.collect()] == ["alost"]
    sinks.finish_graph(spark, f"{tmp_path}")
    vertices, edges, parked = sinks.graph_tables(spark, f"{tmp_path}")
    assert sorted((r.id, r.label) for r in vertices.collect()) == [("a", "V"), ("b", "V"), ("lost", "AdmSynthesized")]
    assert sorted(r.id for r in edges.collect()) == ["ab", "alost", "ba", "bb"] and parked.count() == 0


def test_levels_are_eliminated_with_their_leaves(spark):
    keys = [["a", "x", "1"], ["a", "y", "1"], ["a", "y", "2"], ["b", "x"], ["c"]]
    tree = novelty.snapshot(spark.createDataFrame([("t", k) for k in keys], "tree string, key array<string>"))
    found = {tuple(r.prefix): (r["count"], r.children) for r in reports.eliminate_level(tree, 2).collect()}
    assert found == {(): (5, 3), ("a",): (3, 2), ("a", "1"): (2, 0), ("a", "2"): (1, 0), ("b",): (1, 0), ("c",): (1, 0)}


def test_weekends(spark):
    days = [0, 1, 2, 3, 4, 9]  # Thursday the first, and on
    got = spark.createDataFrame([(d * 86_400 + 5,) for d in days], "s long").select(at_weekend(F.col("s"))).collect()
    assert [r[0] for r in got] == [False, False, True, True, False, True]


def test_results_as_json(spark):
    df = spark.createDataFrame([(1, [1, 2], {"a": True}, None)], "i int, l array<int>, m map<string,boolean>, n string")
    assert reports.result_json(df).head()[0] == '{"i":1,"l":[1,2],"m":{"a":true}}'


def test_every_invariant_is_told(spark):
    from provloom.operators.policy import violations

    v = [("e1", "AdmEvent", "EVENT_WRITE", 5, 4, None), ("e2", "AdmEvent", "EVENT_READ", 1, 2, 1.0), ("a1", "AdmEvent", "EVENT_ADD_OBJECT_ATTRIBUTE", 1, 1, None), ("u1", "AdmSubject", None, None, None, None),
         ("u2", "AdmSubject", None, None, None, None), ("u3", "AdmSubject", None, None, None, None), ("f1", "AdmFileObject", None, None, None, None), ("twin", "AdmFileObject", None, None, None, None)]
    vertices = spark.createDataFrame(v, "id string, label string, eventType string, earliestTimestampNanos long, latestTimestampNanos long, value double")
    vertices = vertices.withColumn("uuid", F.when(F.col("id") == "twin", "f1").otherwise(F.col("id")))
    e = [("e1", "subject", "u1"), ("e1", "predicateObject", "f1"), ("e2", "predicateObject", "u2"), ("a1", "predicateObject", "f1"), ("u2", "parentSubject", "u1"), ("u3", "parentSubject", "u2"),
         ("u2", "unitDependency", "u3"), ("u2", "localPrincipal", "gone")]
    edges = spark.createDataFrame(e, "src string, label string, dst string").withColumn("id", F.concat_ws("|", "src", "label", "dst"))
    got = {(r.rule, r.id) for r in violations(Graph(vertices, edges)).collect()}
    assert got == {
        ("duplicate uuid", "f1"), ("dangling edge", "gone"), ("event without subject", "e2"), ("subject without parent", "u1"), ("subject without principal", "u1"), ("subject without principal", "u3"),
        ("object of wrong kind", "u2"), ("size missing", "e1"), ("bad time", "e1"), ("units of different parents", "u2|unitDependency|u3"), ("attribute without a second object", "a1"),
    }
    other = vertices.where("label <> 'AdmEvent'").union(vertices.where("id = 'e2'").withColumn("eventType", F.lit("EVENT_OTHER")))
    assert ("no event but EVENT_OTHER", "graph") in {(r.rule, r.id) for r in violations(Graph(other, edges)).collect()}


def test_tags_lead_back_to_their_sources(spark):
    from provloom.operators.policy import tag_chain

    writes = spark.createDataFrame([(1, "t3"), (1, "t9"), (2, None), (3, "c1"), (4, "none")], "write long, tag string")
    tags = spark.createDataFrame([("t3", "t2", "o1"), ("t2", "t1", "o2"), ("t1", None, "o3"), ("t9", None, "ox"), ("c1", "c2", "o1"), ("c2", "c1", "o1")], "tag string, prev string, object string")
    sources = spark.createDataFrame([("o1", "camera"), ("o2", "camera"), ("o3", "memory")], "object string, kind string")
    got = {r.write: (r.steps, r.kinds) for r in tag_chain(writes, tags, sources).collect()}
    assert got == {1: (4, ["camera", "memory"]), 2: (0, []), 3: (2, ["camera"]), 4: (0, [])}
