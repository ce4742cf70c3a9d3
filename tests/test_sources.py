"""Tables per kind, bytes of parameters, triples, contexts by specification and alarms as JSON, written and read again."""

import csv
import glob
import json

from pyspark.sql import functions as F

from provloom.sources import files, sinks


def test_tables_per_kind_have_sorted_columns_and_no_commas(spark, tmp_path):
    df = spark.createDataFrame([("A", 'x,"y"', 2, None), ("A", "line\nbreak", 3, "z"), ("B", "é,,", 4, "w")], "label string, text string, a int, b string")
    files.write_kinds(df, f"{tmp_path}/kinds")
    rows = {}
    for kind in "AB":
        rows[kind] = []
        for name in glob.glob(f"{tmp_path}/kinds/label={kind}/*.csv"):
            with open(name, newline="", encoding="utf-8") as f:
                rows[kind] += [dict(r) for r in csv.DictReader(f, escapechar="\\", doublequote=False)]
    assert {tuple(r) for k in rows.values() for r in k} == {("a", "b", "text")}
    assert sorted((r["a"], r["text"]) for r in rows["A"]) == [("2", 'x|"y"'), ("3", "line\nbreak")] and [r["text"] for r in rows["B"]] == ["é||"]


def test_parameter_bytes_as_text(spark):
    df = spark.createDataFrame([([("n", bytearray("größe".encode())), ("m", None), ("o", bytearray(b""))],), ([],), (None,)], "parameters array<struct<name:string,valueBytes:binary>>")
    assert [r[0] for r in df.select(files.parameter_text(F.col("parameters"))).collect()] == [["größe", ""], [], None]


def test_triples(spark, tmp_path):
    lines = ['<s1> <p> <o1> .', '<s1> <q> "a \\"quoted\\" text"@en .', "# comment", "@prefix x: <y> .", '<s2>  <p>\t<o2>  .', '<s3> <p> "5"^^<int> .']
    (tmp_path / "t.ttl").write_text("\n".join(lines))
    found = files.read_turtle(spark, f"{tmp_path}/t.ttl").collect()
    assert sorted((r.subject, r.predicate, r.object, r.literal) for r in found) == sorted([("s1", "p", "o1", None), ("s1", "q", None, 'a \\"quoted\\" text'), ("s2", "p", "o2", None), ("s3", "p", None, "5")]), found


def test_contexts_by_specification(spark):
    rows = spark.createDataFrame([("u1", "READ", "f"), ("u1", "READ", "f"), ("u2", "WRITE", None)], "u string, kind string, file string")
    spec = files.load_spec(json.dumps({"context specification": {"query": "-", "endpoint": "-", "objects": "u", "attributes": ["kind", "file"], "counts": True}}))
    assert {tuple(r) for r in files.extract_context(rows, spec).collect()} == {("u1", "READ_f", 2), ("u2", "WRITE", 1)}
    assert {tuple(r) for r in files.extract_context(rows, spec | {"counts": False}).collect()} == {("u1", "READ_f", 1), ("u2", "WRITE", 1)}


def test_alarms_as_json(spark):
    level = '{"key":"a","localProb":0.5,"globalProb":0.25,"count":3}'
    text = f'{{"key":["a","b"],"data_ts":1,"emit_ms":2,"levels":[{level}],"ratings":{{"ns":-1}}}}'
    read = files.alarms_from_json(spark.createDataFrame([(text,)], "value string"))
    assert files.alarms_to_json(read).head()[0] == text
    log = spark.createDataFrame([("t", ["a", "b"], 0.125, 10**18)], "tree string, key array<string>, p double, nanos long")
    line = log.select(sinks.alarm_line("log", F.col("tree"), F.col("key"), F.col("p"), F.col("nanos"))).head()[0]
    assert line.split("\t")[1:] == ["t", "a / b", "0.125"]
