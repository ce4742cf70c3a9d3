"""Text formats: contexts, triples, tries, alarms, tables of vertices, context specifications."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of a text of any line ends, each file in one piece."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("pos", "value"))


def read_context_csv(spark: SparkSession, path: str) -> DataFrame:
    """A 0/1 matrix with a header, whatever its line ends, as (object, attribute) of the ones."""
    lines = _lines(spark, path).where("trim(value) <> ''").withColumn("cells", F.split("value", ","))
    header = lines.where("pos = 0").select(F.col("cells").alias("names"))
    cells = lines.where("pos > 0").join(F.broadcast(header), F.lit(True)).select(
        F.col("cells")[0].alias("object"), F.explode(F.zip_with(F.expr("slice(names, 2, size(names))"), F.expr("slice(cells, 2, size(cells))"), lambda n, x: F.struct(n.alias("name"), x.alias("cell")))).alias("c")
    )
    return cells.where("c.cell = '1'").select("object", F.col("c.name").alias("attribute"))


def read_cxt(spark: SparkSession, path: str) -> DataFrame:
    """A Burmeister context: B, a blank or name, sizes, names of objects and attributes, rows of X and dots."""
    rows = _lines(spark, path).where("value <> '' or pos = 1")
    got = rows.agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("l")).select(F.transform("l", lambda x: x["value"]).alias("l"))  # one file's header and names
    n, m = F.get("l", F.lit(2)).cast("int"), F.get("l", F.lit(3)).cast("int")
    names = got.select("l", n.alias("n"), m.alias("m"))
    objects = names.select(F.posexplode(F.expr("slice(l, 5, n)")).alias("i", "object"), F.expr("slice(l, 5 + n, m)").alias("attributes"), F.expr("slice(l, 5 + n + m, n)").alias("rows"))
    cells = objects.select("object", F.posexplode("attributes").alias("j", "attribute"), F.expr("rows[i]").alias("row"))
    return cells.where(F.upper(F.expr("substring(row, j + 1, 1)")) == "X").select("object", "attribute")


def read_fimi(spark: SparkSession, path: str) -> DataFrame:
    """One transaction of item numbers a line, as (object, attribute) with the line's number."""
    lines = _lines(spark, path).where("trim(value) <> ''")
    return lines.select(F.col("pos").cast("string").alias("object"), F.explode(F.split(F.trim("value"), r"\s+")).alias("attribute")).distinct()


def to_fimi(ctx: DataFrame) -> DataFrame:
    """Transactions as lines of sorted item numbers."""
    ids = ctx.select("attribute").distinct().withColumn("n", F.row_number().over(Window.orderBy("attribute")))
    return ctx.join(ids, "attribute").groupBy("object").agg(F.array_join(F.array_sort(F.collect_set("n")).cast("array<string>"), " ").alias("value"))


def _listed(ctx: DataFrame, column: str) -> DataFrame:
    """One row: the sorted distinct values, which the formats want in one line."""
    return ctx.select(column).distinct().agg(F.sort_array(F.collect_list(column)).alias(f"{column}s"))


def _rows(ctx: DataFrame, yes: str, no: str, joint: str) -> DataFrame:
    """(object, value): a cell for each attribute, in order; the attributes are one broadcast row."""
    sets = ctx.groupBy("object").agg(F.collect_set("attribute").alias("has")).join(F.broadcast(_listed(ctx, "attribute")), F.lit(True))
    cells = F.transform("attributes", lambda a: F.when(F.array_contains("has", a), yes).otherwise(no))
    return sets.select("object", F.array_join(cells, joint).alias("value"))


#: The fixed lines of a relational context.
_RCF = ("[Relational Context]", "Default Name", "[Binary Relation]", "Name_of_dataset", "[END Relational Context]")


def to_rcf(ctx: DataFrame) -> DataFrame:
    """(part, object, value): the lines of a relational context in the order of part and object: header, names, a row of 0/1 cells for each object, end."""
    spark = ctx.sparkSession
    fixed = spark.createDataFrame([(i, "", line) for i, line in enumerate(_RCF[:4])] + [(7, "", _RCF[4])], "part int, object string, value string")
    names = [_listed(ctx, c).select(F.lit(at).alias("part"), F.lit("").alias("object"), F.array_join(f"{c}s", " | ").alias("value")) for at, c in ((4, "object"), (5, "attribute"))]
    cells = _rows(ctx, "1", "0", " ").select(F.lit(6).alias("part"), F.col("object").cast("string").alias("object"), "value")
    return fixed.union(names[0]).union(names[1]).union(cells)


def to_cxt(ctx: DataFrame) -> DataFrame:
    """(part, object, value): the lines of a Burmeister context in the order of part and object, as ``read_cxt`` reads them."""
    spark = ctx.sparkSession
    head = spark.createDataFrame([(0, "", "B"), (1, "", "")], "part int, object string, value string")
    sizes = [ctx.agg(F.lit(at).alias("part"), F.lit("").alias("object"), F.count_distinct(c).cast("string").alias("value")) for at, c in ((2, "object"), (3, "attribute"))]
    names = [ctx.select(F.lit(at).alias("part"), F.col(c).cast("string").alias("object"), F.col(c).cast("string").alias("value")).distinct() for at, c in ((4, "object"), (5, "attribute"))]
    cells = _rows(ctx, "X", ".", "").select(F.lit(6).alias("part"), F.col("object").cast("string").alias("object"), "value")
    return head.union(sizes[0]).union(sizes[1]).union(names[0]).union(names[1]).union(cells)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, literal) of triples one a line; comments and other lines are left out."""
    triple = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"\S*)\s*\.\s*$'
    lines = spark.read.text(path).where(F.col("value").rlike(triple))
    part = lambda i: F.nullif(F.regexp_extract("value", triple, i), F.lit(""))
    return lines.select(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"), part(4).alias("literal"))


def sink_columns(df: DataFrame) -> DataFrame:
    """Columns in name order, commas in values as bars: what the per-kind tables hold."""
    return df.select(*[F.replace(F.col(c).cast("string"), F.lit(","), F.lit("|")).alias(c) for c in sorted(df.columns)])


def write_kinds(vertices: DataFrame, path: str) -> None:
    """One CSV folder a vertex label, with a header."""
    sink_columns(vertices).repartition("label").write.mode("overwrite").partitionBy("label").option("header", True).csv(path)


def write_trie(tree: DataFrame, path: str) -> None:
    """A trie by its flat prefixes; the order of a walk is the path's."""
    tree.write.mode("overwrite").parquet(path)


def trie_csv(tree: DataFrame) -> DataFrame:
    """Lines of depth, key, local and global probability and count, parents first: ``order`` is the walk's."""
    key = F.coalesce(F.try_element_at("prefix", F.lit(-1)), F.lit(""))
    line = F.concat_ws(",", "level", F.replace(key, F.lit(","), F.lit("|")), "local_prob", "global_prob", "count")
    return tree.select("tree", F.array_join("prefix", "∫").alias("order"), line.alias("value"))


def read_trie_csv(lines: DataFrame) -> DataFrame:
    """(tree, prefix, level, count) of lines (tree, pos, value): a line's parent is the last line before it one level up.

    A trie is one sequence, so each is folded in its order, trie by trie.
    """
    import pandas as pd

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        path: list[str] = []
        rows = []
        for value in part.sort_values("pos")["value"]:
            level, key, _, _, count = value.split(",")
            level = int(level)
            path = path[: max(level - 1, 0)] + ([key] if level else [])
            rows.append((part["tree"].iloc[0], list(path), level, int(count)))
        return pd.DataFrame(rows, columns=["tree", "prefix", "level", "count"])

    return lines.groupBy("tree").applyInPandas(walk, "tree string, prefix array<string>, level int, count long")


ALARM = "key array<string>, data_ts long, emit_ms long, levels array<struct<key:string,localProb:double,globalProb:double,count:long>>, ratings map<string,int>"


def alarms_to_json(alarm_rows: DataFrame) -> DataFrame:
    return alarm_rows.select(F.to_json(F.struct(*alarm_rows.columns)).alias("value"))


def alarms_from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", ALARM).alias("a")).select("a.*")


def load_spec(text: str) -> dict:
    """A context specification: query, objects, attributes, and whether cells are counts."""
    spec = json.loads(text)["context specification"]
    missing = [k for k in ("query", "objects", "attributes") if k not in spec]
    if missing:
        raise ValueError(f"the specification lacks {missing}")
    return spec


def extract_context(rows: DataFrame, spec: dict) -> DataFrame:
    """(object, attribute, count) of a query's rows by a specification; cells are 1 unless it asks for counts."""
    attributes = F.concat_ws("_", *spec["attributes"]) if isinstance(spec["attributes"], list) else F.col(spec["attributes"])
    cells = rows.select(F.col(spec["objects"]).alias("object"), attributes.alias("attribute")).groupBy("object", "attribute").agg(F.count("*").alias("count"))
    return cells if spec.get("counts") else cells.withColumn("count", F.lit(1).cast("long"))


def parameter_text(parameters: Column) -> Column:
    """The bytes of event parameters as text, one string a value."""
    return F.transform(F.filter(parameters, lambda p: p["valueBytes"].isNotNull()), lambda p: F.decode(p["valueBytes"], "UTF-8"))
