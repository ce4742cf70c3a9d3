"""Fuzzy matching of a sequence of labels along a DAG, forward and backward scores, and the best diagnoses.

A node holds, for each place of the pattern, how well the best way into it has matched up to there. Ways are walked by level: only nodes whose scores rose go
on, in joins on the edges' ends, with the greatest taken per node before anything moves. Memory a node is the pattern's length, or ``k`` times that where
the k best ways themselves are asked for. Labels come with a confidence; a step whose label isn't met may be jumped at ``jump`` of the score.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: A step that no label meets costs this factor; scores at or below LEAST go no further.
JUMP, LEAST = 0.1, 0.05


def _stepped(entry: Column, label: Column, confidence: Column, pattern: list[str], jump: float, least: float) -> Column:
    """The scores of a node from those that come in: each place by itself, by a jump from the one before, or by the node's label, which serves once.

    Two chains run along the pattern, one with the label still to be used, one with it used.
    """
    steps = F.transform(F.sequence(F.lit(1), F.lit(len(pattern))), lambda i: F.struct(F.get(entry, i).alias("v"), F.get(F.lit(pattern), i - 1).alias("label")))

    def step(acc: Column, x: Column) -> Column:
        onward = lambda score, by: F.when(score > least, score * by).otherwise(0.0)
        fresh = F.greatest(x["v"], onward(acc["fresh"], F.lit(jump)))
        met = F.when(x["label"] == label, onward(acc["fresh"], confidence)).otherwise(0.0)
        used = F.greatest(fresh, met, onward(acc["used"], F.lit(jump)))
        return F.struct(fresh.alias("fresh"), used.alias("used"), F.concat(acc["out"], F.array(used)).alias("out"))

    start = F.struct(F.get(entry, F.lit(0)).alias("fresh"), F.lit(0.0).alias("used"), F.array(F.get(entry, F.lit(0))).alias("out"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _greatest(name: str, length: int) -> list[Column]:
    return [F.max(F.get(name, F.lit(i))).alias(f"_{i}") for i in range(length)]


def _walk(nodes: DataFrame, edges: DataFrame, start: list[float], step, most: int | None) -> DataFrame:  # noqa: ANN001
    """Rounds of ``step`` from nodes whose scores rose to their successors; (id, label, confidence, entry, state) when nothing rises any more."""
    n = len(start)
    links = checkpoint(edges.select("src", "dst").distinct())
    state = nodes.select("id", "label", F.col("confidence").cast("double").alias("confidence"), F.lit(start).alias("entry"))
    state = checkpoint(state.withColumns({"state": step("entry"), "rose": F.lit(True)}))
    for done in count():
        moved = state.where("rose").select(F.col("id").alias("src"), "state")
        come = links.join(moved, "src").groupBy(F.col("dst").alias("id")).agg(*_greatest("state", n))
        if come.isEmpty():
            return state.drop("rose")
        if done == most:
            raise RuntimeError(f"scores still rise after {most} rounds")
        joined = state.join(come, "id", "left")
        entry = F.array(*[F.greatest(F.get("entry", F.lit(i)), F.coalesce(F.col(f"_{i}"), F.lit(0.0))) for i in range(n)])
        renewed = joined.select("id", "label", "confidence", entry.alias("entry"), F.col("state").alias("old")).withColumn("state", step("entry"))
        rose = F.exists(F.arrays_zip("state", "old"), lambda x: x["state"] > x["old"])
        state = checkpoint(renewed.withColumn("rose", rose).drop("old"))


def fuzzy_states(nodes: DataFrame, edges: DataFrame, pattern: list[str], jump: float = JUMP, least: float = LEAST, most: int | None = None) -> DataFrame:
    """(id, state, score): of nodes (id, label, confidence), the score for each place of the pattern, from 0 (nothing matched, always 1), and for its end.

    A node may begin a match; scores of parents are taken by their greatest. Rounds go on until no score rises, or RuntimeError after ``most``.
    ``jump`` = 0 leaves out jumps. A null label meets nothing; edges to unknown nodes lead nowhere.
    """
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    found = _walk(nodes, edges, [1.0] + [0.0] * len(pattern), lambda entry: _stepped(F.col(entry), F.col("label"), confidence, pattern, jump, least), most)
    return found.select("id", "state", F.get("state", F.lit(len(pattern))).alias("score"))


def backward_states(nodes: DataFrame, edges: DataFrame, pattern: list[str], jump: float = JUMP, least: float = LEAST, most: int | None = None) -> DataFrame:
    """(id, state): for each place, how well the rest of the pattern can be matched after the node, along the best way out of it.

    The same walk on turned edges and the turned pattern: entry i of it is what comes after a node when the last i steps are done.
    """
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    found = _walk(nodes, turned, [1.0] + [0.0] * len(pattern), lambda entry: _stepped(F.col(entry), F.col("label"), confidence, pattern[::-1], jump, least), most)
    return found.select("id", F.reverse("entry").alias("state"))


def through_scores(forward: DataFrame, backward: DataFrame, nodes: DataFrame, pattern: list[str]) -> DataFrame:
    """(id, score): the best match of the whole pattern that goes through a node: both passes multiplied at the best place."""
    both = forward.select("id", F.col("state").alias("f")).join(backward.select("id", F.col("state").alias("b")), "id")
    product = F.transform(F.arrays_zip("f", "b"), lambda x: x["f"] * x["b"])
    return both.select("id", F.array_max(product).alias("score"))


def ranked_diagnoses(nodes: DataFrame, edges: DataFrame, pattern: list[str], k: int = 10, jump: float = JUMP, least: float = LEAST, most: int | None = None) -> DataFrame:
    """(rank, score, path): the k best matches of the whole pattern along ways of the DAG, the path holding the node of each step, null where it was jumped.

    Both passes come first: nodes through which no match of the whole pattern gets above ``least`` are left out. Then ways are
    kept by (node, place), the k best of each, distinct by path, until none is new; what is beyond a node's k best can't be among the k best of all, as what
    follows depends on node and place alone. Matches whose score isn't above ``least`` on the way are none. Ties are broken by the path.
    """
    n = len(pattern)
    forward = checkpoint(fuzzy_states(nodes, edges, pattern, jump, least, most))
    through = through_scores(forward, backward_states(nodes, edges, pattern, jump, least, most), nodes, pattern)
    alive = checkpoint(nodes.join(through.where(F.col("score") > least), "id", "left_semi").select("id", "label", F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence")))
    links = checkpoint(edges.select("src", "dst").distinct().join(alive.select(F.col("id").alias("dst")), "dst", "left_semi"))
    kind = dict(nodes.dtypes)["id"]
    none = F.array_repeat(F.lit(None).cast(kind), F.lit(1))

    def at_node(rows: DataFrame) -> DataFrame:
        """All that a node can make of ways that come in: jumps, its label once, jumps again."""
        some = rows.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n) - F.col("place"))))
        some = some.withColumns({"place": F.col("place") + F.col("a"), "score": F.col("score") * F.pow(F.lit(jump), F.col("a")), "path": F.concat("path", F.array_repeat(none[0], F.col("a")))})
        stays = some.select("id", "place", "score", "path")
        met = some.where((F.col("place") < n) & (F.get(F.lit(pattern), F.col("place")) == F.col("label")))
        met = met.withColumns({"place": F.col("place") + 1, "score": F.col("score") * F.col("confidence"), "path": F.concat("path", F.array("id"))})
        met = met.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n) - F.col("place"))))
        met = met.select("id", (F.col("place") + F.col("b")).alias("place"), (F.col("score") * F.pow(F.lit(jump), F.col("b"))).alias("score"), F.concat("path", F.array_repeat(none[0], F.col("b"))).alias("path"))
        return stays.union(met).where(F.col("score") > least)

    def best(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("id", "place", "path").agg(F.max("score").alias("score"), F.max("old").alias("old"))
        order = Window.partitionBy("id", "place").orderBy(F.desc("score"), F.col("path"))
        return one.withColumn("_n", F.row_number().over(order)).where(f"_n <= {k}").drop("_n")

    begin = alive.select("*", F.lit(0).alias("place"), F.lit(1.0).alias("score"), F.array().cast(f"array<{kind}>").alias("path"))
    kept = checkpoint(best(at_node(begin).withColumn("old", F.lit(0))))
    for done in count():
        fresh = kept.where("old = 0").select(F.col("id").alias("src"), "place", "score", "path")
        came = links.join(fresh, "src").select(F.col("dst").alias("id"), "place", "score", "path").join(alive, "id")
        came = at_node(came).withColumn("old", F.lit(0))
        if done == most:
            raise RuntimeError(f"ways still grow after {most} rounds")
        kept = checkpoint(best(kept.withColumn("old", F.lit(1)).unionByName(came)))
        if kept.where("old = 0").isEmpty():
            break
    ends = kept.where(F.col("place") == n).groupBy("path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "path").limit(k)
    return ends.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path"))).select("rank", "score", "path")  # k rows
