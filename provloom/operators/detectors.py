"""Anomaly detectors over contexts: long frames (object, attribute) of present attributes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .running import ranges, running
from .subsets import SubsetIndex, look_up


def log2(x: Column) -> Column:
    return F.log(x) / F.log(F.lit(2.0))


def context(rows: DataFrame, obj: str, attribute: str) -> DataFrame:
    """The distinct pairs of a boolean context."""
    return rows.where(F.col(attribute).isNotNull()).select(F.col(obj).alias("object"), F.col(attribute).alias("attribute")).distinct()


def dense(ctx: DataFrame, attributes: list[str]) -> DataFrame:
    """The 0/1 matrix, one column an attribute."""
    return ctx.groupBy("object").pivot("attribute", attributes).agg(F.count(F.lit(1))).na.fill(0)


def join_contexts(one: DataFrame, other: DataFrame) -> DataFrame:
    """Both contexts' attributes for the objects of either, prefixed X0_ and X1_."""
    return one.select("object", F.concat(F.lit("X0_"), "attribute").alias("attribute")).union(other.select("object", F.concat(F.lit("X1_"), "attribute").alias("attribute")))


def _frequencies(ctx: DataFrame) -> tuple[DataFrame, Column, Column]:
    n = ctx.select("object").distinct().agg(F.count("*").alias("n"))
    freq = ctx.groupBy("attribute").agg(F.count("*").alias("f")).join(F.broadcast(n), F.lit(True))  # one row
    return freq, F.col("f").cast("double"), F.col("n").cast("double")


def avf(ctx: DataFrame) -> DataFrame:
    """Attribute value frequency: the sum over all attributes of p where present, 1 - p where absent. Low is odd.

    Written as what an object without attributes gets plus 2 p - 1 for each that it has, so absent cells are never made.
    """
    freq, f, n = _frequencies(ctx)
    p = freq.select("attribute", (f / n).alias("p"))
    base = p.agg(F.sum(1 - F.col("p")).alias("base"))
    return ctx.join(p, "attribute").groupBy("object").agg(F.sum(2 * F.col("p") - 1).alias("s")).join(F.broadcast(base), F.lit(True)).select("object", (F.col("base") + F.col("s")).alias("score"))


def avc(ctx: DataFrame) -> DataFrame:
    """Attribute value coding: the code length of the row in bits with p = (f + 1) / (n + 2). High is odd."""
    freq, f, n = _frequencies(ctx)
    p = freq.select("attribute", ((f + 1) / (n + 2)).alias("p"))
    base = p.agg(F.sum(-log2(1 - F.col("p"))).alias("base"))
    own = F.sum(log2(1 - F.col("p")) - log2(F.col("p")))
    return ctx.join(p, "attribute").groupBy("object").agg(own.alias("s")).join(F.broadcast(base), F.lit(True)).select("object", (F.col("base") + F.col("s")).alias("score"))


def rasp(ctx: DataFrame) -> DataFrame:
    """Code length of the present attributes and an end symbol, each by its share of all symbols. High is odd."""
    counts = ctx.groupBy("attribute").agg(F.count("*").alias("f"))
    total = ctx.agg(F.count("*").alias("cells"), F.count_distinct("object").alias("n"))
    symbols = F.col("cells") + F.col("n")
    lengths = counts.join(F.broadcast(total), F.lit(True)).select("attribute", (-log2(F.col("f") / symbols)).alias("bits"))
    end = total.select((-log2(F.col("n") / symbols)).alias("end"))
    return ctx.join(lengths, "attribute").groupBy("object").agg(F.sum("bits").alias("b")).join(F.broadcast(end), F.lit(True)).select("object", (F.col("b") + F.col("end")).alias("score"))


def prequential(rows: DataFrame, seq: list[str], attribute: str, partition: list[str]) -> DataFrame:
    """Online AVC of single-attribute rows: each is coded by the counts of strictly earlier rows of its partition, running sums by ranges of the order."""
    counted = running(ranges(rows, seq[0]), partition, seq, F.lit(1), "_all")
    counted = running(counted, [*partition, attribute], seq, F.lit(1), "_seen")
    return counted.withColumn("bits", -log2(F.col("_seen") / (F.col("_all") + 1))).drop("_all", "_seen", "_range")


def ranked(scores: DataFrame, by: list[str], high_is_odd: bool = True) -> DataFrame:
    """Ranks from 1 in each group, ties by object; running counts by ranges of the score, so a group isn't sorted by one task."""
    order = -F.col("score") if high_is_odd else F.col("score")
    return running(ranges(scores.withColumn("_order", order), "_order"), by, ["_order", "object"], F.lit(1), "rank").withColumn("rank", F.col("rank").cast("int")).drop("_order", "_range")


def percent_ranks(scores: DataFrame, by: list[str]) -> DataFrame:
    """``percentile``: the share of a group's other rows with a smaller score; running counts over the distinct scores, so ties are one row there."""
    counts = scores.groupBy(*by, "score").agg(F.count("*").alias("_n"))
    upto = running(ranges(counts, "score"), by, ["score"], F.col("_n"), "_upto")
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    placed = upto.join(total, by).select(*by, "score", F.coalesce(F.try_divide(F.col("_upto") - F.col("_n"), F.col("_all") - 1), F.lit(0.0)).alias("percentile"))
    return scores.join(placed, [*by, "score"])


def top_share(scores: DataFrame, by: list[str], share: float, most: int) -> DataFrame:
    """The rows of highest score of each group, a share of them, rounded up, and ``most`` at most; ties by object."""
    sizes = scores.groupBy(*by).agg(F.count("*").alias("_all"))
    return ranked(scores, by).join(sizes, by).where(F.col("rank") <= F.least(F.ceil(F.col("_all") * share), F.lit(most))).drop("_all")


def combine(ranks: DataFrame, how: str, weights: dict[str, float] | None = None) -> DataFrame:
    """One score an object from (model, object, score, rank). An object that a model didn't rank has one more than it ranked... as rank.

    uniform and weighted: mean rank; geometric: mean of log ranks; median, minrank: of ranks; average, maxscore: of scores.
    """
    if how in ("average", "maxscore"):
        return ranks.groupBy("object").agg((F.avg("score") if how == "average" else F.max("score")).alias("score"))
    sizes = ranks.groupBy("model").agg(F.count("*").alias("missing"))
    cells = ranks.select("object").distinct().join(F.broadcast(sizes), F.lit(True))  # one row a model
    full = cells.join(ranks.select("object", "model", "rank"), ["object", "model"], "left").withColumn("rank", F.coalesce("rank", "missing").cast("double"))
    w = F.lit(1.0)
    for model, weight in (weights or {}).items():
        w = F.when(F.col("model") == model, F.lit(float(weight))).otherwise(w)
    value = {
        "uniform": F.avg("rank"), "weighted": F.sum(w * F.col("rank")) / F.sum(w), "geometric": F.exp(F.avg(F.log("rank"))),
        "median": F.percentile("rank", 0.5), "minrank": F.min("rank"),
    }[how]
    return full.groupBy("object").agg(value.alias("score"))


def evaluate(ranks: DataFrame, truth: DataFrame) -> DataFrame:
    """NDCG and AUC of each model's ranks against the objects of ``truth``.

    DCG sums 1 / log2(rank + 1) over true objects, over that of the best order; AUC sums max(0, n - 1 - (rank - 1)) / (true * n).
    """
    n = ranks.groupBy("model").agg(F.count("*").cast("double").alias("n"))
    hit = ranks.join(truth.select("object").distinct(), "object").join(n, "model")
    summed = hit.groupBy("model", "n").agg(
        F.count("*").alias("hits"), F.sum(1 / log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.greatest(F.lit(0.0), F.col("n") - F.col("rank"))).alias("area")
    )
    ideal = F.expr("aggregate(transform(sequence(1, cast(hits as int)), i -> ln(2D) / ln(i + 1D)), 0D, (a, x) -> a + x)")
    return summed.select("model", "hits", (F.col("dcg") / ideal).alias("ndcg"), (F.col("area") / (F.col("hits") * F.col("n"))).alias("auc"))


# Itemsets and rules


def itemsets(ctx: DataFrame, share: float) -> DataFrame:
    """Itemsets of any size that at least this share of all objects have, as sorted arrays with support.

    Objects' item lists go to parallel FP-growth: conditional trees of the frequent items are dealt over tasks.
    """
    from pyspark.ml.fpm import FPGrowth

    baskets = ctx.groupBy("object").agg(F.collect_set("attribute").alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=share).fit(baskets).freqItemsets
    return found.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))


def closed(sets: DataFrame) -> DataFrame:
    """Itemsets without a superset of one more item and equal support; of all frequent sets, these are the closed ones."""
    bigger = sets.where(F.size("items") > 1).withColumn("drop", F.explode("items")).select(F.expr("array_remove(items, drop)").alias("items"), F.col("support"))
    return sets.join(bigger.distinct(), ["items", "support"], "left_anti")


def _inside(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def closures(sets: DataFrame) -> DataFrame:
    """(items, closure) of frequent sets, all of which are in ``sets``: the greatest superset of equal support.

    A set that isn't closed has a superset of one more item and equal support; such steps are followed to their end by doubling,
    so a set of n items takes log2(n) rounds of equi-joins.
    """
    bigger = sets.where(F.size("items") > 1).withColumn("drop", F.explode("items")).select(F.expr("array_remove(items, drop)").alias("items"), "support", F.col("items").alias("next"))
    table = checkpoint(sets.join(bigger, ["items", "support"], "left").groupBy("items").agg(F.coalesce(F.min("next"), F.col("items")).alias("closure")))
    while True:
        ahead = table.where("closure <> items").select(F.col("items").alias("closure"), F.col("closure").alias("next"))
        if ahead.isEmpty():
            return table
        joined = table.join(ahead, "closure", "left").select("items", F.coalesce("next", "closure").alias("closure"), F.col("next").isNotNull().alias("moved"))
        table = checkpoint(joined)
        if table.where("moved").isEmpty():
            return table.select("items", "closure")
        table = table.select("items", "closure")


def covers(sets: DataFrame) -> DataFrame:
    """(x, sx, z, support): pairs of closed itemsets, x within z, with no closed one between, of all frequent sets.

    z covers x if and only if each item that z adds to x closes x to z: one row a frequent set and item that it could do without, counted by (x, z).
    """
    closing = closures(sets)
    full = closing.where("items = closure").select("items").join(sets, "items")
    one_more = closing.withColumn("drop", F.explode("items")).select(F.expr("array_remove(items, drop)").alias("x"), F.col("closure").alias("z"))
    found = one_more.join(full.select(F.col("items").alias("x"), F.col("support").alias("sx")), "x").groupBy("x", "sx", "z").agg(F.count("*").alias("n"))
    return found.where("n = size(z) - size(x)").join(full.withColumnRenamed("items", "z"), "z").select("x", "sx", "z", "support")


def cover_rules(sets: DataFrame, n: int) -> DataFrame:
    """Rules x -> y from the covering pairs of the closed itemsets of ``sets``, y what z adds to x, with confidence and lift."""
    other = sets.select(F.col("items").alias("y"), F.col("support").alias("sy"))
    found = covers(sets).withColumn("y", F.array_except("z", "x")).join(other, "y")
    return found.select("x", "y", "support", (F.col("support") / F.col("sx")).alias("confidence"), (F.col("support") * n / (F.col("sx") * F.col("sy"))).alias("lift"))


def unsubsumed(found: DataFrame, narrow: bool = False) -> DataFrame:
    """Rules that no other one subsumes: one whose left side is within theirs and whose right side holds theirs; with ``narrow`` both
    are within theirs, as is right for rules that say something doesn't occur together. Rules meet on an item of the right side."""
    rows = found.select("x", "y").distinct()
    one, two = rows.select(F.col("x").alias("a"), F.col("y").alias("b")), rows
    keyed = one.withColumn("item", F.get("b", F.lit(0)) if narrow else F.explode("b")).join(two.withColumn("item", F.explode("y") if narrow else F.get("y", F.lit(0))), "item")
    right = _inside(F.col("b"), F.col("y")) if narrow else _inside(F.col("y"), F.col("b"))
    less = keyed.where(_inside(F.col("a"), F.col("x")) & right & ((F.col("a") != F.col("x")) | (F.col("b") != F.col("y")))).select("x", "y").distinct()
    return found.join(less, ["x", "y"], "left_anti")


def implications(sets: DataFrame, confidence: float, n: int) -> DataFrame:
    """Covering rules above a confidence, none of them subsumed."""
    return unsubsumed(cover_rules(sets, n).where(F.col("confidence") > confidence))


def anti_implications(sets: DataFrame, confidence: float, n: int) -> DataFrame:
    """Covering rules below a confidence: x mostly comes without all of y; those of the smallest sides."""
    return unsubsumed(cover_rules(sets, n).where(F.col("confidence") < confidence), narrow=True)


def exact_rules(sets: DataFrame) -> DataFrame:
    """(x, y, support): rules that always hold, from a frequent set that isn't closed to what its closure adds, none of them subsumed."""
    full = closed(sets)
    loose = sets.join(full, ["items", "support"], "left_anti").select(F.col("items").alias("x"), "support", F.get("items", F.lit(0)).alias("item"))
    whole = full.select(F.col("items").alias("z"), "support", F.explode("items").alias("item"))
    found = loose.join(whole, ["item", "support"]).where(_inside(F.col("x"), F.col("z"))).select("x", F.array_except("z", "x").alias("y"), "support")
    return unsubsumed(found)


def disjoint_items(sets: DataFrame) -> DataFrame:
    """(x, y): frequent items that are not frequently together. One array holds the items, at most mean basket / share of them."""
    single = sets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("x"))
    items = single.agg(F.sort_array(F.collect_list("x")).alias("all"))
    pairs = single.join(F.broadcast(items), F.lit(True)).select("x", F.explode("all").alias("y")).where("x < y")  # one row
    return pairs.join(sets.where(F.size("items") == 2).select(F.get("items", F.lit(0)).alias("x"), F.get("items", F.lit(1)).alias("y")), ["x", "y"], "left_anti")


def rules(sets: DataFrame, confidence: float, n: int) -> DataFrame:
    """Rules X -> y, X and y from a frequent itemset, with their measures; confidence above the bound."""
    parts = sets.where(F.size("items") > 1).withColumn("y", F.explode("items")).select(F.expr("array_remove(items, y)").alias("x"), "y", "support")
    left = sets.select(F.col("items").alias("x"), F.col("support").alias("sx"))
    right = sets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("y"), F.col("support").alias("sy"))
    pxy, px, py = F.col("support") / n, F.col("sx") / n, F.col("sy") / n
    conf = F.col("support") / F.col("sx")
    return parts.join(left, "x").join(right, "y").where(conf > confidence).select(
        "x", "y", "support", conf.alias("confidence"), (pxy / (px * py)).alias("lift"), (pxy - px * py).alias("leverage"),
        (pxy / (px + py - pxy)).alias("jaccard"), ((pxy / px + pxy / py) / 2).alias("kulczynski"), (F.sqrt(pxy) * (pxy / px - py)).alias("klosgen"),
        (F.abs(px - py) / (px + py - pxy)).alias("imbalance"), (pxy * pxy / px).alias("rpf"), (pxy / F.sqrt(px * py)).alias("cosine"),
        (conf - py).alias("added_value"), ((pxy - 1 + conf) / pxy).alias("counter_rate"), ((pxy - px * py) / F.sqrt(px * py)).alias("lerman"),
        F.try_divide(conf - py, 1 - py).alias("loevinger"),
    )


def cover_cost(ctx: DataFrame, codes: DataFrame) -> DataFrame:
    """(object, bits): the length of an object's items as a cover by a code table (items, support), larger sets first, then the
    more frequent, then by name; items that no set covers are codes of their own. A code's length is -log2 of its share of all uses.

    A cover depends on the items alone, so each distinct set of items is covered once, whatever the number of objects that have it: a batch of sets goes
    through the table as bit rows, code by code. The table is held by each task, bounded by the caller.
    """
    table = [list(r["items"]) for r in codes.orderBy(F.desc(F.size("items")), F.desc("support"), "items").collect()]
    index = SubsetIndex(table)
    wanted = [np.array([index.number[i] for i in c], np.int64) for c in table]

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            left = index.bits(lists)
            used: list[list[int]] = [[] for _ in range(len(left))]
            for n, code in enumerate(wanted):
                hit = np.flatnonzero(left[:, code].all(axis=1))
                left[np.ix_(hit, code)] = False
                for row in hit:
                    used[row].append(n)
            rest = [[x for x in own if x not in index.number or left[row, index.number[x]]] for row, own in enumerate(lists.to_pylist())]
            yield pa.RecordBatch.from_arrays([lists, batch.column("n"), pa.array(used, pa.list_(pa.int32())), pa.array(rest, pa.list_(pa.string()))], ["items", "n", "used", "rest"])

    baskets = checkpoint(ctx.groupBy("object").agg(F.array_sort(F.collect_set("attribute")).alias("items")))
    kinds = baskets.groupBy("items").agg(F.count("*").alias("n"))
    covered = checkpoint(kinds.mapInArrow(cover, "items array<string>, n long, used array<int>, rest array<string>"))
    none = F.lit(None)
    each = F.concat(F.transform("used", lambda c: F.struct(c.alias("code"), none.cast("string").alias("item"))), F.transform("rest", lambda x: F.struct(none.cast("int").alias("code"), x.alias("item"))))
    uses = covered.select("items", "n", F.explode(each).alias("code"))
    counts = uses.groupBy("code").agg(F.sum("n").alias("u"))
    total = uses.agg(F.sum("n").alias("t"))
    lengths = counts.join(F.broadcast(total), F.lit(True)).select("code", (-log2(F.col("u") / F.col("t"))).alias("b"))  # one row
    bits = checkpoint(uses.join(lengths, "code").groupBy("items").agg(F.sum("b").alias("bits")))
    return baskets.join(bits, "items").select("object", "bits")


def fpof(ctx: DataFrame, sets: DataFrame) -> DataFrame:
    """Sum of the supports' shares of frequent itemsets that are strictly smaller than the object's own, over their number."""
    totals = ctx.agg(F.count_distinct("object").alias("n")).join(F.broadcast(sets.agg(F.count("*").alias("k"))), F.lit(True))  # one row each

    def fold(index: SubsetIndex, table: dict, has: np.ndarray, own: np.ndarray) -> list:
        support = np.zeros(len(has), "int64")
        for numbers, rows in index.visit(has):
            support[rows[own[rows] > len(set(table["items"][numbers[0]]))]] += sum(table["support"][n] for n in numbers)
        return [support]

    found = look_up(ctx, sets.select("items", "support"), "items", fold, {"s": "long"}, {"s": F.sum})
    return found.join(F.broadcast(totals), F.lit(True)).select("object", F.coalesce(F.try_divide(F.col("s") / F.col("n"), F.col("k")), F.lit(0.0)).alias("score"))


def outlier_degree(ctx: DataFrame, high: DataFrame) -> DataFrame:
    """The share of an object's closure under the high-confidence rules that it lacks: rules whose left side it has add their right side once."""

    def fold(index: SubsetIndex, table: dict, has: np.ndarray, own: np.ndarray) -> list:
        added = np.zeros_like(has)
        for numbers, rows in index.visit(has):
            for n in numbers:
                added[rows, index.number[table["y"][n]]] = True
        lacks = [[index.items[i] for i in np.flatnonzero(row)] for row in added & ~has]
        return [np.asarray(own, "int64"), pa.array(lacks, pa.list_(pa.string()))]

    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))  # noqa: E731  of one object, a list a block
    found = look_up(ctx, high.select("x", "y").distinct(), "x", fold, {"own": "long", "lacks": "array<string>"}, {"own": F.max, "lacks": union}, more="y")
    return found.select("object", (F.size("lacks") / (F.col("own") + F.size("lacks"))).alias("score"))


def violations(ctx: DataFrame, found: DataFrame) -> DataFrame:
    """For objects that have a rule's left side but not its right: -sum log2(1 - confidence), the greatest lift and their number."""

    def fold(index: SubsetIndex, table: dict, has: np.ndarray, own: np.ndarray) -> list:
        bits, lift, count = np.zeros(len(has)), np.full(len(has), -np.inf), np.zeros(len(has), "int64")
        for numbers, rows in index.visit(has):
            for n in numbers:
                broken = rows[~has[rows, index.number[table["y"][n]]]]
                bits[broken] -= np.log2(max(1 - table["confidence"][n], 1e-9))
                lift[broken] = np.maximum(lift[broken], table["lift"][n])
                count[broken] += 1
        return [bits, lift, count]

    columns = {"bits": "double", "lift": "double", "rules": "long"}
    return look_up(ctx, found.select("x", "y", "confidence", "lift"), "x", fold, columns, {"bits": F.sum, "lift": F.max, "rules": F.sum}, more="y").where("rules > 0")


# Isolation forest measures and clustering


def average_path(n: Column) -> Column:
    """Mean path of an unsuccessful search among n: 2 (ln(n - 1) + 0.5772156649 - (n - 1) / n), 0 for one."""
    x = n.cast("double")
    return F.when(n > 1, 2 * (F.log(x - 1) + 0.5772156649 - (x - 1) / x)).otherwise(F.lit(0.0))


def isolation_score(mean_depth: Column, n: Column) -> Column:
    return F.pow(F.lit(2.0), -mean_depth / average_path(n))


# Rare rules, classes, estimators


def rare_rules(ctx: DataFrame, most: int, least: int = 1) -> DataFrame:
    """Rules x -> y that always hold and whose pair occurs ``least`` to ``most`` times, with lift: x has no object without y. Only rare
    attributes are joined, so an attribute that a third of all objects have meets at most ``most`` objects of each of them."""
    counts = ctx.groupBy("attribute").agg(F.count("*").alias("f"))
    rare = ctx.join(counts.where(F.col("f").between(least, most)).select("attribute"), "attribute").withColumnRenamed("attribute", "x")
    pairs = rare.join(ctx.withColumnRenamed("attribute", "y"), "object").where("x <> y").groupBy("x", "y").agg(F.count("*").alias("support"))
    n = ctx.agg(F.count_distinct("object").alias("n"))
    own, other = counts.select(F.col("attribute").alias("x"), F.col("f").alias("fx")), counts.select(F.col("attribute").alias("y"), F.col("f").alias("fy"))
    return pairs.join(own, "x").where("support = fx").join(other, "y").join(F.broadcast(n), F.lit(True)).select("x", "y", "support", (F.col("n") / F.col("fy")).alias("lift"))


def split_merge(ctx: DataFrame, classes: DataFrame) -> DataFrame:
    """Code lengths within each class (object, class), plus the bits of the class itself."""
    joined = ctx.join(classes, "object")
    sizes = classes.join(ctx.select("object").distinct(), "object").groupBy("class").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    p = joined.groupBy("class", "attribute").agg(F.count("*").alias("f")).join(sizes, "class").withColumn("p", (F.col("f") + 1) / (F.col("n") + 2))
    base = p.groupBy("class").agg(F.sum(-log2(1 - F.col("p"))).alias("base"))
    own = joined.join(p.select("class", "attribute", "p"), ["class", "attribute"]).groupBy("object", "class").agg(F.sum(log2(1 - F.col("p")) - log2(F.col("p"))).alias("s"))
    return own.join(base, "class").join(sizes, "class").join(F.broadcast(total), F.lit(True)).select("object", "class", (F.col("s") + F.col("base") - log2(F.col("n") / F.col("all"))).alias("score"))


def estimators(tree: DataFrame) -> DataFrame:
    """Other estimates of something new below each inner node of a trie: additive, and the escape estimates from children and singletons."""
    singles = tree.where("level > 0 and count = 1").groupBy("tree", F.expr("slice(prefix, 1, level - 1)").alias("prefix")).agg(F.count("*").alias("singles"))
    n, kids, once = F.col("count"), F.col("children"), F.coalesce("singles", F.lit(0))
    return tree.where("children > 0").join(singles, ["tree", "prefix"], "left").select(
        "tree", "prefix", (1 / (n + kids + 1)).alias("additive"), (1 / (n + 1)).alias("escape_a"), (kids / n).alias("escape_b"), (kids / (n + kids)).alias("escape_c"), (once / n).alias("good_turing")
    )
