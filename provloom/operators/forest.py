"""Isolation forest and code-length clustering: seeded, iterative, without a SQL twin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .detectors import log2

#: Rows of a group that one task judges at once.
TOGETHER = 100_000


def _c(n: float) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649 - (n - 1) / n) if n > 1 else 0.0


def grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple:
    """A tree: (attribute, split, left, right, low, high), or the number of rows of a leaf. Attributes without spread aren't split."""
    low, high = x.min(axis=0), x.max(axis=0)
    wide = np.flatnonzero(high > low)
    if limit == 0 or len(x) <= 1 or not len(wide):
        return (len(x),)
    a = int(rng.choice(wide))
    at = float(rng.uniform(low[a], high[a]))
    left = x[:, a] < at
    return a, at, grow(x[left], limit - 1, rng), grow(x[~left], limit - 1, rng), float(low[a]), float(high[a])


def depths(tree: tuple, x: np.ndarray, depth: int = 0, check_range: bool = False) -> np.ndarray:
    """Path lengths; with ``check_range`` a value beyond what the node saw in training ends its path there."""
    if len(tree) == 1:
        return np.full(len(x), depth + _c(tree[0]))
    a, at, left, right, low, high = tree
    out = np.full(len(x), float(depth))
    inside = (x[:, a] >= low) & (x[:, a] <= high) if check_range else np.ones(len(x), bool)
    for side, part in ((left, inside & (x[:, a] < at)), (right, inside & (x[:, a] >= at))):
        if part.any():
            out[part] = depths(side, x[part], depth + 1, check_range)
    return out


def isolation_forest(train: DataFrame, rows: DataFrame, ident: str, features: list[str], trees: int = 50, sample: int = 256, seed: int = 7, check_range: bool = False) -> DataFrame:
    """(ident, score): 2 ** (-mean path / c(sample)). Each tree is grown in a task of its own from a bounded sample of the training
    rows, the least by a hash of their identity and the tree; scoring is one pass. Short paths, high scores, are odd.
    """
    spark = rows.sparkSession
    limit = int(np.ceil(np.log2(max(sample, 2))))
    chosen = train.select(F.col(ident).cast("string").alias("id"), *features).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    n = train.count()
    share = min(1.0, 4 * sample / max(n, 1))  # first a cheap thinning by hash, then the exact least
    thin = chosen.where(F.pmod(F.xxhash64("id", "tree"), F.lit(1_000_000)) < share * 1_000_000)

    def plant(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        import pickle

        part = part.sort_values(["h", "id"]).head(sample)
        tree = grow(part[features].to_numpy(float), limit, np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame({"tree": [int(key[0])], "body": [pickle.dumps((tree, len(part)))]})

    forest = thin.withColumn("h", F.xxhash64("id", "tree")).groupBy("tree").applyInPandas(plant, "tree int, body binary").orderBy("tree").collect()
    shared = spark.sparkContext.broadcast([bytes(r["body"]) for r in forest])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        planted = [pickle.loads(b) for b in shared.value]
        for part in batches:
            x = part[features].to_numpy(float)
            mean = np.mean([depths(t, x, 0, check_range) for t, _ in planted], axis=0)
            size = max(n for _, n in planted)
            yield pd.DataFrame({ident: part[ident], "score": 2.0 ** (-mean / max(_c(size), 1e-9))})

    kind = dict(rows.dtypes)[ident]
    return rows.select(ident, *features).mapInPandas(score, f"{ident} {kind}, score double")


def code_length_clusters(ctx: DataFrame, k: int, rounds: int = 10, epsilon: float = 1e-3) -> DataFrame:
    """(object, cluster, bits): k-means on code length. Objects start in clusters by their hash; each round codes every object by every
    cluster's attribute shares and the cluster's own cost and takes the cheapest, until the total falls by less than epsilon.

    Objects with the same attributes cost the same, so rounds work on the distinct sets of attributes, with the number of objects in each cluster; objects
    are read once before the rounds and once after them.
    """
    first = F.pmod(F.xxhash64("object"), F.lit(k)).cast("int")
    baskets = checkpoint(ctx.groupBy("object").agg(F.sort_array(F.collect_list("attribute")).alias("items")))
    sets = checkpoint(baskets.groupBy("items", first.alias("cluster")).agg(F.count("*").alias("m")))
    attributes = checkpoint(sets.select(F.explode("items").alias("attribute")).distinct())
    total = baskets.count()
    clusters = ctx.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    before = None
    found = None
    for _ in range(rounds):
        sizes = clusters.join(sets.groupBy("cluster").agg(F.sum("m").alias("n")), "cluster", "left").na.fill(0)
        present = sets.select("cluster", "m", F.explode("items").alias("attribute")).groupBy("cluster", "attribute").agg(F.sum("m").alias("f"))
        grid = attributes.join(F.broadcast(sizes), F.lit(True)).join(present, ["cluster", "attribute"], "left").na.fill(0)  # k rows
        p = checkpoint(grid.select("cluster", "attribute", "n", ((F.col("f") + 1) / (F.col("n") + 2)).alias("p")))
        base = p.groupBy("cluster", "n").agg(F.sum(-log2(1 - F.col("p"))).alias("base")).select("cluster", (F.col("base") - log2((F.col("n") + 1) / (total + k))).alias("base"))
        members = sets.groupBy("items").agg(F.sum("m").alias("m"))
        own = members.select("items", "m", F.explode("items").alias("attribute")).join(p, "attribute").groupBy("items", "m", "cluster").agg(F.sum(log2(1 - F.col("p")) - log2(F.col("p"))).alias("s"))
        costs = own.join(F.broadcast(base), "cluster").select("items", "m", "cluster", (F.col("s") + F.col("base")).alias("bits"))
        best = costs.groupBy("items", "m").agg(F.min(F.struct("bits", "cluster")).alias("b"))
        found = checkpoint(best.select("items", "m", F.col("b.cluster").alias("cluster"), F.col("b.bits").alias("bits")))
        now = found.agg(F.sum(F.col("bits") * F.col("m"))).head()[0]
        sets = found.select("items", "cluster", "m")
        if before is not None and now > (1 - epsilon) * before:
            break
        before = now
    return baskets.join(found.drop("m"), "items").select("object", "cluster", "bits")


def forests_by_group(rows: DataFrame, group: str, ident: str, features: list[str], least: int = 50, trees: int = 25, sample: int = 128, seed: int = 7) -> DataFrame:
    """(group, ident, score, odd): a forest of each group with enough rows, grown on its rows of least hash and held against all its rows.

    Odd: a score above the greatest of the training rows. A forest is grown from its training rows, ``sample`` at most, in one task; all rows are dealt in
    parts of a group of some ``TOGETHER`` rows, and each part meets its group's forest. Broadcast is one row a group that has more than one part.
    """
    kinds = dict(rows.dtypes)
    given = rows.select(group, ident, *features).withColumn("h", F.xxhash64(ident))
    order = Window.partitionBy(group).orderBy("h", ident)
    training = given.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= max(sample, least))

    def plant(part: pd.DataFrame) -> pd.DataFrame:
        import pickle

        x = part.sort_values("_at")[features].to_numpy(float)
        if len(x) < least:
            return pd.DataFrame({group: part[group].head(0), "body": np.zeros(0, object)})
        rng, chosen = np.random.default_rng(seed), min(len(x), sample)
        grown = [grow(x[rng.choice(chosen, chosen)], int(np.ceil(np.log2(chosen))), rng) for _ in range(trees)]
        top = float(_scores(grown, x[:chosen], chosen).max())
        return pd.DataFrame({group: part[group].head(1), "body": [pickle.dumps((grown, chosen, top))]})

    forests = checkpoint(training.groupBy(group).applyInPandas(plant, f"{group} {kinds[group]}, body binary"))
    parts = rows.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_parts"))
    split = checkpoint(parts.where("_parts > 1"))
    of_group = lambda df: df.join(F.broadcast(split), F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_g")
    dealt = of_group(given).withColumn("_part", F.pmod(F.xxhash64("h"), F.col("_parts")).cast("int")).drop("_parts", "h")
    copies = of_group(forests).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def judge(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        import pickle

        if not len(part) or not len(model):
            return pd.DataFrame({group: part[group].head(0), ident: part[ident].head(0), "score": np.zeros(0), "odd": np.zeros(0, bool)})
        grown, chosen, top = pickle.loads(model["body"].iloc[0])
        score = _scores(grown, part[features].to_numpy(float), chosen)
        return pd.DataFrame({group: part[group], ident: part[ident], "score": score, "odd": score > top})

    schema = f"{group} {kinds[group]}, {ident} {kinds[ident]}, score double, odd boolean"
    return dealt.groupBy(group, "_part").cogroup(copies.groupBy(group, "_part")).applyInPandas(judge, schema)


def _scores(grown: list[tuple], x: np.ndarray, chosen: int) -> np.ndarray:
    return 2.0 ** (-np.mean([depths(t, x, 0, True) for t in grown], axis=0) / max(_c(chosen), 1e-9))


def classify_segments(train: DataFrame, rows: DataFrame, features: list[str], label: str, seed: int = 7) -> DataFrame:
    """Rows with ``predicted`` by a random forest over the features."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    vector = VectorAssembler(inputCols=features, outputCol="_features")
    model = RandomForestClassifier(featuresCol="_features", labelCol=label, predictionCol="predicted", numTrees=20, seed=seed).fit(vector.transform(train))
    return model.transform(vector.transform(rows)).drop("_features", "rawPrediction", "probability")
