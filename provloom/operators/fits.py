"""Percentiles of scores by fitted distributions, and mean-shift clustering by grid cells."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .running import ranges, running

EULER = 0.5772156649015329
FAMILIES = ("gamma", "weibull", "gev")


def digamma(x: float) -> float:
    """By recurrence to where its series holds."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / x**2
        x += 1
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7) - 1 / (30 * x**9)


def gamma_shape(gap: float) -> float:
    """The likeliest shape of a gamma distribution, where ``gap`` is the logarithm of the mean less the mean logarithm."""
    k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(100):
        step = (math.log(k) - digamma(k) - gap) / (1 / k - trigamma(k))
        k = max(k - step, k / 10)
        if abs(step) < 1e-12 * k:
            break
    return k


def gamma_cdf(x: np.ndarray, shape: float) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below shape + 1, a continued fraction above."""
    x = np.maximum(x, 0.0)
    out = np.zeros(len(x))
    scale = shape * np.log(np.maximum(x, 1e-300)) - x - math.lgamma(shape)
    low = (x > 0) & (x < shape + 1)
    if low.any():
        term = total = np.full(low.sum(), 1 / shape)
        for n in itertools.count(1):
            term = term * x[low] / (shape + n)
            total = total + term
            if (term < 1e-16 * total).all():
                break
        out[low] = total * np.exp(scale[low])
    high = x >= shape + 1
    if high.any():
        b = x[high] + 1 - shape
        c, d = np.full(len(b), 1e300), 1 / b
        h = d.copy()
        for i in range(1, 500):
            a = -i * (i - shape)
            b = b + 2
            d = 1 / np.where(np.abs(a * d + b) < 1e-300, 1e-300, a * d + b)
            c = np.where(np.abs(b + a / c) < 1e-300, 1e-300, b + a / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = 1 - np.exp(scale[high]) * h
    return np.clip(out, 0.0, 1.0)


def cdf(family: str, parameters: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    """Of gamma (shape, scale), weibull (shape, scale), gev (place, scale, shape with the sign of k = -xi)."""
    x = np.asarray(x, float)
    if family == "gamma":
        return gamma_cdf(x / parameters[1], parameters[0])
    if family == "weibull":
        return -np.expm1(-np.power(np.maximum(x, 0.0) / parameters[1], parameters[0]))
    place, scale, k = parameters
    z = (x - place) / scale
    y = z if abs(k) < 1e-9 else -np.log(np.maximum(1 - k * z, 1e-300)) / k
    return np.exp(-np.exp(-y))


def gev_parameters(b0: float, b1: float, b2: float) -> tuple[float, float, float]:
    """From probability-weighted moments (mean, and means weighted by the rank and by its square)."""
    c = (2 * b1 - b0) / (3 * b2 - b0) - math.log(2) / math.log(3)
    k = 7.8590 * c + 2.9554 * c * c
    if abs(k) < 1e-9:
        scale = (2 * b1 - b0) / math.log(2)
        return b0 - EULER * scale, scale, 0.0
    g = math.gamma(1 + k)
    scale = (2 * b1 - b0) * k / (g * (1 - 2.0**-k))
    return b0 + scale * (g - 1) / k, scale, k


def fit_scores(scores: DataFrame, rounds: int = 40) -> dict[str, dict[str, tuple[float, ...]]]:
    """Parameters of each family for each model of (model, score), for as many as can be fitted.

    Gamma and Weibull are the likeliest for positive scores: the gamma's shape comes from mean and mean logarithm, the Weibull's from Newton rounds, each one
    aggregation for all models. The extreme value distribution comes from moments weighted by ranks, running counts by ranges. Scores without spread and
    those with values at or below 0 have no gamma and Weibull. The driver holds a row a model.
    """
    known = checkpoint(scores.where("score is not null").select("model", F.col("score").cast("double").alias("score")))
    sums = known.groupBy("model").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.avg(F.when(F.col("score") > 0, F.log("score"))).alias("log"), F.min("score").alias("least"),
        F.max("score").alias("most"), F.stddev_pop(F.when(F.col("score") > 0, F.log("score"))).alias("spread"),
    ).collect()
    out: dict[str, dict[str, tuple[float, ...]]] = {r["model"]: {} for r in sums}
    spread = {r["model"]: r for r in sums if r["most"] > r["least"]}
    for model, r in spread.items():
        if r["least"] > 0:
            shape = gamma_shape(max(math.log(r["mean"]) - r["log"], 1e-12))
            out[model]["gamma"] = (shape, r["mean"] / shape)
    shapes = {m: math.pi / math.sqrt(6) / r["spread"] for m, r in spread.items() if r["least"] > 0 and r["spread"] > 0}
    going = dict(shapes)
    for _ in range(rounds):
        if not going:
            break
        now = known.sparkSession.createDataFrame([(m, k, float(spread[m]["most"])) for m, k in going.items()], "model string, k double, most double")
        x = F.col("score") / F.col("most")  # powers stay at or below 1
        power, log = F.pow(x, F.col("k")), F.log(x)
        rows = known.join(F.broadcast(now), "model").groupBy("model").agg(F.sum(power).alias("s0"), F.sum(power * log).alias("s1"), F.sum(power * log * log).alias("s2")).collect()  # a row a model
        for r in rows:
            m, k = r["model"], going[r["model"]]
            mean_log = spread[m]["log"] - math.log(spread[m]["most"])
            value = r["s1"] / r["s0"] - 1 / k - mean_log
            slope = r["s2"] / r["s0"] - (r["s1"] / r["s0"]) ** 2 + 1 / k**2
            shapes[m] = max(k - value / slope, k / 10)
            out[m]["weibull"] = (k, float(spread[m]["most"] * (r["s0"] / spread[m]["n"]) ** (1 / k)))
            if abs(shapes[m] - k) < 1e-12 * k:
                del going[m]
            else:
                going[m] = shapes[m]
    counts = known.groupBy("model", "score").agg(F.count("*").alias("n"))
    upto = running(ranges(counts, "score"), ["model"], ["score"], F.col("n"), "upto")
    before, n = F.col("upto") - F.col("n"), F.col("n")  # equal scores share their ranks' sums
    first = n * before + n * (n - 1) / 2
    second = n * before * (before - 1) + 2 * before * n * (n - 1) / 2 + n * (n - 1) * (n - 2) / 3
    for r in upto.groupBy("model").agg(F.sum(F.col("score") * first).alias("b1"), F.sum(F.col("score") * second).alias("b2")).collect():
        s = spread.get(r["model"])
        if s and s["n"] > 2:
            found = gev_parameters(s["mean"], r["b1"] / (s["n"] * (s["n"] - 1.0)), r["b2"] / (s["n"] * (s["n"] - 1.0) * (s["n"] - 2.0)))
            if found[1] > 0 and all(map(math.isfinite, found)):
                out[r["model"]]["gev"] = found
    return out


def _with_cdfs(counts: DataFrame, fitted: dict) -> DataFrame:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = {f: np.full(len(part), np.nan) for f in FAMILIES}
            for model, rows in part.groupby("model").indices.items():
                for family, parameters in fitted.get(model, {}).items():
                    found[family][rows] = cdf(family, parameters, part["score"].to_numpy(float)[rows])
            yield part.assign(**found)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema)
    return counts.mapInPandas(task, f"{types}, {', '.join(f'{f} double' for f in FAMILIES)}")


def fitted_percentiles(scores: DataFrame, family: str = "auto") -> DataFrame:
    """(model, object, score, family, percentile): the fitted distribution's share below a score; ``auto`` takes the family of least Anderson-Darling distance.

    Distances are sums over distinct scores with their ranks, so all models and families take one pass. A model that no family fits has null. Ties have one
    percentile; null scores are left out.
    """
    fitted = fit_scores(scores)
    counts = scores.where("score is not null").select("model", F.col("score").cast("double").alias("score")).groupBy("model", "score").agg(F.count("*").alias("n"))
    placed = running(ranges(counts, "score"), ["model"], ["score"], F.col("n"), "upto").join(F.broadcast(counts.groupBy("model").agg(F.sum("n").alias("all"))), "model")  # a row a model
    rows = checkpoint(_with_cdfs(placed.select("model", "score", "n", "upto", "all"), fitted))
    before, n, total = F.col("upto") - F.col("n"), F.col("n"), F.col("all")

    def distance(f: str):  # noqa: ANN202
        p = F.greatest(F.least(F.col(f), F.lit(1 - 1e-15)), F.lit(1e-300))
        low = n * (2 * before + n)  # the sum of 2 i - 1 over the ranks of equal scores
        return -total - (F.sum(low * F.log(p) + (2 * total * n - low) * F.log(1 - p)) / total)

    found = rows.groupBy("model", "all").agg(*[distance(f).alias(f) for f in FAMILIES]).collect()  # a row a model
    best = {}
    for r in found:
        known = {f: r[f] for f in FAMILIES if r[f] is not None and math.isfinite(r[f])}
        best[r["model"]] = (family if family in known else None) if family != "auto" else min(known, key=known.get, default=None)
    chosen = scores.sparkSession.createDataFrame(list(best.items()), "model string, family string")
    value = F.coalesce(*[F.when(F.col("family") == f, F.col(f)) for f in FAMILIES])
    by_score = rows.join(F.broadcast(chosen), "model").select("model", "score", "family", value.alias("percentile"))  # a row a model
    return scores.select("model", "object", F.col("score").cast("double").alias("score")).join(by_score, ["model", "score"])


# Mean-shift


def mean_shift(points: DataFrame, ident: str, features: list[str], bandwidth: float, rounds: int = 300, epsilon: float = 1e-3) -> DataFrame:
    """(ident, cluster): points climb to the modes of a flat kernel, and modes within the bandwidth are one, the one with more points first.

    Points are counted by grid cells of the bandwidth. A seed is a cell's mean; in each round it moves to the mean of all points within the bandwidth, which
    lie in its cell or a neighbour of it, so seeds meet cells in an equi-join of 3^d keys a seed. Seeds that came to the same place are one. Rounds go on until
    no seed moves by ``epsilon`` bandwidths. Modes are a model's clusters and go to the driver; points are joined with modes by cells too, to the
    nearest mode. Points beyond all modes' bandwidth get cluster -1; null features leave a point out. Clusters are numbered by size.
    """
    d = len(features)
    spark = points.sparkSession
    cell = lambda names: F.array(*[F.floor(F.col(f) / bandwidth).cast("long") for f in names])
    rows = points.select(ident, *[F.col(f).cast("double").alias(f) for f in features]).where(" and ".join(f"`{f}` is not null" for f in features))
    rows = checkpoint(rows.withColumn("cell", cell(features)))
    weights = checkpoint(rows.groupBy("cell", *features).agg(F.count("*").alias("w")))  # equal points once
    near = F.lit([list(o) for o in itertools.product((-1, 0, 1), repeat=d)])
    apart = lambda a, b: sum((F.col(x) - F.col(y)) ** 2 for x, y in zip(a, b))
    seed = [f"_{f}" for f in features]
    seeds = weights.groupBy("cell").agg(*[(F.sum(F.col(f) * F.col("w")) / F.sum("w")).alias(s) for f, s in zip(features, seed)]).select(*seed)

    def around(places: DataFrame, keep: list[str]) -> DataFrame:
        """Places beside the weighted points within the bandwidth."""
        met = places.withColumn("_at", cell(keep)).withColumn("_o", F.explode(near)).withColumn("cell", F.zip_with("_at", "_o", lambda a, b: a + b)).drop("_at", "_o")
        return met.join(weights, "cell").where(apart(features, keep) <= bandwidth**2)

    seeds = checkpoint(seeds.withColumns({"seed": F.monotonically_increasing_id(), "moved": F.lit(True), "w": F.lit(0.0)}))
    for _ in range(rounds):
        climbing = seeds.where("moved")
        if climbing.isEmpty():
            break
        met = around(climbing.drop("w"), seed)
        means = met.groupBy("seed", *seed).agg(*[(F.sum(F.col(f) * F.col("w")) / F.sum("w")).alias(f) for f in features], F.sum("w").cast("double").alias("w"))
        moved = apart(features, seed) > (epsilon * bandwidth) ** 2
        fresh = means.select(*[F.col(f).alias(s) for f, s in zip(features, seed)], "seed", moved.alias("moved"), "w")
        seeds = checkpoint(seeds.where("not moved").unionByName(fresh).dropDuplicates(seed))
    modes = sorted(((r["w"], [r[s] for s in seed]) for r in seeds.collect()), key=lambda x: (-x[0], x[1]))  # the modes, not the points
    kept: list[list[float]] = []
    for _, place in modes:
        if all(math.dist(place, other) > bandwidth for other in kept):
            kept.append(place)
    if not kept:
        return rows.select(ident, F.lit(-1).alias("cluster"))
    names = [f"_{f}" for f in features]
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(kept)], ", ".join(["number int", *(f"`{x}` double" for x in names)]))
    spread = table.withColumn("_at", cell(names)).withColumn("_o", F.explode(near)).withColumn("cell", F.zip_with("_at", "_o", lambda a, b: a + b))
    met = rows.join(spread, "cell").where(apart(features, names) <= bandwidth**2)
    nearest = met.groupBy(ident).agg(F.min(F.struct(apart(features, names).alias("far"), "number")).alias("m")).select(ident, F.col("m.number").alias("number"))
    sized = nearest.groupBy("number").count().orderBy(F.desc("count"), "number").collect()  # a row a cluster
    order = {r["number"]: n for n, r in enumerate(sized)}
    renumber = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return rows.select(ident).join(nearest, ident, "left").select(ident, F.coalesce(F.try_element_at(renumber, F.col("number")), F.lit(-1)).alias("cluster"))
