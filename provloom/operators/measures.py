"""Measures and small transformations of sources, views, scores and alarms, each on any frame with the columns that it names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources


def crop(rows: DataFrame, order: list[str], start: int = 0, end: int | None = None, ingest: bool = True) -> DataFrame:
    """The rows from place ``start`` to before ``end`` in a total order; none at all where ``ingest`` is off. A limit on what is loaded is ``end``."""
    if not ingest:
        return rows.where(F.lit(False))
    ordered = rows.orderBy(*order).offset(start) if start else rows.orderBy(*order)
    return ordered.limit(end - start) if end is not None else ordered


def merge_sources(frames: list[DataFrame], name: str = "source_ord") -> DataFrame:
    """The rows of several sources one after the other, with the number of the source; columns that one lacks are null."""
    marked = [df.withColumn(name, F.lit(n)) for n, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def parse_records(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows with the fields of a JSON text as ``record`` and ``bad``, true where it can't be parsed; a null text is no record and not bad."""
    parsed = rows.withColumn("_p", F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    fields = [f for f in parsed.schema["_p"].dataType.names if f != "_bad"]
    return parsed.select(*rows.columns, F.struct(*[F.col(f"_p.{f}").alias(f) for f in fields]).alias("record"), F.coalesce(F.col("_p._bad").isNotNull(), F.lit(False)).alias("bad"))


def presence_matrix(rows: DataFrame, ident: str, seq: str, fields: list[str]) -> DataFrame:
    """1 where a field is there and 0 where not, one column a field, in the order in which fields are first seen, those never seen last; ties as given."""
    first = rows.agg(*[F.min(F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]).head()
    order = sorted(fields, key=lambda f: (first[f] is None, first[f] if first[f] is not None else 0, fields.index(f)))
    return rows.select(ident, *[F.col(f).isNotNull().cast("int").alias(f"has_{f}") for f in order])


def name_sets(rows: DataFrame, names: DataFrame, key: str, seq: str, name: str, delay: int) -> DataFrame:
    """Rows with ``names``, the sorted set of names that are known of their key when they leave a hold of ``delay`` records: those that come up to then. ``seq`` numbers all records.

    A name counts from where it is first seen, so a key meets each of its names once, however often it is named.
    """
    first = names.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.min(seq).alias("_from")).withColumnRenamed(name, "_name")
    upto = rows.withColumn("_upto", F.col(seq) + F.lit(delay))
    met = upto.join(first, key).where("_from <= _upto").groupBy(seq).agg(F.array_sort(F.collect_set("_name")).alias("names"))
    return rows.join(met, seq, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


# Views and features


def statistics(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(
        F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n) of bins of equal width, the last one closed; null values are left out, and values without spread are in bin 0."""
    known = rows.where(F.col(value).isNotNull())
    ends = known.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins)), F.lit(0))
    return known.join(F.broadcast(ends), F.lit(True)).groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row


def sub_time(a: Column, b: Column) -> Column:
    """Whole seconds from b to a, of nanoseconds; towards zero."""
    return F.call_function("div", a - b, F.lit(1_000_000_000))


def relu_time(a: Column, b: Column) -> Column:
    """As ``sub_time``, but 0 where a is before b."""
    return F.greatest(F.lit(0).cast("long"), sub_time(a, b))


def per_time(x: Column, a: Column, b: Column) -> Column:
    """x by the seconds from b to a; null where there are none."""
    return F.try_divide(x.cast("double"), (a - b) / 1e9)


def time_per(a: Column, b: Column, x: Column) -> Column:
    """The seconds from b to a by x; null where x is 0."""
    return F.try_divide((a - b) / 1e9, x.cast("double"))


def time_between(rows: DataFrame, key: str, nanos: str, first: Column, later: Column) -> DataFrame:
    """(key, delay): from a key's first row of one kind to the next one of another."""
    opened = rows.where(first).groupBy(key).agg(F.min(nanos).alias("_t0"))
    return rows.where(later).join(opened, key).where(F.col(nanos) > F.col("_t0")).groupBy(key).agg(F.min(F.col(nanos) - F.col("_t0")).alias("delay"))


def population(rows: DataFrame, kind: str, seq: str, width: int) -> DataFrame:
    """How many of each kind in each run of ``width`` records."""
    return rows.groupBy(kind, F.expr(f"{seq} div {width}").alias("bucket")).agg(F.count("*").alias("n"))


# Scores and alarms


def high_edges(edges: DataFrame, scores: DataFrame, above: float = 0.0) -> DataFrame:
    """Edges both of whose ends score more than the mean and ``above``; scores are (id, score)."""
    mean = scores.agg(F.avg("score").alias("_m"))
    high = scores.join(F.broadcast(mean), F.lit(True)).where(F.col("score") > F.col("_m") + above).select("id")  # one row
    return edges.join(high.withColumnRenamed("id", "src"), "src", "left_semi").join(high.withColumnRenamed("id", "dst"), "dst", "left_semi")


def repaired_times(alarm_rows: DataFrame, references: DataFrame, ident: str, nanos: str, seq: str) -> DataFrame:
    """Alarms with ``repaired``, the time of the last reference, by its place in its file, whose minute differs by less than two; their own where there is none.

    The minute is the join key, tried at three places, so alarms meet only references near them.
    """
    minute = F.expr(f"{nanos} div 60000000000")
    asked = alarm_rows.select(ident, F.explode(F.array(minute - 1, minute, minute + 1)).alias("_m"))
    held = references.groupBy(minute.alias("_m")).agg(F.max(F.struct(F.col(seq).alias("_s"), F.col(nanos).alias("_t"))).alias("_r"))
    found = asked.join(held, "_m").groupBy(ident).agg(F.max("_r").alias("_r"))
    return alarm_rows.join(found, ident, "left").withColumn("repaired", F.coalesce(F.col("_r._t"), F.col(nanos))).drop("_r")


def coverage(alarm_rows: DataFrame, attack: str, kind: str) -> DataFrame:
    """(attack, alarms, kinds): how many alarms fall into an attack, and in what kinds of tree."""
    return alarm_rows.groupBy(attack).agg(F.count("*").alias("alarms"), F.array_sort(F.collect_set(kind)).alias("kinds"))


def least_threshold(alarm_rows: DataFrame, attack: str, probability: str) -> DataFrame:
    """The least threshold on the probability at which every attack still raises an alarm: the greatest of the attacks' least."""
    return alarm_rows.groupBy(attack).agg(F.min(probability).alias("_m")).agg(F.max("_m").alias("threshold"))


def lowest(scores: DataFrame, k: int = 5000, score: str = "score", tie: str = "object") -> DataFrame:
    """The k rows of least score, as the forest's report asks for: each task gives its least, one merges these."""
    return scores.orderBy(score, tie).limit(k)


def linear_percentiles(alarm_rows: DataFrame, percents: tuple[float, ...]) -> DataFrame:
    """(tree, percent, threshold): percentiles of the local probability, between two values in proportion, as an evaluation of finished trees takes them.
    The aggregate keeps counts of distinct values."""
    found = alarm_rows.groupBy("tree").agg(F.percentile("local_prob", F.lit([p / 100 for p in percents])).alias("_p"))
    each = F.transform(F.arrays_zip(F.lit(list(percents)).alias("percent"), F.col("_p").alias("threshold")), lambda x: x)
    return found.select("tree", F.explode(each).alias("_x")).select("tree", "_x.percent", "_x.threshold")
