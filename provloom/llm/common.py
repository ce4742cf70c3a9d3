"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def checkpoint(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, cutting its lineage.

    The folder is ``shared_folder``'s. ``free``: the shuffle files that it cuts off are let go at once; else they
    stay until the driver happens to collect its garbage.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    done = df.checkpoint(eager=True)
    if free:
        gc.collect()
        sc._jvm.System.gc()
    return done


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``. A temporary one
    takes its place in local mode only; elsewhere a missing folder is an error, as executors would not see it."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="provloom-")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is bound to it.

    Used inside one another, higher-order functions would compute an outer expression anew for each element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_cuts(df: DataFrame, key: Column, buckets: int) -> list:
    """Ascending cut points that split the key's values into about equal parts.

    The driver gets at most ``buckets`` - 1 numbers, from a mergeable quantile summary.
    """
    at = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, at, 20 * buckets).alias("cuts")).head()
    return sorted(set(found["cuts"] or [])) if found else []


def order_bucket(key: Column, cuts: list) -> Column:
    """How many cuts are at or below the key, by binary search; null keys are in bucket -1, before all others."""
    if not cuts:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0))
    table = F.lit(cuts)
    widths = F.lit([1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)])

    def step(low: Column, width: Column) -> Column:
        at = F.get(table, (low + width - 1).cast("int"))
        return F.when(at.isNotNull() & (at <= key), low + width).otherwise(low)

    found = F.aggregate(widths, F.lit(0), lambda low, width: step(low, width).cast("int"))
    return F.when(key.isNull(), F.lit(-1)).otherwise(found)


def order_ranges(df: DataFrame, key: Column, tie: Column, buckets: int) -> Column:
    """The number of each row's range in the order of (key, tie), null keys first: about ``buckets`` ranges of near-equal rows.

    Cuts are of the key. A key that by itself fills several ranges, or a null key that does, is dealt by its ties, a hash;
    the driver gets at most ``buckets`` numbers.
    """
    at = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, at, 20 * buckets).alias("cuts"), F.count(key).alias("known"), F.count("*").alias("n")).head()
    cuts = sorted(found["cuts"] or [])
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    nulls = (found["n"] - found["known"]) * buckets > found["n"]
    dealt = F.pmod(tie, F.lit(buckets)).cast("long")
    inside = F.when(key.isin(heavy), dealt) if heavy else F.when(F.lit(False), F.lit(0).cast("long"))
    inside = inside.when(key.isNull() & F.lit(nulls), dealt).otherwise(F.lit(buckets).cast("long"))  # other keys of a heavy key's bucket come after it
    return order_bucket(key, sorted(set(cuts))).cast("long") * F.lit(buckets + 1) + inside
