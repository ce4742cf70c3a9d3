"""Running sums over all rows in an order, without a task that sees more than a range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(rows: DataFrame, key: str, name: str = "_range", parts: int | None = None) -> DataFrame:
    """Rows with the number of their range of ``key``: quantile cuts, which are all that the driver gets, deal them into about equal parts."""
    parts = parts or 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts)).head()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return rows.withColumn(name, F.lit(0))
    table = F.lit(cuts)

    def step(low: Column, width: Column) -> Column:  # binary search: how many cuts are at or below the key
        at = F.get(table, (low + width - 1).cast("int"))
        return F.when(at.isNotNull() & (at <= F.col(key)), low + width).otherwise(low)

    widths = F.lit([1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)])
    return rows.withColumn(name, F.aggregate(widths, F.lit(0), lambda low, width: step(low, width).cast("int")))


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, part: str = "_range") -> DataFrame:
    """Rows with ``name``, the sum of ``value`` over the rows of their group up to them, whose ``part`` is that of ``ranges`` of the order's first column.

    Each group's totals by range give the sums before a range; inside it, a window adds up the rest. Groups have no null keys.
    """
    totals = rows.groupBy(*by, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn(name, F.sum(value).over(inside)).join(offsets, [*by, part])
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_before")
