"""Places and running totals in one order over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.shared import written


def _ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows dealt to ranges of the order, with the number of the range; as many ranges as Spark shuffles to."""
    return written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def running_total(rows: DataFrame, order: list[Column], value: Column, to: str) -> DataFrame:
    """rows with the sum of value up to and with each. order must leave no ties.

    Each range is summed by itself; only one number for each range is added up across.
    """
    parts = _ranges(rows.withColumn("__value", value), order)
    below = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.groupBy("__range").agg(F.sum("__value").alias("__n")).select("__range", F.coalesce(below, F.lit(0)).alias("__start"))
    inside = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(starts, "__range").withColumn(to, F.col("__start") + inside).drop("__range", "__value", "__start")


def numbered(rows: DataFrame, order: list[Column], to: str = "pos") -> DataFrame:
    """rows with their place in the order, from 1."""
    return running_total(rows, order, F.lit(1).cast("long"), to)
