"""As-of joins: the row of a series at, before or after a given point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(asked: DataFrame, series: DataFrame, by: list[str], at: str, values: list[str], forward: bool = False, parts: int | None = None) -> DataFrame:
    """asked with the values of the last row of series at or before at (forward: the first at or after); null without one.

    Both tables have by and at. One shuffle on by (to so many parts, if they are given) and a running last value: no pairs of rows are ever made.
    """
    both = asked.withColumns({"__own": F.lit(1), "__v": F.lit(None).cast(f"struct<{','.join(f'{v}:{dict(series.dtypes)[v]}' for v in values)}>")})
    rows = series.select(*by, at, F.struct(*values).alias("__v"), F.lit(0).alias("__own"))
    both = both.unionByName(rows, allowMissingColumns=True)
    if parts:
        both = both.repartition(parts, *by)
    if forward:
        order, pick = Window.partitionBy(*by).orderBy(F.desc(at), "__own"), F.last("__v", ignorenulls=True)
    else:
        order, pick = Window.partitionBy(*by).orderBy(at, "__own"), F.last("__v", ignorenulls=True)
    found = both.withColumn("__v", pick.over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where("__own = 1").select(*asked.columns, *[F.col(f"__v.{v}").alias(v) for v in values])
