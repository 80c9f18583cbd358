"""Writes as set logic: each takes tables and gives the table after the write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert that leaves out rows whose key is there; of new rows with one key, one goes in."""
    return table.unionByName(rows.join(table, keys, "left_anti").dropDuplicates(keys))


def upsert_latest(table: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Insert, or move at forward where the key is there."""
    return table.unionByName(rows).groupBy(*keys).agg(F.max(at).alias(at))


def set_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Update of the rows for which condition is true."""
    sure = F.coalesce(condition, F.lit(False))
    return table.withColumns({name: F.when(sure, value).otherwise(F.col(name)) for name, value in values.items()})


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Delete by key."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti").select(table.columns)
