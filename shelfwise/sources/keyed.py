"""A table of files by key that changes in part: only the buckets that a change touches are written anew."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedFiles:
    """Rows dealt to buckets by their key; a manifest says which version of each bucket is in force.

    A change writes the touched buckets as a new version, and then the manifest, through Spark's commit protocol: a reader sees the table
    before or after it, and a change that is repeated under its number (a micro-batch after a failure) does the same again. Buckets that
    are not touched keep their files. Only the manifest, a row for each bucket, comes to the driver.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 32):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[int]:
        """Numbers of the manifests that are whole, in order."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        system = top.getFileSystem(conf)
        if not system.exists(top):
            return []
        whole = [f.getPath() for f in system.listStatus(top) if system.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().partition("=")[2]) for p in whole)

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version in force of each bucket that has rows; before: as it was before that change."""
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/version={known[-1]}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _rows(self, manifest: dict[int, int]) -> DataFrame:
        if not manifest:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(manifest.items())])

    def read(self) -> DataFrame:
        return self._rows(self.manifest())

    def change(self, rows: DataFrame, combine: Combine, number: int | None = None) -> int:
        """Give the touched buckets the rows combine(their rows, the changes), both with the table's keys; returns the change's number.

        combine must not give rows of other keys than it gets. number: of the change; the next one if it is left out.
        """
        if number is None:
            number = max(self._versions(), default=-1) + 1
        before = self.manifest(number)
        touched = {r[0] for r in rows.select(self.bucket()).distinct().collect()}
        if touched:
            after = combine(self._rows({b: v for b, v in before.items() if b in touched}), rows).select(self._rows({}).columns)
            after = after.withColumn("bucket", self.bucket()).repartition("bucket")
            after.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={number}")
        made = self._written(number) & touched if touched else set()
        now = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(made, number)
        table = self.spark.createDataFrame(list(now.items()), "bucket int, version long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={number}")
        return number

    def _written(self, number: int) -> set[int]:
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/version={number}")
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {int(f.getPath().getName().partition("=")[2]) for f in system.listStatus(top) if f.getPath().getName().startswith("bucket=")}

    def upsert(self, rows: DataFrame, at: str, number: int | None = None) -> int:
        """One row for each key, the one with the greatest at (of equals, the greatest row)."""

        def latest(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [c for c in old.columns if c not in (*self.keys, at)]
            whole = F.struct(at, *rest)
            return old.unionByName(new.select(old.columns)).groupBy(*self.keys).agg(F.max(whole).alias("w")).select(*self.keys, "w.*")

        return self.change(rows, latest, number)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
