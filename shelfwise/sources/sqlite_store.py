"""A foreign store: a folder of SQLite files that tasks write, and a data source that reads them by key ranges with filters pushed down."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Keys of one partition of a read, and rows that are handed over at once.
RANGE, BATCH = 50_000, 5_000
#: Ranges of a file are at most so many times as many as its rows would fill.
SPARSE = 4
#: Filters that SQLite answers as Spark does; others stay with Spark.
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def local(path: str) -> str:
    """A folder that driver and executors all have under one name."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"SQLite files need a mounted folder, not {parts.scheme}:")
    return unquote(parts.path)


def write_store(rows: DataFrame, path: str, table: str) -> DataFrame:
    """(file, n) of the files written, one by each task; a task that runs again puts its file in the place of the first. Values are longs, doubles or texts."""
    folder, names = local(path), rows.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():05d}.sqlite", 0
        draft = f"{folder}/.{name}.{task.taskAttemptId()}"
        with sqlite3.connect(draft) as store:
            store.execute(f'CREATE TABLE "{table}" ({", ".join(f"{chr(34)}{c}{chr(34)}" for c in names)})')
            for batch in batches:
                store.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', zip(*[c.to_pylist() for c in batch.columns], strict=True))
                n += batch.num_rows
            store.execute(f'CREATE INDEX "by {names[0]}" ON "{table}" ("{names[0]}")')
        store.close()
        os.replace(draft, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "n"])

    return rows.mapInArrow(write, "file string, n long")


@dataclass
class Keys(InputPartition):
    """A file and a range of its keys; the first range of a file has its rows without a key, too."""

    file: str
    low: int | None
    high: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.folder, self.table, self.key = schema.names, local(options["path"]), options["table"], options["key"]
        self.schema, self.range = schema, int(options.get("range", RANGE))
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons, lists and tests for null of a column; gives back what Spark has to do."""
        for one in filters:
            column = f'"{one.attribute[0]}"' if len(getattr(one, "attribute", ())) == 1 else None
            if column and type(one) in COMPARED and isinstance(one.value, (int, float, str)) and not isinstance(one.value, bool):
                self.conditions.append((f"{column} {COMPARED[type(one)]} ?", [one.value]))
            elif column and isinstance(one, In) and all(isinstance(v, (int, str)) and not isinstance(v, bool) for v in one.value):
                self.conditions.append((f"{column} IN ({', '.join('?' * len(one.value))})", list(one.value)))
            elif column and isinstance(one, (IsNull, IsNotNull)):
                self.conditions.append((f"{column} IS {'NOT ' * isinstance(one, IsNotNull)}NULL", []))
            else:
                yield one

    def partitions(self) -> list[Keys]:
        """Key ranges of each file, wider where keys lie far apart; only the least and the greatest key and the last row's number of a file are read here."""
        out = []
        for name in sorted(f for f in os.listdir(self.folder) if f.endswith(".sqlite") and not f.startswith(".")):
            with sqlite3.connect(f"file:{self.folder}/{name}?mode=ro", uri=True) as store:
                # each by itself, or SQLite goes through the whole index
                least, most, rows = (store.execute(f'SELECT {one} FROM "{self.table}"').fetchone()[0] for one in (f'min("{self.key}")', f'max("{self.key}")', "max(rowid)"))
            store.close()
            starts = [None]
            if least is not None:
                step = max(self.range, (most - least) // (SPARSE * rows // self.range + 1) + 1)
                starts = list(range(least, most + 1, step))
            out += [Keys(name, start if i else None, starts[i + 1] if i + 1 < len(starts) else None) for i, start in enumerate(starts)]
        return out

    def read(self, partition: Keys) -> Iterator[pa.RecordBatch]:
        key = f'"{self.key}"'
        parts = [(f"{key} >= ?", [partition.low])] * (partition.low is not None)
        if partition.high is not None:
            parts.append((f"({key} < ?{' OR ' + key + ' IS NULL' if partition.low is None else ''})", [partition.high]))
        where = " AND ".join(text for text, _ in [*parts, *self.conditions]) or "1"
        values = [v for _, own in [*parts, *self.conditions] for v in own]
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        store = sqlite3.connect(f"file:{self.folder}/{partition.file}?mode=ro", uri=True)
        found = store.execute(f'SELECT {", ".join(f"{chr(34)}{c}{chr(34)}" for c in self.names)} FROM "{self.table}" WHERE {where}', values)
        while rows := found.fetchmany(BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        store.close()


class SqliteFolder(DataSource):
    """spark.read.format("sqlite_folder").schema(...).option("table", ...).option("key", ...).load(path); the key is a whole number."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_folder"

    def schema(self) -> str:
        raise ValueError("give the schema of the table")

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_store(spark, path: str, table: str, key: str, schema: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteFolder)
    return spark.read.format("sqlite_folder").schema(schema).options(table=table, key=key, **options).load(path)
