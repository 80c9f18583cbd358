"""A store of media files with JSON sidecars: its listing, and what each file is worth."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.shared import written

#: Names of whole files, their sidecars, and files that are being made.
WHOLE, SIDECAR, UNFINISHED = r"^(\d+)\.mp4$", r"^(\d+)\.json$", r"^(\d+)\.(ts\.part|live\.spool|part\.mp4|ts\.frontier\.json)$"
#: Files of one folder that a store is written with, and files or bytes that are handed over at once.
FOLDER, BATCH, BYTES = 1_000, 5_000, 1 << 22


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Spark takes it, and the path in it."""
    return fs.FileSystem.from_uri(quote(path, safe="/:@?&=") if ":" in path else path)


def write_files(rows: DataFrame, path: str, count: int, tasks: int) -> DataFrame:
    """(folder, n) of the files written from name, value: the values of one name are the lines of a file. count: about so many files, which sets the number of folders.

    A name decides on its folder and a folder on its task; a task that runs again puts its files in the places of the first ones.
    """
    system, root = file_system(path)
    system.create_dir(root)
    folder = F.pmod(F.xxhash64("name"), F.lit(count // FOLDER + 1)).cast("int")
    rows = rows.where("name IS NOT NULL").select(folder.alias("folder"), "name", F.coalesce("value", F.lit("")).alias("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        attempt = TaskContext.get().taskAttemptId()
        lines = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for folder, own in groupby(lines, itemgetter(0)):
            system.create_dir(f"{root}/{folder}")
            n = 0
            for name, values in groupby(own, itemgetter(1)):
                draft = f"{root}/{folder}/.{name}.{attempt}"
                with system.open_output_stream(draft) as file:
                    file.write("".join(f"{value}\n" for _, _, value in values).encode())
                system.move(draft, f"{root}/{folder}/{name}")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([folder], pa.int32()), pa.array([n], pa.int64())], ["folder", "n"])

    return rows.repartition(tasks, "folder").sortWithinPartitions("folder", "name", "value").mapInArrow(write, "folder int, n long")


def listing(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """path, name, size, modified of all files below path, but hidden ones; no file is opened. One task finds the folders just below path, all tasks list what lies in them."""

    def seen(system: fs.FileSystem, top: str, recursive: bool) -> list[fs.FileInfo]:
        found = system.get_file_info(fs.FileSelector(top, recursive=recursive))
        return [f for f in found if not any(part.startswith((".", "_")) for part in f.path[len(top) :].strip("/").split("/"))]

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, root = file_system(path)
            below = [f.path for f in seen(system, root, False) if f.type == fs.FileType.Directory]
            yield pa.RecordBatch.from_arrays([pa.array([root, *below], pa.string()), pa.array([False] + [True] * len(below))], ["top", "recursive"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(path)
        for top, recursive in (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)):
            found = [f for f in seen(system, top, recursive) if f.type == fs.FileType.File]
            for part in (found[i : i + BATCH] for i in range(0, len(found), BATCH)):
                columns = [[f.path for f in part], [f.base_name for f in part], [f.size for f in part], [f.mtime_ns // 1_000_000 for f in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "name", "size", "ms"])

    tops = spark.range(0, 1, 1, 1).mapInArrow(folders, "top string, recursive boolean").repartition(tasks or spark.sparkContext.defaultParallelism)
    return tops.mapInArrow(files, "path string, name string, size long, ms long").select("path", "name", "size", F.timestamp_millis("ms").alias("modified"))


def contents(files: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """name, value: what is in each of the files of a listing of root, as text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(root)
        kinds = [pa.string(), pa.binary()]
        rows, size = [], 0
        for path, name in (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)):
            with system.open_input_stream(path) as file:
                rows.append((name, file.read()))
            size += len(rows[-1][1])
            if len(rows) == BATCH or size > BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "value"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "value"])

    dealt = files.select("path", "name").repartition(tasks or files.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(read, "name string, value binary").withColumn("value", F.col("value").cast("string"))


def sidecars(texts: DataFrame) -> DataFrame:
    """id, node (null unless a string), said (the size it tells), accessed, broken (its text, if it is no JSON object) of name, value."""
    own = texts.where(F.col("name").rlike(SIDECAR)).withColumn("v", F.try_parse_json("value"))
    kind = lambda field: F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant"))
    node = F.when(kind("megaNodeId") == "STRING", F.try_variant_get("v", "$.megaNodeId", "string"))
    said = F.when(kind("outputSize") != "STRING", F.try_variant_get("v", "$.outputSize", "double"))
    return own.select(
        F.regexp_extract("name", SIDECAR, 1).cast("long").alias("id"), node.alias("node"), said.alias("said"), F.try_to_timestamp(F.try_variant_get("v", "$.lastAccessedAt", "string")).alias("accessed"),
        F.when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), F.col("value")).alias("broken"),
    )


def scanned(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """name, id, size, kind, last_access: whole files are valid where their sidecar names a node and their size, else stale; unfinished ones are temp. Empty whole files and other names are left out."""
    files = written(listing(spark, path, tasks), "listing")
    temp = files.where(F.col("name").rlike(UNFINISHED)).select("name", F.regexp_extract("name", UNFINISHED, 1).cast("long").alias("id"), "size", F.lit("temp").alias("kind"), F.col("modified").alias("last_access"))
    whole = files.where(F.col("name").rlike(WHOLE) & (F.col("size") > 0)).withColumn("id", F.regexp_extract("name", WHOLE, 1).cast("long")).join(sidecars(contents(files.where(F.col("name").rlike(SIDECAR)), path, tasks)), "id", "left")
    valid = F.coalesce(F.col("broken").isNull() & F.col("node").isNotNull() & (F.col("said") == F.col("size")), F.lit(False))
    access = F.when(valid, F.coalesce("accessed", "modified")).otherwise(F.col("modified"))
    return whole.select("name", "id", "size", F.when(valid, "valid").otherwise("stale").alias("kind"), access.alias("last_access")).unionByName(temp)
