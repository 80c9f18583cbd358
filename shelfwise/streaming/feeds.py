"""Streams of files: rows laid down in order, read as a stream, and run to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from shelfwise.sources.shared import shared_dir


def place(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/shelfwise/{name}-{uuid.uuid4().hex}"


def laid_down(rows: DataFrame, key: str, slices: list[Column], name: str, form: str = "parquet", columns: list[str] | None = None, path: str | None = None) -> str:
    """Files of rows, slice after slice as a source would deliver them; within a slice all rows of a key lie in one file.

    A file stream takes older files first, so the rows of a key arrive in the order of the slices, however many files make a micro-batch.
    """
    path = path or place(rows.sparkSession, name)
    for part in slices:
        rows.where(part).repartition(key).select(columns or rows.columns).write.mode("append").format(form).save(path)
    return path


def stream_of(spark, path: str, schema, files: int, form: str = "parquet", **options) -> DataFrame:
    """The files as a stream, so many in a micro-batch."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).options(**options).load(path)


def run_to_end(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", root: str | None = None) -> tuple[DataFrame | None, object]:
    """Run a stream over what is there: to a table of files, or by each(rows, batch). Returns the table and the ended query, which has its progress. root: of a run before, which goes on."""
    root = root or place(stream.sparkSession, f"stream-{name}")
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).outputMode(mode)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{root}/out")
    ended = writer.start()
    ended.awaitTermination()
    return None if each else stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out"), ended


@dataclass
class Slices:
    """Rows that a source delivers slice after slice; form (as written and as read), columns and schema are those of its files."""

    rows: DataFrame
    key: str
    slices: list[Column]
    form: tuple[str, str] = ("parquet", "parquet")
    columns: list[str] | None = None
    schema: object = None
    options: dict[str, str] = field(default_factory=dict)


def run_in_turns(source: Slices, name: str, work: Callable[[DataFrame], DataFrame], each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame | None:
    """work on a stream of the slices, run to its end after each of them.

    A slice is one micro-batch, however many files Spark writes it to: a watermark moves from one slice to the next and never within one, where the files
    that are read later would count as late.
    """
    spark = source.rows.sparkSession
    path, root, out = place(spark, name), place(spark, f"stream-{name}"), None
    columns = source.columns or source.rows.columns
    for part in source.slices:
        laid_down(source.rows, source.key, [part], name, source.form[0], columns, path)
        stream = spark.readStream.format(source.form[1]).schema(source.schema or source.rows.select(columns).schema).options(**source.options).load(path)
        out, _ = run_to_end(work(stream), name, each, mode, root)
    return out
