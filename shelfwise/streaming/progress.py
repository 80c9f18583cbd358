"""Progress of long work: patches merged into one row a key, live counters, trailing rates, and lines of progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfwise.operators.order import numbered
from shelfwise.sources.shared import written
from shelfwise.streaming.shards import SHARDS, folded_by_shard

#: What a key's row begins with.
BEGIN = {"phase": "starting", "total": None, "processed": 0}
PATCH = "key long, event_id long, phase string, total long, processed long"


def lines_of(patches: DataFrame) -> DataFrame:
    """patches with value, a JSON object of one line; fields that are null are left out."""
    return patches.withColumn("value", F.to_json(F.struct(*[c.split()[0] for c in PATCH.split(", ")])))


def merged_patches(patches: DataFrame) -> DataFrame:
    """key, phase, total, processed, last: each field's last value that is not null; a null never takes one back."""
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_id"))), F.lit(BEGIN[c]))
    return patches.groupBy("key").agg(*[last(c).alias(c) for c in BEGIN], F.max("event_id").alias("last"))


def merged_patches_stream(patches: DataFrame) -> DataFrame:
    """The same over a stream, in update mode: a row for each key of a micro-batch. State is one row a key, kept by Spark's own aggregation."""
    return merged_patches(patches)


def status_changes_stream(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """status, change: what each micro-batch adds to and takes from the number of keys in a status, so that sums of change are the counters.

    events: key, event_id, status (null: no news). A key that moves on is taken back from where it was.
    """

    def fold(key: object, rows: list[tuple], before: str | None) -> tuple[list[tuple], str | None]:
        said = [row for row in rows if row[1] is not None]
        after = max(said)[1] if said else before
        return [] if after == before else [(after, 1), *([(before, -1)] if before is not None else [])], after

    return folded_by_shard(events, "key", ["event_id", "status"], fold, "status string, change long", shards)


def trailing_stream(events: DataFrame, window: int, shards: int = SHARDS) -> DataFrame:
    """key, event_id, done, span: items since the oldest sample that is kept, and the ms since then. events: key, event_id, t; each is one item.

    A key's samples lie in its state: those of the last window ms, the last one before them, and two at least.
    """

    def fold(key: object, rows: list[tuple], kept: list[int] | None) -> tuple[list[tuple], list[int]]:
        kept, out, first = kept or [], [], 0
        for t, event in sorted(rows):
            kept.append(t)
            while len(kept) - first > 2 and kept[first + 1] < t - window:
                first += 1
            out.append((key, event, len(kept) - first - 1, t - kept[first]))
        return out, kept[first:]

    return folded_by_shard(events, "key", ["t", "event_id"], fold, "key long, event_id long, done long, span long", shards)


#: What becomes of a picture that is repaired, and which counter of the summary it adds to.
COUNTERS = {
    "repaired-missing": "repairedMissing", "repaired-black": "repairedBlack", "repaired-broken": "repairedBroken", "repaired-problematic": "repairedProblematic",
    "skipped-good": "skippedGood", "not-found": "notFound", "failed": "failed",
}


def write_progress(repairs: DataFrame, path: str) -> None:
    """Lines of JSON of a run over repairs (id, title, status, elapsed), in the order of id: started, then start, phase and done of each, then a summary.

    The parts head, body and tail are read in this order, and their files by name. The counters are observed while the numbered rows
    are written; then tasks write ranges of the order side by side.
    """
    spark = repairs.sparkSession
    fixed = F.col("status").startswith("repaired")
    seen = Observation()
    rows = numbered(repairs, [F.col("id")], "index").observe(seen, F.count("*").alias("scanned"), F.count_if(fixed).alias("repaired"), *[F.count_if(F.col("status") == s).alias(c) for s, c in COUNTERS.items()])
    rows = written(rows, "repairs")
    total = seen.get["scanned"]
    line = lambda **fields: F.to_json(F.struct(*[(c if hasattr(c, "alias") else F.lit(c)).alias(n) for n, c in fields.items()]))
    each = F.array(
        line(type="video-start", videoId=F.col("id"), title=F.col("title"), index=F.col("index"), total=total),
        F.when(fixed, line(type="video-phase", videoId=F.col("id"), title=F.col("title"), phase="repairing", category=F.col("status"))),
        line(type="video-done", videoId=F.col("id"), title=F.col("title"), status=F.col("status"), elapsedMs=F.col("elapsed")),
    )
    body = rows.select("index", F.posexplode(each).alias("step", "value")).where("value IS NOT NULL")
    body.repartitionByRange("index").sortWithinPartitions("index", "step").select("value").write.text(f"{path}/body")
    one = spark.range(1)
    one.select(line(type="started", total=total).alias("value")).write.text(f"{path}/head")
    summary = F.struct(*[F.lit(n).alias(c) for c, n in seen.get.items()])
    one.select(line(type="summary", summary=summary).alias("value")).write.text(f"{path}/tail")


LINE = "type string, videoId long, title string, index long, total long, phase string, category string, status string, elapsedMs long, summary map<string, long>"


def read_progress(spark, path: str) -> DataFrame:
    """The lines' fields; text that is no JSON is left out."""
    lines = spark.read.text([f"{path}/{part}" for part in ("head", "body", "tail")])
    return lines.select(F.from_json("value", LINE).alias("l")).where("l.type IS NOT NULL").select("l.*")
