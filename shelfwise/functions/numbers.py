"""Numbers, times and small tables as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_bool(text: Column) -> Column:
    return F.when(text.isin("1", "true"), True).when(text.isin("0", "false"), False)


def to_utc(text: Column) -> Column:
    """Epoch milliseconds, "date time" or ISO text to a UTC time without zone; null for anything else."""
    epoch = F.timestamp_millis(text.try_cast("long")).cast("timestamp_ntz")
    spelled = F.regexp_replace(F.regexp_replace(text, "Z$", ""), " ", "T").try_cast("timestamp_ntz")
    return F.when(text.rlike(r"^\d+$"), epoch).otherwise(spelled)


def backoff(base: int, failures: Column, most: int) -> Column:
    """base, doubled with each failure after the first, up to most."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(failures, F.lit(1)) - 1), F.lit(most)).cast("long")


#: From here on a duration is in milliseconds, and from here on in microseconds.
MILLISECONDS_FROM, MICROSECONDS_FROM = 1_000, 1_000_000


def duration_seconds(value: Column) -> Column:
    """Whole seconds (halves up) from a number in microseconds, milliseconds or seconds, told by its magnitude; null unless it is above 0 and finite."""
    seconds = F.when(value >= MICROSECONDS_FROM, value / 1_000_000).when(value >= MILLISECONDS_FROM, value / 1_000).otherwise(value)
    return F.when((value > 0) & (value.cast("double") < float("inf")), F.floor(seconds + 0.5).cast("long"))


def size_bytes(text: Column, fallback: int) -> Column:
    """"5GB", "1.5 mb" or "700" (bytes) in steps of 1024; the fallback for zero, nothing and anything else."""
    pattern = r"^(\d+(?:\.\d+)?)\s*(B|KB|MB|GB|TB|)\z"
    tidy = F.upper(F.trim(text))
    number, unit = F.regexp_extract(tidy, pattern, 1), F.regexp_extract(tidy, pattern, 2)
    power = F.when(unit == "KB", 1).when(unit == "MB", 2).when(unit == "GB", 3).when(unit == "TB", 4).otherwise(0)
    value = F.when(number != "", number.try_cast("double"))
    return F.coalesce(F.when(value > 0, F.floor(value * F.pow(F.lit(1024.0), power)).cast("long")), F.lit(fallback).cast("long"))


#: Waits in ms after a failure: of a download that goes on where it broke off, and of the player.
RESUME_LADDER, PLAYER_LADDER = (800, 2000, 5000, 10_000, 15_000), (1000, 2000, 4000)


def ladder(steps: tuple[int, ...], failures: Column) -> Column:
    """The wait after so many failures; the first step for none or one, the last from there on."""
    at = F.least(F.greatest(failures, F.lit(1)), F.lit(len(steps))).cast("int")
    return F.element_at(F.array(*map(F.lit, steps)), at).cast("long")


def byte_range(header: Column, size: Column) -> Column:
    """struct<start, end, ok> of a Range header: null without one, ok false if it cannot be read or met."""
    number = lambda text: F.least(F.nullif(text, F.lit("")).try_cast("double"), F.lit(2.0**62)).cast("long")
    parts = F.split(F.regexp_extract(header, r"^bytes=(\d*-\d*)\z", 1), "-")  # bound once: each lambda's argument is worked out before its body
    bounds = F.transform(F.array(parts), lambda p: F.struct(F.when(F.get(p, F.lit(0)) != "", number(F.get(p, F.lit(0)))).alias("first"), F.when(F.get(p, F.lit(1)) != "", number(F.get(p, F.lit(1)))).alias("last")))

    def met(b: Column) -> Column:
        first, last = b["first"], b["last"]
        start = F.when(first.isNull() & (last > 0), F.greatest(size - last, F.lit(0))).otherwise(first)
        end = F.when(first.isNull() | last.isNull(), size - 1).otherwise(F.least(last, size - 1))
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.coalesce((start <= F.coalesce(last, end)) | first.isNull(), F.lit(False)).alias("fits"))

    said = F.transform(F.transform(bounds, met), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.coalesce(r["fits"] & (r["start"] <= r["end"]) & (r["start"] < size), F.lit(False)).alias("ok")))
    shown = F.transform(said, lambda r: F.struct(F.when(r["ok"], r["start"]).alias("start"), F.when(r["ok"], r["end"]).alias("end"), r["ok"].alias("ok")))
    return F.when(header != "", F.get(shown, F.lit(0)))


def even(value: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(value / 2 + 0.5) * 2).cast("long")


def canvas(width: Column, height: Column, landscape: tuple[int, int] = (640, 360), portrait: tuple[int, int] = (360, 640)) -> Column:
    """struct<width, height>: scaled down into the bounds of its orientation, never up, both even."""
    w, h = F.greatest(F.floor(width), F.lit(2)), F.greatest(F.floor(height), F.lit(2))
    tall = h > w
    scale = F.least(F.lit(1.0), F.when(tall, portrait[0]).otherwise(landscape[0]) / w, F.when(tall, portrait[1]).otherwise(landscape[1]) / h)
    return F.struct(even(w * scale).alias("width"), even(h * scale).alias("height"))


def frame_rate(fps: Column, cap: int) -> Column:
    known = F.when(fps > 0, fps).otherwise(cap)
    return F.least(F.lit(cap), F.greatest(F.lit(1), F.floor(known + 0.01))).cast("int")


def aligned(offset: Column, step: int) -> Column:
    return offset - offset % step


def byte_window(fraction: Column, size: Column, most: int, step: int, floor: int = 4 << 20) -> Column:
    """struct<start, length>: a bounded window at a fraction of a file, its start aligned down and its end inside."""
    want = F.least(F.greatest(F.ceil(size * F.lit(Decimal("0.03"))), F.least(F.lit(floor), size)), F.lit(most), size)
    at = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)) * size)
    start = F.greatest(F.lit(0), F.least(aligned(at, step), aligned(size - want, step)))
    return F.when(size > 0, F.struct(start.cast("long").alias("start"), F.least(want, size - start).cast("long").alias("length"))).otherwise(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length")))


def timeline_window(at: Column, duration: Column, size: Column, most: int, step: int, cover: float = 18, factor: float = 1.8, floor: int = 2 << 20) -> Column:
    """The same for a time in a file of known duration; otherwise at is taken for a fraction. Factors are decimals: their products are rounded once, before the division."""
    wanted = (size * F.lit(Decimal(str(cover))) * F.lit(Decimal(str(factor)))).cast("double")
    want = F.least(F.greatest(F.ceil(wanted / duration), F.least(F.lit(floor), size)), F.lit(most))
    start = F.greatest(F.lit(0), F.least(aligned(F.floor(at / duration * size), step), aligned(F.greatest(F.lit(0), size - want), step)))
    known = F.struct(start.cast("long").alias("start"), F.least(want, size - start).cast("long").alias("length"))
    return F.when((size > 0) & (duration > 0), known).otherwise(byte_window(F.when(at.between(0, 1), at).otherwise(0.0), size, most, step))


def candidate_times(duration: Column, clip: int) -> Column:
    """Where to look for a picture: quarters of a known duration, clear of the end, else fixed seconds."""
    last = F.greatest(F.lit(0), duration - max(1, clip) - 1)
    quarters = F.transform(F.array(*map(F.lit, (0.25, 0.5, 0.75))), lambda f: F.greatest(F.lit(0), F.least(F.floor(duration * f + 0.5), last)).cast("long"))
    return F.when(duration > 0, F.array_distinct(quarters)).otherwise(F.array(*[F.lit(t).cast("long") for t in (10, 30, 60)]))


#: Seconds at which a short or unknown file is looked at, and parts of a known one.
SEEK_LADDER, SEEK_PARTS = (2, 10, 30, 60, 180), (0.05, 0.25, 0.5, 0.75)


def candidate_seeks(duration: Column) -> Column:
    """Where a picture is looked for again, in whole seconds from 1 on: parts of a duration over 4 s and 2 s before its end, else fixed seconds."""
    known = F.array(*[duration * F.lit(p) for p in SEEK_PARTS], F.greatest(F.lit(0.0), duration - F.lit(2.0)))
    seeks = F.when((duration > 4) & (duration.cast("double") < float("inf")), known).otherwise(F.array(*[F.lit(float(t)) for t in SEEK_LADDER]))
    return F.array_distinct(F.transform(seeks, lambda t: F.greatest(F.lit(1), F.floor(t + 0.5)).cast("long")))


#: A scene keeps so many seconds at the end of a file at least, and how far off 16:9 a picture may be.
LEAST_TAIL, WIDE_TOLERANCE = 0.2, 0.1


def clamped_start(start: Column, duration: Column, length: Column) -> Column:
    """A scene's start inside the file; from 0 on where its duration is not known."""
    tail = F.greatest(F.lit(LEAST_TAIL), F.least(length, duration))
    inside = F.greatest(F.lit(0.0), F.least(start, F.greatest(F.lit(0.0), duration - tail)))
    return F.when(duration > 0, inside).otherwise(F.greatest(F.lit(0.0), start))


def scene_window(start: Column, length: Column, duration: Column, size: Column, fraction: Column, estimated: Column, most: int, step: int) -> Column:
    """struct<at, start, length, estimated, fraction>: the bytes of a scene, by its time where the duration is known, else by its fraction of the file, which is an estimate."""
    at = clamped_start(start, duration, length)
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction))
    timed = timeline_window(at, duration, size, most, step, factor=1.6)
    guessed = byte_window(F.coalesce(part, F.lit(0.0)), size, most, step)
    known = F.coalesce(duration > 0, F.lit(False))
    window = F.when(known, timed).otherwise(guessed)
    told = F.when(known, F.coalesce(estimated, F.lit(False))).otherwise(True)
    return F.struct(at.alias("at"), window["start"].alias("start"), window["length"].alias("length"), told.alias("estimated"), F.when(~known, part).alias("fraction"))


def is_widescreen(width: Column, height: Column) -> Column:
    """About 16:9."""
    return F.coalesce((width > 0) & (height > 0) & (F.abs(F.try_divide(width, height) - F.lit(16 / 9)) <= WIDE_TOLERANCE), F.lit(False))


def merged_windows(windows: Column, most: int, gap: int) -> Column:
    """Greedy merge of array<struct<start, length>>: neighbours within gap, while the merged one is not longer than most."""
    first = F.array_sort(F.filter(windows, lambda w: w["length"] > 0))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, length: BIGINT>>)")

    def add(done: Column, w: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        end = last["start"] + last["length"]
        longer = F.greatest(end, w["start"] + w["length"]) - last["start"]
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), longer.alias("length"))))
        return F.when((F.size(done) > 0) & (w["start"] - end <= gap) & (longer <= most), joined).otherwise(F.concat(done, F.array(w)))

    return F.aggregate(first, empty, add)


def sprite_plan(duration: Column, columns: int, most: int, least_interval: int) -> Column:
    """struct<interval, count, rows>: pictures of a sheet, one every interval seconds, as many as fit the duration and the sheet, one at least."""
    d = F.greatest(F.lit(0.5), duration)
    interval = F.greatest(F.lit(least_interval), F.ceil(d / most))
    count = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(d / interval)))
    return F.struct(interval.cast("long").alias("interval"), count.cast("long").alias("count"), F.ceil(count / columns).cast("long").alias("rows"))


def signature_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two pictures' brightness arrays, over the length of the shorter; endless if one is empty."""
    n = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.zip_with(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n, F.lit(0))), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, total / n).when(n == 0, F.lit(float("inf")))


#: Quota shares of the home feed's sources, in their order, with and without a watch history.
FEED_SOURCES = ("recent", "history", "related", "random", "variety")
WITH_HISTORY = (0.15, 0.10, 0.15, 0.30, 0.30)
WITHOUT_HISTORY = (0.15, 0.0, 0.15, 0.35, 0.35)


def quotas(per_page: int, has_history: bool) -> dict[str, int]:
    """Largest remainder: shares of a page that add up to it; ties go by the order of the sources."""
    exact = [s * per_page for s in (WITH_HISTORY if has_history else WITHOUT_HISTORY)]
    whole = [int(x + 1e-9) for x in exact]
    by_rest = sorted(range(len(exact)), key=lambda i: (-(exact[i] - whole[i]), i))
    for i in by_rest[: per_page - sum(whole)]:
        whole[i] += 1
    return dict(zip(FEED_SOURCES, whole, strict=True))
