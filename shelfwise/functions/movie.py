"""What the header of a film says, from its boxes: read in Arrow batches, a file at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.streaming.fragments import HEADER, inside, number

HEADERS = T.StructType([T.StructField("seconds", T.DoubleType()), T.StructField("faststart", T.StringType()), T.StructField("video", T.IntegerType()), T.StructField("clocks", T.MapType(T.IntegerType(), T.LongType()))])


def _versioned(data: bytes, begin: int, first: int, second: int, form: str = ">I") -> int | None:
    """A number of a box at its place in version 0, or at that of version 1."""
    version = data[begin + HEADER : begin + HEADER + 1]
    return number(data, begin + second, form) if version == b"\x01" else number(data, begin + first)


def seconds(data: bytes) -> float | None:
    """The film's duration: of the first movie header in the first movie box that is there as a whole."""
    for kind, begin, end in inside(data, 0, len(data)):
        if kind == b"moov":
            header = next((b for k, b, _ in inside(data, begin + HEADER, end) if k == b"mvhd"), None)
            if header is None:
                return None
            scale, length = _versioned(data, header, 20, 28), _versioned(data, header, 24, 32, ">Q")
            return length / scale if scale and length else None
    return None


def faststart(data: bytes) -> str:
    """Whether the movie box begins before the media."""
    starts: dict[bytes, int] = {}
    for kind, begin, _ in inside(data, 0, len(data)):
        starts.setdefault(kind, begin)
    if b"moov" not in starts:
        return "unknown"
    return "faststart" if starts[b"moov"] < starts.get(b"mdat", len(data)) else "not-faststart"


def clocks(data: bytes) -> tuple[int | None, dict[int, int]]:
    """The first track that has a clock, which stands for the picture, and the ticks a second of all tracks."""
    found: dict[int, int] = {}
    for kind, begin, end in inside(data, 0, len(data)):
        for part, at, stop in inside(data, begin + HEADER, end) if kind == b"moov" else ():
            if part != b"trak":
                continue
            inner = {k: (b, e) for k, b, e in inside(data, at + HEADER, stop)}
            track = _versioned(data, inner[b"tkhd"][0], 20, 28) if b"tkhd" in inner else None
            media = {k: b for k, b, _ in inside(data, inner[b"mdia"][0] + HEADER, inner[b"mdia"][1])} if b"mdia" in inner else {}
            ticks = _versioned(data, media[b"mdhd"], 20, 28) if b"mdhd" in media else None
            if track is not None and ticks:
                found.setdefault(track, ticks)
        if kind == b"moov":
            break
    return next(iter(found), None), found


@F.pandas_udf(HEADERS)
def movie_header(data: pd.Series) -> pd.DataFrame:
    """struct<seconds, faststart, video, clocks> of a file's bytes; of null bytes nothing is known."""
    rows = []
    for one in data:
        whole = bytes(one or b"")
        first, found = clocks(whole)
        rows.append((seconds(whole), faststart(whole), first, found))
    out = pd.DataFrame(rows, columns=["seconds", "faststart", "video", "clocks"])
    return out.astype({"seconds": "float64", "video": "Int32"})
