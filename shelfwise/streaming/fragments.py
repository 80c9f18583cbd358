"""An index of fragments over bytes that arrive in pieces: what is incomplete waits in the stream's state."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from shelfwise.streaming.shards import SHARDS, folded_by_shard

#: Fixed values of the format: bytes of a box's header, with a long size, and of what a fragment is made of.
HEADER, LONG_HEADER, MOVIE, MEDIA = 8, 16, b"moof", b"mdat"
FOUND = "stream long, idx long, start_time double, first_byte long, end_byte long, sequence long"


def box(data: bytes, at: int) -> tuple[int, bytes] | None:
    """Size and type of the box that begins at a place; None while its header is not there, or says a size that no box has."""
    if len(data) < at + HEADER:
        return None
    size, kind = struct.unpack_from(">I4s", data, at)
    if size == 0:
        return len(data) - at, kind  # up to the end of what is there
    if size == 1:
        size = struct.unpack_from(">Q", data, at + HEADER)[0] if len(data) >= at + LONG_HEADER else 0
        return (size, kind) if LONG_HEADER <= size < 1 << 53 else None
    return (size, kind) if size >= HEADER else None


def inside(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin, end) of the boxes that lie whole in a range."""
    while at + HEADER <= end and (found := box(data, at)) and at + found[0] <= end:
        yield found[1], at, at + found[0]
        at += found[0]


def number(data: bytes, at: int, form: str = ">I") -> int | None:
    return struct.unpack_from(form, data, at)[0] if at + struct.calcsize(form) <= len(data) else None


def times(movie: bytes) -> Iterator[tuple[int, int]]:
    """(track, decode time) of each track run of a movie fragment that has both."""
    for kind, begin, end in inside(movie, HEADER, len(movie)):
        if kind != b"traf":
            continue
        parts = {k: b for k, b, _ in inside(movie, begin + HEADER, end)}
        track = number(movie, parts[b"tfhd"] + 12) if b"tfhd" in parts else None
        at = parts.get(b"tfdt")
        base = None if at is None else number(movie, at + 12, ">Q" if movie[at + 8 : at + 9] == b"\x01" else ">I")
        if track is not None and base is not None and base < 1 << 53:
            yield track, base


def sequence(movie: bytes) -> int | None:
    return next((number(movie, begin + 12) for kind, begin, _ in inside(movie, HEADER, len(movie)) if kind == b"mfhd"), None)


def start_time(movie: bytes, scales: dict[int, int], video: int | None) -> float | None:
    """The earliest second of the video's track, else of all tracks whose clock is known."""
    seconds = [(track, base / scales[track]) for track, base in times(movie) if scales.get(track, 0) > 0]
    own = [s for track, s in seconds if track == video] or [s for _, s in seconds]
    return min(own, default=None)


def taken_in(offset: int, pending: bytes, piece: bytes, at: int) -> tuple[int, bytes]:
    """What waits after a piece: bytes that are there already are trimmed, after a gap the index starts anew."""
    expected = offset + len(pending)
    if at > expected:
        return at, piece
    return offset, pending + piece[expected - at :]


def advanced(offset: int, pending: bytes, scales: dict[int, int], video: int | None) -> tuple[list[tuple[float, int, int, int | None]], int, bytes]:
    """Fragments (start, first byte, end, sequence) that are whole, and what waits. Other boxes, and fragments without a time, are passed over."""
    at, found = 0, []
    while (head := box(pending, at)) and at + head[0] <= len(pending):
        end = at + head[0]
        if head[1] == MOVIE:
            media = box(pending, end)
            if media is None or end + media[0] > len(pending):
                break
            if media[1] == MEDIA:
                movie = pending[at:end]
                end += media[0]
                if (start := start_time(movie, scales, video)) is not None:
                    found.append((start, offset + at, offset + end, sequence(movie)))
        at = end
    return found, offset + at, pending[at:]


def indexed_stream(pieces: DataFrame, scales: dict[int, int], video: int | None, shards: int = SHARDS) -> DataFrame:
    """Fragments of streams as they become whole. pieces: stream, first_byte, data, last (whether the stream ends with it).

    State is kept by stream, in shards: where parsing stands, the bytes that wait (less than a fragment, unless a size is broken, when the
    stream stands still as there is no way to know where it goes on) and the number of fragments; it goes with a last piece. A micro-batch's pieces of
    one shard are put in order in memory.
    """

    def fold(stream: int | None, rows: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple | None]:
        offset, pending, n = state or (0, b"", 0)
        ended, out = False, []
        for at, data, last in sorted(rows, key=lambda r: r[0]):
            offset, pending = taken_in(offset, pending, bytes(data), int(at))
            found, offset, pending = advanced(offset, pending, scales, video)
            out += [(stream, n + i, *f) for i, f in enumerate(found)]
            n, ended = n + len(found), ended or bool(last)
        return out, None if ended else (offset, pending, n)

    return folded_by_shard(pieces, "stream", ["first_byte", "data", "last"], fold, FOUND, shards)
