"""Classification tables as column expressions: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.numbers import PLAYER_LADDER, ladder

#: What a worker's message says (any of the phrases, in any case), the error code and whether it is tried again.
OUTCOMES = (
    (("deadline exceeded", "aborted by worker shutdown"), "job_timeout", True),
    (("unsupported", "unknown decoder", "invalid data"), "unsupported_codec", False),
    (("moov not found", "moov incomplete"), "moov_missing", True),
    (("source size unknown",), "source_size_unknown", False),
    (("session expired", "session could not be decrypted", "reconnect required"), "source_unavailable", False),
    (("timeout", "timed out"), "download_timeout", True),
    (("ciphertext fetch failed", "ciphertext fetch truncated", "source unavailable"), "download_failed", True),
    (("encode failed", "ffmpeg"), "encode_failed", True),
    (("output",), "output_invalid", True),
    (("attempt budget exhausted",), "max_attempts", False),
)
OTHERWISE = ("internal", True)
#: System error codes of a network that may come back, names of errors that a client's own cancelling gives.
TRANSIENT = ("ETIMEDOUT", "ECONNRESET", "ECONNREFUSED", "EAI_AGAIN", "ENETUNREACH", "EHOSTUNREACH", "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_SOCKET")
CANCELLED = ("AbortError", "TimeoutError", "ResponseAborted")
#: What a job's state makes of its asset: status, error code, reason.
ASSETS = {
    "completed": ("pending", "artifact_missing", "Preview artifact missing; requeued."),
    "generating": ("generating", None, "Preview is being generated."),
    "queued": ("queued", None, "Waiting for a preview worker slot."),
    "pending": ("pending", None, "Preparing preview."),
    "unsupported": ("unsupported", "unsupported_codec", "This source cannot be previewed safely."),
}
FAILED_ASSET = ("failed", "generation_failed", "Preview generation failed.")


def outcome(detail: Column) -> Column:
    """struct<code, retryable> of a worker's message."""
    as_struct = lambda code, again: F.struct(F.lit(code).alias("code"), F.lit(again).alias("retryable"))
    out = F.when(F.lit(False), as_struct(*OTHERWISE))
    for phrases, code, again in OUTCOMES:
        out = out.when(F.lower(detail).rlike("|".join(phrases)), as_struct(code, again))
    return out.otherwise(as_struct(*OTHERWISE))


def thumb_verdict(mean: Column, least: float) -> Column:
    """unknown, black or usable by mean brightness."""
    return F.when(mean.isNull(), "unknown").when(mean >= least, "usable").otherwise("black")


def is_transient(name: Column, code: Column, message: Column) -> Column:
    """Whether an error of a request is the network's and worth another try."""
    network = F.coalesce(code.isin(*TRANSIENT), F.lit(False)) | F.coalesce((name == "TypeError") & F.lower(message).contains("fetch failed"), F.lit(False))
    return ~F.coalesce(name.isin(*CANCELLED), F.lit(False)) & network


def asset(status: Column) -> Column:
    """struct<status, code, reason> of an asset that is not there, by the state of its job; completed means that the file is gone."""
    row = lambda said: F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(said, ("status", "code", "reason"), strict=True)])
    out = F.when(F.lit(False), row(FAILED_ASSET))
    for state, said in ASSETS.items():
        out = out.when(status == state, row(said))
    return out.otherwise(row(FAILED_ASSET))


#: A transport stream has this byte every so many bytes, in four fifths of the places at least; what other files begin with.
SYNC, PACKET, SYNCED = b"\x47", 188, 0.8
MATROSKA, RIFF, AVI = b"\x1a\x45\xdf\xa3", b"RIFF", b"AVI "


def sniffed_type(head: Column) -> Column:
    """A file's media type by its first bytes, whatever its name says; null for what is not known."""
    n = F.length(head)
    part = lambda at, size: F.substring(head, at + 1, size)
    synced = F.size(F.filter(F.sequence(F.lit(0), n - 1, F.lit(PACKET)), lambda i: F.substring(head, i + 1, F.lit(1)) == F.lit(SYNC)))
    packets = F.when(n >= PACKET, synced >= F.floor(n / PACKET) * F.lit(SYNCED)).otherwise(False)
    size = F.conv(F.hex(part(0, 4)), 16, 10).cast("long")
    boxed = (n >= 8) & (size >= 8) & (size <= n)
    return (
        F.when(packets, "video/mp2t")
        .when(boxed & (part(4, 4) == F.lit(b"ftyp")), "video/mp4")
        .when(boxed & (part(4, 4) == F.lit(b"webm")), "video/webm")
        .when((n >= 4) & (part(0, 4) == F.lit(MATROSKA)), "video/webm")
        .when((n >= 12) & (part(0, 4) == F.lit(RIFF)) & (part(8, 4) == F.lit(AVI)), "video/x-msvideo")
    )


def container_of(head: Column) -> Column:
    """ts, mp4 or unknown."""
    found = sniffed_type(head)
    return F.when(found == "video/mp2t", "ts").when(found == "video/mp4", "mp4").otherwise("unknown")


def routed(stored: Column, seen: Column) -> Column:
    """struct<verdict, corrected>: how a file is played and, where its bytes prove the stored label wrong, the right one. Unknown bytes leave the label in force."""
    labelled = F.coalesce(stored == "video/mp2t", F.lit(False))
    is_ts = F.when(seen == "ts", True).when(seen == "mp4", False).otherwise(labelled)
    corrected = F.when((seen == "ts") & ~labelled, "video/mp2t").when((seen == "mp4") & labelled, "video/mp4")
    return F.struct(F.when(is_ts, "mp2t").otherwise("mp4").alias("verdict"), corrected.alias("corrected"))


#: The least and the longest wait in ms that a server may ask for, and what is said when a file cannot be played.
WAIT_LEAST, WAIT_MOST, STILL_PREPARING = 1000, 30_000, "The video is still being prepared."


def player_retry(status: Column, unreachable: Column, retry_after: Column, attempt: Column) -> Column:
    """struct<action, delay, message> after a playback error, by what a probe of the address says: null status and not unreachable means no probe. attempt: from 0."""
    wait = ladder(PLAYER_LADDER, attempt + 1)
    asked = F.regexp_extract(F.trim(retry_after), r"^(\d+)\z", 1).try_cast("double") * 1000
    asked = F.when(asked.isNotNull(), F.least(F.greatest(asked, F.lit(WAIT_LEAST)), F.lit(WAIT_MOST)).cast("long"))
    told = lambda action, delay=None, message=None: F.struct(F.lit(action).alias("action"), F.lit(delay).cast("long").alias("delay") if delay is None else delay.alias("delay"), F.lit(message).cast("string").alias("message"))
    waits = F.coalesce(unreachable, F.lit(False)) | status.between(500, 599) | status.isin(200, 206)
    return (
        F.when(~F.coalesce(unreachable, F.lit(False)) & (status == 410), told("unavailable"))
        .when(~F.coalesce(unreachable, F.lit(False)) & status.isin(503, 429), told("retry", F.coalesce(asked, wait)))
        .when(waits, told("retry", wait))
        .otherwise(told("fatal", message=STILL_PREPARING))
    )
