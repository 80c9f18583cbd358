"""Text functions of the library as column expressions; pandas only for Unicode normalisation and pair similarity."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: markers that download sites put after a name.
CDN_MARKER = r"(?i)_-_(VOE|CDN|Content_Delivery|Video_Cloud)[^.]*\.[^.]+\z"
#: Fixed value: leading words that are no creator's name.
GENERIC_PREFIX = r"(?i)^(joi|bbc|hot[_ ]girl[_ ]joi|pov)[\s_\-–—]*"


def collapsed(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)^.*[/\\]", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+\z", "")


def clean_filename(name: Column) -> Column:
    """Base name without a site's marker and the exact prefix Watch_."""
    return F.regexp_replace(F.regexp_replace(base_name(name), CDN_MARKER, ""), "^Watch_", "")


def title_of(name: Column) -> Column:
    return collapsed(F.regexp_replace(stem(clean_filename(name)), "_+", " "))


def without_watch(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)^watch[_\s]+", ""))


def parsed_name(name: Column) -> Column:
    """struct<creator, title> of a file name: "Creator - Title" first, then "Creator_-_Title", else only a title."""
    own = stem(clean_filename(name))

    def cut(mark: str, tidy) -> tuple[Column, Column, Column]:
        at = F.locate(mark, own)
        left = collapsed(F.regexp_replace(F.substring(own, F.lit(1), at - 1), "_+", " "))
        right = collapsed(tidy(F.substring(own, at + len(mark), F.length(own))))
        creator = without_watch(left)
        return (at > 1) & (right != ""), F.when(creator != "", creator), right

    spaced, scored = cut(" - ", lambda t: t), cut("_-_", lambda t: F.regexp_replace(t, "_+", " "))
    creator = F.when(spaced[0], spaced[1]).when(scored[0], scored[1])
    title = F.when(spaced[0], spaced[2]).when(scored[0], scored[2]).otherwise(title_of(name))
    return F.struct(creator.alias("creator"), title.alias("title"))


def guessed_creator(name: Column) -> Column:
    """The two site conventions: Creator_-Title and _Creator__Title; null for others.

    Runs without underscores are taken whole, single underscores join them: there is one way only to read a name, so none takes longer than its length.
    """
    own = stem(name)
    first = F.regexp_extract(own, r"^_?([^_]++(?:_[^_]++)*?)_[–—-]", 1)
    second = F.regexp_extract(own, r"^_([^_]++(?:_[^_]++)*?)__", 1)
    return F.when(first != "", F.trim(first)).when(second != "", F.trim(second))


def creator_name(name: Column) -> Column:
    """Without generic prefixes, which end wherever the word does; nothing left is an unknown creator."""
    tidy = collapsed(F.regexp_replace(F.trim(F.regexp_replace(name, GENERIC_PREFIX, "")), "_+", " "))
    return F.when(tidy == "", "Unknown Creator").otherwise(tidy)


def extension(name: Column) -> Column:
    """Lower-case, '' without one; a dot that begins or ends the name does not count."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)\z", 1))


@F.pandas_udf(T.StringType())
def slug(text: pd.Series) -> pd.Series:
    """ASCII words joined by hyphens, at most 120 characters; 'video' if nothing is left."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not 0x300 <= ord(c) <= 0x36F).lower()
        return "-".join(re.findall("[a-z0-9]+", plain))[:120] or "video"

    return text.map(one)


#: Marks of numbered and copied files.
_NUMBERED = (re.compile(r"^(.*\S)\s*[-._\s]*[(\[]\s*\d{1,3}\s*[)\]]\s*$"), re.compile(r"^(.*\S)\s+-\s*\d{1,3}\s*$"))
_COPY_WORD = re.compile(r"^(.*\S)\s+[-._]?\s*\(?\s*(copy(\s*\d+)?|duplicates?)\s*\)?\s*$")
#: Stem that a copy word needs to be a marker (fixed value).
LEAST_STEM = 4


def _unmarked(title: str) -> str:
    for pattern in _NUMBERED:
        if found := pattern.match(title):
            return found[1].strip()
    found = _COPY_WORD.match(title)
    return found[1].strip() if found and len(found[1].strip()) >= LEAST_STEM else title


def comparison_key(name: str | None) -> str:
    """A file name as the key under which its duplicates meet."""
    title = re.split(r"[/\\]", name or "")[-1]
    title = re.sub(r"\.[^.]+$", "", re.sub("(?i)^watch_", "", title))
    title = unicodedata.normalize("NFKC", title).lower()
    while (shorter := _unmarked(title)) != title:
        title = shorter
    for mark in (" - ", "_-_"):
        if title.find(mark) > 0:
            title = title[title.find(mark) + 3 :]
            break
    return " ".join("".join(c if c.isspace() or unicodedata.category(c)[0] in "LN" else " " for c in title).split())


@F.pandas_udf(T.StringType())
def normal_title(name: pd.Series) -> pd.Series:
    return name.map(comparison_key)


def similarity(a: str, b: str) -> int:
    """Jaro-Winkler in percent: half transpositions stay halves, the prefix always counts, halves round up."""
    if not a or not b:
        return 0
    if a == b:
        return 100
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, from_a = [True] * len(b), []
    for i, char in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == char), None)
        if j is not None:
            free[j] = False
            from_a.append(char)
    if not from_a:
        return 0
    moved = sum(x != y for x, y in zip(from_a, (c for c, f in zip(b, free, strict=True) if not f), strict=True)) / 2
    m = len(from_a)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    shared = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return int((jaro + shared * 0.1 * (1 - jaro)) * 100 + 0.5)


def similarity_bound(a: str, b: str) -> Column:
    """No less than similarity() of two columns, as a part of one: as if all characters that the other text has anywhere were matched in order."""
    shared = F.expr(f"least(length({a}) - length(translate({a}, {b}, '')), length({b}) - length(translate({b}, {a}, '')))")
    jaro = (F.try_divide(shared, F.length(a)) + F.try_divide(shared, F.length(b)) + 1) / 3
    prefix = sum((F.when(F.substring(a, 1, k) == F.substring(b, 1, k), 1).otherwise(0) for k in range(1, 5)), F.lit(0))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.IntegerType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


#: Characters that no file system likes, invisible ones, the name that is given when nothing is left, and the longest name and extension.
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'
INVISIBLE = r"[\x7f-\x9f\u200b-\u200f\u2028-\u202f\ufeff]"
FALLBACK_NAME, LONGEST_NAME, LONGEST_EXTENSION = "video.bin", 180, 10
_EDGE = r"[\s\x{feff}]"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_EDGE}+|{_EDGE}+\z", "")


def safe_name(name: Column) -> Column:
    """The last part of a path without characters that are unsafe in a file name; '' if nothing is left."""
    own = F.regexp_replace(F.regexp_replace(base_name(F.coalesce(name, F.lit(""))), UNSAFE, ""), INVISIBLE, "")
    return F.regexp_replace(trimmed(F.regexp_replace(own, r"^\.+", "")), r"[. ]+\z", "")


def short_ending(name: Column) -> Column:
    """The extension with its dot, if it has up to 10 characters and a name before it; else ''."""
    return F.regexp_extract(name, rf"(?s)^.+(\.[^.]{{1,{LONGEST_EXTENSION}}})\z", 1)


def download_name(name: Column, title: Column | None = None, ending: Column | None = None) -> Column:
    """A safe file name: of name, else of title (with ending, if it has none), else a fixed one; cut to 180 characters with its extension kept."""
    own, other = safe_name(name), safe_name(F.lit(None).cast("string") if title is None else title)
    tail = F.lower(trimmed(F.lit(None).cast("string") if ending is None else ending))
    tail = F.coalesce(F.regexp_replace(F.regexp_replace(tail, r"^\.+", ""), "[^a-z0-9]", ""), F.lit(""))
    with_tail = F.when(F.length(tail).between(1, LONGEST_EXTENSION) & (short_ending(other) == ""), F.concat(other, F.lit("."), tail)).otherwise(other)
    full = F.when(own != "", own).when(other != "", with_tail).otherwise(FALLBACK_NAME)
    last = short_ending(full)
    stem_of = F.substring(full, F.lit(1), F.least(F.length(full) - F.length(last), LONGEST_NAME - F.length(last)))
    return F.when(F.length(full) > LONGEST_NAME, F.concat(stem_of, last)).otherwise(full)


def uri_encoded(text: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits and - _ . ! ~ * ' ( ) stay."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def content_disposition(name: Column) -> Column:
    """attachment with the name without quotes and backslashes; of other than printable ASCII an underscore for each UTF-16 unit, and the encoded name beside it."""
    plain = F.regexp_replace(name, r'["\\]', "")
    ascii_name = F.regexp_replace(F.regexp_replace(plain, r"[\x{10000}-\x{10FFFF}]", "__"), r"[^\x20-\x7E]", "_")
    both = F.concat(F.lit('attachment; filename="'), F.when(ascii_name == "", "download").otherwise(ascii_name), F.lit("\"; filename*=UTF-8''"), uri_encoded(name))
    return F.when(plain.rlike(r"^[\x20-\x7E]+\z"), F.concat(F.lit('attachment; filename="'), plain, F.lit('"'))).otherwise(both)


def safe_reason(text: Column, most: int = 240) -> Column:
    return F.substring(collapsed(F.regexp_replace(text, r"https?://\S+", "[url]")), 1, most)


#: Fixed value: an account's label where neither it nor its address gives one.
NO_LABEL = "MEGA account"


def label_of(label: Column, email: Column) -> Column:
    """A label cut to 50, or the part of the address before the @, or a fixed one."""
    own, local = F.substring(trimmed(label), 1, 50), F.substring_index(email, "@", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(local, F.lit("")), F.lit(NO_LABEL))


def folder_name(name: Column) -> Column:
    tidy = collapsed(name)
    return F.when(F.length(tidy).between(1, 100), tidy)


def email_key(email: Column) -> Column:
    return F.lower(F.trim(email))


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; null for null, negative or endless times."""
    s = F.floor(seconds).cast("long")
    with_hours = F.format_string("%d:%02d:%02d", F.expr("0L") + F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when((seconds >= 0) & (seconds.cast("double") < float("inf")), F.when(s >= 3600, with_hours).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60)))


def bytes_text(size: Column) -> Column:
    """In steps of 1024; one decimal below ten and above bytes; null for null, negative or endless sizes."""
    known = (size >= 0) & (size.cast("double") < float("inf"))
    step = F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.log2(F.greatest(size, F.lit(1))) / 10))).cast("int")
    value = size / F.pow(F.lit(1024.0), step)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), step + 1)
    return F.when(known, F.when((step > 0) & (value < 10), F.format_string("%.1f %s", value, unit)).otherwise(F.format_string("%.0f %s", value, unit)))


def vtt_time(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, in hex."""
    start = F.lit(0x811C9DC5).cast("long")
    step = lambda h, unit: (h.bitwiseXOR(F.conv(unit, 16, 10).cast("long")) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.hex(F.aggregate(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})")), start, step)))


def attribute_handles(attributes: Column) -> Column:
    """map of type to handle from "v:type*handle/v:type*handle"; the last of a type wins."""
    parts = F.filter(F.split(attributes, "/"), lambda p: p.rlike(r"^\d+:\d+\*.+"))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r":(\d+)\*", 1).alias("k"), F.regexp_extract(p, r"\*(.+)", 1).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded by two spaces before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


#: Fixed value: a public file link, its file handle and its key.
FILE_LINK = r"^https?://(?:www\.)?mega\.(?:nz|co\.nz)/file/([A-Za-z0-9_-]{8})#([A-Za-z0-9_-]{32,64})\z"


def link_parts(url: Column) -> Column:
    """struct<id, key> of a file link, null fields for anything else."""
    part = lambda i: F.nullif(F.regexp_extract(trimmed(url), FILE_LINK, i), F.lit(""))
    return F.struct(part(1).alias("id"), part(2).alias("key"))


def embed_url(url: Column, autoplay: bool = False, muted: bool = False) -> Column:
    """The player's address of a file link, with its flags; null for anything else."""
    flags = "1a" * autoplay + "1m" * muted
    found = link_parts(url)
    return F.concat(F.lit("https://mega.nz/embed/"), found["id"], F.lit("#"), found["key"], F.lit("!" + flags if flags else ""))


def preview_url(url: Column) -> Column:
    return embed_url(url, autoplay=True, muted=True)


def named_handles(attributes: Column) -> Column:
    """struct<thumbnail, preview, media>: the handles of types 0, 1 and 8."""
    found = attribute_handles(attributes)
    return F.struct(*[F.try_element_at(found, F.lit(k)).alias(n) for k, n in (("0", "thumbnail"), ("1", "preview"), ("8", "media"))])


#: What the text of an account's error says, in this order.
SESSION_GONE, SECOND_FACTOR, BAD_LOGIN = "-15", "-26", "(?i)(-9)|(-16)|invalid credentials"
PASSING = "(?i)(-3)|(-4)|(-18)|(-19)|fetch failed|ECONNRESET|ECONNREFUSED|ETIMEDOUT|EAI_AGAIN|socket hang up|network|temporarily unavailable|aborted|timeout|server returned error|too busy"


def error_kind(text: Column, login: Column) -> Column:
    """session-expired, mfa, auth, transient or unknown. login: whether it came from logging in, where what is not known is the account's fault."""
    return (
        F.when(text.contains(SESSION_GONE), "session-expired")
        .when(text.contains(SECOND_FACTOR), "mfa")
        .when(login & text.rlike(BAD_LOGIN), "auth")
        .when(text.rlike(PASSING), "transient")
        .otherwise(F.when(login, "auth").otherwise("unknown"))
    )


#: Media types by extension; these are the extensions of video files.
MIME = {
    "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "mkv": "video/x-matroska", "webm": "video/webm", "avi": "video/x-msvideo", "mpg": "video/mpeg", "mpeg": "video/mpeg",
    "wmv": "video/x-ms-wmv", "flv": "video/x-flv", "ts": "video/mp2t", "3gp": "video/3gpp", "3g2": "video/3gpp2",
}


def mime_of(name: Column) -> Column:
    """Media type by extension; null for another."""
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.try_element_at(table, extension(name))
