"""Benchmark decontamination by templates.

Words are canonicalised to template tokens: a number with the unit behind it, and a run of names (capitalised words inside a
sentence, with one that begins it before them), are one typed placeholder each, however many words they have; other
words stand for themselves. Units are a list and what the benchmark itself puts behind its numbers; numbers may be written as words.
Windows of WINDOW tokens of the benchmark items are hash-joined with those of the documents, so a question asked again with other
numbers, names or units still meets its item. Windows of the words themselves, in lower case, are joined
beside them: a verbatim copy is found whatever its words are and wherever its capitals stand. Of each pair the matched windows
of words, and those of tokens, are put into runs with one shift between item and document. A run of tokens counts only as far as its
slots are consistent: one value of the item always stands for one value of the document.

A document is contaminated by an item if consistent runs cover MIN_COVER of the item's words, or one of
them is MIN_RUN words long. An item shorter than a window is one window as long as itself; one of fewer than
LEAST words says too little: it contaminates nothing, and undecidable() names it. Tokens of an item count from LEAST on, too.

Words are runs of letters, of scripts without spaces single characters. Where every noun has a capital letter
all nouns count as names; then a template says little, and windows of the words themselves find the copies.
Texts and items are read whole, however long they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import give_back, numbered, written
from shelfwise.llm.shingles import mix

WINDOW, MIN_RUN, MIN_COVER, LITERAL, LEAST = 8, 13, 0.5, 4, 4
#: Windows of the benchmark up to which their hashes go to every worker (8 bytes each); beyond it all windows are shuffled.
INDEX_WINDOWS = 4_000_000
UNITS = frozenset("mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles g mg kg t ton tons lb lbs oz pound pounds ounce ounces ml cl dl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp kmh mph hz khz mhz ghz kb mb gb tb w kw kwh v a k c f degree degrees".split())
#: Numbers as words (fixed values).
COUNTED = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil".split()
)
#: Units that are learned from the benchmark: the most frequent words behind its numbers, this many at most, each in so many items at least.
LEARNED, LEARNED_ITEMS = 5_000, 2
NUMBER, NAME = (xxhash.xxh3_64_intdigest(f"slot {kind}") for kind in ("number", "name"))
#: Letters of scripts that write no spaces between words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Words, and the marks that end a sentence.
TOKEN = re.compile(rf"\d+(?:[.,:/]\d+)*|[^\W\d_{UNSPACED}]+|[{UNSPACED}]|[.!?\n。！？]")
_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_WORDS = np.uint64(0x6C6974657261)


UNSPACED_LETTER = re.compile(f"[{UNSPACED}]")
#: The same where a text has no such letters, which is quicker.
SPACED = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?\n。！？]")


class Kinds(dict):
    """Numbers of tokens; by number a token's literal hash and kind: 0 word, 1 number, 2 maybe a name, 3 maybe a unit, 4 mark. units: the words that are one behind a number."""

    def __init__(self, units: frozenset[str] = UNITS):
        super().__init__()
        self.units = units
        self.literal, self.kind = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int8)

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        if number == len(self.literal):
            self.literal, self.kind = np.concatenate([self.literal] * 2), np.concatenate([self.kind] * 2)
        if token in ".!?\n。！？":
            self.literal[number], self.kind[number] = 0, 4
        else:
            low = token.lower()
            self.literal[number] = xxhash.xxh3_64_intdigest(low)
            self.kind[number] = 1 if token[0].isdigit() or low in COUNTED else 2 if token[0].isupper() and token[1:].islower() else 3 if low in self.units else 0
        return number

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > 300_000:
            self.clear()
        tokens = (TOKEN if not text.isascii() and UNSPACED_LETTER.search(text) else SPACED).findall(text)
        numbers = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.literal[numbers], self.kind[numbers]


class Words(NamedTuple):
    """A text's words, by hash, the token of each and whether that is a slot; and its template tokens: each one's value (the hash of a
    name's words, of a number, of a word), its unit (0: none), what stands for it in a window, its first word."""

    literal: np.ndarray
    token: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    unit: np.ndarray
    template: np.ndarray
    start: np.ndarray


def templates(text: str | None, kinds: Kinds) -> Words:
    literal, kind = kinds.of(text or "")
    if not len(literal):
        none = np.empty(0, np.int64)
        return Words(literal, none, none.astype(bool), literal, literal, literal, none)
    before = np.empty_like(kind)
    before[0], before[1:] = 4, kind[:-1]
    capital = kind == 2
    name = capital & (before != 4)
    name[:-1] |= capital[:-1] & capital[1:]
    unit = (kind == 3) & (before == 1)
    goes_on = unit.copy()  # of the token before; marks are no names, so they part runs
    goes_on[1:] |= name[1:] & name[:-1]
    word = kind != 4
    literal, name, number, unit, goes_on = literal[word], name[word], kind[word] == 1, unit[word], goes_on[word]
    start = np.flatnonzero(~goes_on)
    token = np.cumsum(~goes_on) - 1
    value, units = literal[start], np.zeros(len(start), np.uint64)
    template = np.where(name[start], np.uint64(NAME), np.where(number[start], np.uint64(NUMBER), value))
    if len(more := np.flatnonzero(goes_on)):
        own, is_unit = token[more], unit[more]
        units[own[is_unit]] = literal[more[is_unit]]
        more, own = more[~is_unit], own[~is_unit]
        np.add.at(value, own, mix(literal[more] + (more - start[own]).astype(np.uint64)))
    return Words(literal, token, name | number | unit, value, units, template, start)


class Index:
    """Sorted hashes, behind a table of bits that most others fail."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = min(26, max(16, (16 * len(known)).bit_length()))
        self.shift, self.marks = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.marks[known.view(np.uint64) >> self.shift] = True

    def hits(self, own: np.ndarray) -> np.ndarray:
        """Places of own that are among the hashes."""
        maybe = np.flatnonzero(self.marks[own.view(np.uint64) >> self.shift])
        if not len(self.known):
            return maybe[:0]
        at = np.searchsorted(self.known, own[maybe])
        return maybe[self.known[np.minimum(at, len(self.known) - 1)] == own[maybe]]


def windows(own: Words, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(width, word places, token places, hashes) of all windows of words, and of those of tokens that have a slot and are not mostly
    slots. A window of words without slots is one of tokens as well; a place is -1 where it is not one."""
    n, m = len(own.literal), len(own.value)
    slot_words, slots = np.zeros(n + 1, np.int32), np.zeros(m + 1, np.int32)
    np.cumsum(own.slot, out=slot_words[1:])
    np.cumsum(own.slot[own.start], out=slots[1:])
    total, masked = np.zeros(n, np.uint64), np.zeros(m, np.uint64)
    for width in range(1, max(widths, default=0) + 1):
        n, m = n - (width > 1), max(0, m - (width > 1))
        if n <= 0:
            return
        total = total[:n] + own.literal[width - 1 :] * _STEPS[width - 1]
        masked = masked[:m] + own.template[width - 1 : width - 1 + m] * _STEPS[width - 1]
        if width in widths:
            among = slots[width : width + m] - slots[:m]
            some = np.flatnonzero((among > 0) & (width - among >= min(LITERAL, max(1, width // 2))))
            free = slot_words[width : width + n] == slot_words[:n]
            hashes = np.concatenate([mix(total + _WORDS + np.uint64(width)), mix(masked[some] + np.uint64(width))])
            yield width, np.concatenate([np.arange(n), np.full(len(some), -1)]), np.concatenate([np.where(free, own.token[:n], -1), some]), hashes.view(np.int64)


def _values(literal: np.ndarray) -> list[int]:
    return literal.view(np.int64).tolist()


def _units(benchmark: DataFrame) -> frozenset[str]:
    """UNITS and the learned ones; a list of fixed length at most."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[str] = []
            for text in batch["text"]:
                tokens = TOKEN.findall(text or "")
                out += {b.lower() for a, b in pairwise(tokens) if (a[0].isdigit() or a.lower() in COUNTED) and b[0].isalpha() and b.lower() not in COUNTED}
            yield pd.DataFrame({"word": pd.Series(out, dtype=object)})

    counts = benchmark.where("item_id is not null").select("text").mapInPandas(read, "word string").groupBy("word").agg(F.count("*").alias("n"))
    return UNITS | {r["word"] for r in counts.where(F.col("n") >= LEARNED_ITEMS).orderBy(F.desc("n"), "word").limit(LEARNED).collect()}


def _items(benchmark: DataFrame, units: frozenset[str] = UNITS) -> DataFrame:
    """item_id and the words and tokens of each row of the benchmark that has an item_id."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = Kinds(units)
        for batch in batches:
            found = [templates(t, kinds) for t in batch["text"]]
            yield pd.DataFrame({"item_id": batch["item_id"], **{f"item_{c}": [_values(getattr(w, c)) for w in found] for c in ("literal", "value", "unit", "template")}, "item_start": [w.start.tolist() for w in found], "item_slot": [w.slot[w.start].tolist() for w in found]})

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), "text")
    return rows.mapInPandas(read, "item_id long, item_literal array<long>, item_value array<long>, item_unit array<long>, item_template array<long>, item_start array<int>, item_slot array<boolean>")


def undecidable(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of the items that are too short to contaminate anything."""
    return _items(benchmark).select("item_id", F.size("item_literal").alias("words")).where(F.col("words") < LEAST)


def _item_windows(items: DataFrame) -> DataFrame:
    """window, item_id, word_at, token_at (-1: none), words (of the item), width."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, literal, value, unit, template, start, slot in zip(*[batch[c] for c in ("item_id", "item_literal", "item_value", "item_unit", "item_template", "item_start", "item_slot")], strict=True):
                literal, value, unit, template = (np.array(x, np.int64).view(np.uint64) for x in (literal, value, unit, template))
                start = np.array(start, np.int64)
                spans = np.diff(np.append(start, len(literal)))
                own = Words(literal, np.repeat(np.arange(len(value)), spans), np.repeat(np.array(slot, bool), spans), value, unit, template, start)
                by_words, by_tokens = min(WINDOW, len(literal)), min(WINDOW, len(value)) if len(value) >= LEAST else 0
                for width, words, tokens, hashes in windows(own, sorted({by_words, by_tokens} - {0})):
                    words = words if width == by_words else np.full(len(words), -1)
                    tokens = tokens if width == by_tokens else np.full(len(tokens), -1)
                    out += [(window, item, w, t, len(literal), width) for window, w, t in zip(hashes.tolist(), words.tolist(), tokens.tolist(), strict=True) if w >= 0 or t >= 0]
            yield pd.DataFrame(out, columns=["window", "item_id", "word_at", "token_at", "words", "width"])

    return items.mapInPandas(read, "window long, item_id long, word_at int, token_at int, words int, width int")


def _runs(found: list, width: int, values: list[int] = (), units: list[int] = (), slots: list[bool] = ()) -> Iterator[list[int]]:
    """Runs of neighbouring places of an item that windows of some width cover; of tokens, a slot whose value or unit clashes with those before it in its run begins a new one."""
    here = {w["at"] + i: (w["values"][i], w["values"][width + i] if len(w["values"]) > width else 0) for w in found for i in range(width)}
    run: list[int] = []
    there: dict[tuple[int, int], int] = {}
    for at in sorted(here):
        ties = []
        if len(slots) and slots[at]:
            a, b = (values[at], units[at]), here[at]
            ties = [((kind, side), x, y) for kind in (0, 1) if a[kind] and b[kind] for side, x, y in ((0, a[kind], b[kind]), (1, b[kind], a[kind]))]
        if run and (at != run[-1] + 1 or any(there.get((*key, x), y) != y for key, x, y in ties)):
            yield run
            run, there = [], {}
        there |= {(*key, x): y for key, x, y in ties}
        run.append(at)
    if run:
        yield run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, longest, words): pairs of a document and an item that it holds, each once.

    covered: words of the item that consistent runs cover; longest: words of the longest run; words: of the item.
    Null texts have no words; rows without doc_id or item_id are left out. Documents that repeat a doc_id count together.
    Items of fewer than LEAST words and an empty benchmark find nothing.
    """
    units = _units(benchmark)
    items = written(_items(benchmark, units).where(F.size("item_literal") >= LEAST), "benchmark-items")
    found = written(_item_windows(items), "benchmark-windows")
    n = found.count()
    widths = sorted(r[0] for r in found.select("width").distinct().collect())  # at most WINDOW of them
    index = None
    if n <= INDEX_WINDOWS:
        hashes = found.select("window").distinct().toArrow()["window"].to_numpy()
        index = docs.sparkSession.sparkContext.broadcast(np.sort(hashes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(units)
        known = Index(index.value) if index is not None else None
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "window": [], "word": [], "token": [], "values": []}
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = templates(text, kinds)
                for width, words, tokens, hashes in windows(own, widths):
                    hit = np.arange(len(hashes)) if known is None else known.hits(hashes)
                    for i in hit.tolist():
                        word, token = int(words[i]), int(tokens[i])
                        out["doc_id"].append(doc)
                        out["window"].append(int(hashes[i]))
                        out["word"].append(word)
                        out["token"].append(token)
                        out["values"].append(_values(own.literal[word : word + width] if word >= 0 else np.concatenate([own.value[token : token + width], own.unit[token : token + width]])))
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["window"], pa.int64()), pa.array(out["word"], pa.int32()), pa.array(out["token"], pa.int32()), pa.array(out["values"], pa.list_(pa.int64()))], list(out))
        kinds.clear()
        give_back()

    narrow = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    hits = narrow.mapInArrow(read, "doc_id long, window long, word int, token int, values array<long>").join(found, "window")
    # Runs of words and of tokens are told apart. A run keeps one shift between document and item; its rows are the matched windows of one pair, at most one per place of the item.
    kind = lambda tokens, place, at: F.when((place >= 0) & (at >= 0), F.struct(F.lit(tokens).alias("tokens"), (place - at).alias("shift"), at.alias("at")))
    both = F.array_compact(F.array(kind(False, F.col("word"), F.col("word_at")), kind(True, F.col("token"), F.col("token_at"))))
    hits = hits.select("doc_id", "item_id", "words", "values", F.inline(both))
    shifts = hits.groupBy("doc_id", "item_id", "tokens", "shift").agg(F.sort_array(F.collect_set(F.struct("at", "values"))).alias("found"), F.max("words").alias("words"))
    pairs = shifts.join(items, "item_id")

    @F.pandas_udf("at array<int>, longest int")
    def consistent(found: pd.Series, tokens: pd.Series, item_literal: pd.Series, item_value: pd.Series, item_unit: pd.Series, item_start: pd.Series, item_slot: pd.Series) -> pd.DataFrame:
        rows = []
        for own, by_tokens, literal, value, unit, start, slot in zip(found, tokens, item_literal, item_value, item_unit, item_start, item_slot, strict=True):
            ends = [*start[1:], len(literal)]
            least = min(WINDOW, len(value if by_tokens else literal))
            kept: list[int] = []
            longest = 0
            for run in _runs(own, least, value, unit, slot) if by_tokens else _runs(own, least):
                words = [w for at in run for w in range(start[at], ends[at])] if by_tokens else run
                longest = max(longest, len(words)) if len(run) >= least else longest
                kept += words if len(run) >= least else []
            rows.append((sorted(set(kept)), longest))
        return pd.DataFrame(rows, columns=["at", "longest"])

    runs = pairs.withColumn("c", consistent("found", "tokens", "item_literal", "item_value", "item_unit", "item_start", "item_slot"))
    whole = runs.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("c.at")))).alias("covered"), F.max("c.longest").alias("longest"), F.max("words").alias("words"))
    return whole.where((F.col("covered") >= MIN_COVER * F.col("words")) | (F.col("longest") >= MIN_RUN)).select("doc_id", "item_id", "covered", "longest", "words")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows. Rows are judged by themselves, those without doc_id or of a repeated one too."""
    rows = numbered(docs, "clean-rows")
    gone = contaminated(rows.select(F.col("__row").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__row")).distinct()
    return rows.join(gone, "__row", "left_anti").select(docs.columns)
