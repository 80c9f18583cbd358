"""Language-model scoring with a hierarchical Pitman-Yor process.

Every word is a context: its restaurant seats the words that follow it (the first word of a text and the end
of one follow the end). All context restaurants share one parent restaurant, whose base is uniform over the
vocabulary and one unknown word. Customers of a context are the training tokens after it; each table of a
context is a customer of the parent.

Seating is sampled by Gibbs, a dish at a time: a sweep takes all n customers of every dish of every restaurant from their tables
and seats them again, whatever n is. Up to SMALL customers the number of tables is drawn from its exact law; above, a seating is
proposed and accepted by Metropolis and Hastings, TRIES times in a sweep, which keeps the exact law as well. Order: the parent is
seated for one table a dish and context; the contexts then make BURN_IN and SAMPLES sweeps under its probabilities; the parent is
seated anew for their last tables and makes as many sweeps. Dishes move side by side, in GROUPS groups by chance: the
dishes of a group see their restaurant's number of tables as the groups before have left it. Discounts are set from the counts of counts,
the strength is STRENGTH. A token's probability is the mean over the sampled seatings, of the contexts and then of
the parent, so that the probabilities after a context add up to one.

How the corpus is gathered: each task turns BLOCK_TOKENS tokens (a block) into its distinct pairs of a context and
a word, with the documents that they stand in, and sends them out by context to parts. A part holds whole
restaurants, so only the parent's totals go around: each part asks the owners of its words, and owners answer. A
message exists only where a block and a part share a pair, so there are never more messages than pairs. Then each
part adds up the logarithms by document. Counts cover all training documents; nothing is capped or left out.

Contexts that would make a part much larger than others are dealt by word to several parts, so that no task holds
all that follows a frequent word. Their numbers of customers and tables are added up across; a part sees the other
parts' tables as they were before its sweeps. Which contexts these are is told by word counts over a 64th of the
texts; that decides only where their pairs go. They are fewer than FREQUENT times the parts.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import give_back, shared_dir, written

#: Tokens of a block, bytes of text for each part, and the share of a part, as its inverse, from which a context is dealt to several.
BLOCK_TOKENS, PART_BYTES, FREQUENT = 1_800_000, 16 << 20, 16
BURN_IN, SAMPLES, STRENGTH = 2, 3, 1.0
#: Customers up to which a dish's law is tabulated, proposals of a sweep above, groups of dishes of a sweep.
SMALL, TRIES, GROUPS = 128, 4, 4
#: Buckets of a table (Spark refuses more than 100,000) and frequent contexts, at most: lists that the driver holds.
MOST_BUCKETS, MOST_HOT = 50_000, 250_000
END = xxhash.xxh3_64_intdigest(b"\x00end")
ROWS = "part int, kind int, source long, data binary, n1 long, n2 long, asked binary"


def _pack(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, protocol=5))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _planes(x: np.ndarray) -> tuple[str, bytes]:
    """Numbers by the significance of their bytes: the high ones are nearly all zero and compress away."""
    x = np.ascontiguousarray(x)
    return x.dtype.str, x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def _from_planes(planes: tuple[str, bytes]) -> np.ndarray:
    kind = np.dtype(planes[0])
    return np.ascontiguousarray(np.frombuffer(planes[1], np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> tuple[str, bytes]:
    """Rising numbers by their differences."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _from_steps(planes: tuple[str, bytes]) -> np.ndarray:
    x = _from_planes(planes)
    return np.cumsum(x, dtype=x.dtype)


def _small(x: np.ndarray) -> tuple[str, bytes]:
    return _planes(x.astype("<u4" if not len(x) or x.max() < 1 << 32 else "<u8"))


def _counts(planes: tuple[str, bytes]) -> np.ndarray:
    return _from_planes(planes).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


# ------------------------------------------------------------------------------------------- seating


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function, for x above 0."""
    shift = np.ones_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift * x, shift)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x - np.log(shift)


def partitions(discount: float, most: int) -> np.ndarray:
    """[n, t]: the logarithm of the weights of all ways to seat n customers at t tables, by the recurrence of generalised Stirling numbers."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0.0
    for n in range(most):
        t = np.arange(1, n + 1)
        table[n + 1, 1 : n + 1] = table[n, 1 : n + 1] + np.log(n - discount * t)
        table[n + 1, 1 : n + 2] = np.logaddexp(table[n + 1, 1 : n + 2], table[n, : n + 1])
    return table


class Seating:
    """Numbers of tables of many dishes, and of those of over SMALL customers when each table was opened: opened[i] is the place, from 1, of
    the customer who opened a table of dish own[i]; tables stand in order of dishes and places. A table's customers after the first are not told apart: the
    law needs only how many there are in all.
    """

    def __init__(self, customers: np.ndarray, discount: float, tables: np.ndarray | None = None, opened: np.ndarray | None = None):
        """customers: two at least. They start at one table of their dish, which the first sweep leaves whatever it is worth, or as they were kept."""
        self.customers, self.discount = customers, discount
        self.tables = np.ones(len(customers), np.int64) if tables is None else tables.copy()
        self.many = np.flatnonzero(customers > SMALL)
        self.opened = np.ones(len(self.many), np.int64) if opened is None else opened
        self.known = partitions(discount, SMALL)
        self.begun = np.full(len(self.many), opened is not None)

    def sweep(self, at: np.ndarray, total: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> None:
        """Seat the customers of every dish anew. at: each dish's restaurant, total: tables of the restaurants (kept up to date), base: the parent's probability of each dish."""
        group = rng.integers(GROUPS, size=len(self.customers))
        place = np.full(len(self.customers), -1)
        place[self.many] = np.arange(len(self.many))
        for g in range(GROUPS):
            own = np.flatnonzero(group == g)
            others = STRENGTH + self.discount * (total[at[own]] - self.tables[own])
            small = self.customers[own] <= SMALL
            before = self.tables[own]
            self.tables[own[small]] = self._drawn(self.customers[own[small]], others[small], base[own[small]], rng)
            if not small.all():
                self._proposed(own[~small], place[own[~small]], others[~small], base[own[~small]], rng)
            np.add.at(total, at[own], self.tables[own] - before)

    def _drawn(self, n: np.ndarray, others: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Numbers of tables by their exact law, the dishes of one n side by side."""
        out = np.ones(len(n), np.int64)
        u = rng.random(len(n))
        for size in np.unique(n).tolist():
            which = np.flatnonzero(n == size)
            for a in range(0, len(which), (1 << 20) // size):
                some = which[a : a + (1 << 20) // size]
                fresh = np.log((others[some, None] + self.discount * np.arange(size)) * base[some, None])
                log = self.known[size, 1 : size + 1] + np.cumsum(fresh, axis=1)
                law = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
                out[some] = 1 + (law < u[some, None] * law[:, -1:]).sum(axis=1)
        return np.minimum(out, n)

    def _proposed(self, dish: np.ndarray, place: np.ndarray, others: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> None:
        """TRIES independent proposals for dishes of many customers, each taken with the chance of Metropolis and Hastings.

        A proposal opens tables at customers j with the survival of _since: about the hazard of the law, in which a new table of the weight w must outweigh the
        seats there are, and be worth its discount to all who come after. The exact chance of a proposal and the law's weight
        of the same history are both closed forms, so their quotient is exact.
        """
        n, d = self.customers[dish].astype(np.float64), self.discount
        first = np.concatenate([[0], np.cumsum(self.tables[self.many])])
        size = self.tables[self.many[place]]
        history = self.opened[np.repeat(first[place], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)].astype(np.float64)
        owner = np.repeat(np.arange(len(dish)), size)
        weight = self._weight(owner, history, size, n, others, base)
        weight[~self.begun[place]] = -np.inf
        self.begun[place] = True
        for _ in range(TRIES):
            new_owner, new_history, new_size = self._history(n, others, base, rng)
            new_weight = self._weight(new_owner, new_history, new_size, n, others, base)
            taken = np.log(rng.random(len(dish))) < new_weight - weight
            keep, take = ~taken[owner], taken[new_owner]
            owner, history = np.concatenate([owner[keep], new_owner[take]]), np.concatenate([history[keep], new_history[take]])
            order = np.lexsort((history, owner))
            owner, history = owner[order], history[order]
            size, weight = np.where(taken, new_size, size), np.where(taken, new_weight, weight)
        rest = ~np.isin(np.repeat(np.arange(len(self.many)), self.tables[self.many]), place)
        every = np.concatenate([np.repeat(np.arange(len(self.many)), self.tables[self.many])[rest], place[owner]])
        places = np.concatenate([self.opened[rest], history.astype(np.int64)])
        self.opened = places[np.lexsort((places, every))]
        self.tables[dish] = size

    def _bent(self, i: np.ndarray, t: np.ndarray | int, w: np.ndarray, n: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shift, power and factor of the hazard after the table t was opened at i: factor x power x (x + shift)^(power - 1)."""
        shift = np.maximum(0.45 * w - self.discount * t - 0.5, 0.5 - i)
        power = np.maximum(self.discount * (1 - base), 0.02)
        return shift, power, w / power / (n + shift) ** power

    def _history(self, n: np.ndarray, others: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(dish, place) of the tables opened, in order, and how many each dish has."""
        left = np.arange(len(n))
        last = np.ones(len(n))
        owners, places = [left], [last]
        t = 1
        while len(left):
            w = (others[left] + self.discount * t) * base[left]
            shift, power, factor = self._bent(last, t, w, n[left], base[left])
            reach = (last + shift) ** power - np.log(rng.random(len(left))) / factor
            on = reach < (n[left] + shift) ** power
            left = left[on]
            last = np.clip(np.ceil(reach[on] ** (1 / power[on]) - shift[on]), last[on] + 1, n[left])
            owners.append(left)
            places.append(last)
            t += 1
        owner, place = np.concatenate(owners), np.concatenate(places)
        order = np.lexsort((place, owner))
        return owner[order], place[order], np.bincount(owner, minlength=len(n))

    def _weight(self, owner: np.ndarray, place: np.ndarray, size: np.ndarray, n: np.ndarray, others: np.ndarray, base: np.ndarray) -> np.ndarray:
        """By dish the logarithm of the law's weight of a history over the chance that it is proposed."""
        d = self.discount
        t = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + 1.0  # tables from this one on
        ends = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.empty(0, bool)
        after = np.where(ends, n[owner] + 1, np.append(place[1:], 0))
        w = (others[owner] + d * t) * base[owner]
        joins = log_gamma(after - 1 - d * t) - log_gamma(place - d * t)
        shift, power, factor = self._bent(place, t, w, n[owner], base[owner])
        step = factor * ((after - 1 + shift) ** power - (place + shift) ** power)  # nobody opens one before
        here = factor * ((after + shift) ** power - (after - 1 + shift) ** power)
        with np.errstate(divide="ignore"):
            chance = np.where(ends, 0.0, np.log(-np.expm1(-here))) - step
        fresh = np.where(ends, 0.0, np.log(w))
        return np.bincount(owner, joins + fresh - chance, len(n))


def discount_of(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


# ------------------------------------------------------------------------------------------ gathering


class Hot:
    """Contexts that several parts share: their hashes in order, and over how many parts each is spread."""

    def __init__(self, shares: dict[int, float], parts: int):
        self.hashes = np.array(sorted(shares), np.uint64)
        self.parts = np.array([min(parts, int(np.ceil(FREQUENT * parts * shares[int(h)]))) for h in self.hashes], np.int64)

    @classmethod
    def of(cls, texts: DataFrame, parts: int) -> Hot:
        """From word counts over a 64th of the texts: those with over 1 / FREQUENT of a part's share of all tokens, the MOST_HOT most frequent ones of them."""
        lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        some = texts.where(F.pmod(F.xxhash64("text"), F.lit(64)) == 0).select(F.split(lower, r"[\x20\x09-\x0D]+").alias("words"))
        counts = written(some.select(F.explode("words").alias("word")).where("word <> ''").groupBy("word").count(), "lm-frequent")
        texts_, words = some.count(), counts.agg(F.sum("count")).first()[0] or 0
        total = max(1, texts_ + words)
        found = counts.where(F.col("count") * FREQUENT * parts > total).orderBy(F.desc("count"), "word").limit(MOST_HOT).collect()
        shares = {xxhash.xxh3_64_intdigest(r["word"].encode("utf-8", "surrogatepass")): r["count"] / total for r in found}
        return cls(shares | ({END: texts_ / total} if texts_ * FREQUENT * parts > total else {}), parts)

    def spread(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), np.int64)
        at = self.at(hashes)
        out[at >= 0] = self.parts[at[at >= 0]]
        return out

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the contexts each hash is; -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


class Shared:
    """Customers and tables, over all parts, of the contexts that several parts share."""

    def __init__(self, hot: Hot, rows: DataFrame, scale: float = 1.0):
        self.customers, self.tables = np.zeros(len(hot.hashes)), np.zeros(len(hot.hashes))
        for r in rows.where("kind = 3").groupBy("source").agg(F.sum("n1").alias("c"), F.sum("n2").alias("t")).collect():  # one row each
            self.customers[r["source"]], self.tables[r["source"]] = r["c"], r["t"] / scale

    def fill(self, hot: np.ndarray, own: np.ndarray, which: str) -> np.ndarray:
        """own numbers of a part's restaurants, with those of the shared ones in their place; hot: which of these each is, or -1."""
        return np.where(hot >= 0, getattr(self, which)[np.maximum(hot, 0)], own) if len(self.customers) else own


class _Block:
    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple[int | None, bool]] = []
        self.n = 0

    def add(self, doc: int | None, text: str | None, trains: bool) -> None:
        ids = self.ids
        words = words_of(text)
        own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
        self.tokens.append(own)
        self.docs.append((doc, trains))
        self.n += len(own) + 1

    def messages(self, parts: int, hot: Hot) -> Iterator[tuple[int, int, bytes]]:
        """(part, 0, pairs of the contexts of that part) and (some part, 1, the documents)."""
        hashes = np.array([*map(xxhash.xxh3_64_intdigest, self.ids), END], np.uint64)
        end = len(hashes) - 1
        self.ids.clear()
        lengths = np.array([len(t) + 1 for t in self.tokens])
        token = np.full(self.n, end, np.int64)
        at = 0
        for own in self.tokens:
            token[at : at + len(own)] = own
            at += len(own) + 1
        self.tokens.clear()
        context = np.concatenate([[end], token[:-1]])  # the token before; the end before the first
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
        rank, by = np.empty(len(hashes), np.int64), np.argsort(hashes)
        rank[by] = np.arange(len(hashes))
        spread = hot.spread(hashes)
        part = (part_of(hashes, parts)[context] + (hashes[token] >> np.uint64(20)).astype(np.int64) % spread[context]) % parts
        key = (part * len(hashes) + rank[context]) * len(hashes) + rank[token]
        del token, context, part
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(first, len(key)))
        u, w = np.divmod(key[first], len(hashes))
        part, u = np.divmod(u, len(hashes))
        del key, order
        trains = np.packbits(np.array([t for _, t in self.docs], bool)).tobytes()
        cuts = np.searchsorted(part, np.arange(parts + 1))
        ends = np.append(first, self.n)
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                own_u, size = np.unique(u[a:b], return_counts=True)
                own_w, index = np.unique(w[a:b], return_inverse=True)
                yield p, 0, _pack(_steps(hashes[by][own_u]), _small(size), _steps(hashes[by][own_w]), _small(index), _small(times[a:b]), _planes(doc[ends[a] : ends[b]]), trains)
        ids = [d for d, _ in self.docs]
        yield -1, 1, _pack(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), lengths)


def _gather(docs: DataFrame, parts: Parts, hot: Hot) -> DataFrame:
    """(part, kind, source: the block, data), see _Block.messages. docs: doc_id, text, trains."""
    most = BLOCK_TOKENS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 24, _Block()

        def sent() -> Iterator[pa.RecordBatch]:
            for part, kind, data in block.messages(parts.n, hot):
                yield pa.RecordBatch.from_pydict({"part": pa.array([parts.label(part if kind == 0 else number % parts.n)], pa.int32()), "kind": pa.array([kind], pa.int32()), "source": pa.array([number], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                for doc, text, trains in zip(*(some[c].to_pylist() for c in ("doc_id", "text", "trains")), strict=True):
                    block.add(doc, text, trains)
                    if block.n >= most:
                        yield from sent()
                        number, block = number + 1, _Block()
        if block.n:
            yield from sent()
        give_back()

    return docs.mapInArrow(read, "part int, kind int, source long, data binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of part, kind, source and data, and maybe n1, n2 and asked."""
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*[(*r, *(0, 0, None)[len(r) - 4 :]) for r in rows], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in ROWS.split(", ")])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(part, its rows as (kind, source, data)) of rows in order of part."""
    part, held = None, []
    for batch in batches:
        for own, kind, source, data in zip(*(batch[c].to_pylist() for c in ("part", "kind", "source", "data")), strict=True):
            if own != part and held:
                yield part, held
                held = []
            part = own
            held.append((kind, source, data))
    if held:
        yield part, held


def _merged(messages: list[tuple[int, bytes]], parts: int, hot: Hot) -> tuple[bytes, bytes, list[tuple[int, bytes]], list[tuple[int, int, int]], int, int]:
    """The part's restaurants and what each block asks of them, the words by owner, customers and tables of shared contexts, and how many pairs were learned once and twice."""
    parts_of = []
    for block, data in messages:
        u, size, w, index, times, doc, trains = _unpack(data)
        parts_of.append((block, _from_steps(u), _counts(size), _from_steps(w), _counts(index), _counts(times), doc, trains))
    messages.clear()
    all_u, all_w = (np.unique(np.concatenate([p[i] for p in parts_of])) for i in (1, 3))
    keys, learned, asks = [], [], []
    for block, u, size, w, index, times, doc, trains in parts_of:
        keys.append(np.repeat(np.searchsorted(all_u, u), size) * len(all_w) + np.searchsorted(all_w, w)[index])
        flags = np.unpackbits(np.frombuffer(trains, np.uint8))[_from_planes(doc)]
        learned.append(np.add.reduceat(flags.astype(np.int64), np.cumsum(times) - times))
        asks.append((block, len(times), _pack(_small(times), doc)))
    parts_of.clear()
    pair, place = np.unique(np.concatenate(keys), return_inverse=True)
    keys.clear()
    count = np.bincount(place, np.concatenate(learned), len(pair)).astype(np.int64)
    u, w = np.divmod(pair, len(all_w))
    asked, at = [], 0
    for block, n, docs in asks:
        asked.append((block, _pack(_steps(place[at : at + n].astype("<u4"))), docs))
        at += n
    sums = np.bincount(w, count, len(all_w)).astype(np.int64), np.bincount(w, count > 0, len(all_w)).astype(np.int64)
    owner = part_of(all_w, parts)
    by = np.lexsort((all_w, owner))
    cuts = np.searchsorted(owner[by], np.arange(parts + 1))
    words = [(q, _pack(_steps(all_w[by[a:b]]), *(_small(s[by[a:b]]) for s in sums))) for q, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
    index = np.empty(len(by), np.int64)  # words in the order in which owners answer
    index[by] = np.arange(len(by))
    model = _pack(_small(np.bincount(u, minlength=len(all_u))), _small(index[w]), _small(count), hot.at(all_u).astype("<i4"))
    which = hot.at(all_u)
    shared = [(int(which[i]), int(c), int(t)) for i, c, t in zip(*(x[which >= 0] for x in (np.arange(len(all_u)), np.bincount(u, count, len(all_u)), np.bincount(u, count > 0, len(all_u)))), strict=True)]
    return model, pickle.dumps(asked, protocol=5), words, shared, int((count == 1).sum()), int((count == 2).sum())


class Parts:
    """How many parts there are, and the number that stands for each in a table: chosen so that a hash partitioning gives every task one part. Beyond MOST_BUCKETS
    parts the numbers are the parts' own, nothing is listed, and a task has several parts, one after the other."""

    def __init__(self, spark, wanted: int):
        self.labels, self.numbers, self.n = None, None, wanted
        if wanted <= MOST_BUCKETS:
            slot = F.pmod(F.hash(F.col("id").cast("int")), F.lit(wanted))
            self.labels = [r["id"] for r in spark.range(64 * wanted).groupBy(slot.alias("slot")).agg(F.min("id").alias("id")).orderBy("slot").collect()]
            self.numbers, self.n = {p: i for i, p in enumerate(self.labels)}, len(self.labels)

    @property
    def buckets(self) -> int:
        return min(self.n, MOST_BUCKETS)

    def label(self, number: int) -> int:
        return number if self.labels is None else self.labels[number]

    def number(self, label: int) -> int:
        return label if self.numbers is None else self.numbers[label]


def _bucketed(df: DataFrame, parts: Parts, name: str) -> DataFrame:
    """Written in buckets of part, so that what meets it by part needs no shuffle of it."""
    spark, table = df.sparkSession, f"lm_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts.buckets, "part").option("compression", "zstd").option("path", f"{shared_dir(spark).rstrip('/')}/shelfwise/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def _restaurants(blocks: DataFrame, parts: Parts, hot: Hot) -> DataFrame:
    """Kind 0: the restaurants of a part; kind 1: documents of a block; kind 2: words of a part for their owner (n1); kind 3: customers and tables here of a shared context."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            for kind, source, data in rows:
                if kind == 1:
                    yield _rows([(part, 1, source, data)])
            messages = [(source, data) for kind, source, data in rows if kind == 0]
            rows.clear()
            if messages:
                model, asked, words, shared, ones, twos = _merged(messages, parts.n, hot)
                yield _rows([(part, 0, parts.number(part), model, ones, twos, asked)])
                for owner, data in words:
                    yield _rows([(part, 2, owner, data, parts.label(owner), 0)])
                for context, customers, tables in shared:
                    yield _rows([(part, 3, context, None, customers, tables)])
        give_back()

    return _bucketed(blocks.repartition(parts.buckets, "part").sortWithinPartitions("part", "source").mapInArrow(read, ROWS), parts, "model")


# ------------------------------------------------------------------------------------------ the parent


class Totals:
    """A few sums over the parent's owners: tokens, words, customers, tables, words of one customer and of two."""

    def __init__(self, root: DataFrame, before: Totals | None = None):
        names = ("tokens", "words", "guests", "tables", "ones", "twos")
        row = root.agg(*[F.sum(n).alias(n) for n in names]).first()
        for n in names:
            setattr(self, n, row[n] or 0)
        self.top = before.top if before else discount_of(self.ones, self.twos)

    def parent(self, guests: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's predictive probability of words with so many customers and tables; of an unknown word with 0 and 0."""
        fresh = (STRENGTH + self.top * self.tables) / (self.words + 1)
        return (guests - self.top * tables + fresh) / (STRENGTH + self.guests)


ROOT = "part int, data binary, tokens long, words long, guests long, tables long, ones long, twos long"


def _root_row(part: int, known: bytes, count: np.ndarray, guests: np.ndarray, tables: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
    numbers = [count.sum(), (guests > 0).sum(), guests.sum(), tables.sum(), (guests == 1).sum(), (guests == 2).sum()]
    data = _pack(known, _small(count), _small(guests), _small(tables), _small(opened))
    columns = [pa.array([part], pa.int32()), pa.array([data], pa.binary()), *(pa.array([int(x)], pa.int64()) for x in numbers)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROOT.split(", ")])


def _root(up: DataFrame, parts: Parts) -> DataFrame:
    """One row per owner of words: which words each part asks for, their training counts and customers, all at one table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            asked = [(source, *map(_from_steps, x[:1]), *map(_counts, x[1:])) for _, source, data in rows for x in [_unpack(data)]]
            rows.clear()
            words = np.unique(np.concatenate([a[1] for a in asked]))
            count, guests = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            known = []
            for source, own, tokens, tables in asked:
                at = np.searchsorted(words, own)
                count[at] += tokens
                guests[at] += tables
                known.append((parts.number(source), _steps(at.astype("<u4"))))
            yield _root_row(part, _pack(known), count, guests, np.minimum(guests, 1), np.ones((guests > SMALL).sum(), np.int64))
        give_back()

    return written(up.mapInArrow(read, ROOT), "lm-root")


def _root_sweep(root: DataFrame, totals: Totals, turn: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["data"].to_pylist(), strict=True):
                known, *planes = _unpack(data)
                count, guests, tables, opened = map(_counts, planes)
                many = guests > 1
                base = np.full(many.sum(), 1 / (totals.words + 1))
                seating = Seating(guests[many], totals.top) if turn == 0 else Seating(guests[many], totals.top, tables[many], opened)
                all_tables = np.array([totals.tables], np.int64)
                seating.sweep(np.zeros(many.sum(), np.int64), all_tables, base, np.random.default_rng([turn, part]))
                tables[many] = seating.tables
                yield _root_row(part, known, count, guests, tables, seating.opened)

    return written(root.mapInArrow(read, ROOT), f"lm-root-{turn}")


def _answers(roots: list[DataFrame], totals: list[Totals], parts: Parts) -> DataFrame:
    """(part, source: the owner, data): the mean probability of each word that a part asks for, and its training count."""
    tagged = [r.select("part", F.lit(i).alias("kind"), F.lit(0).cast("long").alias("source"), "data") for i, r in enumerate(roots)]
    both = tagged[0]
    for more in tagged[1:]:
        both = both.unionByName(more)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            mean = 0.0
            for kind, _, data in rows:
                known, *planes = _unpack(data)
                count, guests, tables, _ = map(_counts, planes)
                mean = mean + totals[kind].parent(guests, tables) / len(totals)
            for asker, places in _unpack(known)[0]:
                at = _from_steps(places).astype(np.int64)
                yield _rows([(parts.label(asker), 0, parts.number(part), _pack(_planes(mean[at].astype("<f4")), _small(count[at]), places))])

    if len(roots) > 1:
        both = both.repartition(parts.buckets, "part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(read, ROWS)


def _met(model: DataFrame, answers: DataFrame, parts: Parts, *more: str) -> DataFrame:
    """One row for each part: data (its restaurants), answers, an array of (kind, source, data), and more of its columns."""
    said = answers.repartition(parts.buckets, "part").groupBy("part").agg(F.collect_list(F.struct("kind", "source", F.col("data").alias("said"))).alias("answers"))
    return model.where("kind = 0").select("part", "data", *more).join(said, "part").select("part", "data", "answers", *more)


def _heard(answers: list[dict]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, tuple, int]]]:
    """Probability and count of the part's words in their order, and the owners with the places of what they know."""
    parts = [(a["source"], *_unpack(a["said"])) for a in sorted(answers, key=lambda a: a["source"]) if a["kind"] == 0]
    base, count = [_from_planes(p[1]).astype(np.float64) for p in parts], [_counts(p[2]) for p in parts]
    return np.concatenate(base), np.concatenate(count), [(p[0], p[3], len(c)) for p, c in zip(parts, count, strict=True)]


# ---------------------------------------------------------------------------------------- the contexts


def seat_contexts(at: np.ndarray, count: np.ndarray, base: np.ndarray, n: int, discount: float, rng: np.random.Generator, of_all=None) -> tuple[np.ndarray, np.ndarray]:
    """(last, mean) numbers of tables of the dishes count of the restaurants at (0 to n - 1), after burn-in over the samples.

    of_all: from the tables here of the restaurants to those over all parts."""
    last = (count > 0).astype(np.int64)
    of_all = of_all or (lambda own: own)
    mean = last.astype(float)
    many = np.flatnonzero(count > 1)
    if len(many):
        seating = Seating(count[many], discount)
        total = np.round(of_all(np.bincount(at, last, n))).astype(np.int64)
        kept = np.zeros(len(many))
        for turn in range(BURN_IN + SAMPLES):
            seating.sweep(at[many], total, base[many], rng)
            if turn >= BURN_IN:
                kept += seating.tables / SAMPLES
        last[many], mean[many] = seating.tables, kept
    return last, mean


def _sampled(model: DataFrame, answers: DataFrame, parts: Parts, discount: float, shared: Shared) -> DataFrame:
    """Kind 1: the mean tables of a part's dishes of two customers at least; kind 2: the last tables by word for their owner; kind 3: mean tables here of a shared context, times SAMPLES."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                *planes, hot = _unpack(row["data"])
                size, word, count = map(_counts, planes)
                base, _, owners = _heard(row["answers"])
                at = np.repeat(np.arange(len(size)), size)
                last, mean = seat_contexts(at, count, base[word], len(size), discount, np.random.default_rng([7, row["part"]]), lambda own, hot=hot: shared.fill(hot, own, "tables"))
                for i, tables in zip(hot[hot >= 0], np.bincount(at, mean, len(size))[hot >= 0], strict=True):
                    yield _rows([(row["part"], 3, int(i), None, 0, int(np.round(tables * SAMPLES)))])
                yield _rows([(row["part"], 1, -1, _pack(_small(np.round(mean[count > 1] * SAMPLES))))])
                tables, start = np.bincount(word, last, len(base)).astype(np.int64), 0
                for owner, places, n in owners:
                    yield _rows([(parts.label(owner), 2, row["part"], _pack(places, _small(tables[start : start + n])))])
                    start += n
        give_back()

    return written(_met(model, answers, parts).mapInArrow(read, ROWS), "lm-sampled")


def _root_again(root: DataFrame, up: DataFrame, parts: Parts) -> DataFrame:
    """The parent's customers after the contexts' sweeps, all at one table."""
    old = root.select("part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("source"), "data")
    both = old.unionByName(up.select("part", "kind", "source", "data")).repartition(parts.buckets, "part").sortWithinPartitions("part", "kind")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            known, count, *_ = _unpack(rows[0][2])
            count = _counts(count)
            guests = np.zeros(len(count), np.int64)
            for _, _, data in rows[1:]:
                places, tables = _unpack(data)
                guests[_from_steps(places).astype(np.int64)] += _counts(tables)
            yield _root_row(part, known, count, guests, np.minimum(guests, 1), np.ones((guests > SMALL).sum(), np.int64))

    return written(both.mapInArrow(read, ROOT), "lm-root-again")


# --------------------------------------------------------------------------------------------- scoring


def predictive(at: np.ndarray, count: np.ndarray, tables: np.ndarray, base: np.ndarray, n: int, discount: float, of_all=None) -> np.ndarray:
    """Probability of each dish in its restaurant, from counts and mean numbers of tables; base: the parent's probability of the dish.

    of_all: from a restaurant's customers or tables here to those over all parts."""
    of_all = of_all or (lambda own, which: own)
    below = STRENGTH + of_all(np.bincount(at, count, n), "customers")
    return (count - discount * tables + (STRENGTH + discount * of_all(np.bincount(at, tables, n), "tables"))[at] * base) / below[at]


def _sums(model: DataFrame, answers: DataFrame, parts: Parts, discount: float, totals: Totals, shared: Shared) -> DataFrame:
    """(source: the block, data): by document the sums over one part's tokens."""
    tokens, words = totals.tokens, totals.words

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                *planes, hot = _unpack(row["data"])
                size, word, count = map(_counts, planes)
                base, seen, _ = _heard(row["answers"])
                at = np.repeat(np.arange(len(size)), size)
                tables = (count > 0).astype(float)
                (kept,) = [a["said"] for a in row["answers"] if a["kind"] == 1]
                tables[count > 1] = _counts(_unpack(kept)[0]) / SAMPLES
                score = np.log10(predictive(at, count, tables, base[word], len(size), discount, lambda own, which, hot=hot: shared.fill(hot, own, which)))
                plain = np.log10((seen + 0.5) / (tokens + 0.5 * (words + 1)))[word]
                known = (seen > 0)[word].astype(np.int64)
                asked = pickle.loads(row["asked"])
                row.clear()
                for block, places, docs in asked:
                    times, doc = _unpack(docs)
                    pair, doc = np.repeat(_from_steps(*_unpack(places)).astype(np.int64), _counts(times)), _from_planes(doc)
                    own, doc = np.unique(doc, return_inverse=True)
                    data = _pack(_steps(own), *(_planes(np.bincount(doc, x[pair], len(own))) for x in (score, plain)), _small(np.bincount(doc, known[pair], len(own))))
                    yield _rows([(0, 2, block, data)])
        give_back()

    return _met(model, answers, parts, "asked").mapInArrow(read, ROWS).select("kind", "source", "data")


OUT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, trains) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs; trains: a boolean column, null counts as false.

    A text is its words and one end; a null or empty one is the end alone. base_score: add-half unigrams.
    score: log10 probability under the sampled model. Without training documents every word is unknown.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(trains, F.lit(False)).alias("trains"))
    bytes_ = marked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = Parts(spark, max(4, -(-bytes_ // PART_BYTES)))
    hot = Hot.of(marked, parts.n)
    model = _restaurants(_gather(marked, parts, hot), parts, hot)
    shared = Shared(hot, model)
    up = model.where("kind = 2").select(F.col("n1").cast("int").alias("part"), F.lit(0).alias("kind"), F.col("part").cast("long").alias("source"), "data")
    root = _root(up.repartition(parts.buckets, "part").sortWithinPartitions("part", "source"), parts)
    totals = Totals(root)
    row = model.where("kind = 0").agg(F.sum("n1"), F.sum("n2")).first()
    discount = discount_of(row[0] or 0, row[1] or 0)
    first = _root_sweep(root, totals, 0)
    totals = Totals(first, totals)
    sampled = _sampled(model, _answers([first], [totals], parts), parts, discount, shared)
    root = _root_again(root, sampled.where("kind = 2"), parts)
    totals = Totals(root)
    roots, kept = [], []
    for turn in range(BURN_IN + SAMPLES):
        root = _root_sweep(root, totals, turn)
        totals = Totals(root, totals)
        if turn >= BURN_IN:
            roots.append(root)
            kept.append(totals)
    answers = _answers(roots, kept, parts).unionByName(sampled.where("kind = 1"))
    seated = Shared(hot, sampled, SAMPLES)
    seated.customers = shared.customers
    sums = _sums(model, answers, parts, discount, totals, seated)
    both = model.where("kind = 1").select("kind", "source", "data").unionByName(sums).select(F.lit(0).alias("part"), "kind", "source", "data")
    return both.repartition("source").sortWithinPartitions("source", "kind").mapInArrow(_documents(totals.tokens), OUT)


def _documents(tokens: int):
    """The rows of each block's documents, whose own row comes first and those of its parts after it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def done() -> pa.RecordBatch:
            ids, null, lengths, known, plain, score = held
            columns = [pa.array(ids, pa.int64(), mask=null), pa.array(lengths.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), tokens, np.int64)), pa.array(plain), pa.array(score)]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

        for batch in batches:
            for kind, data in zip(batch["kind"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if kind == 1:
                    if held:
                        yield done()
                    ids, null, lengths = _unpack(data)
                    held = [ids, null, lengths, np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))]
                else:
                    doc, score, plain, known = _unpack(data)
                    doc = _from_steps(doc)
                    held[3][doc] += _counts(known)
                    held[4][doc] += _from_planes(plain)
                    held[5][doc] += _from_planes(score)
        if held:
            yield done()

    return read
