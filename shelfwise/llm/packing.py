"""Best-fit packing of documents into training sequences, by hierarchical residual packing.

Round 0 packs what each partition holds, best fit in order of falling length, a chunk at a time; the underfull
bins of a chunk are items of the next. Bins that are full or nearly so are final. The underfull bins of a node
go on as items of their filled length to the next round, where FAN_IN nodes meet in one and are packed best-fit
again, up to the root. Only bins travel up the tree, as a number and a length; their pieces are moved once, at the end.

Two bins that are both at most half full never leave a node (one would have gone into the other), so of the bins
that meet in a node at most FAN_IN are at most half full, and every merge needs one of those: there are at most
FAN_IN merges. The fuller bins that they use can always be chosen among the emptiest of each node, which take
whatever any others would. So the KEEP emptiest bins of a node are more than merges can use, the others are final
as well, and no node holds more than FAN_IN * KEEP bins, whatever the lengths are.
"""

from __future__ import annotations

import array
import base64
import itertools
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import written

FAN_IN, KEEP, SLACK = 32, 256, 8
#: Items that are packed at a time in round 0, and chunks of text whose ids a worker remembers.
CHUNK, CACHE = 100_000, 1_000_000
#: The one string that the tokenizer reads as a special token.
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    """Where the public tokenizer's file lies on this machine; SHELFWISE_TOKENIZER names another."""
    if path := os.environ.get("SHELFWISE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Ids of a text as little-endian uint32 bytes, remembered by chunks that begin at a single space.

    A space between two other visible characters always starts a new pre-token, so texts may be cut
    there. Chunks of Latin letters go through the same vocabulary's ranks, which is faster; all else,
    and texts that hold a special token's string, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if os.path.exists(ranks := path.removesuffix(".json") + ".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if self.fast is None or max(chunk, default="") > "ɏ":
            ids = self.slow(chunk)
        else:
            ids = array.array("I", self.fast(chunk)).tobytes()
        if len(self) < CACHE:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.slow(text)
        parts = text.split(" ")
        chunks = [parts[0]]
        for part in parts[1:]:
            if not part or part[0].isspace() or not chunks[-1] or chunks[-1][-1].isspace():
                chunks[-1] += " " + part  # white space beside this space: no cut here
            else:
                chunks.append(" " + part)
        return b"".join(map(self.__getitem__, chunks))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, max_length: int = 1024, end_id: int = 2, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is the ids of its text (null: empty) and end_id; a longer one is cut into pieces of
    max_length, of which the first takes the rest. Rows that repeat a doc_id are documents of their own.
    """
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = own.encode(text or "") + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at) % max_length or max_length
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((doc, piece, at, length, zlib.crc32(part), part))
                    at, piece = at + length, piece + 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in columns[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item its bin and its place there; items are taken from the longest to the shortest."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    room, n = 0, 0  # bit r of room: some open bin has r left
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if fits := room >> size:
            left = size + (fits & -fits).bit_length() - 1
            own = open_bins[left].pop()
            if not open_bins[left]:
                room &= ~(1 << left)
        else:
            own, left, n = n, capacity, n + 1
        bins[i], offsets[i] = own, capacity - left
        if left > size:
            open_bins[left - size].append(own)
            room |= 1 << (left - size)
    return bins, offsets


PACKED = PIECES + ", sequence_id long, offset long, open boolean"
COLUMNS = [c.split()[0] for c in PACKED.split(", ")]
MOVED = "bin long, into long, shift long, fill long, open boolean, node long"


def _underfull(fill: np.ndarray, capacity: int) -> np.ndarray:
    """The bins that go on: those with more than SLACK room, the KEEP emptiest of them."""
    keep = np.zeros(len(fill), bool)
    emptiest = np.argsort(fill, kind="stable")[:KEEP]
    keep[emptiest] = fill[emptiest] < capacity - SLACK
    return keep


def _settle(rows: pa.Table, item: np.ndarray, inside: np.ndarray, capacity: int, first_id: int) -> pa.Table:
    """Pack rows into bins numbered from first_id; rows of one item stay together, each at its place inside."""
    order = np.lexsort((inside, item))
    rows, item, inside = rows.take(pa.array(order)), item[order], inside[order]
    length = rows["length"].to_numpy()
    first = np.concatenate([[True], item[1:] != item[:-1]])
    lengths = np.add.reduceat(length, np.flatnonzero(first))
    bins, offsets = best_fit(lengths, capacity)
    of = np.cumsum(first) - 1
    keep = _underfull(np.bincount(bins, weights=lengths).astype(np.int64), capacity)
    rows = rows.select(COLUMNS[:5])
    for name, values in zip(COLUMNS[5:], (first_id + bins[of], inside + offsets[of], keep[bins[of]]), strict=True):
        rows = rows.append_column(name, pa.array(values))
    return rows


def _merging(capacity: int, depth: int):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        node, rows = key[0].as_py(), rows.sort_by("bin")
        fill = rows["fill"].to_numpy()
        bins, shift = best_fit(fill, capacity)
        filled = np.bincount(bins, weights=fill).astype(np.int64)
        columns = [rows["bin"], pa.array((depth << 58 | node << 36) + bins), pa.array(shift), pa.array(filled[bins]), pa.array(_underfull(filled, capacity)[bins]), pa.array(np.full(len(rows), node))]
        return pa.table(columns, names=[c.split()[0] for c in MOVED.split(", ")])

    return merge


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """items (as pieces() gives them) with sequence_id and offset: sequences without gaps, none longer than capacity.

    items is read once and should be a written table; every round is written too, so a lost executor
    never mixes two packings. An empty table gives an empty result.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 36
        open_rows = None  # pieces of underfull bins, at most KEEP of these

        def settled(held: list[pa.RecordBatch]) -> pa.Table:
            nonlocal next_id
            rows = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            item, inside = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            if open_rows is not None:
                item = np.concatenate([item, open_rows["sequence_id"].to_numpy() + len(rows)])
                inside = np.concatenate([inside, open_rows["offset"].to_numpy()])
                rows = pa.concat_tables([rows, open_rows.select(COLUMNS[:5])])
            done = _settle(rows, item, inside, capacity, next_id)
            next_id = pc.max(done["sequence_id"]).as_py() + 1
            return done

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                done = settled(held)
                open_rows = done.filter(done["open"])
                yield from done.filter(pc.invert(done["open"])).combine_chunks().to_batches()
                held, n = [], 0
        if n:
            yield from settled(held).combine_chunks().to_batches()
        elif open_rows is not None:
            yield from open_rows.combine_chunks().to_batches()

    placed = written(items.select(*[c.split()[0] for c in PIECES.split(", ")]).mapInArrow(local, PACKED), "packed")
    node = F.shiftright("sequence_id", 36).alias("node")
    level = placed.where("open").groupBy(F.col("sequence_id").alias("bin"), node).agg(F.sum("length").alias("fill"))
    moved = None
    for depth in itertools.count(1):
        level = written(level.select("bin", "fill", "node"), "bins")
        if level.select("node").distinct().limit(2).count() < 2:
            break
        up = level.withColumn("node", F.expr(f"node div {FAN_IN}"))
        step = written(up.groupBy("node").applyInArrow(_merging(capacity, depth), MOVED), f"bins-{depth}")
        level = step.where("open").groupBy(F.col("into").alias("bin"), "node").agg(F.max("fill").alias("fill"))
        if moved is None:
            moved = step.select("bin", "into", "shift")
        else:
            further = step.select(F.col("bin").alias("into"), F.col("into").alias("to"), F.col("shift").alias("more"))
            moved = moved.join(further, "into", "left").select("bin", F.coalesce("to", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    if moved is None:
        return placed.drop("open")
    out = placed.join(moved.withColumnRenamed("bin", "sequence_id"), "sequence_id", "left")
    return out.select(*COLUMNS[:5], F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, max_length: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(written(pieces(docs, max_length, end_id, path), "pieces"), max_length)


def sequences(docs: DataFrame, packed: DataFrame, max_length: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves; doc_id must be unique for this."""
    ids = pieces(docs, max_length, end_id, path, with_ids=True).select("doc_id", "piece", "ids")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
