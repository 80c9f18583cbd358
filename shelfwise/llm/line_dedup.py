"""Reversible line dedup: sharded cuckoo filters over an exact reference-count table.

State, all of it tables in the shared folder, each row under a shard that a digest of its key picks:

* postings   (shard, key, doc_id, change): which document holds which line, once each; change is 1, or -1 once deleted;
* references (shard, key, refs, first_doc, last_doc, version): the exact count of documents and the smallest of them;
* filters    (shard, cells, version): a cuckoo filter of the keys that at least two documents hold;
* documents  (shard, doc_id, version, alive): under a shard of the document.

Every change appends small tables and rewrites nothing: of references, filters and documents the highest version
counts. A change reads only the shards that it touches (tables are sorted by shard, so the rest of a file is
skipped), and after COMPACT changes the tables are written anew as one.

Inserting documents adds postings and raises counts; a key whose count reaches two enters its filter.
Deleting documents adds postings that cancel theirs; a key that falls below two leaves the filter (which a
Bloom filter could not do), and the smallest document is found again from the postings that remain,
so a deletion brings back exactly the lines that would have stayed without those documents.
Applying the state asks the filters first: only lines they may know go on to the exact table.

Keys are 128-bit digests. A hot line costs one row of references; its shard's postings are dealt to as many copies
of the filter as their number asks for, and the join with the exact table is one that Spark splits by itself.
Texts are read whole; a very long line is one digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import give_back, written

WHITE = b" \t\n\x0b\x0c\r"
#: Keys that one shard's filter is meant for, postings that meet one copy of it, changes until the tables are written as one.
SHARD_KEYS, PROBE_ROWS, COMPACT = 100_000, 1_000_000, 8
#: Touched shards up to which a change names them to the readers of the tables; beyond it whole tables are read.
NAMED = 20_000
SLOTS = 4


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """One digest for each line of the text; None where the key is shorter than min_chars code points."""
    keys: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):  # bytes.lower() is A-Z only
        key = line.strip(WHITE)
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)
        keys.append(xxhash.xxh3_128_digest(key) if long else None)
    return keys


# ---------------------------------------------------------------------------------------------- filter


def _places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and 16-bit fingerprint (never 0) of digests given as rows of two uint64."""
    fingers = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
    return (keys[:, 0] & np.uint64(buckets - 1)).astype(np.int64), np.where(fingers == 0, 1, fingers).astype(np.uint16)


def _other(bucket: np.ndarray, finger: np.ndarray, buckets: int) -> np.ndarray:
    return bucket ^ ((finger.astype(np.int64) * 0x5BD1E995 >> 5) & (buckets - 1))


def _digests(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)


class CuckooFilter:
    """cells[bucket, slot]: 16-bit fingerprints, 0 where free. A key lies in one of two buckets."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) / (0.8 * SLOTS)))))
        while True:
            made = cls(np.zeros((buckets, SLOTS), dtype=np.uint16))
            if made.insert(keys):
                return made
            buckets *= 2

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy())

    def data(self) -> bytes:
        return self.cells.astype("<u2").tobytes()

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """All keys at once: each round fills free slots, the rest evict one fingerprint a bucket and move on. False: too full."""
        cells, buckets, rng = self.cells, len(self.cells), np.random.default_rng(7)
        at, finger = _places(keys, buckets)
        for turn in range(rounds):
            if not len(at):
                return True
            order = np.argsort(at, kind="stable")
            at, finger = at[order], finger[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            taken = cells[at] != 0
            fits = rank < SLOTS - taken.sum(1)
            slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            cells[at[fits], slot[fits]] = finger[fits]
            at, finger = at[~fits], finger[~fits]
            if turn and len(at):
                bucket, first = np.unique(at, return_index=True)
                victim = rng.integers(0, SLOTS, len(bucket))
                evicted = cells[bucket, victim].copy()
                cells[bucket, victim] = finger[first]
                finger[first] = evicted
            at = _other(at, finger, buckets)
        return not len(at)

    def delete(self, keys: np.ndarray) -> None:
        """Only of keys that were inserted, as the exact table knows. All keys at once: each takes one equal cell of its first bucket, what finds none one of its second."""
        at, finger = _places(keys, len(self.cells))
        for _ in range(2):
            order = np.lexsort((finger, at))
            at, finger = at[order], finger[order]
            place = at * 65536 + finger
            rank = np.arange(len(at)) - np.searchsorted(place, place)
            equal = self.cells[at] == finger[:, None]
            here = rank < equal.sum(1)
            slot = np.argsort(~equal, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            self.cells[at[here], slot[here]] = 0
            at, finger = at[~here], finger[~here]
            at = _other(at, finger, len(self.cells))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, finger = _places(keys, len(self.cells))
        return ((self.cells[at] == finger[:, None]) | (self.cells[_other(at, finger, len(self.cells))] == finger[:, None])).any(1)


# ----------------------------------------------------------------------------------------------- state


def postings_of(docs: DataFrame, shards: int, min_chars: int = 10) -> DataFrame:
    """(shard, key, doc_id), each line key once a row. Rows without doc_id have none."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                yield some(batch.slice(start, 500))
        give_back()

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = [], []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            own = {k for k in line_keys(text.as_py(), min_chars) if k}
            ids += [doc] * len(own)
            keys += own
        shard = (_digests(keys)[:, 1] % np.uint64(shards)).astype(np.int32) if keys else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["shard", "key", "doc_id"])

    narrow = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(emit, "shard int, key binary, doc_id long")


def _references(postings: DataFrame) -> DataFrame:
    return postings.groupBy("shard", "key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def _repeated(references: DataFrame) -> DataFrame:
    """Keys that two documents hold at least; rows of one doc_id are one document."""
    return references.where("first_doc <> last_doc")


def _filters(references: DataFrame) -> DataFrame:
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "cells": [CuckooFilter.of(_digests(rows["key"])).data()]})

    return _repeated(references).select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, cells binary")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written so that a reader of some shards skips the rest."""
    return written(df.sortWithinPartitions("shard"), name)


def _union(tables: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _latest(tables: tuple[DataFrame, ...], *keys: str) -> DataFrame:
    """The rows of the highest version of each key."""
    if len(tables) == 1:
        return tables[0].drop("version")
    rest = [c for c in tables[0].columns if c not in (*keys, "version")]
    newest = _union(tables).groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("x"))
    return newest.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def _touched(change: DataFrame):
    """A condition on shard that holds for all shards of the change, read from its own small table."""
    shards = [r[0] for r in change.select("shard").distinct().limit(NAMED + 1).collect()]
    return F.col("shard").isin(shards) if len(shards) <= NAMED else F.lit(True)


@dataclass(frozen=True)
class LineDedup:
    """The state after some insertions and deletions; every change gives a new one and leaves the old one whole."""

    shards: int
    min_chars: int
    tables: dict[str, tuple[DataFrame, ...]]
    version: int = 0

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = 10, shards: int | None = None) -> LineDedup:
        """The state that holds docs. shards: so many that a shard has about SHARD_KEYS keys (a document is taken for 16 lines)."""
        shards = shards or max(64, 16 * docs.count() // SHARD_KEYS)
        empty = cls(shards, min_chars, {})
        postings = _kept(postings_of(docs, shards, min_chars).withColumn("change", F.lit(1)), "line-postings")
        references = _kept(_references(postings), "line-references")
        return replace(empty, tables={
            "postings": (postings,),
            "references": (references.withColumn("version", F.lit(0)),),
            "filters": (_kept(_filters(references), "line-filters").withColumn("version", F.lit(0)),),
            "documents": (empty._documents(docs, True),),
        })

    @property
    def postings(self) -> DataFrame:
        """(shard, key, doc_id) of the documents that the state holds."""
        if len(self.tables["postings"]) == 1:
            return self.tables["postings"][0].drop("change")
        return _union(self.tables["postings"]).groupBy("shard", "key", "doc_id").agg(F.sum("change").alias("change")).where("change > 0").drop("change")

    @property
    def references(self) -> DataFrame:
        """(shard, key, refs, first_doc, last_doc)."""
        return _latest(self.tables["references"], "shard", "key").where("refs > 0")

    @property
    def filters(self) -> DataFrame:
        """(shard, cells)."""
        return _latest(self.tables["filters"], "shard")

    def _documents(self, docs: DataFrame, alive: bool) -> DataFrame:
        """Rows of the table of documents. Only a later change asks for them, so the first ones are not written before."""
        ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        return ids.select(F.expr(f"cast(pmod(xxhash64(doc_id), {self.shards}) as int)").alias("shard"), "doc_id", F.lit(alive).alias("alive"), F.lit(self.version).alias("version"))

    def _held(self, ids: DataFrame) -> DataFrame:
        """Those of the documents in ids (rows of the table of documents) that the state holds."""
        here = _touched(ids)
        known = _latest(tuple(t.where(here) for t in self.tables["documents"]), "shard", "doc_id").where("alive").select("shard", "doc_id")
        return ids.select("shard", "doc_id").join(known, ["shard", "doc_id"], "left_semi")

    def insert(self, docs: DataFrame) -> LineDedup:
        """Documents whose doc_id the state has already are left out."""
        state = replace(self, version=self.version + 1)
        ids = _kept(state._documents(docs, True), "line-ids")
        new = _kept(ids.join(self._held(ids), ["shard", "doc_id"], "left_anti").select(*ids.columns), "line-documents")
        added = postings_of(docs.join(new.select("doc_id"), "doc_id", "left_semi"), self.shards, self.min_chars)
        added = _kept(added.withColumn("change", F.lit(1)), "line-postings")
        return state._changed(added, new)

    def delete(self, doc_ids: DataFrame) -> LineDedup:
        """doc_ids: a table with doc_id. Unknown ones change nothing. Where documents are known by their ids alone, finding their lines reads all postings once."""
        state = replace(self, version=self.version + 1)
        ids = _kept(state._documents(doc_ids, False), "line-ids")
        gone = _kept(ids.join(self._held(ids), ["shard", "doc_id"], "left_semi").select(*ids.columns), "line-documents")
        lost = self.postings.join(gone.select("doc_id"), "doc_id", "left_semi").select("shard", "key", "doc_id")
        return state._changed(_kept(lost.withColumn("change", F.lit(-1)), "line-postings"), gone)

    def _changed(self, change: DataFrame, documents: DataFrame) -> LineDedup:
        """Append the change, count its keys anew, and move what crossed two documents in or out of the filters of its shards."""
        here, keys = _touched(change), change.select("shard", "key").distinct()
        tables = self.tables | {"postings": (*self.tables["postings"], change), "documents": (*self.tables["documents"], documents)}
        grown = replace(self, tables=tables | {"postings": tuple(t.where(here) for t in tables["postings"])})
        old = _latest(tuple(t.where(here) for t in self.tables["references"]), "shard", "key").join(keys, ["shard", "key"], "left_semi")
        counted = _references(grown.postings.join(keys, ["shard", "key"], "left_semi"))
        none = keys.join(counted, ["shard", "key"], "left_anti").select("shard", "key", F.lit(0).cast("long").alias("refs"), F.lit(None).cast("long").alias("first_doc"), F.lit(None).cast("long").alias("last_doc"))
        new = _kept(counted.unionByName(none), "line-references")
        was, now = (_repeated(r).select("shard", "key") for r in (old, new))
        moves = now.join(was, ["shard", "key"], "left_anti").withColumn("into", F.lit(True)).unionByName(was.join(now, ["shard", "key"], "left_anti").withColumn("into", F.lit(False)))
        moves = _kept(moves, "line-moves")

        def move(key: tuple, filters: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            into, out = (_digests(moved["key"][moved["into"] == w]) for w in (True, False))
            cells = CuckooFilter.read(filters["cells"].iloc[0]) if len(filters) else CuckooFilter.of(into)
            if len(filters):
                cells.delete(out)
                if not cells.insert(into):
                    return pd.DataFrame({"shard": [key[0]], "cells": [None]})
            return pd.DataFrame({"shard": [key[0]], "cells": [cells.data()]})

        moving = _touched(moves)
        before = _latest(tuple(t.where(moving) for t in self.tables["filters"]), "shard").join(moves.select("shard").distinct(), "shard", "left_semi")
        filters = _kept(before.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(move, "shard int, cells binary"), "line-filters")
        tables |= {"references": (*self.tables["references"], new.withColumn("version", F.lit(self.version)))}
        full = filters.where("cells is null").select("shard")  # a filter that overflowed is made again, larger
        if full.limit(1).count():
            current = _latest(tuple(t.where(moving) for t in tables["references"]), "shard", "key").join(full, "shard", "left_semi")
            filters = _kept(filters.where("cells is not null").unionByName(_filters(current)), "line-filters")
        tables |= {"filters": (*self.tables["filters"], filters.withColumn("version", F.lit(self.version)))}
        state = replace(self, tables=tables)
        return state.compacted() if len(tables["postings"]) > COMPACT else state

    def compacted(self) -> LineDedup:
        """The same state in one table of each kind."""
        version = F.lit(self.version)
        documents = _latest(self.tables["documents"], "shard", "doc_id").where("alive")
        return replace(self, tables={
            "postings": (_kept(self.postings.withColumn("change", F.lit(1)), "line-postings"),),
            "references": (_kept(self.references, "line-references").withColumn("version", version),),
            "filters": (_kept(self.filters, "line-filters").withColumn("version", version),),
            "documents": (_kept(documents, "line-documents").withColumn("version", version),),
        })

    def suspects(self, postings: DataFrame) -> DataFrame:
        """The postings whose key its shard's filter may hold: all repeated ones, and about one in 8,000 others."""
        large = self.references.groupBy("shard").agg(F.sum("refs").alias("n")).where(f"n > {PROBE_ROWS}").select("shard", F.expr(f"cast(ceil(n / {PROBE_ROWS}) as int)").alias("salts"))
        large = written(large, "line-large")  # one row for each shard of more than PROBE_ROWS postings
        salts = F.coalesce("salts", F.lit(1))
        lists = self.filters.join(large, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "cells", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
        asked = postings.join(large, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("cells"), "key", "doc_id")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, salt, cells = None, None, None
            for batch in batches:
                kinds = batch["kind"].to_numpy()
                cuts = [*np.flatnonzero(kinds == 0), len(kinds)]
                for start, end in zip([0, *cuts], cuts, strict=False):
                    if start < end and kinds[start] == 0:
                        shard, salt, cells = batch["shard"][start].as_py(), batch["salt"][start].as_py(), CuckooFilter.read(batch["cells"][start].as_py())
                        start += 1
                    if start >= end or cells is None:
                        continue
                    part = batch.slice(start, end - start)
                    shards, keys, docs = part["shard"].to_numpy(), part["key"].to_pylist(), part["doc_id"].to_numpy()
                    here = (shards == shard) & (part["salt"].to_numpy() == salt)
                    known = np.flatnonzero(here & cells.contains(_digests(keys)))
                    yield pa.RecordBatch.from_arrays([pa.array(shards[known]), pa.array([keys[i] for i in known], pa.binary()), pa.array(docs[known])], ["shard", "key", "doc_id"])

        both = lists.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        return both.mapInArrow(probe, "shard int, key binary, doc_id long")

    def apply(self, docs: DataFrame, postings: DataFrame | None = None) -> DataFrame:
        """docs with the dropped lines taken out of text, and the columns n_lines and n_dropped (columns of those names are replaced).

        A null text counts as one empty line and stays null. A row without doc_id keeps all lines.
        postings: of docs, if they are there already.
        """
        postings = postings_of(docs, self.shards, self.min_chars) if postings is None else postings
        holders = _repeated(self.references).select("shard", "key", "first_doc")
        drops = self.suspects(postings).join(holders, ["shard", "key"]).where("doc_id <> first_doc")
        drops = drops.groupBy("doc_id").agg(F.collect_set("key").alias("__drop"))
        rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
        joined = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(drops, "doc_id", "left")
        min_chars = self.min_chars

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    yield cut_some(batch.slice(start, 1000))
            give_back()

        def cut_some(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Only texts that lose lines become Python strings."""
            text, drop = batch["text"], batch["__drop"]
            lines = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 1).cast(pa.int64())
            touched = pc.is_valid(drop)
            stay, lost = [], np.zeros(batch.num_rows, np.int64)
            for i in np.flatnonzero(touched.to_numpy(zero_copy_only=False)):
                one, gone = text[i].as_py(), set(drop[i].as_py())
                left = [line for line, key in zip(one.split("\n"), line_keys(one, min_chars), strict=True) if key not in gone]
                stay.append("\n".join(left))
                lost[i] = lines[i].as_py() - len(left)
            text = pc.replace_with_mask(text, touched, pa.array(stay, pa.string())) if stay else text
            return pa.RecordBatch.from_arrays([batch["doc_id"], text, *(batch[c] for c in rest), lines, pa.array(lost)], ["doc_id", "text", *rest, "n_lines", "n_dropped"])

        schema = joined.select("doc_id", "text", *rest).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
        return joined.select("doc_id", "text", *rest, "__drop").mapInArrow(cut, schema)
