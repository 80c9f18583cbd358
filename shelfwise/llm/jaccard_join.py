"""Self-join on the Jaccard similarity of word 5-grams, by the chosen-path method.

1. Every text becomes the set of its shingles; equal sets are one class of copies with one representative.
2. A set is embedded as COORDS minimum hashes, its sampled tokens. A run starts with all sets in one node
   and splits each node on coordinates that the node's own hash picks: always one, a second one in a
   quarter of the nodes, so that a pair at the threshold shares one child on average and never thins out.
   After DEPTH splits the nodes are buckets. A bucket with over LARGE sets goes on DEPTH splits at a time,
   AGAIN times from the start, where that at least halves the pairs to be compared; all its pairs are compared
   where it does not. A run finds a pair at the threshold with the chance ONE_RUN, which a test measures, and runs are
   independent: they are repeated until the chance of having found it reaches TARGET. A step of a large bucket is
   repeated AGAIN times (it loses 0.2 % of such pairs).
3. Buckets are compared by brute force on one byte of each coordinate, large ones in pairs of parts; pairs
   that may reach the threshold join their sets into candidate groups.
4. Within a group all sets whose sizes allow it are compared exactly, in blocks. Links are counted there and
   never written as pairs: each block gives one row for each of its sets.

Texts without words have no shingles and link to nothing. A null text has no words.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import give_back, numbered, written
from shelfwise.llm.shingles import WordHashes, mix, shingles
from shelfwise.operators import graph

COORDS, DEPTH, LARGE, AGAIN = 128, 3, 4096, 6
#: Recall to be reached for pairs at the threshold, what one run reaches, and the runs that this takes (16).
TARGET, ONE_RUN = 0.9999999, 0.64
RUNS = math.ceil(math.log(1 - TARGET) / math.log(1 - ONE_RUN))
#: Sets of up to SMALL[1] shingles have true minimum hashes, those from SMALL[0] binned ones; pairs of one similarity share a kind.
SMALL = (128, 160)
#: Estimated similarity that makes a candidate: four standard deviations below the threshold.
SLACK = 0.15
BLOCK = 512
#: Sets of a bucket around which the others are gathered before pairs are compared.
STARS = 16
_MULT = mix(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(77))
_EDGES = (np.arange(COORDS, dtype=np.uint64)) << np.uint64(57)


def signature(found: np.ndarray, binned: bool) -> np.ndarray:
    """COORDS values of a sorted set; binned: the least in each of COORDS ranges, an empty one borrows from the next."""
    if not binned:
        return (found[:, None] * _MULT + _ADD).min(axis=0)
    at = np.searchsorted(found, _EDGES)
    ends = np.append(at[1:], len(found))
    filled = np.flatnonzero(at < ends)
    source = filled[np.searchsorted(filled, np.arange(COORDS)) % len(filled)]
    steps = ((source - np.arange(COORDS)) % COORDS).astype(np.uint64)
    return mix(found[at[source]] + steps * np.uint64(0x9E3779B97F4A7C15))


def descend(signatures: np.ndarray, rows: np.ndarray, nodes: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Split nodes depth times; rows says whose signature each node's path follows."""
    for _ in range(depth):
        twice = (mix(nodes ^ np.uint64(0x51)) & np.uint64(3)) == 0
        first = (mix(nodes ^ np.uint64(0x11)) % np.uint64(COORDS)).astype(np.int64)
        second = (mix(nodes ^ np.uint64(0x22)) % np.uint64(COORDS)).astype(np.int64)
        rows = np.concatenate([rows, rows[twice]])
        at = np.concatenate([first, second[twice]])
        nodes = mix(np.concatenate([nodes, nodes[twice] ^ np.uint64(0xABCDEF)]) * np.uint64(0x9E3779B97F4A7C15) + signatures[rows, at] + at.astype(np.uint64))
    return rows, nodes


def of_kind(nodes: np.ndarray, kind: np.ndarray | np.uint64) -> np.ndarray:
    return nodes >> np.uint64(1) << np.uint64(1) | kind


def leaves(signatures: np.ndarray, kind: int) -> list[np.ndarray]:
    """Per row the buckets of all runs; kinds of signatures never share one, and a bucket's last bit is its kind."""
    n = len(signatures)
    rows = np.tile(np.arange(n), RUNS)
    roots = np.repeat(mix(np.arange(1, RUNS + 1, dtype=np.uint64) + np.uint64(1000 * (kind + 1))), n)
    rows, nodes = descend(signatures, rows, roots)
    nodes = of_kind(nodes, np.uint64(kind))
    order = np.argsort(rows, kind="stable")
    return np.split(nodes[order].astype(np.int64), np.searchsorted(rows[order], np.arange(1, n))) if n else []


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, d1 and d2 (digest of the shingle set), size, bytes (a byte of each coordinate, both kinds), leaves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            digests, sizes, low = [], [], [bytearray(2 * COORDS) for _ in ids]
            kinds: list[list[tuple[int, np.ndarray]]] = [[], []]
            for i, (doc, text) in enumerate(zip(ids, batch["text"].to_pylist(), strict=True)):
                found = shingles(words.of(text), width)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes() if len(found) else f"no words {doc}".encode()))
                for kind, has in enumerate((0 < len(found) <= SMALL[1], len(found) >= SMALL[0])):
                    if has:
                        own = signature(found, kind == 1)
                        kinds[kind].append((i, own))
                        low[i][kind * COORDS : (kind + 1) * COORDS] = (own >> np.uint64(40)).astype(np.uint8).tobytes()
            own_leaves: list[list[np.ndarray]] = [[] for _ in ids]
            for kind, rows in enumerate(kinds):
                for start in range(0, len(rows), 1000):
                    part = rows[start : start + 1000]
                    for (i, _), nodes in zip(part, leaves(np.array([s for _, s in part]), kind), strict=True):
                        own_leaves[i].append(nodes)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2) if ids else np.empty((0, 2), np.int64)
            merged = [np.unique(np.concatenate(x)) if x else np.empty(0, np.int64) for x in own_leaves]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(sizes, pa.int32()), pa.array([bytes(x) for x in low], pa.binary()), pa.array(merged, pa.list_(pa.int64()))],
                ["doc_id", "d1", "d2", "size", "bytes", "leaves"],
            )
        words.clear()
        give_back()

    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(read, "doc_id long, d1 long, d2 long, size int, bytes binary, leaves array<long>")


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[dict[str, list | np.ndarray]]:
    """Consecutive rows of equal key as columns: numbers as arrays, the rest as lists. Holds one group and one batch."""
    held: dict[str, list] = {}

    def columns(batch: pa.RecordBatch) -> dict:
        return {n: c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}

    def joined(parts: dict[str, list]) -> dict:
        return {n: np.concatenate(p) if isinstance(p[0], np.ndarray) else [x for y in p for x in y] for n, p in parts.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch)
        cuts = [0, *(np.flatnonzero(np.diff(rows[key])) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            part = {n: c[start:end] for n, c in rows.items()}
            if held and held[key][-1][-1] != part[key][0]:
                yield joined(held)
                held = {}
            for n, c in part.items():
                held.setdefault(n, []).append(c)
    if held:
        yield joined(held)


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n members the least member it is linked to through pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = root[a], root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if (differ := low != high).any():
                np.minimum.at(root, high[differ], low[differ])
                while (root[root] != root).any():
                    root = root[root]
            else:
                break
    while (root[root] != root).any():
        root = root[root]
    return root


def _alike(low: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket that may reach the threshold, some rows at a time; of sets that others already link, not all pairs."""
    n = len(sizes)
    small = sizes <= SMALL[1]

    def near(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        hits = np.zeros((len(rows), len(columns)), np.int16)
        for kind, has in enumerate((small, sizes >= SMALL[0])):
            part = low[:, kind * COORDS : (kind + 1) * COORDS]
            same = (part[rows][:, None, :] == part[columns][None, :, :]).sum(2)
            hits = np.maximum(hits, np.where(has[rows][:, None] & has[columns][None, :], same, 0))
        one, other = sizes[rows][:, None], sizes[columns]
        return (hits >= (threshold - SLACK) * COORDS) & (np.minimum(one, other) >= threshold * np.maximum(one, other))

    star = np.full(n, -1)
    for k in range(STARS if n > 4 * STARS else 0):
        left = np.flatnonzero(star < 0)
        if not len(left):
            break
        own = left[near(left[:1], left)[0]]
        star[own], star[left[0]] = k, k
        yield np.repeat(left[:1], len(own)), own
    order = np.concatenate([np.flatnonzero(star == k) for k in range(STARS)] + [np.flatnonzero(star < 0)])
    ends = np.cumsum([(star == k).sum() for k in range(STARS)])
    start = 0
    while start < n:
        inside = int(ends[np.searchsorted(ends, start, side="right")]) if start < ends[-1] else 0  # end of the star, whose pairs are linked
        columns = order[inside or start :]
        rows = order[start : min(inside or n, start + max(1, 4_000_000 // (max(1, len(columns)) * COORDS)))]
        start += len(rows)
        if len(columns):
            close = near(rows, columns)
            a, b = np.nonzero(close if inside else close & (np.arange(len(columns)) > np.arange(len(rows))[:, None]))
            yield rows[a], columns[b]


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each id is linked to through edges (a, b), of all but the least ones themselves."""
    return graph.components(edges).withColumnRenamed("node", "id").where("id <> root")


def _onward(times: int):
    """Sets of large buckets (leaf, rep, bytes) go on along their paths, by the bucket's kind; parent is the bucket. Bytes stand for the values: they part fewer sets and no pair."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low = np.frombuffer(b"".join(batch["bytes"].to_pylist()), np.uint8).reshape(-1, 2 * COORDS)
            parent, rep = batch["leaf"].to_numpy(), batch["rep"].to_numpy()
            kind = parent.view(np.uint64) & np.uint64(1)
            own = np.where(kind[:, None] == 1, low[:, COORDS:], low[:, :COORDS]).astype(np.uint64)
            for turn in range(times):
                rows, nodes = descend(own, np.arange(len(own)), mix(parent.view(np.uint64) + np.uint64(turn + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(parent[rows]), pa.array(of_kind(nodes, kind[rows]).view(np.int64)), pa.array(rep[rows])], ["parent", "leaf", "rep"])

    return read


def _in_parts(members: DataFrame, size: int) -> DataFrame:
    """(leaf, rep) for all pairs of parts of the buckets leaf, which have n sets. Each two sets of a bucket meet."""
    parts = members.withColumn("g", F.expr(f"cast(ceil(n / {size}) as int)")).withColumn("own", F.expr("cast(pmod(xxhash64(rep), g) as int)"))
    parts = parts.withColumn("other", F.explode(F.expr("sequence(0, g - 1)")))
    return parts.select(F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other")).alias("leaf"), "rep")


def _buckets(sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between representatives that some bucket finds alike. sets: rep, size, bytes, leaves."""
    members = sets.select("rep", F.explode("leaves").alias("leaf"))
    most, again = LARGE, AGAIN
    parts = []
    while True:
        shared = members.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h")).where("n > 1")
        large = F.expr(f"CASE WHEN n > {most} THEN leaf END")
        shared = written(shared.groupBy("n", "h", large.alias("large")).agg(F.min("leaf").alias("leaf")).selectExpr("leaf", "n", "nvl2(large, h, null) AS h"), "buckets")  # of buckets with the same sets one is enough, if all its pairs are compared
        parts.append(members.join(shared.where(f"n <= {most}").select("leaf"), "leaf").select("leaf", "rep"))
        if not shared.where(f"n > {most}").limit(1).count():
            break
        rows = members.join(shared.where(f"n > {most}"), "leaf").join(sets.select("rep", "bytes"), "rep")
        rows = written(rows.select("leaf", "n", "h", "rep", "bytes"), "large")
        tried = rows.mapInArrow(_onward(again), "parent long, leaf long, rep long").groupBy("parent", "leaf").agg(F.count("*").cast("double").alias("c"))
        tried = tried.groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("pairs")).withColumnRenamed("parent", "leaf")
        fate = rows.groupBy("leaf").agg(F.first("n").alias("n"), F.first("h").alias("h")).join(tried, "leaf")
        fate = written(fate.withColumn("whole", F.expr("pairs > 0.5D * n * n")), "fate")
        whole = rows.select("leaf", "n", "rep").join(fate.where("whole").groupBy("n", "h").agg(F.min("leaf").alias("leaf")).select("leaf"), "leaf")
        parts.append(_in_parts(whole, max(1, most // 4)))
        onward = rows.join(fate.where("NOT whole").select("leaf"), "leaf").select(rows.columns)
        members = written(onward.mapInArrow(_onward(again), "parent long, leaf long, rep long").select("leaf", "rep"), "members")
    kept = written(functools.reduce(DataFrame.unionByName, parts), "members")
    kept = kept.join(sets.select("rep", "size", "bytes"), "rep").select("leaf", "rep", "size", "bytes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []
        for group in groups(batches, "leaf"):
            ids, first = np.unique(group["rep"], return_index=True)
            if len(ids) < 2:
                continue
            low = np.frombuffer(b"".join(group["bytes"][i] for i in first), np.uint8).reshape(-1, 2 * COORDS)
            root = forest(len(ids), _alike(low, group["size"][first].astype(np.int64), threshold))
            linked = np.flatnonzero(root != np.arange(len(ids)))
            out_a.append(ids[root[linked]])
            out_b.append(ids[linked])
            if len(out_a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return kept.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(compare, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, exactly, as products of 0/1 matrices over the shingles that two sets have at least."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = max(256, 8_000_000 // max(1, n))
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((n, min(width, int(shared.sum()) - start)), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out


def _blocks(member: DataFrame, threshold: float) -> DataFrame:
    """member (root, rep, size ...) with side and near, the sides that a set has to be compared with.

    A group's sets are dealt to levels of sizes, of which only equal and neighbouring ones can reach the threshold, and
    within a level to sides of some BLOCK sets. Each two sides of such levels meet in one block, and each side with itself.
    """
    member = member.withColumn("level", F.floor(F.log("size") / -math.log(threshold - 1e-6)).cast("int"))
    sides = member.groupBy("root", "level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g")).groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("level", "g"))).alias("sides"))
    member = member.join(sides, "root")
    g = lambda level: F.coalesce(F.try_element_at("sides", level), F.lit(0))
    code = lambda level, side: level.cast("long") * 2**32 + side
    own = F.expr("cast(pmod(xxhash64(rep), element_at(sides, level)) as int)")
    near = F.flatten(F.transform(F.array(F.col("level") - 1, "level", F.col("level") + 1), lambda level: F.when(g(level) > 0, F.transform(F.sequence(F.lit(0), g(level) - 1), lambda k: code(level, k))).otherwise(F.array().cast("array<bigint>"))))
    return member.withColumns({"side": code(F.col("level"), own), "near": near}).drop("sides", "level", "size")


def _exact(docs: DataFrame, member: DataFrame, threshold: float, width: int) -> DataFrame:
    """(rep, root, links, linked) from each block: links to other texts, the documents behind them. member: rep, copies, root, size."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = pa.array([shingles(words.of(t), width).tobytes() for t in batch["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("root", "rep", "copies", "side", "near", "d1", "d2")), sets], ["root", "rep", "copies", "side", "near", "d1", "d2", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(_blocks(member, threshold), "rep")
    sets = texts.select("root", "rep", "copies", "side", "near", "d1", "d2", "text").mapInArrow(read, "root long, rep long, copies long, side long, near array<long>, d1 long, d2 long, set binary")
    sets = sets.withColumn("other", F.explode("near")).drop("near")
    sets = sets.withColumn("block", F.xxhash64("root", F.least("side", "other"), F.greatest("side", "other")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "block"):
            digests = [xxhash.xxh3_128_digest(s) for s in group["set"]]
            mine = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            valid = np.flatnonzero((mine[:, 0] == group["d1"]) & (mine[:, 1] == group["d2"]))  # a repeated doc_id may have other texts
            ids, first = np.unique(group["rep"][valid], return_index=True)
            first = valid[first]
            sets = [np.frombuffer(group["set"][i], np.uint64) for i in first]
            copies, side, other = group["copies"][first], group["side"][first], group["other"][first]
            size = np.array([len(s) for s in sets], np.float64)
            both = overlaps(sets).astype(np.float64) if len(sets) > 1 else np.zeros((len(sets), len(sets)))
            link = both >= threshold * (size[:, None] + size - both) - 1e-9
            np.fill_diagonal(link, False)
            if len(side) and (side != other).any():
                link &= side[:, None] != side[None, :]  # a block of two sides counts what lies between them
            root = forest(len(ids), [np.nonzero(np.triu(link))])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(link.sum(1).astype(np.int64)), pa.array((link @ copies.astype(np.float64)).astype(np.int64))], ["rep", "root", "links", "linked"])

    return sets.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "rep long, root long, links long, linked long")


def join(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, class_id (least doc_id of all that are linked with it, over any number of links), text_id (least doc_id of
    the same shingle set), n_links (other documents at or over the threshold), n_text_links (other texts so).

    Rows of one doc_id and text are one document. Each input row has one row; a null doc_id has the class of its text.
    """
    rows = written(sketches(docs, width), "sketches")
    copies = written(rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies")), "copies")
    sets = rows.where("size > 0").join(copies.where("rep is not null").withColumn("doc_id", F.col("rep")), ["d1", "d2", "doc_id"])
    alike = components(_buckets(sets.select("rep", "size", "bytes", "leaves"), threshold))
    least = alike.select(F.col("root").alias("id"), "root").distinct()
    member = alike.unionByName(least).withColumnRenamed("id", "rep").join(sets.select("rep", "size", "copies", "d1", "d2"), "rep")
    blocks = written(_exact(docs, member, threshold, width), "blocks")
    links = blocks.groupBy("rep").agg(F.sum("links").alias("n_text_links"), F.sum("linked").alias("linked"))
    edges = blocks.where("rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b"))
    links = links.join(components(edges).withColumnRenamed("id", "rep"), "rep", "left")
    texts = copies.join(links, "rep", "left")
    none = F.lit(0).cast("long")
    texts = texts.select("d1", "d2", F.coalesce("root", "rep").alias("class_id"), F.col("rep").alias("text_id"), (F.coalesce("linked", none) + F.greatest(F.col("copies") - 1, none)).alias("n_links"), F.coalesce("n_text_links", none).alias("n_text_links"))
    return rows.select("doc_id", "d1", "d2").join(texts, ["d1", "d2"]).drop("d1", "d2")


def keep_one(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """docs with one row of each class: of the rows with its least doc_id (a null one comes last) one of the least text.

    Rows are told apart by themselves, not by doc_id: rows of one doc_id with texts of different classes all stay, and
    exact repeats go. Rows without words all stay.
    """
    rows = numbered(docs, "near-rows")
    found = join(rows.select(F.col("__row").alias("doc_id"), "text"), threshold, width).select(F.col("doc_id").alias("__row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"), "__row")
    kept = rows.select("__row", order.alias("order")).join(found, "__row").groupBy("class_id").agg(F.min("order").alias("order"))
    return rows.join(kept.select("order.__row"), "__row", "left_semi").select(docs.columns)
