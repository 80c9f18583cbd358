"""Near-duplicates by SimHash fingerprints, searched in BK-trees.

1. A text's fingerprint has a bit where over half the hashes of its three-word shingles have it. Equal fingerprints
   are one node; copies cost nothing more.
2. Nodes are dealt to shards. Of 64 bits in three runs, two fingerprints that differ in at most two bits agree in one
   run at least, so a shard holds all fingerprints that agree in the bits `fixed`. A shard of more than MOST nodes is
   dealt anew by its bits that are still free, in three runs again: no pair is lost. A shard with 10 free bits has 1,024 nodes
   at most, so six turns always suffice and every tree has a bound that does not depend on the data.
3. Each shard becomes a BK-tree: a child hangs on its parent by the Hamming distance between the two. A search at
   distance d from a node follows the edges d - RADIUS to d + RADIUS alone. The trees of the most populous shards, TREES
   a turn and none over MOST nodes, are broadcast, and their nodes look for their like wherever they are; the
   nodes of other shards meet their tree in one task. Trees of all shards are never broadcast: that would
   bring all fingerprints to the driver.
4. A search hands on, not its pairs, but a forest of them, one row for each node at most.

A null text is empty; a text without words has fingerprint zero and is linked like any other. Rows without doc_id have
the component of their fingerprint; a component of such rows alone has the id null. Rows of one doc_id with several texts
are rows of their own. Long texts are hashed a block of shingles at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import give_back, written
from shelfwise.llm.jaccard_join import forest
from shelfwise.operators import graph

SEED, WIDTH, BITS, RADIUS = 42, 3, 64, 2
#: Nodes of a tree at most; trees that are broadcast in a turn, of more than POPULAR nodes each: 64 times 4,096 nodes of 16 bytes are 4 MB.
MOST, TREES, POPULAR = 1 << 12, 64, 1 << 9
#: Pairs of node and tree node that a search may hold at once, and nodes whose trees a task holds at once.
HELD, PLANTED = 2_000_000, 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes are split at [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WIDTH, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in spans])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, fp long")


class Trees:
    """BK-trees of many shards, as arrays: nodes by level, a node's children side by side in the order of their distance."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        """shard: numbers from 0, ascending; a tree's root is its first node."""
        n = len(fps)
        group, rest = shard.astype(np.int64), np.arange(n)
        order, edges, parents, level, done = [], [], [], None, 0
        edge = np.zeros(n, np.int64)
        while len(rest):
            _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
            heads = rest[first]
            order.append(heads)
            edges.append(edge[first])
            parents.append(np.full(len(first), -1) if level is None else level[first])
            keep = np.ones(len(rest), bool)
            keep[first] = False
            rest, inverse = rest[keep], inverse[keep]
            edge = np.bitwise_count(fps[rest] ^ fps[heads[inverse]]).astype(np.int64)
            level, group = inverse + done, inverse * (BITS + 1) + edge
            done += len(first)
        whole = np.concatenate(order) if order else np.empty(0, np.int64)
        self.nodes = fps[whole]
        #: Children of a node: those whose key, parent * (BITS + 1) + edge, lies in a range; keys ascend after the roots.
        self.roots = len(order[0]) if order else 0
        self.keys = (np.concatenate(parents) * (BITS + 1) + np.concatenate(edges))[self.roots :] if order else np.empty(0, np.int64)

    def near(self, fps: np.ndarray, root: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs (place in fps, node) at most radius apart, of each search in the tree of its root; nodes visited."""
        who, node, found_who, found_node, visited = np.arange(len(fps)), root, [], [], 0
        while len(who):
            visited += len(who)
            apart = np.bitwise_count(fps[who] ^ self.nodes[node]).astype(np.int64)
            close = apart <= radius
            found_who.append(who[close])
            found_node.append(node[close])
            base = node * (BITS + 1)
            low = np.searchsorted(self.keys, base + np.maximum(apart - radius, 1), side="left")
            count = np.searchsorted(self.keys, base + np.minimum(apart + radius, BITS), side="right") - low
            who = np.repeat(who, count)
            node = np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(who)) + self.roots
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *found_who]), np.concatenate([empty, *found_node]), visited


def linked(trees: Trees, fps: np.ndarray, root: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b): forests over the pairs that searches for fps find, some searches at a time. size: nodes of each search's tree, a bound of what it holds."""
    cuts = np.searchsorted(np.cumsum(size), np.arange(HELD, int(size.sum()) + HELD, HELD), side="left") + 1
    start = 0
    for end in np.unique(np.minimum(cuts, len(fps))).tolist():
        who, node, _ = trees.near(fps[start:end], root[start:end])
        both, place = np.unique(np.concatenate([fps[start:end][who], trees.nodes[node]]), return_inverse=True)
        label = forest(len(both), [(place[: len(who)], place[len(who) :])])
        joined = np.flatnonzero(label != np.arange(len(both)))
        yield pa.RecordBatch.from_arrays([pa.array(both[label[joined]].view(np.int64)), pa.array(both[joined].view(np.int64))], ["a", "b"])
        start = end


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within the shards whose nodes are a row each."""
    for batch in batches:
        sizes = np.diff(batch["fps"].offsets.to_numpy())
        cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + PLANTED, PLANTED)))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True):  # so many nodes at a time, and one shard more
            counts, fps = sizes[a:b], batch["fps"].slice(a, b - a).flatten().to_numpy().view(np.uint64)
            shard = np.repeat(np.arange(len(counts)), counts)
            yield from linked(Trees(shard, fps), fps, shard, counts[shard])
    give_back()


def masks(fixed: int) -> list[int]:
    """The bits of fixed with each of three runs of the other bits."""
    free = [b for b in range(BITS) if not fixed >> b & 1]
    return [fixed | sum(1 << b for b in run.tolist()) for run in np.array_split(free, 3)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _dealt(nodes: DataFrame, known: list[int]) -> tuple[DataFrame, list[int]]:
    """nodes (fp, fixed) with a row for each run of their free bits (fixed, value); known: all values of fixed."""
    cases = F.array(*[F.struct(F.lit(_signed(k)).alias("old"), F.array(*[F.lit(_signed(m)) for m in masks(k)]).alias("new")) for k in known])
    new = F.map_from_entries(cases)[F.col("fixed")]
    rows = nodes.select("fp", F.explode(new).alias("fixed")).select("fp", "fixed", F.col("fp").bitwiseAND(F.col("fixed")).alias("value"))
    made = [m for k in known for m in masks(k)]
    distinct = list(dict.fromkeys(made))
    return rows if len(distinct) == len(made) else rows.distinct(), distinct  # two ways may lead to one shard


def _popular(members: DataFrame, counts: DataFrame, trees: int) -> tuple[DataFrame | None, list[tuple[int, int]]]:
    """Edges of the most populous shards, whose trees are broadcast; the names of these shards."""
    spark = members.sparkSession
    names = counts.where(f"n > {POPULAR} AND n <= {MOST}").orderBy(F.desc("n"), "fixed", "value").limit(trees).select("fixed", "value").collect()
    if not names:
        return None, []
    chosen = F.broadcast(spark.createDataFrame([(*k, i) for i, k in enumerate(names)], "fixed long, value long, tree int"))
    queries = members.join(chosen, ["fixed", "value"]).select("tree", "fp")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps(Trees(np.zeros(len(x), np.int64), np.array(x, np.int64).view(np.uint64))) for x in batch["fps"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["tree"], pa.array(made, pa.binary())], ["tree", "made"])

    built = queries.groupBy("tree").agg(F.sort_array(F.collect_list("fp")).alias("fps")).mapInArrow(build, "tree int, made binary").collect()
    sent = spark.sparkContext.broadcast({t: bytes(made) for t, made in built})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Trees] = {}
        for batch in batches:
            tree, fps = batch["tree"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            for t in np.unique(tree).tolist():
                if t not in held:
                    held[t] = pickle.loads(sent.value[t])  # noqa: S301  our own bytes
                own = fps[tree == t]
                yield from linked(held[t], own, np.zeros(len(own), np.int64), np.full(len(own), len(held[t].nodes)))

    return queries.mapInArrow(search, "a long, b long"), [tuple(k) for k in names]


def neighbours(nodes: DataFrame, trees: int = TREES) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of nodes (fp, distinct) at most RADIUS bits apart."""
    spark = nodes.sparkSession
    members, known = _dealt(nodes.select("fp", F.lit(0).cast("long").alias("fixed")), [0])
    parts = []
    while True:
        counts = written(members.groupBy("fixed", "value").agg(F.count("*").alias("n")).where("n > 1"), "simhash-shards")
        edges, names = _popular(members, counts, trees)
        if edges is not None:
            parts.append(written(edges, "simhash-edges"))
        rest = counts
        if names:
            rest = rest.join(F.broadcast(spark.createDataFrame(names, "fixed long, value long")), ["fixed", "value"], "left_anti")
        grouped = members.join(rest.where(f"n <= {MOST}").select("fixed", "value"), ["fixed", "value"])
        grouped = grouped.groupBy("fixed", "value").agg(F.collect_list("fp").alias("fps")).select("fps")
        parts.append(written(grouped.mapInArrow(_inside, "a long, b long"), "simhash-edges"))
        if not counts.where(f"n > {MOST}").limit(1).count():
            break
        large = members.join(counts.where(f"n > {MOST}").select("fixed", "value"), ["fixed", "value"]).select("fp", "fixed")
        members, known = _dealt(large, known)
        members = written(members, "simhash-members")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most RADIUS bits reach from the row."""
    rows = written(fingerprints(docs), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = graph.components(neighbours(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    placed = written(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
