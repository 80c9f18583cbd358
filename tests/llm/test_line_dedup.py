import random

import numpy as np

from shelfwise.llm import line_dedup
from shelfwise.llm.line_dedup import CuckooFilter, LineDedup

from .conftest import frame

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """{doc_id: kept text} by the rule itself."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(WHITE).translate(lower)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(doc)
    gone = lambda doc, line: len(holders.get(key(line), ())) > 1 and min(holders[key(line)]) != doc
    return {doc: "\n".join(x for x in (text or "").split("\n") if not gone(doc, x)) for doc, text in rows}


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


ROWS = [(1, "A line that repeats\nonly here one\nshort"), (2, " a LINE that repeats\t\nshort\nA line that repeats"), (3, "other text here\n\nÉcole des lignes"), (4, "École des lignes\nécole des lignes\nshort"), (5, "")]


def test_matches_the_rule_and_undoes_deletions(spark):
    docs = frame(spark, ROWS)
    state = LineDedup.of(docs, shards=4)
    assert texts(state.apply(docs)) == brute(ROWS)
    less = state.delete(spark.createDataFrame([(1,), (99,)], "doc_id long"))
    rest = [r for r in ROWS if r[0] != 1]
    assert texts(less.apply(frame(spark, rest))) == brute(rest)
    again = less.insert(frame(spark, ROWS[:2]))  # document 2 is there already
    assert texts(again.apply(docs)) == brute(ROWS)
    key = lambda s: {(r["shard"], bytes(r["key"]), r["refs"], r["first_doc"]) for r in s.references.collect()}
    assert key(again) == key(state)


def test_odd_rows(spark, odd):
    state = LineDedup.of(odd, shards=4)
    out = state.apply(odd)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["n_dropped"] == 6 and by[2]["text"] == "" and by[3]["text"] == "One more line of text"
    assert by[4]["text"] is None and by[4]["n_lines"] == 1 and by[5]["n_lines"] == 1 and by[7]["n_lines"] == 4
    assert sorted(r["n_dropped"] for r in rows if r["doc_id"] is None) == [0, 0]
    empty = frame(spark, [])
    assert LineDedup.of(empty, shards=2).apply(empty).count() == 0


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    made = CuckooFilter.of(keys[:4000])
    assert made.contains(keys[:4000]).all() and made.contains(keys[4000:]).mean() < 0.01
    made.delete(keys[:2000])
    assert made.contains(keys[2000:4000]).all() and made.contains(keys[:2000]).mean() < 0.01
    assert CuckooFilter.read(made.data()).contains(keys[2000:4000]).all()


def files(state, name):
    return {f for t in state.tables[name] for f in t.inputFiles()}


def test_changes_append_and_touch_only_their_shards(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "\n".join(f"line number {rng.randrange(150)} of the many" for _ in range(6))) for i in range(80)]
    state = LineDedup.of(frame(spark, rows[:60]), shards=16)
    versions = {"filters": {r["shard"]: bytes(r["cells"]) for r in state.filters.collect()}}
    more = state.insert(frame(spark, rows[60:61] + rows[:3]))
    for name in ("postings", "references", "filters"):
        assert files(state, name) < files(more, name)  # old files stay as they are
    touched = {r["shard"] for r in more.tables["postings"][-1].collect()}
    assert touched and {r["doc_id"] for r in more.tables["postings"][-1].collect()} == {60}
    assert {r["shard"] for t in ("references", "filters") for r in more.tables[t][-1].collect()} <= touched
    assert all(bytes(r["cells"]) == versions["filters"][r["shard"]] for r in more.filters.collect() if r["shard"] not in touched)
    monkeypatch.setattr(line_dedup, "COMPACT", 3)
    held = dict(rows[:61])
    for turn in range(4):
        new, gone = rows[61 + 4 * turn : 65 + 4 * turn], rng.sample(sorted(held), 5)
        more = more.insert(frame(spark, new)).delete(spark.createDataFrame([(g,) for g in [*gone, 9999]], "doc_id long"))
        held = {d: t for d, t in (*held.items(), *new) if d not in gone}
        if turn % 2:
            assert texts(more.apply(frame(spark, list(held.items())))) == brute(list(held.items()))
    assert all(len(t) <= 3 for t in more.tables.values())
    fresh = LineDedup.of(frame(spark, list(held.items())), shards=16)
    key = lambda s: {(r["shard"], bytes(r["key"]), r["refs"], r["first_doc"], r["last_doc"]) for r in s.references.collect()}
    assert key(more) == key(fresh)


def test_hot_shards_are_dealt_to_more_tasks(spark, monkeypatch):
    rows = [(i, f"the one line that all have\nand one of its own {i}") for i in range(50)]
    monkeypatch.setattr(line_dedup, "PROBE_ROWS", 7)
    state = LineDedup.of(frame(spark, rows), shards=2)
    assert texts(state.apply(frame(spark, rows))) == brute(rows)
    assert state.suspects(state.postings).count() >= 50
