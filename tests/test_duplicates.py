import random

import pytest

from shelfwise.functions.text import comparison_key, similarity
from shelfwise.operators.duplicates import groups, wiped_out
from shelfwise.operators.graph import components

SCHEMA = "id long, node_id string, name string, title string, size long, duration long"


def file(i, name, size=1_500_000_000, duration=1112):
    return (i, f"n{i}", name, name.rsplit(".", 1)[0], size, duration)


def found(spark, rows):
    return groups(spark.createDataFrame(rows, SCHEMA)).orderBy("title").collect()


def test_keys_and_similarity():
    for name in ("Amazing Video.mp4", "Amazing Video (1).mp4", "amazing_video [3].mkv", "Amazing Video - Copy.mp4", "Amazing Video copy 2.mp4", "Watch_Amazing Video - 2.mp4", "Jane - Amazing Video (duplicate).mp4"):
        assert comparison_key(name) == "amazing video", name
    assert comparison_key("The Copy.mp4") == "the copy" and comparison_key("Watch Me Dance.mp4") == "watch me dance" and comparison_key(None) == ""
    assert similarity("best moments collection", "best moments selections") == 92 and similarity("amazing videos", "amazing video") == 99
    assert similarity("", "a") == 0 and similarity("abc", "xyz") == 0 and similarity("martha", "marhta") == 96 and similarity("abcvwxyz", "cabvwxyz") == 94


@pytest.mark.parametrize(
    ("a", "b", "confidence", "status"),
    [
        (file(1, "Amazing Videos.mp4"), file(2, "Amazing Video.mp4"), "high", "same"),
        (file(1, "Best Moments Collection.mp4"), file(2, "Best Moments Selections.mp4"), "possible", "same"),
        (file(1, "Same Title.mp4", 1000), file(2, "Same Title.mp4", 2000), None, None),
        (file(1, "Same Title.mp4", duration=60), file(2, "Same Title.mp4", duration=600), None, None),
        (file(1, "Same Title.mp4", duration=None), file(2, "Same Title.mp4", duration=600), "high", "partial-unknown"),
        (file(1, "Same Title.mp4"), file(2, "Same Title.mkv"), "possible", "same"),
        (file(1, "Short.mp4"), file(2, "Shorts.mp4"), None, None),
        (file(1, "abc.mp4"), file(2, "abc.mp4"), None, None),
        (file(1, "Same Title.mp4", 0), file(2, "Same Title.mp4", 0), None, None),
    ],
)
def test_pairs(spark, a, b, confidence, status):
    got = found(spark, [a, b])
    assert [(g["confidence"], g["duration_status"]) for g in got] == ([(confidence, status)] if confidence else [])


def test_groups(spark):
    rows = [file(1, "Amazing Video.mp4"), file(2, "Amazing Video (1).mp4"), file(3, "Amazing Video copy.mp4"), file(4, "Other Film.mp4", 500), file(5, "Other Film - 2.mp4", 500), file(6, "Alone.mp4", 7)]
    got = found(spark, rows)
    assert [(g["members"], g["savings"], g["duration"]) for g in got] == [([1, 2, 3], 3_000_000_000, 1112), ([4, 5], 500, 1112)]
    table = groups(spark.createDataFrame(rows, SCHEMA))
    gone = wiped_out(table, spark.createDataFrame([(4,), (5,), (1,)], "id long")).collect()
    assert [g["group_key"] for g in gone] == [got[1]["group_key"]]
    chain = found(spark, [file(1, "aaaaaaaaaa bbbbbbbbbb.mp4", duration=10), file(2, "aaaaaaaaaa bbbbbbbbbb.mp4", duration=12), file(3, "aaaaaaaaaa bbbbbbbbbb.mp4", duration=14), file(4, "aaaaaaaaaa bbbbbbbbbb.mp4", duration=16)])
    assert [g["members"] for g in chain] == [[1, 2, 3, 4]] and chain[0]["duration"] == 14 and chain[0]["duration_status"] == "partial-unknown"


def test_many_files_of_one_size_need_equal_keys(spark):
    rows = [file(i, f"A very similar title number {i:04d}.mp4") for i in range(501)] + [file(600, "A very similar title number 0007.mkv")]
    assert [g["members"] for g in found(spark, rows)] == [[7, 600]]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)]
    root = {}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root.get(a, a), root.get(b, b))
    want = {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_the_bound_is_never_below_the_similarity(spark):
    from shelfwise.functions.text import similarity_bound

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde ]-^") for _ in range(rng.randint(1, 14)))
    rows = [(a, "".join(c if rng.random() < 0.8 else rng.choice("abcde") for c in a) if rng.random() < 0.7 else word()) for a in (word() for _ in range(600))]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity_bound("a", "b").alias("bound")).collect()
    assert all(r["bound"] * 100 + 0.5 + 1e-9 >= similarity(r["a"], r["b"]) for r in got) and sum(r["bound"] < 0.895 for r in got) > 200
