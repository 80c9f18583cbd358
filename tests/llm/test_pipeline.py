import random

import corpus_pipeline
from shelfwise.llm import quality

from .conftest import frame


def test_stages_by_hand(spark, tmp_path):
    rng = random.Random(6)
    lines = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12)) for _ in range(40)]
    docs = [(i, "\n".join(lines[i : i + 2] + [f"own text number {i} of the many"]), "en", "s", 0) for i in range(0, 30, 3)]
    docs += [(100, docs[0][1] + " extra", "en", "s", 0), (101, "BUY!! NOW!! " * 30, "en", "s", 0), (102, "start " + lines[35] + " " + lines[36] + " end", "en", "s", 0), (103, None, None, None, None), (104, "", "en", "s", 0)]
    docs = frame(spark, docs, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    more = [(500 + i, "BUY!! NOW!! CHEAP!! " * 20) for i in range(30)]
    spark.createDataFrame([(i, int(i < 500), 0) for i in [*range(0, 30, 3), 101, *[m[0] for m in more]]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, lines[35] + " " + lines[36])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    lined = stages["line_dedup"](spark, docs, str(tmp_path))
    assert lined.columns == docs.columns and lined.count() == docs.count()
    assert {r["doc_id"]: r["text"] for r in lined.collect()}[100].endswith("many extra")
    kept = {r["doc_id"] for r in stages["ngram_jaccard_join"](spark, docs, str(tmp_path)).collect()}
    assert 100 not in kept and kept >= {0, 3, 101, 102, 103, 104}
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in stages["benchmark_decontamination"](spark, docs, str(tmp_path)).collect()} == {102}
    accepted = stages["quality_classifier"](spark, docs, str(tmp_path))
    assert accepted.columns == docs.columns and set(range(0, 30, 3)) <= {r["doc_id"] for r in accepted.collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["offset"] + r["length"] <= 1024 for r in out)
    assert quality.ACCEPT == 0.3


def test_extra_columns_with_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, n_dropped string, class_id string, rep string, item_id string"
    docs = frame(spark, [(1, "some clean text of a document", "en", "s", 3, "a", "b", "c", "d", "e", "f"), (None, None), (2, "another clean text of a document", "en", "s", 3, "a", "b", "c", "d", "e", "f")], schema)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind in any of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r)[5:] for r in out.collect() if r["doc_id"]} == {("a", "b", "c", "d", "e", "f")}, name
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == 3


def test_empty(spark, tmp_path):
    frame(spark, [], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_by_brute_force(spark, tmp_path):
    """All stages but the classifier's score done again in plain Python."""
    from tokenizers import Tokenizer

    from shelfwise.llm import packing

    from .test_jaccard_join import brute as near
    from .test_line_dedup import brute as deduped

    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    shared = [" ".join(word() for _ in range(10)) for _ in range(12)]
    items = [" ".join(word() for _ in range(26)) for _ in range(3)]
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 5))] + rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    base = [[word() for _ in range(120)] for _ in range(4)]
    rows += [(100 + 10 * k + i, " ".join(own[:60] + [f"copy{i}"] + own[60:])) for k, own in enumerate(base) for i in range(3)] + [(200 + i, rows[i + 20][1]) for i in range(3)]
    rows += [(300 + i, " ".join(word() for _ in range(20)) + " " + items[i % 3] + " " + word()) for i in range(4)] + [(400 + i, "CHEAP!! NOW!! " * 30) for i in range(12)] + [(500, None), (501, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame(spark, [(*r, "en", "s", len(r[1] or "")) for r in rows], schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400)) for i, _ in rows if i % 2 == 0], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).collect()]
    assert {d for d, _ in good} >= set(range(60)) and not {d for d, _ in good} & set(range(400, 412))
    lined = sorted(deduped(good).items())
    classes = near(lined)
    kept = [(d, t) for d, t in lined if classes[d][0] == d]
    holds = lambda text, item: any(" ".join(item.split()[a : a + 13]) in " ".join(text.split()) for a in range(14))
    clean = {d: t for d, t in kept if not any(holds(t, item) for item in items)}
    assert len(lined) > len(kept) > len(clean)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_rows_of_one_id_are_told_apart(spark, tmp_path):
    a, b = "the quick brown fox jumps over a lazy dog by the river", "an entirely other text that nobody has seen before today"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = frame(spark, [(1, a), (9, a), (9, b), (None, b), (None, a)], schema)
    left = corpus_pipeline.keep_one_of_each_class(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, a), (9, b)]
