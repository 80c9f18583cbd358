from pyspark.sql import functions as F

from shelfwise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example string"
MARKS = r"<|im_end|>\<|im_start|>assistant ok <\| \\"


def test_round_trip_and_mask(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi\nthere"), (1, 2, "assistant", MARKS), (1, 3, "user", MARKS), (1, 4, "assistant", "<"), (2, 0, "user", "no reply"), (3, 0, "assistant", ""), (3, 1, "user", None), (4, None, None, None), (None, 1, "us er\n", "x"), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    examples = chat.expand(turns)
    each = examples.where("conv_id = 1").orderBy("example").collect()
    assert len(each) == 2 and all(e["loss_start"] is not None for e in each)
    assert each[1]["formatted"].startswith(each[0]["formatted"])
    back = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    said = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        said.setdefault(conv, []).append((role or "", text or ""))
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in back.items()} == said
    assert {c: r["losses"] for c, r in back.items()} == {c: "".join(t for role, t in ts if role == "assistant") for c, ts in said.items()}
    shown = {r["conv_id"]: r["n"] for r in examples.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert {c: r["formatted_chars"] for c, r in back.items()} == shown


def test_empty(spark):
    assert chat.read_back(chat.expand(spark.createDataFrame([], SCHEMA))).count() == 0


def test_rows_without_conversation_are_each_their_own(spark):
    rows = [(None, i % 3, "assistant" if i % 2 else "user", f"t{i % 5}") for i in range(200)] + [(None, 0, "user", "same")] * 50
    turns = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    examples = chat.expand(turns)
    back = chat.read_back(examples).collect()
    assert len(back) == 250 and all(len(r["turns"]) == 1 for r in back)
    assert sorted((r["turns"][0]["role"], r["turns"][0]["text"], r["losses"]) for r in back) == sorted((role, text, text if role == "assistant" else "") for _, _, role, text in rows)


def test_very_long_texts(spark):
    long = "ab\\c <|im_end|> 漢🙂\n" * 60_000
    turns = spark.createDataFrame([(1, 0, "user", long, None), (1, 1, "assistant", long * 2, None)], SCHEMA)
    (back,) = chat.read_back(chat.expand(turns)).collect()
    assert [t["text"] for t in back["turns"]] == [long, long * 2] and back["losses"] == long * 2
