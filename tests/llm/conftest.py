import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int"


def frame(spark, rows, schema=SCHEMA):
    """Rows may be shorter than the schema; shard is an extra column with a clashing name."""
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ties."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long = " ".join(word() for _ in range(20_000))
    body = "\n".join(" ".join(word() for _ in range(12)) for _ in range(6))
    rows = [(1, body, "en", "a"), (2, body, "en", "a"), (3, body + "\nOne more line of text", None, None), (4, None, None, "a"), (5, "", "fr", "b"), (6, long, "de", "b"), (None, body, "en", "a"), (None, None, None, None), (7, "  \n\n\t\n", "en", "b"), (8, "Ünïcode 漢字 🙂 text.", "en", "c"), (9, "same", "en", "c"), (9, "same", "en", "c")]
    return frame(spark, rows)
