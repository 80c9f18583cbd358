"""Every registered query with SQL of its own gives the same rows in another engine."""

import duckdb
import pytest

from shelfwise import registry

SMALL = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def plain(value):
    return round(float(value), 6) if isinstance(value, float) else [plain(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, engine, name):
    rows = registry.queries()[name](spark, SMALL)
    order = sorted(rows.columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in rows.collect())
    said = engine.execute(SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == order
    assert got == sorted(repr([plain(r[names.index(c)]) for c in order]) for r in said.fetchall())


def test_the_llm_part_may_be_missing(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    real = importlib.import_module

    def gone(name, *more):
        if name.startswith("shelfwise.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name=name)
        return real(name, *more)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(SQL)
    assert "shelfwise.registry" in sys.modules
