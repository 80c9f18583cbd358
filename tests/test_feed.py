from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.numbers import quotas
from shelfwise.operators.scope import page_strips
from shelfwise.operators.selection import by_quota, patterned, round_robin, up_next
from shelfwise.plans.feed import Pools

from .tables import Tables, video


def test_quotas():
    assert list(quotas(24, True).values()) == [4, 2, 4, 7, 7] and list(quotas(24, False).values()) == [4, 0, 4, 8, 8]
    assert all(sum(quotas(n, h).values()) == n for n in (1, 2, 5, 7, 10, 24, 48, 96) for h in (True, False))


def test_picks():
    assert round_robin([[1, 2, 3], [4], [5], [7, 6]]) == [1, 4, 5, 7, 2, 6, 3]
    assert by_quota({"recent": [1, 2, 3], "random": [1, 4]}, {"recent": 1, "random": 2}, 3, {2}) == [("recent", 1), ("random", 4), ("recent", 3)]
    assert by_quota({"recent": [1, 2, 3]}, {"recent": 9}, 9, {1, 2}) == [("recent", 3)]
    pools = {"creator": [11, 12, 13], "title": [21, 22], "random": [31, 32]}
    assert up_next(1, pools) == [11, 12, 21, 22] and up_next(11, {**pools, "title": [21]}) == [12, 13, 21, 31]
    assert up_next(1, {"creator": [11, 12, 13, 14], "title": [], "random": []}) == [11, 12, 13, 14]
    assert patterned({"creator": [1, 2, 3], "title": [4], "random": [5, 1, 6]}, "ctctr", 6, set()) == [1, 4, 2, 5, 3, 6]


@pytest.mark.parametrize(("page", "pages", "strip"), [(1, 5, [1, 2, 3, 4, 5]), (5, 20, [1, None, 4, 5, 6, None, 20]), (1, 20, [1, 2, None, 20]), (20, 20, [1, None, 19, 20])])
def test_strip(spark, page, pages, strip):
    assert spark.range(1).select(page_strips(F.lit(page).cast("long"), F.lit(pages).cast("long")).alias("s")).first()["s"] == strip


@pytest.fixture(scope="module")
def library(spark):
    rows = [video(i, f"{['alpha', 'beta', 'gamma'][i % 3]} part {i}", 1, day=i / 1440, creator=i % 3) for i in range(1, 61)]
    rows += [video(100 + i, f"alpha public {i}", None, day=i) for i in range(5)] + [video(200, "alpha gone", 9), video(300, "alpha other", 2)]
    seen = [(1, 1, datetime(2026, 5, 1)), (1, 2, datetime(2026, 5, 1) + timedelta(hours=1))]
    return Tables(spark, rows, [(c, 1, n) for c, n in enumerate(("alpha", "beta", "gamma"))], seen)


def test_home(library):
    pools = Pools(library, 1)
    first, second = pools.home(1), pools.home(2)
    sources = [s for s, _ in first]
    assert len(first) == 24 and [sources.count(s) for s in ("recent", "history", "related", "random", "variety")] == [4, 2, 4, 7, 7]
    assert len({i for _, i in first + second}) == len(first) + len(second)
    assert [i for s, i in first if s == "recent"] == [60, 59, 58, 57] and first == pools.home(1)
    assert not {200, 300} & {i for _, i in first + second} and Pools(library, 3).home(1) == []


def test_pools(library):
    pools = Pools(library, 1)
    assert pools.same_creator(60, 0, 3) == [57, 54, 51] and pools.same_creator(60, None) == []
    assert not {1, 2} & set(pools.by_history()) and pools.by_history()[:2] == [59, 56]
    related = pools.related(60, 24)
    assert len(related) == 24 and 60 not in related and len(set(related)) == 24 and related[:2] == [57, 54]
    pages = [pools.shuffled("x", p) for p in (1, 2, 3)]
    assert len(set(sum(pages, []))) == 65 and pages[0] == pools.shuffled("x", 1) != pools.shuffled("y", 1)
    assert Pools(library, 3).shuffled("x") and set(Pools(library, 3).shuffled("x")) == set(range(100, 105))


def feeds_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["user_id"], r["page"], r["pos"])):
        out.setdefault((r["user_id"], r["page"]), []).append((r["source"], r["id"]))
    return out


def test_all_feeds_are_those_of_each_user(library, spark):
    from shelfwise.plans.feeds import home_feeds
    from shelfwise.sources.catalog import Library

    got = feeds_of(home_feeds(library, 3).collect())
    assert got == {(u, p): picks for u in (1, 2, 3) for p in (1, 2, 3) if (picks := Pools(library, u).home(p))}
    small = Library(spark, "/root/testdata/sf0.001")
    got = feeds_of(home_feeds(small, 2).collect())
    assert {u for u, _ in got} == {0, 1, 2, 3, 4}
    assert got == {(u, p): Pools(small, u).home(p) for u in range(5) for p in (1, 2)}
