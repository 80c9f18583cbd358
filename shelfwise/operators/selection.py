"""Folds over the few rows of recommendation pools. Pools are ranked and cut by Spark; these only pick from at most a page of each."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain, zip_longest


def fresh(ids: Iterable[int], taken: set[int], most: int | None = None) -> list[int]:
    """The first ids that are not taken; they are taken then."""
    out: list[int] = []
    left = iter(ids)
    while most is None or len(out) < most:
        one = next(left, None)
        if one is None:
            break
        if one not in taken:
            taken.add(one)
            out.append(one)
    return out


def by_quota(pools: dict[str, list[int]], quotas: dict[str, int], size: int, taken: Iterable[int] = ()) -> list[tuple[str, int]]:
    """(source, id): each source its quota, in order, an id with the first that claims it; then what is left fills the page."""
    seen = set(taken)
    picks = [(source, one) for source, ids in pools.items() for one in fresh(ids, seen, quotas.get(source, 0))]
    for source, ids in pools.items():
        picks += [(source, one) for one in fresh(ids, seen, max(0, size - len(picks)))]
    return picks


def round_robin(lists: Iterable[list]) -> list:
    """One from each list in turn, until all are used up."""
    gap = object()
    return [x for x in chain.from_iterable(zip_longest(*lists, fillvalue=gap)) if x is not gap]


def patterned(pools: dict[str, list[int]], pattern: str, size: int, taken: set[int]) -> list[int]:
    """Ids by a repeated pattern of pool names (their first letters); a pool that has run out is passed over."""
    left = {name[0]: iter(ids) for name, ids in pools.items()}
    out: list[int] = []
    while len(out) < size:
        got = [one for letter in pattern for one in fresh(left[letter], taken, 1)]
        if not got:
            break
        out += got
    return out[:size]


def up_next(current: int, pools: dict[str, list[int]], size: int = 4) -> list[int]:
    """Two of the same creator, then title matches, then more of the creator, then chance."""
    taken = {current}
    out = fresh(pools["creator"], taken, min(2, size))
    for name in ("title", "creator", "random"):
        out += fresh(pools[name], taken, size - len(out))
    return out
