"""State of many keys at a time: Python is called once for a shard of keys and a micro-batch, not once for each key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Shards where the number of keys is not known, and rows of a stream for which there is one where it is.
SHARDS, ROWS = 256, 10_000

#: (key, its rows of a micro-batch, its state or None) to (rows for the output, its state; None ends it).
Fold = Callable[[object, list[tuple], object], tuple[list[tuple], object]]


def shards_for(rows: int) -> int:
    """So many that a shard stays as small as it is however many rows there are."""
    return max(SHARDS, -(-rows // ROWS))


def folded_by_shard(rows: DataFrame, key: str, columns: list[str], fold: Fold, schema: str, shards: int = SHARDS) -> DataFrame:
    """What fold makes of each key's columns, in append mode. A shard's state is one row, its keys' states; it goes with the last of them.

    A micro-batch's rows of a shard are held in memory: as many shards as its size asks for bound them.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def step(shard: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, own, out = pickle.loads(state.get[0]) if state.exists else {}, {}, []
        for batch in batches:
            keys = batch["__key"].tolist() if shard[0] >= 0 else [None] * len(batch)
            for one, *values in zip(keys, *[batch[c].tolist() for c in columns], strict=True):
                own.setdefault(one, []).append(tuple(values))
        for one, values in own.items():
            made, now = fold(one, values, held.pop(one, None))
            out += made
            if now is not None:
                held[one] = now
        if held:
            state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({n: pd.array(c, "Int64") if None in c and any(isinstance(v, int) for v in c) else list(c) for n, c in zip(names, zip(*out, strict=True), strict=True)}, copy=False)

    dealt = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(shards)))  # keys that are null have a shard of their own, as pandas has no null among whole numbers
    narrow = rows.select(dealt.cast("long").alias("__shard"), F.col(key).alias("__key"), *columns)
    return narrow.groupBy("__shard").applyInPandasWithState(step, schema, "held binary", "append", GroupStateTimeout.NoTimeout)
