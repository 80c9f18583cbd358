"""What has to change so that stored rows match a remote snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of changes, in the order in which they are told.
CHANGES = (("rename", "name"), ("size", "size"), ("timestamp", "ts"), ("move", "parent"), ("file-attributes", "fa"))


def plan_changes(remote: DataFrame, existing: DataFrame) -> DataFrame:
    """node_id, action (add, update, remove, unchanged), changes, and both sides' columns.

    A full outer join on the node; comparisons take nulls for values, but a stored size that is null always counts as changed.
    """
    left = remote.select("node_id", F.struct(*[c for _, c in CHANGES]).alias("new"))
    right = existing.select("node_id", F.struct("id", *[c for _, c in CHANGES]).alias("old"))
    both = left.join(right, "node_id", "full_outer")

    def differs(column: str):
        new, old = F.coalesce(F.col(f"new.{column}"), F.lit("")) if column == "name" else F.col(f"new.{column}"), F.col(f"old.{column}")
        if column == "size":
            new, old = F.coalesce(new, F.lit(0)), F.coalesce(old, F.lit(-1))
        return ~new.eqNullSafe(old)

    told = F.array_compact(F.array(*[F.when(differs(c), name) for name, c in CHANGES]))
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(F.size(told) > 0, "update").otherwise("unchanged")
    return both.withColumn("action", action).withColumn("changes", F.when(F.col("action") == "update", told).otherwise(F.array().cast("array<string>")))
