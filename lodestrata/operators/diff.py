"""Keyed differences between two versions of a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_diff(left: DataFrame, right: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """``status`` (same, changed, only_left, only_right), the changed columns, and the order of display.

    One full outer join on the keys; null values compare as equal to each other.
    """
    a = left.select(*keys, F.struct(*compared).alias("l"))
    b = right.select(*keys, F.struct(*compared).alias("r"))
    j = a.join(b, keys, "full")
    changed = F.filter(F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in compared)), lambda x: x.isNotNull())
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    status = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").when(F.size(changed) > 0, "changed").otherwise("same")
    order = F.when(status == "changed", 0).when(status == "only_right", 1).when(status == "only_left", 2).otherwise(3)
    return j.select(*keys, status.alias("status"), F.when(both, F.array_join(changed, ",")).otherwise("").alias("changed_columns"), order.alias("display_order"))


def merge_versions(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str], take: list[str], union: list[str]) -> DataFrame:
    """Merges two descriptions of the same objects, field by field.

    ``keep`` columns hold the existing value if there is one, ``take`` columns the incoming one, and ``union``
    columns (arrays) the sorted union of both.
    """
    e, i = existing.alias("e"), incoming.alias("i")
    j = e.join(i, keys, "full")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return j.select(
        *keys,
        *(F.coalesce(F.col(f"e.{c}"), F.col(f"i.{c}")).alias(c) for c in keep),
        *(F.coalesce(F.col(f"i.{c}"), F.col(f"e.{c}")).alias(c) for c in take),
        *(F.sort_array(F.array_union(empty(F.col(f"e.{c}")), empty(F.col(f"i.{c}")))).alias(c) for c in union),
    )
