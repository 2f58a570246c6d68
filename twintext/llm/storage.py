"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintext.stages import discard, materialise, new_path, scratch, shared_dir, sieved

__all__ = ["BROADCAST_BYTES", "discard", "join_checked", "materialise", "new_path", "per_shard", "scratch", "shared_dir", "sieved"]

#: Most bytes of a table that is sent to every executor.
BROADCAST_BYTES = 32 << 20


def join_checked(
    rows: DataFrame, table: DataFrame, keys: list[str], beyond: Callable[[], DataFrame] | None = None,
    how: str = "inner", row_bytes: Column | int = 64,
) -> DataFrame:
    """Joins a materialised table: broadcast up to ``BROADCAST_BYTES``, else ``beyond()`` or a shuffle."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = table.agg(F.sum(size.cast("long"))).first()[0] or 0
    if total <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), keys, how)
    return beyond() if beyond else rows.join(table, keys, how)


def per_shard(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Joins per-group values to rows that have ``keys`` and ``__shard``.

    The groups are first dealt to the shards in which they occur, so no key
    gathers more rows in a task than one shard holds.
    """
    dealt = rows.select(*keys, "__shard").distinct().join(groups, keys)
    return rows.join(dealt, [*keys, "__shard"])
