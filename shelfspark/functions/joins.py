"""Joins whose broadcast is decided by the size of a side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast, and the bytes that they have as JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """At most so many rows and bytes, nulls counting as nothing. Only the length of a row leaves its task."""
    each = df.select(F.octet_length(F.to_json(F.struct("*"))).cast("long").alias("size")).limit(rows + 1)
    found = each.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= size


def join_small(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join. right is broadcast only if it has at most `bound` rows and BROADCAST_BYTES bytes; beyond that Spark
    shuffles both sides."""
    return left.join(F.broadcast(right) if is_small(right, bound) else right, on, how)
