"""Places of rows in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

_PART = 33  # bits of monotonically_increasing_id() below the partition's number


def numbered(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """rows and `at`, their place (gapless from 0) in ascending order of keys; as a table.

    rows: a scan or a table, with narrow steps only, so that a lost task makes the same rows again. Rows are dealt by
    ranges of keys and, among equal keys, of their place in the input, so that a hot key is split over tasks; places inside
    a range are written with the rows, and the sizes of the ranges (one row a range) give what stands before each."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(n, *keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    placed = stage(dealt.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("__at", _PART)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).toLocalIterator())
    before, starts = 0, []
    for p, size in sizes:
        starts.append((p, before))
        before += size
    offsets = spark.createDataFrame(starts, "__part long, __before long")
    joined = placed.join(F.broadcast(offsets), part == F.col("__part"))
    at = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _PART) - 1))
    out = joined.withColumn("at", at).drop("__at", "__part", "__before")
    out._staged_at = placed._staged_at
    return out
