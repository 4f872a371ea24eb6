"""Places and ranks without a window over a whole table or a very large group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import ordered_list
from shelfspark.tables import Work

#: Rows of a group that are ranked in one window.
WINDOW_ROWS = 1_000_000
_PART = 33  # bits of monotonically_increasing_id() below the partition's number


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df and its rows' places (gapless from 0) in ascending order; as a table.

    Rows are dealt by ranges of the order and, among equals, of their place in df, so a hot value is split. Places inside a
    range are written with the rows; the sizes of the ranges, a row each, give what stands before a range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    with Work(spark, "positions") as work:
        placed = work.result(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", _PART)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).toLocalIterator())
    before, starts = 0, []
    for p, size in sizes:
        starts.append((p, before))
        before += size
    offsets = spark.createDataFrame(starts, "__part long, __before long")
    at = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _PART) - 1))
    return placed.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, at).drop("__at", "__part", "__before")


def ranks(df: DataFrame, group: str | list[str], order: list[str], name: str, above: int | None = None) -> DataFrame:
    """df and the rank (from 0) of each row in its group. Groups of up to `above` rows are a window each; larger ones,
    whose number is bounded by that, are dealt by ranges of (group, order), and a rank is the place of a row less the
    place of its group's first. Null is a group."""
    above = WINDOW_ROWS if above is None else above
    by = [group] if isinstance(group, str) else group
    mine = [f"__group{i}" for i in range(len(by))]
    large = df.groupBy(*by).count().where(F.col("count") > above).select(*[F.col(c).alias(m) for c, m in zip(by, mine, strict=True)])
    few = large.limit(1_001).collect()
    window = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")
    if not few:
        return df.withColumn(name, window)

    def same(rows: DataFrame, others: DataFrame) -> Column:
        every = [rows[c].eqNullSafe(others[m]) for c, m in zip(by, mine, strict=True)]
        return reduce(Column.__and__, every)

    listed = F.broadcast(large) if len(few) <= 1_000 else large
    rest = df.join(listed, same(df, large), "left_anti").withColumn(name, window)
    placed = positions(df.join(listed, same(df, large), "left_semi"), [*(F.col(c).asc_nulls_first() for c in by), *(F.col(c) for c in order)], "__place")
    first = placed.groupBy(*[F.col(c).alias(m) for c, m in zip(by, mine, strict=True)]).agg(F.min("__place").alias("__first"))
    some = placed.join(F.broadcast(first) if len(few) <= 1_000 else first, same(placed, first)).withColumn(name, F.col("__place") - F.col("__first"))
    return rest.unionByName(some.drop("__place", "__first", *mine))


def chunks(df: DataFrame, group: list[str], order: list[str], line: str, joiner: str, size: int) -> DataFrame:
    """(group, chunk, n, text): lines of each group in order, `size` to a row, joined. Lines that are null are not there."""
    ranked = ranks(df.where(F.col(line).isNotNull()), group, order, "__rank")
    rows = ranked.withColumn("chunk", F.floor(F.col("__rank") / size).cast("long"))
    return rows.groupBy(*group, "chunk").agg(F.count("*").alias("n"), F.array_join(ordered_list([F.col("__rank")], F.col(line)), joiner).alias("text"))
