"""Broadcast by rows and by bytes."""

from pyspark.sql import functions as F

from shelfspark.functions import joins


def test_is_small_counts_rows_and_bytes(spark):
    rows = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 1000))
    assert joins.is_small(rows, 100)
    assert not joins.is_small(rows, 99)
    assert not joins.is_small(rows, 100, 100_000)  # 1,000 and more bytes a row
    assert joins.is_small(rows.select("id"), 100, 2_000)
    assert joins.is_small(rows.where("false"), 0, 0)


def test_long_texts_are_shuffled(spark, monkeypatch):
    left = spark.range(10).withColumnRenamed("id", "k")
    right = spark.range(10).select(F.col("id").alias("k"), F.repeat(F.lit("é"), 100).alias("text"), F.lit(None).alias("none"), F.array(F.lit(1.5)).alias("xs"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(joins.join_small(left, right, "k"))
    monkeypatch.setattr(joins.is_small, "__defaults__", (joins.BROADCAST_ROWS, 1_500))
    joined = joins.join_small(left, right, "k")
    assert "broadcast" not in plan(joined) and joined.count() == 10
