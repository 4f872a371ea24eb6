"""The answer store over three runs."""

from pyspark.sql import functions as F

from shelfspark.operators import model_io
from shelfspark.operators.answers import AnswerStore


def test_three_runs(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    asked = spark.range(300).select(F.concat(F.lit("k"), F.col("id") % 200).alias("cache_key"), F.col("id"))
    sent = []
    for run in range(3):  # each run opens the store anew
        store = AnswerStore(spark, path, 4)
        known, missing = model_io.split_cached(asked, store.latest())
        sent.append(missing.count())
        assert known.count() == (0 if run == 0 else 300)
        assert store.record(missing.select("cache_key", F.concat(F.lit("a"), F.col("cache_key")).alias("answer"))) == min(run, 1) + 1
        store.close()
    assert sent == [200, 0, 0]


def test_latest_wins_also_after_compaction(spark, tmp_path):
    store = AnswerStore(spark, f"file://{tmp_path}/store", 4)
    say = lambda *rows: spark.createDataFrame(rows, "cache_key string, answer string")
    store.record(say(("a", "1"), ("b", "1"), (None, "1")))
    store.record(say(("b", "2"), ("c", "2"), ("c", "3")))
    held = lambda: {r["cache_key"]: r["answer"] for r in store.latest().collect()}
    assert held() == {"a": "1", "b": "2", "c": "3"}
    for _ in range(3):
        store.compact()
        assert held() == {"a": "1", "b": "2", "c": "3"} and spark.table(store._table).count() == 3
    assert store.record(say(("a", "4"))) == 3 and held()["a"] == "4"


def test_a_lookup_does_not_shuffle_the_store(spark, tmp_path):
    store = AnswerStore(spark, f"file://{tmp_path}/store", 4)
    store.record(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), F.lit("x").alias("answer")))
    asked = spark.range(50).select(F.sha2((F.col("id") * 7).cast("string"), 256).alias("cache_key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known, _ = model_io.split_cached(asked.repartition(3), store.latest())
        plan = known._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert known.count() == 50 and plan.count("Exchange hashpartitioning") == 1
