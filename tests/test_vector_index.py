"""The pruned vector index against a full scan."""

import numpy as np
import pytest

from shelfspark.operators import retrieval, vector_index
from shelfspark.tables import Work


def rows_of(seed, n, groups, width=8, spread=0.15):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(groups, width))
    x = middle[draw.integers(0, groups, n)] + spread * draw.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, sides):
    return spark.createDataFrame([(s, k, v.tolist()) for s, x in sides.items() for k, v in enumerate(x)], "side string, key long, vec array<float>")


def asked(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, vec array<float>")


def full_scan(sides, queries, k):
    out = set()
    for s, x in sides.items():
        scores = np.round(queries.astype(np.float64) @ x.astype(np.float64).T, 4)
        for i, row in enumerate(scores):
            for rank, j in enumerate(sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]):
                out.add((i, s, j, float(row[j]), rank + 1))
    return out


def found(df):
    return {(r["query_id"], r["side"], r["key"], r["score"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("lists", [1, 12])
def test_search_equals_a_full_scan(spark, monkeypatch, lists):
    monkeypatch.setattr(vector_index, "CHUNK", 50)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 4)
    sides = {"before": rows_of(1, 400, 10), "after": rows_of(2, 300, 10)}
    sides["after"][100:160] = sides["after"][99]  # ties
    queries = np.concatenate([rows_of(3, 10, 5), sides["after"][99:101], np.zeros((1, 8), np.float32)])
    assert found(retrieval.search(asked(spark, queries), frame(spark, sides), 7, lists)) == full_scan(sides, queries, 7)


def test_bounds_leave_lists_out_and_more_queries_read_no_more(spark):
    sides = {"before": rows_of(4, 2000, 16, spread=0.05)}
    queries = rows_of(4, 80, 16, spread=0.05)
    few, many = [], []
    with Work(spark, "test") as work:
        index = vector_index.build(work, frame(spark, sides), 16)
        one = found(vector_index.top_k(work, asked(spark, queries[:20]), index, 5, few))
        four = found(vector_index.top_k(work, asked(spark, queries), index, 5, many))
    assert one == full_scan(sides, queries[:20], 5) and four == full_scan(sides, queries, 5)
    assert sum(v["scored"] for v in few) < 0.5 * 20 * 2000  # most rows are never scored
    assert sum(v["read"] for v in many) < 2 * sum(v["read"] for v in few)  # four times the queries


def test_odd_inputs(spark):
    none = frame(spark, {})
    assert retrieval.search(asked(spark, rows_of(1, 2, 1)), none).count() == 0
    assert retrieval.search(asked(spark, []), frame(spark, {"a": rows_of(1, 5, 1)})).count() == 0
    same = frame(spark, {"a": np.repeat(rows_of(1, 1, 1), 30, axis=0)}).withColumn("key", __import__("pyspark").sql.functions.lit(7))
    got = retrieval.search(asked(spark, rows_of(1, 1, 1)), same, 4).collect()
    assert [r["key"] for r in got] == [7] * 4 and sorted(r["rank"] for r in got) == [1, 2, 3, 4]


def test_working_tables_go(spark):
    import os

    with Work(spark, "gone") as work:
        table = work.table(spark.range(5), "numbers")
        kept = work.result(table.where("id > 2"))
        assert os.path.isdir(work.folder.removeprefix("file://"))
    assert not os.path.isdir(work.folder.removeprefix("file://")) and kept.count() == 2
