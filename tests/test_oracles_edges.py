"""Catalog queries against their SQL on small tables with what only larger tables have."""

import pytest
from pyspark.sql import functions as F
from test_oracles import TABLES, normal

from shelfspark.functions import text as T
from shelfspark.operators import normalize, retrieval
from shelfspark.plans import registry


def same_as_sql(spark, sf_dir, folder, name, table, rows):
    """Both results on rows in the place of one table; that of Spark."""
    import duckdb

    rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{f'{folder}/{t}.parquet/*.parquet' if t == table else f'{sf_dir}/{t}.parquet'}'")
    ours, theirs = registry.QUERIES[name](spark, str(folder)).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)
    return ours


@pytest.mark.parametrize("first", [0, 1000, 998_990, 999_990, 1_199_980, 999_999_990])
def test_numbers_of_any_size(spark, sf_dir, tmp_path, first):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 20").withColumn("p_partkey", F.col("p_partkey") + first)
    assert len(same_as_sql(spark, sf_dir, tmp_path, "f0_number_parsers", "part", rows)) == 20


def test_parsers_with_two_commas(spark):
    row = spark.range(1).select(*[f(F.lit("S$ 1,299,000.5")) for f in (T.comparison_number, T.fit_number, T.constraint_number, T.parse_price)]).first()
    assert tuple(row) == (1299000.5, 1.0, 1299000.5, 1299000.5)


def test_pieces_of_short_texts(spark, sf_dir, tmp_path):
    texts = [None, "", "A.", "Erö.", "This.", "The     \n ", "The null", "Is. N/A", "a ZQ-9 zq b", "ZQ9Z", "Éç Éç Éç Éç", "x" * 50, "Σ\U0001f600 İΣ \u00a0ß K"]
    rows = spark.createDataFrame([(4 * i + j, t) for i, t in enumerate(texts) for j in range(4)], "doc_id long, text string")
    got = same_as_sql(spark, sf_dir, tmp_path, "n6_verify_attributes", "documents", rows)
    assert got["verdict"].value_counts().to_dict() == {"kept": 2 * len(texts) + 1, "skipped": len(texts), "rejected": len(texts) - 1}


def test_blank_candidates_are_skipped(spark):
    cases = {None: "skipped", "": "skipped", " \n": "skipped", "None": "skipped", " n/a ": "skipped", '""': "kept", '"a-b"': "kept", "ab c": "rejected"}
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "product_id long, value string")
    got = normalize.verify_attributes(rows, rows.select("product_id", F.lit("A. B").alias("raw"))).orderBy("product_id").collect()
    assert [r["verdict"] for r in got] == list(cases.values())


def test_queries_numbered_like_a_bound(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 3").withColumn("vec_id", F.col("vec_id") * 50)
    rows = rows.unionByName(rows.withColumn("vec_id", F.col("vec_id") + 2950)).unionByName(rows.withColumn("vec_id", F.col("vec_id") + 300_000))
    assert len(same_as_sql(spark, sf_dir, tmp_path, "q7_sanitize", "embeddings", rows)) == 36


def test_named_bound_stays(spark):
    queries = spark.createDataFrame([(0, "query 3000 under 400"), (1, "query 30000 under 13000")], "query_id int, query string")
    rows = queries.selectExpr("query_id", "0 as pos", "'a' as requirement", "'price' as normalized_attribute", "'lte' as operator", "'3000' as value", "'USD' as unit", "'hard' as strength", "'' as source_text")
    got = retrieval.sanitize_constraints(rows, queries).orderBy("query_id").collect()
    assert [(r["operator"], r["value"], r["strength"]) for r in got] == [("lte", "3000", "hard"), ("exists", None, "preference")]
