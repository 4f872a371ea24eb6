"""Catalog summary and suggested shopper queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import blank_to_null, ordered_list

from .gaps import first_members

#: The fixed example questions, which are never suggested.
EXAMPLES = [
    "I'm training for a half marathon in Singapore's humid weather and need lightweight shoes under S$200.",
    "Find me a sustainable skincare routine for oily skin that takes less than 5 minutes every morning.",
]


def catalog_summary(members: DataFrame, products: DataFrame, schema: DataFrame, missing: DataFrame, personas: DataFrame) -> DataFrame:
    """Per cluster: products, prices among the first 8 members, expected and missing attributes, shopper intents."""
    size = members.groupBy("cluster").agg(F.count("*").alias("product_count"))
    prices = first_members(members).join(products.select("product_id", "price"), "product_id").groupBy("cluster").agg(ordered_list([F.col("member_pos")], blank_to_null(F.col("price"))).alias("sample_prices"))
    attrs = schema.groupBy("cluster").agg(ordered_list([F.col("attr_pos")], F.col("attr")).alias("available_attributes"))
    lacks = missing.where("missing > 0").join(schema, ["cluster", "attr"]).groupBy("cluster").agg(ordered_list([F.col("attr_pos")], F.col("attr")).alias("missing_attributes"))
    told = personas.groupBy("cluster").agg(ordered_list([F.col("pos")], F.coalesce(F.nullif(F.col("narrative_seed"), F.lit("")), F.col("title"))).alias("shopper_intents"))
    return size.join(prices, "cluster", "left").join(attrs, "cluster", "left").join(lacks, "cluster", "left").join(told, "cluster", "left")


def clean_queries(df: DataFrame, most: int = 3) -> DataFrame:
    """df (group, pos, query): trimmed, blanks dropped, the first `most` of a group, the fixed examples dropped."""
    rows = df.withColumn("query", blank_to_null(F.col("query"))).where("query is not null")
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("group").orderBy("pos"))).where(F.col("__r") <= most).drop("__r")
    return rows.where(~F.col("query").isin(EXAMPLES))
