"""Nearest-price competitors and verified facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.joins import join_small
from shelfspark.functions.ranks import ranks
from shelfspark.functions.text import blank_to_null, parse_price


def competitors(members: DataFrame, n: int = 3) -> DataFrame:
    """members (cluster, product_id, member_pos, price text) -> (cluster, product_id, rank, competitor_id, distance).

    Exact and close to linear: the n nearest of a product lie in its own price group or in the n next distinct prices on
    either side, and of each price only the first n + 1 members can be among them. Prices are ranked over distinct
    prices, by ranges where a cluster has very many, so a hot cluster costs its distinct prices, not its rows, and no task
    holds them all. Products without a price come last, in order, where a cluster has too few with one."""
    rows = members.select("cluster", "product_id", "member_pos", parse_price(F.col("price")).alias("p"))
    priced = rows.where("p is not null")
    grid = ranks(priced.select("cluster", "p").distinct(), "cluster", ["p"], "level")
    first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("member_pos"))
    cand = priced.withColumn("__r", first(["cluster", "p"])).where(F.col("__r") <= n + 1).join(grid, ["cluster", "p"])
    cand = cand.select("cluster", "level", F.col("product_id").alias("competitor_id"), F.col("member_pos").alias("cpos"), F.col("p").alias("cp"))
    target = priced.join(grid, ["cluster", "p"]).select("cluster", "product_id", "p", F.explode(F.sequence(F.col("level") - n, F.col("level") + n)).alias("level"))
    near = target.join(cand, ["cluster", "level"]).where("product_id <> competitor_id").select("cluster", "product_id", "competitor_id", "cpos", F.abs(F.col("p") - F.col("cp")).alias("distance"))
    # the first unpriced members stand at no distance, behind all others
    loose = rows.where("p is null").withColumn("__r", first(["cluster"])).where(F.col("__r") <= n + 1).select("cluster", F.col("product_id").alias("competitor_id"), F.col("member_pos").alias("cpos"))
    few = priced.groupBy("cluster").count().where(F.col("count") <= n).select("cluster")
    after = join_small(priced.join(few, "cluster", "left_semi"), loose, "cluster").select("cluster", "product_id", "competitor_id", "cpos", F.lit(None).cast("double").alias("distance"))
    head = rows.withColumn("__r", first(["cluster"])).where(F.col("__r") <= n + 1).select("cluster", F.col("product_id").alias("competitor_id"), F.col("member_pos").alias("cpos"))
    lost = join_small(rows.where("p is null"), head, "cluster").where("product_id <> competitor_id").select("cluster", "product_id", "competitor_id", "cpos", F.lit(None).cast("double").alias("distance"))
    order = Window.partitionBy("cluster", "product_id").orderBy(F.col("distance").asc_nulls_last(), "cpos")
    return near.unionByName(after).unionByName(lost).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("cluster", "product_id", "rank", "competitor_id", "distance")


def verified_attributes(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """(product_id, attr, value, ord): non-blank attributes and, behind them, the catalog price."""
    own = attributes.where(blank_to_null(F.col("value")).isNotNull()).select("product_id", "attr", "value", "ord")
    price = products.where(blank_to_null(F.col("price")).isNotNull()).select("product_id", F.lit("catalog_price").alias("attr"), F.col("price").alias("value"), F.lit(1_000_000).cast("long").alias("ord"))
    return own.unionByName(price)


#: Fixed text.
UNVERIFIED = "No agent content was generated because this product has no verified normalized attributes."


def gate_unverified(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Products without any non-blank attribute, with the one line that flags them."""
    has = attributes.where(blank_to_null(F.col("value")).isNotNull()).select("product_id").distinct()
    return products.join(has, "product_id", "left_anti").select("product_id", F.array(F.lit(UNVERIFIED)).alias("unsupported_claims"))


SCHEMA_VERSION = 3


def default_content(content: DataFrame, lists: list[str]) -> DataFrame:
    """Null lists become empty ones; the version is stamped."""
    return content.withColumns({c: F.coalesce(F.col(c), F.array().cast(content.schema[c].dataType)) for c in lists} | {"schema_version": F.lit(SCHEMA_VERSION)})
