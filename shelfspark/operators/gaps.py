"""Work orders for missing data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.ranks import chunks
from shelfspark.functions.text import blank_to_null, half_even, ordered_list

#: Names of a row of a work order; the others follow in rows of missing_names.
NAMES = 1_000
#: Fixed text where no criterion gives a reason.
DEFAULT_REASON = "Expected for this category by buyers and shopping agents"


def attribute_reasons(personas: DataFrame, criteria: DataFrame) -> DataFrame:
    """(cluster, attr, reason): distinct `title: rationale` of criteria with a rationale, in persona and criterion order."""
    told = criteria.where(blank_to_null(F.col("rationale")).isNotNull()).join(personas.select("cluster", "persona_id", "title", F.col("pos").alias("ppos")), "persona_id")
    line = told.select("cluster", F.col("attribute").alias("attr"), F.concat_ws(": ", "title", "rationale").alias("line"), F.struct("ppos", "pos").alias("at"))
    first = line.groupBy("cluster", "attr", "line").agg(F.min("at").alias("at"))
    return first.groupBy("cluster", "attr").agg(F.array_join(ordered_list([F.col("at")], F.col("line")), " | ").alias("reason"))


def missing_names(presence: DataFrame, names: DataFrame, size: int = NAMES) -> DataFrame:
    """(cluster, attr, chunk, n, missing_products): names of the products that lack an attribute, by member position, `size` to
    a row. Joined in the order of chunk they are the whole list, whatever its length."""
    rows = presence.where("applies and not present").join(names, "product_id").select("cluster", "attr", "member_pos", "product_id", "name")
    return chunks(rows, ["cluster", "attr"], ["member_pos", "product_id"], "name", ", ", size).withColumnRenamed("text", "missing_products")


def attribute_requests(presence: DataFrame, names: DataFrame, reasons: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """Per cluster and attribute with a gap: products it applies to, missing count and percentage, the reason and product
    names. presence without the fallback; names (product_id, name). first: names of the first so many products only, for
    rows of bounded size (missing_names has all); by default all names."""
    rows = presence.where("applies").join(names, "product_id")
    lacks = ~F.col("present")
    listed = [] if first is not None else [F.array_join(ordered_list([F.col("member_pos")], F.when(lacks, F.col("name"))), ", ").alias("missing_products")]
    of = rows.groupBy("cluster", "attr").agg(F.count("*").alias("applicable"), F.count_if(lacks).alias("missing"), *listed).where("missing > 0")
    if first is not None:
        of = of.join(missing_names(presence, names, first).where("chunk = 0").select("cluster", "attr", "missing_products"), ["cluster", "attr"], "left")
    told = of.join(reasons, ["cluster", "attr"], "left") if reasons is not None else of.withColumn("reason", F.lit(None).cast("string"))
    return told.select("cluster", "attr", "applicable", "missing", half_even(100.0 * F.col("missing") / F.col("applicable"), 1).alias("missing_pct"), F.coalesce("reason", F.lit(DEFAULT_REASON)).alias("reason"), F.coalesce("missing_products", F.lit("")).alias("missing_products"))


def product_requests(presence: DataFrame, names: DataFrame) -> DataFrame:
    rows = presence.where("applies").groupBy("cluster", "product_id").agg(
        F.count("*").alias("applicable"), F.count_if(~F.col("present")).alias("missing"),
        F.array_join(ordered_list([F.col("attr_pos")], F.when(~F.col("present"), F.col("attr"))), ", ").alias("missing_attributes"),
    ).where("missing > 0")
    return rows.join(names, "product_id").select("cluster", "product_id", "name", "applicable", "missing", half_even(100.0 * F.col("missing") / F.col("applicable"), 1).alias("missing_pct"), "missing_attributes")


def gap_headline(by_attribute: DataFrame, by_product: DataFrame, members: DataFrame) -> DataFrame:
    """One row: open attribute rows, products with a gap, all products, and the worst attribute."""
    worst = by_attribute.orderBy(F.col("missing").desc(), "cluster", "attr").limit(1).select(F.col("cluster").alias("worst_cluster"), F.col("attr").alias("worst_attr"), F.col("missing").alias("worst_missing"))
    one = by_attribute.agg(F.count("*").alias("attribute_rows")).crossJoin(by_product.agg(F.count("*").alias("product_rows"))).crossJoin(members.agg(F.count("*").alias("products")))
    return one.join(worst, F.lit(True), "left")


def first_members(members: DataFrame, n: int = 8) -> DataFrame:
    """The first n members of each cluster; the window's top-n filter keeps at most n rows a cluster and task before the
    shuffle."""
    return members.withColumn("__r", F.row_number().over(Window.partitionBy("cluster").orderBy("member_pos"))).where(F.col("__r") <= n).drop("__r")
