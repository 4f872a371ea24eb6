"""Presence of attributes, completeness of products and clusters, persona coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.joins import join_small
from shelfspark.functions.text import blank_to_null, half_even, ordered_list


def attribute_presence(members: DataFrame, schema: DataFrame, applicability: DataFrame, attributes: DataFrame, products: DataFrame, fallback: bool = True) -> DataFrame:
    """(cluster, product_id, attr, attr_pos, applies, present) for each member and schema attribute.

    A product with any normalized attribute is looked up exactly. One with none (only if `fallback`) has an attribute if a
    spec key holds the attribute's name or the reverse, or the description holds it. products: (product_id, spec_keys
    array, description)."""
    value = attributes.where(blank_to_null(F.col("value")).isNotNull()).groupBy("product_id").agg(F.collect_set("attr").alias("__has"))
    any_row = attributes.groupBy("product_id").agg(F.count("*").alias("__n"))
    rows = members.join(applicability.select("product_id", "applicable"), "product_id", "left").join(value, "product_id", "left").join(any_row, "product_id", "left").join(products.select("product_id", "spec_keys", "description"), "product_id", "left")
    wide = join_small(rows, schema, "cluster")
    name = F.lower("attr")
    guess = F.exists(F.coalesce("spec_keys", F.array().cast("array<string>")), lambda k: F.lower(k).contains(name) | name.contains(F.lower(k))) | F.coalesce(F.lower("description").contains(name), F.lit(False))
    exact = F.coalesce(F.array_contains("__has", F.col("attr")), F.lit(False))
    found = F.when(F.col("__n").isNotNull() | F.lit(not fallback), exact).otherwise(guess)
    applies = F.col("applicable").isNull() | F.array_contains("applicable", F.col("attr"))
    return wide.select("cluster", "product_id", "member_pos", "attr", "attr_pos", applies.alias("applies"), (applies & found).alias("present"))


def percent(part: Column, whole: Column) -> Column:
    """round(100 part / whole, 1), ties to even; 100 if there is nothing to have."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(half_even(100.0 * part / whole, 1))


def product_completeness(presence: DataFrame) -> DataFrame:
    names = lambda c: ordered_list([F.col("attr_pos")], F.when(c, F.col("attr")))
    has = presence.groupBy("cluster", "product_id").agg(
        names(F.col("applies") & F.col("present")).alias("present"), names(F.col("applies") & ~F.col("present")).alias("missing"), names(~F.col("applies")).alias("not_applicable"),
    )
    return has.withColumn("pct", percent(F.size("present"), F.size("present") + F.size("missing")))


def missing_counts(presence: DataFrame) -> DataFrame:
    return presence.groupBy("cluster", "attr").agg(F.count_if(F.col("applies") & ~F.col("present")).alias("missing"))


def cluster_completeness(products: DataFrame) -> DataFrame:
    """Mean of the rounded product percentages; summed as decimals, so the order of rows doesn't matter."""
    return products.groupBy("cluster").agg(half_even(F.sum(F.col("pct").cast("decimal(10,1)")).cast("double") / F.count("*"), 1).alias("completeness"))


def present_anywhere(presence: DataFrame) -> DataFrame:
    return presence.where("present").select("cluster", "attr").distinct()


def persona_rating(personas: DataFrame, presence: DataFrame) -> DataFrame:
    """Mean over products of the share of a persona's supporting expected attributes that are present, in percent."""
    wanted = personas.select("cluster", "persona_id", F.explode(F.array_distinct("supporting")).alias("attr"))
    per = wanted.join(presence, ["cluster", "attr"]).groupBy("cluster", "persona_id", "product_id").agg((F.count_if("present") / F.count("*")).alias("share"))
    mean = per.groupBy("cluster", "persona_id").agg(half_even(100.0 * F.sum(F.col("share").cast("decimal(20,12)")).cast("double") / F.count("*"), 1).alias("rating"))
    return personas.join(mean, ["cluster", "persona_id"], "left").withColumn("rating", F.coalesce("rating", F.lit(0.0)))


def persona_coverage(personas: DataFrame, presence: DataFrame) -> DataFrame:
    there = present_anywhere(presence).groupBy("cluster").agg(F.collect_set("attr").alias("__there"))
    any_ = F.coalesce("__there", F.array().cast("array<string>"))
    return personas.join(there, "cluster", "left").withColumn("covered", F.array_intersect("supporting", any_)).withColumn("missing", F.array_except("supporting", any_)).drop("__there")


def pick_persona(personas: DataFrame) -> DataFrame:
    """One persona per cluster: a selected one, else the highest rating, else the first."""
    best = Window.partitionBy("cluster").orderBy(F.coalesce("selected", F.lit(False)).desc(), F.col("rating").desc(), "pos")
    return personas.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
