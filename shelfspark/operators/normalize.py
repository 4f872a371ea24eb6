"""Schemas, applicability, candidate attributes and their verbatim check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import blank_to_null, canonical, ordered_list, snake_case, strip

MOST_ATTRIBUTES, MOST_SAMPLES = 12, 8


def clean_schema(schema: DataFrame) -> DataFrame:
    """schema (cluster, attr, attr_pos): trimmed, blanks dropped, the first 12."""
    kept = schema.withColumn("attr", blank_to_null(F.col("attr"))).where("attr is not null")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("attr_pos"))
    return kept.withColumn("__r", rank).where(F.col("__r") <= MOST_ATTRIBUTES).drop("__r")


def expected_attributes(schema: DataFrame, fallback: DataFrame) -> DataFrame:
    return schema.unionByName(fallback.join(schema.select("cluster").distinct(), "cluster", "left_anti"))


def validate_applicability(answers: DataFrame, schema: DataFrame, members: DataFrame) -> DataFrame:
    """answers (product_id, attrs) -> (product_id, applicable): schema names in schema order; if any product of a cluster
    has no answer, the whole cluster has none (null: all apply)."""
    names = schema.groupBy("cluster").agg(ordered_list([F.col("attr_pos")], F.col("attr")).alias("__schema"))
    joined = members.join(answers.groupBy("product_id").agg(F.first("attrs").alias("attrs")), "product_id", "left").join(names, "cluster", "left")
    complete = members.join(answers, "product_id", "left").groupBy("cluster").agg(F.bool_and(F.col("attrs").isNotNull()).alias("__all"))
    return joined.join(complete, "cluster").select("cluster", "product_id", F.when(F.col("__all"), F.filter("__schema", lambda a: F.array_contains("attrs", a))).alias("applicable"))


def align_candidates(answers: DataFrame, batches: DataFrame, schema: DataFrame) -> DataFrame:
    """answers (batch, index, pos, attr, value), batches (batch, index, product_id, cluster): the last answer for a product
    and attribute, schema names only."""
    last = answers.join(batches, ["batch", "index"]).groupBy("cluster", "product_id", "attr").agg(F.max_by("value", "pos").alias("value"), F.max("pos").alias("ord"))
    return last.join(schema.select("cluster", "attr"), ["cluster", "attr"], "left_semi")


def raw_text(products: DataFrame, specs: DataFrame) -> DataFrame:
    """(product_id, raw): name, description and `key value` of all specs."""
    told = specs.groupBy("product_id").agg(F.array_join(ordered_list([F.col("ord")], F.concat_ws(" ", "key", "value")), " ").alias("__s"))
    return products.join(told, "product_id", "left").select("product_id", F.concat_ws(" ", "name", "description", "__s").alias("raw"))


def verify_attributes(candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """Adds verdict: kept, rejected or skipped. A value counts if its canonical form stands in the canonical source text
    (built once per product); one shorter than two characters is kept; blanks and `null`, `none`, `n/a` are skipped."""
    source = raw.select("product_id", canonical(F.col("raw")).alias("__raw"))
    value = canonical(F.col("value"))
    blank = F.coalesce(F.lower(strip(F.col("value"))).isin("", "null", "none", "n/a"), F.lit(True))
    kept = (F.length(value) < 2) | F.coalesce(F.col("__raw").contains(value), F.lit(False))
    return candidates.join(source, "product_id", "left").withColumn("verdict", F.when(blank, "skipped").when(kept, "kept").otherwise("rejected")).drop("__raw")


def normalization_stats(members: DataFrame, verified: DataFrame, applicability: DataFrame, failed: DataFrame, schema: DataFrame) -> DataFrame:
    """Per cluster: schema size, products, products with a kept value, rejected values, failed batches, applicability."""
    size = schema.groupBy("cluster").agg(F.count("*").alias("schema_size"))
    of = members.groupBy("cluster").agg(F.count("*").alias("total"))
    values = members.join(verified, "product_id").groupBy("cluster").agg(F.count_distinct(F.when(F.col("verdict") == "kept", F.col("product_id"))).alias("with_values"), F.count_if(F.col("verdict") == "rejected").alias("rejected"))
    applies = applicability.groupBy("cluster").agg(F.bool_and(F.col("applicable").isNotNull()).alias("applicability"))
    bad = failed.groupBy("cluster").agg(F.count_if(~F.col("ok")).alias("failed_batches"))
    joined = of.join(size, "cluster", "left").join(values, "cluster", "left").join(applies, "cluster", "left").join(bad, "cluster", "left")
    return joined.na.fill(0, ["schema_size", "with_values", "rejected", "failed_batches"]).na.fill(False, ["applicability"])


def batch_status(answers: DataFrame) -> DataFrame:
    """answers (cluster, batch, attempt, ok): a batch is done if one of its first two attempts is valid."""
    return answers.where("attempt <= 2").groupBy("cluster", "batch").agg(F.bool_or("ok").alias("ok"), F.count("*").alias("attempts"))


def segment_candidates(specs: DataFrame) -> DataFrame:
    """specs (product_id, ord, key, value) -> candidates of `Key: value | Key: value` texts, keys in snake case."""
    parts = specs.select("product_id", "ord", F.posexplode(F.split("value", r"\|")).alias("part", "t"))
    key, value = F.regexp_extract("t", r"^([^:]+):(.*)$", 1), F.regexp_extract("t", r"^([^:]+):(.*)$", 2)
    return parts.where(F.col("t").rlike(r"^[^:]+:")).select("product_id", snake_case(key).alias("attr"), strip(value).alias("value"), (F.col("ord") * 1000 + F.col("part")).alias("ord"))


def example_values(attributes: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, attr, example): the first member's value."""
    return attributes.where("value is not null").join(members, "product_id").groupBy("cluster", "attr").agg(F.min_by("value", F.struct("member_pos", "ord")).alias("example"))


def available_attributes(facts: DataFrame) -> DataFrame:
    """facts (attr, value, pos) -> (attr, samples): distinct non-blank values, first seen first, at most 8."""
    seen = facts.where(blank_to_null(F.col("value")).isNotNull()).groupBy("attr", "value").agg(F.min("pos").alias("pos"))
    ranked = seen.withColumn("__r", F.row_number().over(Window.partitionBy("attr").orderBy("pos", "value"))).where(F.col("__r") <= MOST_SAMPLES)
    return ranked.groupBy("attr").agg(ordered_list([F.col("__r")], F.col("value")).alias("samples"))
