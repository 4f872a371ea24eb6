"""Rule-based fit of products to personas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.joins import join_small
from shelfspark.functions.text import blank_to_null, fit_number, half_even, ordered_list, strip

#: Operator names and their other spellings (fixed values).
ALIASES = {"<": "lt", "<=": "lte", ">": "gt", ">=": "gte", "=": "eq", "==": "eq", "!=": "neq"}
OPERATORS = ["present", "lt", "lte", "gt", "gte", "in", "contains", "eq", "neq"]
MOST_CRITERIA = 5


def operator_name(x: Column) -> Column:
    t = F.lower(strip(x))
    names = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    return F.coalesce(F.try_element_at(names, t), t)


def clean_criteria(criteria: DataFrame, personas: DataFrame, schema: DataFrame) -> DataFrame:
    """Known operators on schema attributes, the first five per persona."""
    known = criteria.withColumn("operator", operator_name(F.col("operator"))).where(F.col("operator").isin(OPERATORS))
    placed = known.join(personas.select("persona_id", "cluster"), "persona_id")
    valid = placed.join(schema.select("cluster", F.col("attr").alias("attribute")), ["cluster", "attribute"], "left_semi")
    return valid.withColumn("__r", F.row_number().over(Window.partitionBy("persona_id").orderBy("pos"))).where(F.col("__r") <= MOST_CRITERIA).drop("__r")


def verdict(operator: Column, wanted: Column, options: Column, value: Column) -> Column:
    """True, false, or null where it cannot be said."""
    have, low, want = fit_number(value), F.lower(strip(value)), F.lower(strip(wanted))
    limit = fit_number(wanted)
    numeric = F.when(operator == "lt", have < limit).when(operator == "lte", have <= limit).when(operator == "gt", have > limit).when(operator == "gte", have >= limit)
    choices = F.coalesce(options, F.array(wanted))
    return (
        F.when(blank_to_null(value).isNull(), F.lit(None).cast("boolean"))
        .when(operator == "present", F.lit(True))
        .when(operator.isin("lt", "lte", "gt", "gte"), numeric)
        .when(operator == "in", F.array_contains(F.transform(choices, lambda o: F.lower(strip(o))), low))
        .when(operator == "contains", low.contains(want))
        .when(operator == "eq", low == want)
        .when(operator == "neq", low != want)
    )


def check_criterion(criteria: DataFrame, members: DataFrame, attributes: DataFrame) -> DataFrame:
    """criteria (cluster, persona_id, pos, attribute, operator, value, options) x members -> verdict rows."""
    pairs = join_small(members, criteria.withColumnRenamed("value", "wanted"), "cluster")
    values = attributes.groupBy("product_id", "attr").agg(F.first("value").alias("value")).groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("__values"))
    joined = pairs.join(values, "product_id", "left").withColumn("__v", F.try_element_at("__values", F.col("attribute")))
    label = F.concat_ws(" ", "attribute", "operator", F.coalesce(F.array_join("options", ", "), "wanted"))
    return joined.select("cluster", "persona_id", "product_id", "member_pos", "pos", label.alias("label"), verdict(F.col("operator"), F.col("wanted"), F.col("options"), F.col("__v")).alias("verdict"))


def product_fit(verdicts: DataFrame) -> DataFrame:
    names = lambda c: ordered_list([F.col("pos")], F.when(c, F.col("label")))
    v = F.col("verdict")
    rows = verdicts.groupBy("cluster", "persona_id", "product_id").agg(names(v).alias("passed"), names(~v).alias("failed"), names(v.isNull()).alias("unknown"))
    sure, every = F.size("passed") + F.size("failed"), F.size("passed") + F.size("failed") + F.size("unknown")
    return rows.withColumn("coverage", half_even(100.0 * sure / every, 1)).withColumn("fit", F.when(sure == 0, F.lit(0.0)).otherwise(half_even(100.0 * F.size("passed") / sure, 1))).withColumn("qualifies", F.size("passed") == every)


def cluster_fit(fits: DataFrame) -> DataFrame:
    total = F.count("*")
    return fits.groupBy("cluster", "persona_id").agg(
        half_even(F.sum(F.col("coverage").cast("decimal(10,1)")).cast("double") / total, 1).alias("coverage"),
        half_even(100.0 * F.count_if("qualifies") / total, 1).alias("fit"), F.count_if("qualifies").alias("qualifying"), total.alias("products"),
    )
