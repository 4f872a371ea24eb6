"""Generated claims and comparisons checked against verified facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import blank_to_null, canonical, comparison_number, ordered_list

#: Fixed texts of rejections.
NO_TEXT, NO_EVIDENCE = "required explanatory text was missing", "no attribute evidence was supplied"
BAD_CITATION, NOT_VERIFIED = "evidence was malformed", "an evidence key or value did not match verified attributes"
NOT_APPROVED = "semantic support was not established"
COMPARISON_REASONS = ["competitor was not supplied", "comparison attribute was not verified for both products", "comparison values did not match the verified attributes", "comparison direction could not be verified"]
LABELS = {"derived_insights": "Derived insight", "query_angles": "Query angle", "not_for": "Exclusion", "use_cases": "Use case"}


def rejection_message(label: Column, text: Column, reason: Column) -> Column:
    return F.concat(label, F.lit(" '"), F.coalesce(blank_to_null(text), F.lit("unnamed item")), F.lit("' was removed: "), reason, F.lit("."))


def _label(field: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), field), field)


def validate_evidence(claims: DataFrame, verified: DataFrame) -> DataFrame:
    """claims (product_id, field, idx, text1, text2, evidence array<struct<attribute, value>>) -> the same with stored
    evidence, `kept`, `reason` and `message`. Later reasons override earlier ones: missing text, no evidence, then a
    malformed or unverified citation."""
    facts = verified.select("product_id", canonical(F.col("attr")).alias("k"), F.col("attr").alias("fact"), F.col("value").alias("fact_value"))
    facts = facts.groupBy("product_id", "k").agg(F.max_by(F.struct("fact", "fact_value"), F.struct("fact", "fact_value")).alias("f"))
    cited = claims.select("product_id", "field", "idx", F.posexplode_outer("evidence").alias("at", "e")).withColumn("k", canonical(F.col("e.attribute")))
    ok = canonical(F.col("f.fact_value")) == canonical(F.col("e.value"))
    shaped = blank_to_null(F.col("e.attribute")).isNotNull() & blank_to_null(F.col("e.value")).isNotNull()
    state = F.when(F.col("at").isNull(), F.lit(None)).when(~shaped, BAD_CITATION).when(~F.coalesce(ok, F.lit(False)), NOT_VERIFIED)
    checked = cited.join(facts, ["product_id", "k"], "left").withColumn("state", state)
    each = checked.groupBy("product_id", "field", "idx").agg(
        F.count("at").alias("n"), F.max_by("state", F.when(F.col("state").isNotNull(), F.col("at"))).alias("bad"),
        ordered_list([F.col("at")], F.when(F.col("state").isNull() & F.col("at").isNotNull(), F.struct(F.col("f.fact").alias("attribute"), F.col("f.fact_value").alias("value")))).alias("stored"),
    )
    missing = blank_to_null(F.col("text1")).isNull() | blank_to_null(F.col("text2")).isNull()
    reason = F.coalesce(F.col("bad"), F.when(F.col("n") == 0, NO_EVIDENCE), F.when(missing, NO_TEXT))
    out = claims.join(each, ["product_id", "field", "idx"]).withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    out = out.withColumn("evidence", F.when(F.col("kept"), F.col("stored")).otherwise(F.col("evidence")))
    return out.withColumn("message", F.when(~F.col("kept"), rejection_message(_label(F.col("field")), F.col("text1"), F.col("reason")))).drop("n", "bad", "stored")


def apply_review(claims: DataFrame, approvals: DataFrame, rejections: DataFrame) -> DataFrame:
    """Kept claims, numbered anew per field, stay if `field:number` is approved; others take the reviewer's reason."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("product_id", "field").orderBy("idx")) - 1
    ided = claims.where("kept").withColumn("claim_id", F.concat("field", F.lit(":"), number.cast("string")))
    yes = approvals.select("product_id", "claim_id").distinct().withColumn("__ok", F.lit(True))
    why = rejections.groupBy("product_id", "claim_id").agg(F.first("reason").alias("__why"))
    joined = ided.drop("reason").join(yes, ["product_id", "claim_id"], "left").join(why, ["product_id", "claim_id"], "left")
    kept = F.coalesce("__ok", F.lit(False))
    return joined.withColumn("kept", kept).withColumn("reason", F.when(~kept, F.coalesce("__why", F.lit(NOT_APPROVED)))).drop("__ok", "__why")


def direction_of(own: Column, other: Column) -> Column:
    a, b = comparison_number(own), comparison_number(other)
    numeric = F.when(a > b, "more").when(a < b, "less").otherwise("similar")
    return F.when(a.isNotNull() & b.isNotNull(), numeric).when(canonical(own) == canonical(other), "similar").otherwise("different")


def validate_comparisons(comparisons: DataFrame, competitors: DataFrame, verified: DataFrame) -> DataFrame:
    """comparisons (product_id, idx, competitor, axis, own_value, other_value, direction), competitors (product_id,
    competitor_id, competitor_name). Adds kept, reason, and for kept ones the stored axis and the tradeoff sentence."""
    names = competitors.select("product_id", "competitor_id", F.col("competitor_name").alias("stored_name"), canonical(F.col("competitor_name")).alias("k")).dropDuplicates(["product_id", "k"])
    fact = lambda id_, p: verified.groupBy(F.col("product_id").alias(id_), canonical(F.col("attr")).alias("a")).agg(F.max_by(F.struct("attr", "value"), F.struct("attr", "value")).alias(p))
    rows = comparisons.withColumn("k", canonical(F.col("competitor"))).withColumn("a", canonical(F.col("axis")))
    rows = rows.join(names, ["product_id", "k"], "left").join(fact("product_id", "f"), ["product_id", "a"], "left").join(fact("competitor_id", "g"), ["competitor_id", "a"], "left")
    same = lambda x, y: F.coalesce(canonical(x) == canonical(y), F.lit(False))
    found = direction_of(F.col("f.value"), F.col("g.value"))
    reason = (
        F.when(F.col("competitor_id").isNull(), COMPARISON_REASONS[0])
        .when(F.col("f").isNull() | F.col("g").isNull(), COMPARISON_REASONS[1])
        .when(~same(F.col("own_value"), F.col("f.value")) | ~same(F.col("other_value"), F.col("g.value")), COMPARISON_REASONS[2])
        .when(~F.coalesce(F.lower("direction") == found, F.lit(False)), COMPARISON_REASONS[3])
    )
    out = rows.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    sentence = F.concat(F.lit("Verified "), F.col("f.attr"), F.lit(": this product is "), F.col("f.value"), F.lit("; "), F.col("stored_name"), F.lit(" is "), F.col("g.value"), F.lit("."))
    message = F.concat(F.lit("Comparison against "), F.coalesce("competitor", F.lit("unknown product")), F.lit(" on "), F.coalesce("axis", F.lit("unknown attribute")), F.lit(" was removed: "), F.col("reason"), F.lit("."))
    out = out.withColumn("message", F.when(~F.col("kept"), message))
    return out.withColumn("axis", F.when(F.col("kept"), F.col("f.attr")).otherwise(F.col("axis"))).withColumn("tradeoff", F.when(F.col("kept"), sentence)).drop("k", "a", "f", "g", "stored_name")


def unsupported_claims(*sources: DataFrame) -> DataFrame:
    """Messages (product_id, idx, message) of several sources, in the order given, as one list per product."""
    marked = [s.select("product_id", F.lit(i).alias("src"), "idx", "message") for i, s in enumerate(sources)]
    every = marked[0]
    for m in marked[1:]:
        every = every.unionByName(m)
    return every.where("message is not null").groupBy("product_id").agg(ordered_list([F.col("src"), F.col("idx"), F.col("message")], F.col("message")).alias("unsupported_claims"))
