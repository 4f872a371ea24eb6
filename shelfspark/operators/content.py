"""Generated content rebuilt from the claims that pass all gates.

Lists of a product's content become rows with their place in the list; evidence, review and comparison gates decide on rows,
in that order; one grouping by product puts what is left back into nested lists, in the old order, and the messages of what
went into one list behind those that came with the content. Nothing that a gate refused is in a list that is published.

content: one row a product: product_id, the lists of FIELDS (structs of two texts and evidence array<struct<attribute,
value>>), comparisons array<struct<against, axis, target_value, competitor_value, direction>>, unsupported_claims
array<string>, and personas array<struct<label, fit>>; a list may be null. Further columns go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import blank_to_null, canonical, ordered_list
from shelfspark.tables import Work

from .claims import apply_review, rejection_message, validate_comparisons, validate_evidence
from .competitors import SCHEMA_VERSION, UNVERIFIED

#: The lists with evidence, in the order of their gates, and the names of their two texts (fixed values).
FIELDS = {"derived_insights": ("claim", "reasoning"), "query_angles": ("shopper_question", "answer"), "not_for": ("exclusion", "reason"), "use_cases": ("scenario", "why_it_fits")}
#: Fixed text of a statement that a reviewer did not approve.
STATEMENT = "Derived statement"
_EVIDENCE = "array<struct<attribute:string,value:string>>"


def claim_rows(content: DataFrame) -> DataFrame:
    """(product_id, field, idx, text1, text2, evidence): a row for each item that is not null."""
    each = [
        content.select("product_id", F.posexplode(field).alias("idx", "item")).where("item is not null").select(
            "product_id", F.lit(field).alias("field"), "idx", F.col(f"item.{a}").alias("text1"), F.col(f"item.{b}").alias("text2"), F.coalesce(F.col("item.evidence").cast(_EVIDENCE), F.array().cast(_EVIDENCE)).alias("evidence"))
        for field, (a, b) in FIELDS.items()
    ]
    return reduce(DataFrame.unionByName, each)


def comparison_rows(content: DataFrame) -> DataFrame:
    rows = content.select("product_id", F.posexplode("comparisons").alias("idx", "item")).where("item is not null")
    return rows.select("product_id", "idx", F.col("item.against").alias("competitor"), F.col("item.axis").alias("axis"), F.col("item.target_value").alias("own_value"), F.col("item.competitor_value").alias("other_value"), F.col("item.direction").alias("direction"))


def gate_content(work: Work, content: DataFrame, verified: DataFrame, competitors: DataFrame, approvals: DataFrame, rejections: DataFrame) -> DataFrame:
    """content as above -> (product_id, personas, the lists, comparisons array<struct<against, direction, axis, tradeoff>>,
    unsupported_claims, schema_version).

    verified (product_id, attr, value), catalog_price among them, which alone verifies nothing; competitors (product_id, rank,
    competitor_id, competitor_name): of one name the last counts; approvals (product_id, claim_id), rejections (product_id,
    claim_id, reason): `field:number`, numbers counting what passed the evidence gate."""
    known = verified.where((F.col("attr") != "catalog_price") & blank_to_null(F.col("value")).isNotNull()).select("product_id").distinct()
    told = content.join(known, "product_id", "left_semi")
    checked = work.table(validate_evidence(claim_rows(told), verified), "checked")
    reviewed = work.table(apply_review(checked, approvals, rejections), "reviewed")
    names = competitors.groupBy("product_id", canonical(F.col("competitor_name")).alias("__k")).agg(F.max_by(F.struct("competitor_id", "competitor_name"), "rank").alias("c")).select("product_id", "c.*")
    compared = validate_comparisons(comparison_rows(told), names, verified)

    at = F.create_map(*[x for i, f in enumerate(FIELDS) for x in (F.lit(f), F.lit(i))])
    none = lambda kind: F.lit(None).cast(kind)
    item = F.struct("text1", "text2", "evidence")
    pair = "struct<text1:string,text2:string,evidence:" + _EVIDENCE + ">"
    side = "struct<against:string,direction:string,axis:string,tradeoff:string>"
    row = lambda gate, place, claim, comparison, message: ("product_id", F.lit(gate).alias("gate"), place.alias("place"), "idx", claim.cast(pair).alias("claim"), comparison.cast(side).alias("comparison"), message.alias("message"))
    refused = F.when(~F.col("kept"), rejection_message(F.lit(STATEMENT), F.coalesce(blank_to_null(F.col("text1")), F.col("text2")), F.col("reason")))
    given = told.select("product_id", F.posexplode("unsupported_claims").alias("idx", "message"))
    rows = [
        given.select(*row(0, F.lit(0), none(pair), none(side), F.col("message"))),
        checked.where(~F.col("kept")).select(*row(1, at[F.col("field")], none(pair), none(side), F.col("message"))),
        reviewed.select(*row(2, at[F.col("field")], F.when(F.col("kept"), item), none(side), refused)),
        compared.select(*row(3, F.lit(0), none(pair), F.when(F.col("kept"), F.struct(F.col("competitor").alias("against"), F.lower("direction").alias("direction"), "axis", "tradeoff")), F.col("message"))),
    ]
    order = [F.col("gate"), F.col("place"), F.col("idx")]
    lists = [ordered_list(order, F.when((F.col("gate") == 2) & (F.col("place") == i), F.col("claim"))).alias(f) for i, f in enumerate(FIELDS)]
    back = reduce(DataFrame.unionByName, rows).groupBy("product_id").agg(*lists, ordered_list(order, F.col("comparison")).alias("comparisons"), ordered_list(order, F.col("message")).alias("unsupported_claims"))
    shape = lambda f: f"array<struct<{FIELDS[f][0]}:string,{FIELDS[f][1]}:string,evidence:{_EVIDENCE}>>"
    empty = lambda kind: F.array().cast(kind)
    gated = known.withColumn("__told", F.lit(True))
    joined = content.select("product_id", "personas").join(back, "product_id", "left").join(gated, "product_id", "left")
    ok = F.coalesce("__told", F.lit(False))
    return joined.select(
        "product_id", F.when(ok, F.coalesce("personas", empty(content.schema["personas"].dataType))).otherwise(empty(content.schema["personas"].dataType)).alias("personas"),
        *[F.coalesce(F.col(f).cast(shape(f)), empty(shape(f))).alias(f) for f in FIELDS], F.coalesce("comparisons", empty(f"array<{side}>")).alias("comparisons"),
        F.when(ok, F.coalesce("unsupported_claims", empty("array<string>"))).otherwise(F.array(F.lit(UNVERIFIED))).alias("unsupported_claims"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def score_inputs(completeness: DataFrame, content: DataFrame) -> DataFrame:
    """completeness (cluster, product_id, completeness, missing), rebuilt content -> the rows that score_components takes."""
    n = sum((F.size(f) for f in (*FIELDS, "comparisons")), F.lit(0))
    told = content.select(
        "product_id", F.lit(True).alias("has_content"), F.transform("personas", lambda p: p["label"]).alias("labels"), F.transform("personas", lambda p: p["fit"]).alias("fits"), F.size("not_for").alias("n_not_for"),
        F.transform("comparisons", lambda c: c["tradeoff"]).alias("tradeoffs"), n.alias("n_kept"), F.size("unsupported_claims").alias("n_unsupported"),
    )
    rows = completeness.join(told, "product_id", "left")
    none = F.array().cast("array<string>")
    fill = {c: F.coalesce(c, F.lit(0)) for c in ("n_not_for", "n_kept", "n_unsupported")} | {c: F.coalesce(c, none) for c in ("labels", "fits", "tradeoffs")}
    return rows.withColumns(fill | {"has_content": F.coalesce("has_content", F.lit(False))})
