"""Readiness score of products, clusters and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import blank_to_null, half_even

WEIGHTS = {"completeness": 0.25, "personas": 0.20, "not_for": 0.15, "comparisons": 0.15, "grounding": 0.25}
POOR_FIT = "poor"


def score_components(rows: DataFrame) -> DataFrame:
    """rows (completeness, has_content, labels array, fits array, n_not_for, tradeoffs array, n_kept, n_unsupported)
    -> the five components, each 0 to 1 with four decimals; without content all but completeness are 0."""
    labels = F.array_distinct(F.transform(F.filter("labels", lambda x: blank_to_null(x).isNotNull()), lambda x: F.lower(x)))
    poor = F.coalesce(F.exists("fits", lambda r: r == POOR_FIT), F.lit(False))
    told = F.filter("tradeoffs", lambda t: blank_to_null(t).isNotNull())
    total = F.col("n_kept") + F.col("n_unsupported")
    parts: dict[str, Column] = {
        "personas": F.least(F.size(labels), F.lit(4)) / 4 * F.when(poor, 1.0).otherwise(0.7),
        "not_for": F.least(F.col("n_not_for"), F.lit(2)) / 2,
        "comparisons": F.least(F.size(told), F.lit(3)) / 3,
        "grounding": F.when(total == 0, F.lit(0.5)).otherwise(F.try_divide(F.col("n_kept"), total)),
    }
    return rows.withColumns({"c_completeness": half_even(F.col("completeness") / 100, 4)} | {f"c_{k}": F.when(F.col("has_content"), half_even(v.cast("double"), 4)).otherwise(F.lit(0.0)) for k, v in parts.items()})


def readiness_score(components: DataFrame) -> DataFrame:
    total = sum((F.col(f"c_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return components.withColumn("readiness", half_even(F.round(100 * total, 6), 1))


def cluster_readiness(scores: DataFrame) -> DataFrame:
    return scores.groupBy("cluster").agg(half_even(F.sum(F.col("readiness").cast("decimal(10,1)")).cast("double") / F.count("*"), 1).alias("readiness"))


def catalog_readiness(clusters: DataFrame) -> DataFrame:
    """Unweighted mean of the cluster scores; 0 without clusters."""
    return clusters.agg(F.coalesce(half_even(F.sum(F.col("readiness").cast("decimal(10,1)")).cast("double") / F.count("*"), 1), F.lit(0.0)).alias("readiness"))


def top_gaps(rows: DataFrame) -> DataFrame:
    """Adds gaps: up to five messages, longest first (ties in their order); without content the short form.
    rows: score inputs and `missing` (array of attribute names)."""
    lacks = F.when(F.size("missing") > 0, F.concat(F.lit("Missing filterable attributes: "), F.array_join("missing", ", ")))
    few = F.array_compact(F.array(lacks, F.lit("No persona selected yet — pick one to generate content")))
    full = F.array_compact(F.array(
        lacks,
        F.when(~F.coalesce(F.exists("fits", lambda r: r == POOR_FIT), F.lit(False)), F.lit("No 'poor fit' persona — a card that suits everyone ranks for no one")),
        F.when(F.col("n_not_for") == 0, F.lit("No negative information — nothing stops a wrong recommendation")),
        F.when(~F.exists("tradeoffs", lambda t: blank_to_null(t).isNotNull()), F.lit("No comparison states a tradeoff, so agents can't rank this against siblings")),
        F.when(F.col("n_unsupported") > 0, F.concat(F.col("n_unsupported").cast("string"), F.lit(" claim(s) flagged unsupported and pending review"))),
    ))
    ranked = F.array_sort(F.transform(full, lambda m, i: F.struct((-F.length(m)).alias("l"), i.alias("i"), m.alias("m"))))
    return rows.withColumn("gaps", F.when(F.col("has_content"), F.transform(F.slice(ranked, 1, 5), lambda s: s["m"])).otherwise(few))


def cluster_dashboard(members: DataFrame, completeness: DataFrame, readiness: DataFrame, personas: DataFrame, fits: DataFrame, missing: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row a cluster: members, completeness, readiness, the picked persona's fit, attributes missing somewhere, and the
    normalization stats (cluster and any further columns) if they are given."""
    size = members.groupBy("cluster").agg(F.count("*").alias("members"))
    lacks = missing.where("missing > 0").groupBy("cluster").agg(F.array_sort(F.collect_list("attr")).alias("missing"))
    picked = personas.select("cluster", "persona_id", "title").join(fits.select("cluster", "persona_id", "fit", F.col("coverage").alias("fit_coverage")), ["cluster", "persona_id"], "left").drop("persona_id")
    out = size.join(completeness, "cluster", "left").join(readiness, "cluster", "left").join(picked, "cluster", "left").join(lacks, "cluster", "left")
    return out if stats is None else out.join(stats, "cluster", "left")
