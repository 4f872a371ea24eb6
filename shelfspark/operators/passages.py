"""Text views of products: index texts and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import blank_to_null, ordered_list


def _lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n")


def _pairs(rows: DataFrame, key: str, joiner: str) -> DataFrame:
    return rows.groupBy("product_id").agg(F.array_join(ordered_list([F.col("ord")], F.concat_ws(": ", key, "value")), joiner).alias("pairs"))


def _price() -> Column:
    return F.concat(F.lit("Price: "), F.coalesce(blank_to_null(F.col("price")), F.lit("not stated")))


def raw_index_text(products: DataFrame, specs: DataFrame) -> DataFrame:
    """(product_id, text): name, price, description and `k: v; ...`, blank parts left out."""
    return products.join(_pairs(specs, "key", "; "), "product_id", "left").select("product_id", _lines(F.col("name"), _price(), F.col("description"), F.col("pairs")).alias("text"))


def optimized_index_text(products: DataFrame, attributes: DataFrame, content: DataFrame) -> DataFrame:
    """(product_id, text): name, price, normalized attributes and the generated passage (product_id, passage)."""
    rows = products.join(_pairs(attributes, "attr", "; "), "product_id", "left").join(content, "product_id", "left")
    return rows.select("product_id", _lines(F.col("name"), _price(), F.concat(F.lit("Attributes: "), F.col("pairs")), F.col("passage")).alias("text"))


def raw_passage(products: DataFrame, specs: DataFrame) -> DataFrame:
    rows = products.join(_pairs(specs, "key", ", "), "product_id", "left")
    price = F.concat(F.lit("Price: "), blank_to_null(F.col("price")))
    return rows.select("product_id", _lines(F.col("name"), price, F.col("description"), F.concat(F.lit("Specs: "), F.col("pairs"))).alias("passage"))


def render_passage(content: DataFrame) -> DataFrame:
    """content (product_id, insights array<struct<claim, reasoning, evidence array<struct<attribute, value>>>>, use_cases
    array<struct<scenario, why_it_fits>>, query_angles array<struct<shopper_question, answer>>, not_for
    array<struct<exclusion, reason>>, comparisons array<struct<against, direction, axis, tradeoff>>) -> (product_id,
    passage): five headed sections, empty ones left out. Headings and line forms are fixed."""
    e = lambda x: F.coalesce(x, F.lit(""))
    section = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.lit(head + "\n"), F.array_join(lines, "\n")))
    cited = lambda i: F.array_join(F.transform(i["evidence"], lambda c: F.concat(c["attribute"], F.lit(": "), c["value"])), ", ")
    text = F.array_join(F.array_compact(F.array(
        section("Derived product insights:", F.transform("insights", lambda i: F.concat(F.lit("- "), e(i["claim"]), F.lit(" Reasoning: "), e(i["reasoning"]), F.lit(" [Evidence: "), e(cited(i)), F.lit("]")))),
        section("Relevant use cases:", F.transform("use_cases", lambda u: F.concat(F.lit("- "), e(u["scenario"]), F.lit(": "), e(u["why_it_fits"])))),
        section("Questions this product can answer:", F.transform("query_angles", lambda q: F.concat(F.lit("- Q: "), e(q["shopper_question"]), F.lit(" A: "), e(q["answer"])))),
        section("Not a fit for:", F.transform("not_for", lambda n: F.concat(F.lit("- "), e(n["exclusion"]), F.lit(": "), e(n["reason"])))),
        section("How it compares:", F.transform("comparisons", lambda c: F.concat(F.lit("- vs. "), e(c["against"]), F.lit(": "), e(c["direction"]), F.lit(" "), e(c["axis"]), F.lit(" — "), e(c["tradeoff"])))),
    )), "\n\n")
    return content.select("product_id", text.alias("passage"))
