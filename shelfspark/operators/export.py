"""Exports: CSV, JSON and schema.org JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.joins import join_small
from shelfspark.functions.text import blank_to_null, ordered_list, price_number

#: Currency symbols and codes, longest symbol first (fixed values); SYMBOL_ORDER is the order of the parity option.
CURRENCIES = {"US$": "USD", "S$": "SGD", "A$": "AUD", "RM": "MYR", "$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₹": "INR"}
SYMBOL_ORDER = ["S$", "US$", "$", "£", "€", "¥", "RM", "₹", "A$"]
IN_STOCK, OUT_OF_STOCK = "https://schema.org/InStock", "https://schema.org/OutOfStock"
#: Spec keys and values that tell the stock (fixed values).
STOCK_TEXT_KEYS = ["availability", "available", "stock status"]
STOCK_NUMBER_KEYS = ["variant inventory qty", "inventory quantity", "inventory_quantity", "stock"]
STOCK_YES, STOCK_NO = ["in stock", "instock", "available", "true", "yes"], ["out of stock", "outofstock", "unavailable", "false", "no"]


def currency_code(price: Column, parity: bool = False) -> Column:
    """Code of the first symbol found in the text: longest symbols first, or in SYMBOL_ORDER for parity."""
    symbols = SYMBOL_ORDER if parity else list(CURRENCIES)
    return F.coalesce(*[F.when(price.contains(s), CURRENCIES[s]) for s in symbols])


def detect_currency(products: DataFrame, parity: bool = False, keys: list[str] | None = None) -> DataFrame:
    """One row (of each group of keys): the currency of the first price, by position, that has a symbol."""
    code = currency_code(F.col("price"), parity)
    return products.select(*keys or [], "position", code.alias("code")).where("code is not null").groupBy(*keys or []).agg(F.min_by("code", "position").alias("currency"))


def availability(specs: Column) -> Column:
    """Schema.org URL where the specs prove it: text keys first, then quantities; else null."""
    low = F.transform(F.map_entries(specs), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), e["value"].alias("v")))
    value = lambda k: F.get(F.transform(F.filter(low, lambda e: e["k"] == k), lambda e: e["v"]), F.lit(0))
    text = [F.when(F.lower(F.trim(value(k))).isin(STOCK_YES), IN_STOCK).when(F.lower(F.trim(value(k))).isin(STOCK_NO), OUT_OF_STOCK) for k in STOCK_TEXT_KEYS]
    number = lambda k: F.regexp_substr(F.regexp_replace(value(k), ",", ""), F.lit(r"-?\d+(?:\.\d+)?")).try_cast("double")
    count = [F.when(number(k) > 0, IN_STOCK).when(number(k) <= 0, OUT_OF_STOCK) for k in STOCK_NUMBER_KEYS]
    return F.coalesce(*text, *count)


def export_rows(members: DataFrame, products: DataFrame, personas: DataFrame, content: DataFrame, attributes: DataFrame) -> DataFrame:
    """Member x cluster x picked persona x content; products (product_id, name, price, description, specs), personas one
    per cluster (title, narrative_seed, user_story), content (product_id, passage, knowledge columns)."""
    pairs = attributes.where(F.col("value").isNotNull()).groupBy("product_id").agg(ordered_list([F.col("ord")], F.struct("attr", "value")).alias("verified"))
    rows = join_small(members.join(products, "product_id"), personas.select("cluster", "title", "narrative_seed", "user_story"), "cluster", "left")
    rows = rows.join(content, "product_id", "left").join(pairs, "product_id", "left")
    return rows.withColumn("verified", F.coalesce("verified", F.array().cast("array<struct<attr:string,value:string>>")))


def csv_rows(rows: DataFrame) -> DataFrame:
    """The nine columns of the flat file."""
    e = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        "cluster", e("product_id"), F.coalesce("name", F.lit("Unnamed product")).alias("product"), e("price"), F.coalesce("title", F.lit("")).alias("persona"), e("user_story"),
        F.coalesce("passage", F.lit("")).alias("agent_optimized_content"), F.array_join(F.transform("verified", lambda v: F.concat(v["attr"], F.lit(": "), v["value"])), "; ").alias("verified_attributes"),
        F.coalesce("description", F.lit("")).alias("original_description"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    csv_rows(rows).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


KNOWLEDGE = ["derived_insights", "query_angles", "use_cases", "not_for", "comparisons", "unsupported_claims"]


def json_rows(rows: DataFrame) -> DataFrame:
    """One nested record per product, knowledge lists included where the rows have them."""
    null = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    knowledge = [F.coalesce(F.col(k), F.array().cast(rows.schema[k].dataType)).alias(k) for k in KNOWLEDGE if k in rows.columns]
    return rows.select(
        F.col("product_id").alias("id"), "cluster", "name", null("price").alias("price"), F.coalesce("description", F.lit("")).alias("original_description"),
        F.map_from_entries("verified").alias("verified_attributes"), F.col("specs").alias("raw_attributes"),
        F.struct(null("title").alias("title"), null("narrative_seed").alias("narrative_seed"), null("user_story").alias("user_story")).alias("target_persona"),
        null("passage").alias("agent_optimized_content"), *([F.struct(*knowledge).alias("knowledge_layer")] if knowledge else []),
    )


def write_json(rows: DataFrame, path: str) -> None:
    """One object a line."""
    json_rows(rows).write.option("ignoreNullFields", False).json(path)


def jsonld_nodes(rows: DataFrame, currency: str | None = None) -> DataFrame:
    """(product_id, node): schema.org Product as JSON text; keys without a value are left out."""
    number = price_number(F.col("price"))
    offer = F.when(number.isNotNull(), F.struct(F.lit("Offer").alias("@type"), number.alias("price"), availability(F.col("specs")).alias("availability"), F.lit(currency).cast("string").alias("priceCurrency")))
    told = F.transform(F.filter("verified", lambda v: blank_to_null(v["value"]).isNotNull()), lambda v: F.struct(F.lit("PropertyValue").alias("@type"), v["attr"].alias("name"), v["value"].alias("value")))
    node = F.struct(
        F.lit("Product").alias("@type"), F.col("product_id").alias("identifier"), "name", F.col("cluster").alias("category"), F.coalesce(F.nullif(F.col("passage"), F.lit("")), F.col("description")).alias("description"),
        offer.alias("offers"), F.when(F.size("verified") > 0, told).alias("additionalProperty"),
        F.when(blank_to_null(F.col("title")).isNotNull(), F.struct(F.lit("PeopleAudience").alias("@type"), F.col("title").alias("audienceType"))).alias("audience"),
    )
    return rows.select("product_id", F.to_json(node, {"ignoreNullFields": "true"}).alias("node"))


def write_requests(by_attribute: DataFrame, by_product: DataFrame, path: str) -> None:
    """Both work orders, the largest gaps first."""
    worst = F.col("missing").desc()
    for name, df in (("by_attribute", by_attribute.orderBy(worst, "cluster", "attr")), ("by_product", by_product.orderBy(worst, "cluster", "name", "product_id"))):
        df.write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
