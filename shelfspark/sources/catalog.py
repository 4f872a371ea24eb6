"""Catalog files and items -> products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import NA_WORDS, blank_to_null, clean_price, strip, strip_html

#: Column names that are looked for, in order of priority (fixed values).
NAME_KEYS = ["name", "product", "product name", "title"]
PRICE_KEYS = ["price", "variant price", "unit price", "sale price", "retail price", "cost", "msrp"]
DESCRIPTION_KEYS = ["description", "desc", "body (html)", "body html", "body"]
PRODUCT = "product_id string, name string, price string, description string, specs map<string,string>, image_description string, source_page int, extraction_mode string"
VISION_LIMIT = 80


def read_csv_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """All columns as text; the words that table readers take as missing become null. `lines`: no field holds a line end,
    the splittable form."""
    raw = spark.read.option("header", True).option("multiLine", not lines).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(NA_WORDS), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_json_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(item): one JSON text per object of an array, of `products`, or the object itself. `lines`: one object a line,
    the splittable form."""
    text = spark.read.text(path, wholetext=not lines).select(F.col("value").alias("t"))
    return json_items(text)


def json_items(text: DataFrame, col: str = "t") -> DataFrame:
    t = F.trim(F.col(col))
    products = F.get_json_object(t, "$.products")
    array = F.when(t.startswith("["), t).when(products.startswith("["), products).otherwise(F.concat(F.lit("["), t, F.lit("]")))
    items = text.select(F.explode(F.from_json(array, "array<string>")).alias("item"))
    return items.where(F.trim("item").startswith("{"))


def load_catalog(spark: SparkSession, path: str, format: str | None = None, lines: bool = False) -> DataFrame:
    """Products of a CSV or JSON catalog. lines: one record a line, the splittable form (that of `.jsonl`)."""
    kind = format or path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return products_from_table(read_csv_catalog(spark, path, lines))
    if kind in ("json", "jsonl"):
        return products_from_items(read_json_catalog(spark, path, lines=lines or kind == "jsonl"))
    raise ValueError(f"unsupported catalog format: {kind}")


def find_column(columns: list[str], keys: list[str]) -> str | None:
    found = {c.strip().lower(): c for c in reversed(columns)}
    return next((found[k] for k in keys if k in found), None)


def collect_specs(df: DataFrame, used: list[str]) -> Column:
    """Map of the other columns' values; blanks and `nan` left out."""
    rest = [c for c in df.columns if c not in used]
    if not rest:
        return F.create_map().cast("map<string,string>")
    made = F.create_map(*[x for c in rest for x in (F.lit(c), strip(F.col(f"`{c}`").cast("string")))])
    return F.map_filter(made, lambda _, v: v.isNotNull() & (v != "") & (F.lower(v) != "nan"))


def products_from_table(df: DataFrame) -> DataFrame:
    """Name, price and description by known column names; the first column stands in for a name; others are specs."""
    name = find_column(df.columns, NAME_KEYS) or df.columns[0]
    price, description = find_column(df.columns, PRICE_KEYS), find_column(df.columns, DESCRIPTION_KEYS)
    text = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    about = F.coalesce(strip(text(description)), F.lit(""))
    return df.select(
        F.lit(None).cast("string").alias("product_id"),
        F.coalesce(blank_to_null(text(name)), F.lit("Unnamed product")).alias("name"),
        clean_price(text(price)).alias("price"),
        F.when(about.contains("<"), strip_html(about)).otherwise(about).alias("description"),
        collect_specs(df, [c for c in (name, price, description) if c]).alias("specs"),
        F.lit(None).cast("string").alias("image_description"),
        F.lit(None).cast("int").alias("source_page"),
        F.lit("table").alias("extraction_mode"),
    )


def is_shopify(item: Column) -> Column:
    has = lambda k: F.array_contains(F.json_object_keys(item), k)
    return F.coalesce(has("variants") | has("body_html") | (has("title") & has("id")), F.lit(False))


_SHOPIFY = (
    "title string, body_html string, vendor string, product_type string, tags string, price string, "
    "variants array<struct<price:string,sku:string>>, options array<struct<name:string,values:array<string>>>, images array<struct<alt:string>>"
)


def image_description(images: Column) -> Column:
    """First three alternative texts, else the number of images."""
    alts = F.filter(F.transform(images, lambda i: strip(i["alt"])), lambda a: a.isNotNull() & (a != ""))
    return F.when(F.size(alts) > 0, F.array_join(F.slice(alts, 1, 3), "; ")).when(F.size(images) > 0, F.concat(F.size(images).cast("string"), F.lit(" product image(s) present")))


def products_from_shopify(items: DataFrame) -> DataFrame:
    """Shop items: price from variants (`min - max` if several), specs from vendor, type, tags and options."""
    df = items.select(F.from_json("item", _SHOPIFY).alias("x")).select("x.*")
    prices = F.array_distinct(F.filter(F.transform("variants", lambda v: blank_to_null(v["price"])), lambda p: p.isNotNull()))
    numbers = F.transform(prices, lambda p: p.try_cast("double"))
    price = (
        F.when(F.size(prices) > 1, F.when(F.exists(numbers, lambda n: n.isNull()), prices[0]).otherwise(F.concat(F.array_min(numbers).cast("string"), F.lit(" - "), F.array_max(numbers).cast("string"))))
        .when(F.size(prices) == 1, prices[0])
        .otherwise(F.col("price"))
    )
    tags = F.when(F.trim("tags").startswith("["), F.array_join(F.from_json("tags", "array<string>"), ", ")).otherwise(F.col("tags"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("vendor", F.col("vendor")), ("product_type", F.col("product_type")), ("tags", tags))])
    options = F.coalesce(F.transform("options", lambda o: F.struct(o["name"].alias("key"), F.array_join(o["values"], ", ").alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))
    every = F.filter(F.concat(pairs, options), lambda e: e["key"].isNotNull() & e["value"].isNotNull() & (strip(e["value"]) != ""))
    first = F.filter(every, lambda e, i: ~F.exists(F.slice(every, 1, i), lambda f: f["key"] == e["key"]))
    return df.select(
        F.lit(None).cast("string").alias("product_id"), F.coalesce(blank_to_null(F.col("title")), F.lit("Unnamed product")).alias("name"), clean_price(price).alias("price"),
        strip_html(F.col("body_html")).alias("description"), F.map_from_entries(first).alias("specs"), image_description(F.col("images")).alias("image_description"),
        F.lit(None).cast("int").alias("source_page"), F.lit("shopify").alias("extraction_mode"),
    )


def products_from_generic(items: DataFrame) -> DataFrame:
    """Other objects: known keys first, all further values to specs; nested values stay JSON text."""
    x = items.select(F.from_json("item", "map<string,string>").alias("m"), F.json_object_keys("item").alias("k"))
    low = F.transform_keys("m", lambda k, _: F.lower(F.trim(k)))
    pick = lambda keys: F.coalesce(*[blank_to_null(F.try_element_at(F.col("low"), F.lit(k))) for k in keys])
    df = x.withColumn("low", F.map_from_entries(F.array_distinct(F.map_entries(low))))
    known = NAME_KEYS + PRICE_KEYS + DESCRIPTION_KEYS
    specs = F.map_filter(F.col("m"), lambda k, v: v.isNotNull() & ~F.lower(F.trim(k)).isin(known))
    specs = F.transform_values(specs, lambda _, v: F.when(v.isin("[]", "{}"), F.lit("")).otherwise(v))
    return df.select(
        F.lit(None).cast("string").alias("product_id"), F.coalesce(pick(NAME_KEYS), F.try_element_at(F.col("m"), F.get("k", F.lit(0))), F.lit("Unnamed product")).alias("name"),
        clean_price(pick(PRICE_KEYS)).alias("price"), strip_html(pick(DESCRIPTION_KEYS)).alias("description"), specs.alias("specs"),
        F.lit(None).cast("string").alias("image_description"), F.lit(None).cast("int").alias("source_page"), F.lit("json").alias("extraction_mode"),
    )


def products_from_items(items: DataFrame) -> DataFrame:
    return products_from_shopify(items.where(is_shopify(F.col("item")))).unionByName(products_from_generic(items.where(~is_shopify(F.col("item")))))


def extraction_mode_counts(products: DataFrame) -> DataFrame:
    return products.groupBy("extraction_mode").agg(F.count("*").alias("products"))


def route_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with little text go to `vision`, others to `text`."""
    return pages.withColumn("route", F.when(F.length(strip(F.coalesce(F.col(text), F.lit("")))) < VISION_LIMIT, "vision").otherwise("text"))


def default_extracted(df: DataFrame, mode: str) -> DataFrame:
    """Extracted rows with their defaults, the mode, and the page that they come from as source_page (a page is stamped
    over whatever the extraction said)."""
    page = F.col("page" if "page" in df.columns else "source_page").cast("int")
    return df.withColumns({
        "source_page": page,
        "price": F.nullif(F.col("price"), F.lit("")), "image_description": F.nullif(F.col("image_description"), F.lit("")), "description": F.coalesce("description", F.lit("")),
        "specs": F.coalesce(F.col("specs"), F.create_map().cast("map<string,string>")), "extraction_mode": F.lit(mode),
    })


def parse_specs(x: Column) -> Column:
    """A JSON object, or `k: v, k: v`; the last of equal keys counts; blank gives an empty map."""
    pairs = F.filter(F.transform(F.split(x, ","), lambda p: F.struct(strip(F.regexp_extract(p, "^([^:]*):", 1)).alias("key"), strip(F.regexp_replace(p, "^[^:]*:", "")).alias("value"), p.contains(":").alias("ok"))), lambda p: p["ok"] & (p["key"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    plain = F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.coalesce(strip(x), F.lit("")) == "", empty).when(strip(x).startswith("{"), F.coalesce(F.from_json(x, "map<string,string>"), empty)).otherwise(plain)


def clean_products(df: DataFrame) -> DataFrame:
    """Edited rows: trimmed; blank names get a stand-in; blank prices and ids are null."""
    return df.withColumns({
        "name": F.coalesce(blank_to_null(F.col("name")), F.lit("Unnamed product")), "price": blank_to_null(F.col("price")), "product_id": blank_to_null(F.col("product_id")),
        "description": F.coalesce(strip(F.col("description")), F.lit("")),
    })


def review_table(products: DataFrame) -> DataFrame:
    return products.select(F.coalesce("product_id", F.lit("")).alias("product_id"), "name", F.coalesce("price", F.lit("")).alias("price"), "description", F.to_json("specs").alias("specs"))
