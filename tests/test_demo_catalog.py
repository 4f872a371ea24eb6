"""A shop export of twenty products in three grades of data quality, from file to work orders."""

import csv

import pytest
from pyspark.sql import functions as F

from shelfspark import jobs
from shelfspark.functions.text import snake_case
from shelfspark.operators import completeness, export, normalize

HEADER = ["Handle", "Title", "Body (HTML)", "Vendor", "Product Category", "Type", "Tags", "Published", "Option1 Name", "Option1 Value", "Variant SKU", "Variant Grams", "Variant Inventory Qty", "Variant Price", "Image Src", "SEO Title", "SEO Description", "Specs (metafield)", "Ingredients (metafield)"]
KEYS = ["Weight", "Drop", "Stack height", "Surface", "Support", "Fit", "Closure", "Upper"]


def product(i):
    values = [f"{200 + i}g", f"{i % 12}mm", f"{20 + i}mm", "road", "neutral", "regular", "laces", "mesh"]
    specs = " | ".join(f"{k}: {v}" for k, v in zip(KEYS, values)) if i < 11 else f"{200 + i}g / {i % 12}mm drop / road" if i < 16 else "See product page for details."
    sku = {8: "SKU7", 15: "SKU14"}.get(i, f"SKU{i}")
    return [f"shoe-{i}", f"Shoe {i}", f"<p>Runs, number {i}.</p>", f"Vendor {i % 4}", "Apparel > Shoes", "Running Shoes", "daily, road", "TRUE", "Size", "US 9", sku, str(200 + i), "0" if i in (2, 5, 17) else str(i + 1), f"{100 + 10 * i}.00", f"https://example.com/{i}.jpg", f"Shoe {i} online", "Buy it", specs, ""]


@pytest.fixture(scope="module")
def audited(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("demo")
    with (at / "shoes.csv").open("w", newline="") as f:
        csv.writer(f).writerows([HEADER, *map(product, range(20))])
    products = jobs.load(spark, f"{at}/shoes.csv")
    specs = products.select("product_id", F.posexplode("specs").alias("ord", "key", "value")).where("key like 'Specs%'").select("product_id", "ord", "key", "value")
    candidates = normalize.segment_candidates(specs).withColumn("cluster", F.lit("Running Shoes"))
    frame = spark.createDataFrame
    given = jobs.Answers(
        frame([(0, "Running Shoes", i, str(i)) for i in range(20)], "cluster_pos int, cluster string, item_pos int, index string"), frame([], "source string, final string, pos int"),
        frame([("Running Shoes", k, i) for i, k in enumerate(KEYS)], "cluster string, attr string, attr_pos int").withColumn("attr", snake_case(F.col("attr"))), frame([], "product_id string, attrs array<string>"), candidates,
        frame([("Running Shoes", "p", 0, "Runner", "", ["weight"])], "cluster string, persona_id string, pos int, title string, narrative_seed string, supporting array<string>"),
        frame([("Running Shoes", "p", 0, "weight", "lte", "205", None, "light")], "cluster string, persona_id string, pos int, attribute string, operator string, value string, options array<string>, rationale string"),
    )
    return jobs.audit(spark, f"{at}/shoes.csv", given, f"{at}/out")


def test_products(audited):
    rows = sorted(audited["products"].collect(), key=lambda r: r["position"])
    assert len(rows) == 20 and {len(r["specs"]) for r in rows} == {15}
    assert [r["product_id"] for r in rows if "-" in r["product_id"]] == ["SKU7-2", "SKU14-2"]
    assert rows[3]["name"] == "Shoe 3" and rows[3]["description"] == "Runs, number 3." and rows[3]["price"] == "130.00"
    stock = audited["products"].select(export.availability(F.col("specs")).alias("a")).groupBy("a").count().collect()
    assert {r["a"]: r["count"] for r in stock} == {export.IN_STOCK: 17, export.OUT_OF_STOCK: 3}
    assert export.detect_currency(audited["products"]).first()["currency"] is None


def test_attributes_and_work_orders(audited):
    verdicts = {r["verdict"]: r["count"] for r in audited["candidates"].groupBy("verdict").count().collect()}
    assert verdicts == {"kept": 88}
    orders = {r["attr"]: (r["applicable"], r["missing"], r["missing_pct"]) for r in audited["by_attribute"].collect()}
    assert orders == {k: (20, 9, 45.0) for k in ("weight", "drop", "stack_height", "surface", "support", "fit", "closure", "upper")}
    assert audited["by_product"].count() == 9 and audited["headline"].first()["attribute_rows"] == 8
    assert completeness.cluster_completeness(audited["completeness"]).first()["completeness"] == 55.0
    assert audited["cluster_fit"].first().asDict() == {"cluster": "Running Shoes", "persona_id": "p", "coverage": 55.0, "fit": 30.0, "qualifying": 6, "products": 20}
    assert audited["by_attribute_names"].where("attr = 'fit'").first()["missing_products"] == ", ".join(f"Shoe {i}" for i in range(11, 20))
