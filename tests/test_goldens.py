"""Small results derived by hand."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.operators import claims, clusters, competitors, completeness, export, fit, identity, model_io, readiness, retrieval
from shelfspark.sources import catalog


def values(spark, fn, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (T.clean_price, {" S$189 ": "S$189", "nan": None, "call us": None, "": None}),
        (T.strip_html, {"<p>A&nbsp;B</p>": "A B", "x &lt; y": "x &lt; y", "": ""}),
        (T.parse_price, {"S$189": 189.0, "$1,299.00": 1299.0, "20.0 - 30.0": 20.0, "n/a": None}),
        (T.fit_number, {"258g": 258.0, "1/5": 1.0, "high": None, "1,299": 1.0}),
        (T.constraint_number, {"1,299": 1299.0, "-3mm": -3.0}),
        (T.comparison_number, {"1,299 g": 1299.0, "-2": -2.0}),
        (T.price_number, {"$1,299.00": "1299.00"}),
        (T.canonical, {"8 mm": "8mm", "mesh (high)": "meshhigh"}),
        (fit.operator_name, {" < ": "lt", "GTE": "gte"}),
        (export.currency_code, {"US$20": "USD", "S$20": "SGD", "A$5": "AUD", "20": None}),
    ],
)
def test_text_functions(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_currency_parity_option(spark):
    assert values(spark, lambda x: export.currency_code(x, parity=True), ["US$20", "A$5"]) == ["SGD", "USD"]


def test_half_even(spark):
    assert spark.range(1).select(T.half_even(F.lit(31.25), 1)).first()[0] == 31.2


def test_csv_and_json_catalogs(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Handle,Title,Body (HTML),Variant Price,Note\nh1,One,"<p>A, ""b""</p>",179.00,N/A\nh2,,,call us,\n')
    rows = catalog.load_catalog(spark, str(tmp_path / "c.csv")).orderBy("name").collect()
    assert [(r["name"], r["price"], r["description"], r["specs"]) for r in rows] == [("One", "179.00", 'A, "b"', {"Handle": "h1"}), ("Unnamed product", None, "", {"Handle": "h2"})]
    for name, text in {"a.json": '[{"title": "T", "variants": [{"price": "10"}, {"price": "25"}]}, 3]', "b.json": '{"products": [{"Name": "N", "x": [1]}]}', "c.json": '{"name": "Solo", "price": "S$5"}'}.items():
        (tmp_path / name).write_text(text)
    got = [catalog.load_catalog(spark, str(tmp_path / n)).first() for n in ("a.json", "b.json", "c.json")]
    assert [(g["name"], g["price"], g["extraction_mode"]) for g in got] == [("T", "10.0 - 25.0", "shopify"), ("N", None, "json"), ("Solo", "S$5", "json")]
    assert got[1]["specs"] == {"x": "[1]"}
    with pytest.raises(ValueError, match="unsupported"):
        catalog.load_catalog(spark, "x.xlsx")


def test_parse_specs(spark):
    assert values(spark, catalog.parse_specs, ['{"a":1}', "a: x, b: y:z", "", "a: 1, a: 2"]) == [{"a": "1"}, {"a": "x", "b": "y:z"}, {}, {"a": "2"}]


def test_membership(spark):
    labels = spark.createDataFrame([(0, "A", 0, "0"), (0, "A", 1, "1"), (0, "A", 2, "9"), (1, "", 0, "1"), (1, "", 1, "2"), (1, "", 2, "q")], "cluster_pos int, cluster string, item_pos int, index string")
    products = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "position long, product_id string")
    got = {r["product_id"]: r["cluster"] for r in clusters.validate_membership(labels, products).collect()}
    assert got == {"p0": "A", "p1": "A", "p2": "Cluster 2", "p3": "Uncategorized"}


def test_unique_ids_skip_natural_names(spark):
    rows = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x-2"), (3, "x"), (4, "y")], "position long, base string")
    got = {r["position"]: r["product_id"] for r in identity.ensure_product_ids(rows, F.col("base")).collect()}
    assert got == {0: "x", 1: "x-3", 2: "x-2", 3: "x-4", 4: "y"}
    assert len(set(got.values())) == 5


def test_competitors_against_brute_force(spark):
    import random

    draw = random.Random(5)
    rows = [(draw.choice("ab"), f"p{i}", i, draw.choice([None, "S$5", "S$7", "S$7.5", "S$9", "20"])) for i in range(120)]
    got = {}
    for r in competitors.competitors(spark.createDataFrame(rows, "cluster string, product_id string, member_pos long, price string")).collect():
        got.setdefault(r["product_id"], {})[r["rank"]] = r["competitor_id"]
    number = lambda p: float(p.replace("S$", "")) if p else None
    for c, pid, pos, price in rows:
        others = [(abs(number(price) - number(q)) if price and q else float("inf"), k, o) for d, o, k, q in rows if d == c and o != pid]
        if not price:
            others = [(0, k, o) for _, k, o in others]
        assert [got[pid][i] for i in (1, 2, 3)] == [o for _, _, o in sorted(others)[:3]]


def test_completeness_percent(spark):
    got = spark.createDataFrame([(5, 8), (0, 0), (5, 16)], "a int, b int").select(completeness.percent(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [62.5, 100.0, 31.2]


def test_readiness(spark):
    kind = "completeness double, has_content boolean, labels array<string>, fits array<string>, n_not_for int, tradeoffs array<string>, n_kept int, n_unsupported int"
    full = (80.0, True, ["a", "B", "c", "d"], ["good", "poor"], 2, ["x", "y", "z"], 10, 0)
    rows = [(80.0, False, [], [], 0, [], 0, 0), full, (*full[:3], ["good"], *full[4:])]
    got = readiness.readiness_score(readiness.score_components(spark.createDataFrame(rows, kind))).collect()
    assert [r["readiness"] for r in got] == [20.0, 95.0, 89.0]


def test_comparison_direction(spark):
    facts = spark.createDataFrame([("a", "Weight", "236g"), ("b", "weight", "254g")], "product_id string, attr string, value string")
    near = spark.createDataFrame([("a", "b", "Bee")], "product_id string, competitor_id string, competitor_name string")
    rows = [("a", i, "bee", "weight", "236 g", "254g", d) for i, d in enumerate(("more", "less"))]
    got = claims.validate_comparisons(spark.createDataFrame(rows, "product_id string, idx int, competitor string, axis string, own_value string, other_value string, direction string"), near, facts).orderBy("idx").collect()
    assert [r["kept"] for r in got] == [False, True]
    assert got[1]["tradeoff"] == "Verified Weight: this product is 236g; Bee is 254g."


def test_sanitize(spark):
    q = spark.createDataFrame([(1, "low drop shoes under 200")], "query_id int, query string")
    kind = "query_id int, pos int, requirement string, normalized_attribute string, operator string, value string, unit string, strength string, source_text string"
    rows = [(1, 0, "a", "price", "lte", "200", "USD", "hard", None), (1, 1, "b", "drop", "lte", "6", "mm", "hard", None), (1, 2, "c", "support", "eq", "stability", None, "hard", None)]
    got = retrieval.sanitize_constraints(spark.createDataFrame(rows, kind), q).orderBy("pos").collect()
    assert [(r["operator"], r["strength"]) for r in got] == [("lte", "hard"), ("exists", "preference"), ("exists", "preference")]


def test_constraints(spark):
    facts = spark.createDataFrame([("k", "price", "219.00", 0), ("k", "support_type", "stability", 1)], "key string, attr string, value string, ord int")
    kind = "query_id int, side string, key string, pos int, normalized_attribute string, operator string, value string, requirement string"
    rows = [(1, "s", "k", 0, "price", "lte", "200", "p"), (1, "s", "k", 1, "support", "eq", "stability", "s"), (1, "s", "k", 2, "width", "eq", "wide", "w")]
    got = retrieval.check_constraints(retrieval.resolve_constraint_attribute(spark.createDataFrame(rows, kind), facts)).orderBy("pos").collect()
    assert [r["status"] for r in got] == ["fail", "pass", "unknown"]


def test_gate_keeps_all_when_none_passes(spark):
    hits = spark.createDataFrame([(1, "s", k, i + 1, []) for i, k in enumerate("ab")], "query_id int, side string, key string, rank int, gaps array<string>")
    checks = spark.createDataFrame([(1, "s", k, "fail") for k in "ab"], "query_id int, side string, key string, status string")
    assert retrieval.gate_candidates(hits, checks).count() == 2


def test_clamp_and_budget(spark):
    rows = spark.createDataFrame([("150",), ("x",), ("-3",)], "confidence string").withColumns({"recommend": F.lit(None).cast("boolean"), "reason": F.lit(None).cast("string")})
    assert [r["confidence"] for r in retrieval.clamp_confidence(rows).collect()] == [100, 0, 0]
    calls = spark.createDataFrame([(i, 2.0) for i in range(4)], "call_id long, usd double")
    assert [r["allowed"] for r in model_io.within_budget(calls, 5.0, ranges=2).orderBy("call_id").collect()] == [True, True, True, False]


def test_positions(spark):
    rows = clusters.positions(spark.range(97).select((F.col("id") * 7 % 97).alias("x")), [F.col("x")]).collect()
    assert sorted((r["x"], r["position"]) for r in rows) == [(i, i) for i in range(97)]


def test_exports_write(spark, tmp_path):
    members = spark.createDataFrame([("c", "p1", 0)], "cluster string, product_id string, member_pos long")
    products = spark.createDataFrame([("p1", "Name", "US$5", 'says "hi"', {"stock": "3"})], "product_id string, name string, price string, description string, specs map<string,string>")
    personas = spark.createDataFrame([("c", "Title", None, None)], "cluster string, title string, narrative_seed string, user_story string")
    content = spark.createDataFrame([("p1", "Text")], "product_id string, passage string")
    facts = spark.createDataFrame([("p1", "a", "1", 0)], "product_id string, attr string, value string, ord int")
    rows = export.export_rows(members, products, personas, content, facts)
    export.write_csv(rows, str(tmp_path / "csv"))
    export.write_json(rows, str(tmp_path / "json"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["original_description"] == 'says "hi"'
    assert spark.read.json(str(tmp_path / "json")).first()["id"] == "p1"
    assert '"availability":"https://schema.org/InStock"' in export.jsonld_nodes(rows, "USD").first()["node"]
