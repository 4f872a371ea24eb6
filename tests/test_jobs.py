"""The batch jobs from files to exports, on a small catalog with known results."""

import json
import math

import pytest
from pyspark.sql import functions as F

from shelfspark import jobs
from shelfspark.operators import clusters

CATALOG = """Title,Variant SKU,Variant Price,Body (HTML),Color,Weight
Runner A,R-1,S$ 100.00,"<p>Light runner, red upper</p>",red,200 g
Runner B,R-1,S$ 120.00,Road runner in blue,blue,
Runner C,R-3,,Trail runner,green,300 g
Boot,B-1,S$ 90.50,Leather boot,,900 g
"""


def answers(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    return jobs.Answers(
        frame([(0, "Running", 0, "0"), (0, "Running", 1, "1"), (0, "Running", 2, "2"), (0, "Running", 3, "x")], "cluster_pos int, cluster string, item_pos int, index string"),
        frame([], "source string, final string, pos int"),
        frame([("Running", "color", 0), ("Running", "weight", 1)], "cluster string, attr string, attr_pos int"),
        frame([], "product_id string, attrs array<string>"),
        frame([("R-1", "Running", "color", "red", 0), ("R-1", "Running", "weight", "200 g", 1), ("R-1-2", "Running", "color", "blue", 0), ("R-1-2", "Running", "weight", "150 g", 1), ("R-3", "Running", "weight", "300 g", 1)], "product_id string, cluster string, attr string, value string, ord int"),
        frame([("Running", "p1", 0, "Marathoner", "", ["color", "weight"])], "cluster string, persona_id string, pos int, title string, narrative_seed string, supporting array<string>"),
        frame([("Running", "p1", 0, "weight", "lte", "250", None, "light shoes tire less")], "cluster string, persona_id string, pos int, attribute string, operator string, value string, options array<string>, rationale string"),
    )


def test_audit_and_publish(spark, tmp_path):
    (tmp_path / "shop.csv").write_text(CATALOG)
    done = jobs.audit(spark, f"{tmp_path}/shop.csv", answers(spark), f"{tmp_path}/out")
    assert {r["product_id"] for r in done["products"].collect()} == {"R-1", "R-1-2", "R-3", "B-1"}
    assert {(r["product_id"], r["cluster"]) for r in done["members"].collect()} == {("R-1", "Running"), ("R-1-2", "Running"), ("R-3", "Running"), ("B-1", "Uncategorized")}
    # R-1-2's weight stands nowhere in its source
    assert {(r["product_id"], r["attr"]) for r in done["candidates"].where("verdict = 'rejected'").collect()} == {("R-1-2", "weight")}
    got = {r["attr"]: (r["applicable"], r["missing"], r["missing_pct"], r["missing_products"], r["reason"]) for r in done["by_attribute"].collect()}
    assert got["weight"] == (3, 1, 33.3, "Runner B", "Marathoner: light shoes tire less") and got["color"][:4] == (3, 1, 33.3, "Runner C")
    assert sorted((r["product_id"], r["missing_attributes"]) for r in done["by_product"].collect()) == [("R-1-2", "weight"), ("R-3", "color")]
    assert done["headline"].first()["products"] == 4
    written = spark.read.option("header", True).csv(f"{tmp_path}/out/version=1/requests/by_product")
    assert sorted(r["product_id"] for r in written.collect()) == ["R-1-2", "R-3"]
    fits = {r["product_id"]: (r["fit"], r["qualifies"]) for r in done["product_fit"].collect()}
    assert fits == {"R-1": (100.0, True), "R-1-2": (0.0, False), "R-3": (0.0, False)}
    stats = {r["cluster"]: r for r in done["stats"].collect()}
    assert (stats["Running"]["total"], stats["Running"]["with_values"], stats["Running"]["rejected"]) == (3, 3, 1)
    picked = done["picked"].first()
    assert (picked["persona_id"], picked["rating"], picked["covered"]) == ("p1", 66.7, ["color", "weight"])

    stories = spark.createDataFrame([("Running", "as a runner")], "cluster string, user_story string")
    sent = jobs.publish(spark, f"{tmp_path}/out", *generated(spark), stories, f"{tmp_path}/pub")
    told = {r["product_id"]: r for r in sent["content"].collect()}
    assert [c["claim"] for c in told["R-1"]["derived_insights"]] == ["light enough to race", "race day shoe"]
    assert told["R-1"]["derived_insights"][0]["evidence"][0].asDict() == {"attribute": "weight", "value": "200 g"}
    assert [c["tradeoff"] for c in told["R-1"]["comparisons"]] == ["Verified color: this product is red; Runner B is blue."]
    assert told["R-1"]["unsupported_claims"] == ["Derived insight 'weighs nothing' was removed: an evidence key or value did not match verified attributes.", "Derived statement 'for giants' was removed: not entailed.", "Comparison against Runner Z on color was removed: competitor was not supplied."]
    assert told["B-1"]["unsupported_claims"] == ["No agent content was generated because this product has no verified normalized attributes."] and not told["B-1"]["derived_insights"]
    nodes = {r["product_id"]: json.loads(r["node"]) for r in sent["jsonld"].collect()}
    assert nodes["R-1"]["offers"]["priceCurrency"] == "SGD" and nodes["R-1"]["additionalProperty"][1] == {"@type": "PropertyValue", "name": "weight", "value": "200 g"}
    assert "light enough" in nodes["R-1"]["description"] and nodes["R-3"]["description"] == "Trail runner" and "offers" not in nodes["R-3"]
    rows = {r["product_id"]: r for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/pub/version=1/csv").collect()}
    assert rows["R-1"]["persona"] == "Marathoner" and rows["B-1"]["verified_attributes"] in (None, "")
    near = {(r["product_id"], r["rank"]): r["competitor_id"] for r in sent["competitors"].collect()}
    assert near["R-1", 1] == "R-1-2"
    # nothing that a gate refused is in an export, but in the list of what was refused
    records = [json.loads(line) for f in (tmp_path / "pub/version=1/json").glob("*.json") for line in f.read_text().splitlines()]
    for r in records:
        r["knowledge_layer"].pop("unsupported_claims")
    exported = json.dumps(records) + json.dumps(nodes) + "".join(f.read_text() for f in (tmp_path / "pub/version=1/csv").glob("*.csv"))
    assert "race day shoe" in exported and not any(x in exported for x in ("weighs nothing", "for giants", "Runner Z", "out of nowhere"))
    ready = {r["product_id"]: (r["c_grounding"], r["c_not_for"], r["readiness"]) for r in sent["readiness"].collect()}
    assert ready["R-1"][:2] == (0.5, 0.0) and ready["B-1"][0] == 0.0 and ready["R-1"][2] > ready["B-1"][2]
    board = {r["cluster"]: r for r in sent["dashboard"].collect()}
    assert (board["Running"]["members"], board["Running"]["rejected"], board["Running"]["title"]) == (3, 1, "Marathoner")

    seen = jobs.index(spark, f"{tmp_path}/out", f"{tmp_path}/pub", f"{tmp_path}/index")
    assert sorted((r["side"], r["key"]) for r in seen["entries"].collect()) == [("after", "R-1"), ("before", "R-1")]
    assert tuple(seen["coverage"].first()) == (1, 4)
    assert sorted(r["cluster"] for r in seen["pending"].collect()) == ["Running"]  # two runners have no content at all


def generated(spark):
    """Content of R-1 with one good insight of each kind and one refused by each gate; of B-1, which has no verified fact."""
    cite = "array<struct<attribute:string,value:string>>"
    kind = f"product_id string, personas array<struct<label:string,fit:string>>, derived_insights array<struct<claim:string,reasoning:string,evidence:{cite}>>, query_angles array<struct<shopper_question:string,answer:string,evidence:{cite}>>, not_for array<struct<exclusion:string,reason:string,evidence:{cite}>>, use_cases array<struct<scenario:string,why_it_fits:string,evidence:{cite}>>, comparisons array<struct<against:string,axis:string,target_value:string,competitor_value:string,direction:string>>, unsupported_claims array<string>"
    weight, price = [("Weight", "200 G")], [("catalog price", "S$ 100.00")]
    rows = [
        ("R-1", [("racer", "good")], [("light enough to race", "weighs little", weight), ("weighs nothing", "so light", [("weight", "0 g")]), ("race day shoe", "price and weight", weight + price)], None, [("for giants", "too small", weight)], [], [("runner b", "color", "red", "blue", "different"), ("Runner Z", "color", "red", "blue", "different")], None),
        ("B-1", [("walker", "good")], [("out of nowhere", "no fact", price)], None, None, None, None, ["kept no more"]),
    ]
    yes = spark.createDataFrame([("R-1", "derived_insights:0"), ("R-1", "derived_insights:1")], "product_id string, claim_id string")
    no = spark.createDataFrame([("R-1", "not_for:0", "not entailed")], "product_id string, claim_id string, reason string")
    return spark.createDataFrame(rows, kind), yes, no


def test_a_job_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    from shelfspark import versions

    (tmp_path / "shop.csv").write_text(CATALOG)
    out = f"{tmp_path}/out"
    assert versions.latest(spark, out) == {}
    jobs.audit(spark, f"{tmp_path}/shop.csv", answers(spark), out)
    (tmp_path / "shop.csv").write_text(CATALOG + "Boot C,C-9,10,New boot,black,1 kg\n")
    with monkeypatch.context() as broken:
        broken.setattr(jobs.fit, "product_fit", lambda verdicts: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.audit(spark, f"{tmp_path}/shop.csv", answers(spark), out)
    assert versions.latest(spark, out)["products"].count() == 4
    jobs.audit(spark, f"{tmp_path}/shop.csv", answers(spark), out)
    now = versions.latest(spark, out)
    assert now["products"].count() == 5 and now["headline"].first()["products"] == 5


def test_audit_deals_products_out_once(spark, tmp_path):
    from shelfspark import versions
    from shelfspark.operators import completeness, fit, gaps, normalize

    (tmp_path / "shop.csv").write_text(CATALOG)
    jobs.audit(spark, f"{tmp_path}/shop.csv", answers(spark), f"{tmp_path}/out")
    of = versions.latest(spark, f"{tmp_path}/out")
    products, members, attributes, presence = (of[n] for n in ("products", "members", "attributes", "presence"))
    names = products.select("product_id", "name")
    made = {
        "presence": completeness.attribute_presence(members, of["schema"], of["applicability"], attributes, products.select("product_id", F.map_keys("specs").alias("spec_keys"), "description")),
        "completeness": completeness.product_completeness(presence),
        "verdicts": fit.check_criterion(of["criteria"], members, attributes),
        "by_product": gaps.product_requests(presence, names),
        "raw": normalize.raw_text(products, products.select("product_id", F.posexplode("specs").alias("ord", "key", "value"))),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = {name: df.select("*")._jdf.queryExecution().executedPlan().toString() for name, df in made.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {name: plan.count("Exchange hashpartitioning(") for name, plan in plans.items()} == dict.fromkeys(made, 0), plans


def test_positions_of_several_files(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"part-{i}.csv").write_text("name,price\n" + "".join(f"item {i} {j},1\n" for j in range(5)))
    for lines in (True, False):
        rows = jobs.load(spark, str(tmp_path), "csv", lines).collect()
        assert [r["name"] for r in sorted(rows, key=lambda r: r["position"])] == [f"item {i} {j}" for i in range(4) for j in range(5)]
        assert sorted(r["position"] for r in rows) == list(range(20))


def test_ranks_inside_a_large_group(spark, monkeypatch):
    from shelfspark.functions import ranks as R
    from shelfspark.operators import identity, model_io

    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"c{i % 5}", f"p{i}", 1000 - i) for i in range(600)]
    df = spark.createDataFrame(rows, "cluster string, product_id string, member_pos long").repartition(5)
    plain = {(r["product_id"], r["r"]) for r in R.ranks(df, "cluster", ["member_pos"], "r").collect()}
    monkeypatch.setattr(R, "WINDOW_ROWS", 50)  # now "hot" is ranked by ranges
    split = R.ranks(df, "cluster", ["member_pos"], "r")
    assert {(r["product_id"], r["r"]) for r in split.collect()} == plain
    hot = [r for r in split.withColumn("part", F.spark_partition_id()).where("cluster = 'hot'").collect()]
    assert len({r["part"] for r in hot}) > 1 and sorted(r["r"] for r in hot) == list(range(200))
    batches = clusters.assign_batches(df, 10, "member_pos", by="cluster").where("cluster = 'hot'").groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in batches) == [(b, 10) for b in range(20)]
    products = df.select("product_id", F.col("product_id").alias("name"), F.lit("d").alias("description"), F.create_map(F.lit("k"), F.lit("v")).alias("specs"))
    asked = model_io.normalize_requests(df.where("cluster is not null"), products, spark.createDataFrame([("hot", "a", 0)], "cluster string, attr string, attr_pos int"))
    assert asked.where("cluster = 'hot'").agg(F.sum("n")).first()[0] == 200
    same = spark.createDataFrame([(None if i % 2 else "", i, "n", "d", {"sku": "S" if i % 3 else f"T{i}"}) for i in range(300)], "product_id string, position long, name string, description string, specs map<string,string>")
    ids = [r["product_id"] for r in sorted(identity.ensure_product_ids(same).collect(), key=lambda r: r["position"]) if r["specs"]["sku"] == "S"]
    assert ids == ["S", *(f"S-{k}" for k in range(2, 201))]


def test_evaluate(spark, tmp_path):
    index = spark.createDataFrame([(s, k, [3.0 * (k == 1) + 0.1 * k, 2.0 * (k == 2), 1.0 * (k == 3)], f"text {k}") for s in ("before", "after") for k in (1, 2, 3)], "side string, key long, vec array<float>, text string")
    queries = spark.createDataFrame([(7, "the first one", [1.0, 0.0, 0.0])], "query_id long, query string, vec array<float>")
    facts = spark.createDataFrame([(1, "size", "10", 0), (2, "size", "20", 0)], "key long, attr string, value string, ord int")
    from shelfspark.plans import retrieval_queries, views

    none = retrieval_queries._constraints(views.Views(spark, "/root/testdata/sf0.001")).limit(0)
    rankings = retrieval_queries._rankings(views.Views(spark, "/root/testdata/sf0.001")).limit(0)
    done = jobs.evaluate(spark, queries, index, facts, none, rankings, f"{tmp_path}/out")
    assert {r["side"] for r in done["final_ranks"].collect()} == {"before", "after"}
    assert {r["key"]: r["final_rank"] for r in done["final_ranks"].where("side = 'after'").collect()}[1] == 1
    assert not any(r["moved"] for r in done["movement"].collect())


def test_competitors_of_a_cluster_with_many_prices(spark, monkeypatch):
    from shelfspark.functions import ranks as R
    from shelfspark.operators import competitors

    rows = [("hot", f"p{i}", i, f"${(i * 7919) % 5000}.{i % 100:02}" if i % 9 else None) for i in range(3000)] + [("few", f"q{i}", i, f"${i}" if i < 2 else None) for i in range(6)] + [("same", f"r{i}", i, "$5") for i in range(200)]
    df = spark.createDataFrame(rows, "cluster string, product_id string, member_pos long, price string")
    plain = sorted(tuple(r) for r in competitors.competitors(df).collect())
    monkeypatch.setattr(R, "WINDOW_ROWS", 100)
    assert sorted(tuple(r) for r in competitors.competitors(df.repartition(6)).collect()) == plain
    price = {p: float(x[1:]) for c, p, _, x in rows if x and c == "hot"}
    at = {p: i for _, p, i, _ in rows}
    got = {}
    for _, p, rank, other, _ in plain:
        got.setdefault(p, {})[rank] = other
    for p in ("p1", "p500", "p2999"):
        assert [got[p][k] for k in (1, 2, 3)] == sorted((q for q in price if q != p), key=lambda q: (abs(price[p] - price[q]), at[q]))[:3]
    assert [got["q0"][k] for k in (1, 2, 3)] == ["q1", "q2", "q3"] and [got["q5"][k] for k in (1, 2, 3)] == ["q0", "q1", "q2"]


def test_chunks_joined_are_the_whole_list(spark, monkeypatch):
    from shelfspark.functions import ranks as R
    from shelfspark.operators import gaps

    rows = [("hot" if i % 3 else "c", "size", i % 5 != 0, i % 7 == 0, 500 - i, f"p{i}", f"name {i}") for i in range(500)]
    p = spark.createDataFrame(rows, "cluster string, attr string, applies boolean, present boolean, member_pos long, product_id string, name string").repartition(4)
    presence, names = p.drop("name"), p.select("product_id", "name")
    whole = {r["cluster"]: r["missing_products"] for r in gaps.attribute_requests(presence, names).collect()}
    for rows_of_a_window in (1_000_000, 20):
        monkeypatch.setattr(R, "WINDOW_ROWS", rows_of_a_window)
        parts = {}
        for r in gaps.missing_names(presence, names, 30).collect():
            assert r["n"] <= 30
            parts.setdefault(r["cluster"], {})[r["chunk"]] = r["missing_products"]
        assert {c: ", ".join(x[k] for k in sorted(x)) for c, x in parts.items()} == whole
    first = {r["cluster"]: r["missing_products"] for r in gaps.attribute_requests(presence, names, first=3).collect()}
    assert first == {c: ", ".join(x.split(", ")[:3]) for c, x in whole.items()}
    chunked = clusters.member_chunks(presence.select("cluster", "product_id"), 40).collect()
    assert sorted(i for r in chunked for i in r["product_ids"].split("\n")) == sorted(f"p{i}" for i in range(500))


def test_k_means_by_hand_and_under_another_layout(spark, sf_dir):
    index = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id as key", "embedding as vec")
    one = {r["key"]: r["cluster"] for r in clusters.cluster_by_embedding(index.coalesce(1), 6, 5).collect()}
    assert {r["key"]: r["cluster"] for r in clusters.cluster_by_embedding(index.repartition(7), 6, 5).collect()} == one
    rows = index.orderBy(F.xxhash64("key", F.lit(5)), "key").collect()
    unit = [[x / math.sqrt(sum(y * y for y in r["vec"])) for x in r["vec"]] for r in rows]
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 9)
    centres = [unit[0]]
    while len(centres) < 6:
        centres.append(min(unit, key=lambda u: max(dot(u, c) for c in centres)))
    nearest = lambda u: max(range(6), key=lambda j: (dot(u, centres[j]), -j))
    for _ in range(clusters.STEPS):
        of = [nearest(u) for u in unit]
        sums = [[sum(round(u[i] * clusters.POINT) for u, j in zip(unit, of) if j == c) for i in range(len(unit[0]))] for c in range(6)]
        new = [[x / math.sqrt(sum(y * y for y in s)) for x in s] if any(s) else centres[j] for j, s in enumerate(sums)]
        if all(abs(x - y) < 1e-12 for a, b in zip(new, centres) for x, y in zip(a, b)):
            break
        centres = new
    assert {r["key"]: nearest(u) for r, u in zip(rows, unit)} == one and len(set(one.values())) > 1


def test_cluster_by_embedding(spark):
    rows = [(i, [1.0 + 0.01 * i, 0.0, 0.0] if i % 3 == 0 else [0.0, 1.0, 0.01 * i] if i % 3 == 1 else [0.0, -0.02 * i, -3.0]) for i in range(60)]
    got = clusters.cluster_by_embedding(spark.createDataFrame(rows, "key long, vec array<double>"), 3, 5).collect()
    of = {r["key"]: r["cluster"] for r in got}
    assert len(of) == 60 and len({of[0], of[1], of[2]}) == 3 and all(of[i] == of[i % 3] for i in of)


def test_budget_keeps_calls_without_an_id(spark):
    from shelfspark.operators import model_io

    rows = spark.createDataFrame([(None, 0.5), (1, 0.25), (2, 0.25), (1, 0.5), (None, 0.125)], "call_id long, usd double")
    got = sorted((r["call_id"] if r["call_id"] is not None else 9, r["usd"], r["spent_before"], r["allowed"]) for r in model_io.within_budget(rows, 1.0).collect())
    assert got == [(1, 0.25, 0.0, True), (1, 0.5, 0.25, True), (2, 0.25, 0.75, True), (9, 0.125, 1.0, False), (9, 0.5, 1.125, False)]


def test_csv_line_form(spark, tmp_path):
    from shelfspark.sources import catalog

    (tmp_path / "a.csv").write_text('name,price\n"A, b",1\nC,NA\n')
    for lines in (True, False):
        assert [tuple(r) for r in catalog.read_csv_catalog(spark, f"{tmp_path}/a.csv", lines).collect()] == [("A, b", "1"), ("C", None)]
