"""Trees of hashes: few changes cost few parts."""

from pyspark.sql import functions as F

from shelfspark import jobs
from shelfspark.operators import signature
from shelfspark.tables import Work


def catalog(spark, n):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("cluster"), F.concat(F.lit("p"), F.col("id")).alias("product_id"), F.col("id").alias("price"))


def test_one_changed_product_reads_one_part(spark):
    rows = catalog(spark, 20_000)
    values = [F.col("product_id"), F.col("price")]
    with Work(spark, "test") as work:
        old = signature.tree(work, rows, values)
        new = signature.tree(work, rows.withColumn("price", F.when(F.col("product_id") == "p9", -1).otherwise(F.col("price"))), values)
        seen = {}
        clusters, products = signature.changes(work, old, new, seen)
        assert [tuple(r) for r in clusters.collect()] == [("hot", "changed")] and [tuple(r) for r in products.collect()] == [("hot", "p9", "changed")]
        assert seen["leaves"] <= 8 and seen["clusters"] == 14
        assert old.root.first() != new.root.first() and signature.tree(work, rows.repartition(7), values).root.first() == old.root.first()
        seen = {}
        assert signature.changes(work, old, old, seen)[1].isEmpty() and seen["leaves"] == 0


def test_changes_equal_a_full_comparison(spark, monkeypatch):
    rows = catalog(spark, 900)
    values = [F.col("product_id"), F.col("price")]
    after = rows.where("price % 11 <> 0").withColumn("price", F.when(F.col("price") % 13 == 0, 0).otherwise(F.col("price"))).unionByName(rows.limit(3).withColumn("product_id", F.concat(F.lit("new"), "price"))).unionByName(rows.where("price = 1"))
    key = lambda df: {(r["cluster"], r["product_id"]): r["price"] for r in df.collect()}
    a, b = key(rows), key(after)
    wanted = {(*k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)} | {("c1", "p1", "changed")}  # p1 is there twice
    for few in (500, 2):
        monkeypatch.setattr(signature, "FEW", few)
        with Work(spark, "test") as work:
            found = signature.changes(work, signature.tree(work, rows, values), signature.tree(work, after, values))[1]
            assert {tuple(r) for r in found.collect()} == wanted
            whole = signature.changes(work, signature.tree(work, rows.limit(0), values), signature.tree(work, rows, values))[1]
            assert whole.count() == 900


def test_index_job_works_on_changes(spark, tmp_path):
    from test_jobs import CATALOG, answers, generated

    (tmp_path / "shop.csv").write_text(CATALOG)
    paths = [f"{tmp_path}/{x}" for x in ("audit", "pub", "index")]
    stories = spark.createDataFrame([("Running", "as a runner")], "cluster string, user_story string")

    def run(out, seen=None):
        jobs.audit(spark, f"{tmp_path}/shop.csv", answers(spark), paths[0])
        jobs.publish(spark, paths[0], *generated(spark), stories, paths[1])
        done = jobs.index(spark, paths[0], paths[1], out, seen=seen)
        return done, sorted(tuple(r) for r in done["entries"].select("side", "key", "name", "cluster", "text").collect())

    done, _ = run(paths[2])
    assert done["changed"].count() == 4
    (tmp_path / "shop.csv").write_text(CATALOG.replace("Light runner, red upper", "Light runner, red upper, new sole"))
    seen = {}
    done, entries = run(paths[2], seen)
    assert [(r["product_id"], r["change"]) for r in done["changed"].collect()] == [("R-1", "changed")] and seen["leaves"] == 2
    assert entries == run(f"{tmp_path}/whole")[1] and "new sole" in entries[1][4]
