"""Requests to models, defaults of what comes back, and clusters by embedding, over the catalog view."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import clusters, competitors, model_io
from shelfspark.sources import catalog

from .views import Views, with_views

QUERIES, ORACLES = {}, {}


def query(sql: str | None):  # noqa: ANN201
    def add(fn):  # noqa: ANN001, ANN202
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = with_views(sql)
        return fn

    return add


@query("SELECT product_id, price, CASE WHEN k % 3 = 0 THEN '' ELSE description END AS description, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS n_specs, CASE WHEN k % 5 <> 0 THEN p_brand END AS image_description, p_size AS source_page, 'vision' AS extraction_mode FROM cat")
def s14_default_extracted(v):  # noqa: ANN001, ANN201
    rows = v.cat.selectExpr(
        "product_id", "coalesce(price, '') as price", "case when k % 3 = 0 then null else description end as description", "case when k % 2 = 0 then map('a', 'b') end as specs",
        "case when k % 5 = 0 then '' else p_brand end as image_description", "-1 as source_page", "p_size as page",
    )
    return catalog.default_extracted(rows, "vision").select("product_id", "price", "description", F.size(F.map_keys("specs")).alias("n_specs"), "image_description", "source_page", "extraction_mode")


@query("SELECT product_id, CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS insights, CASE WHEN k % 3 = 0 THEN p_brand ELSE '' END AS not_for, 3 AS schema_version FROM cat")
def v5_default_content(v):  # noqa: ANN001, ANN201
    rows = v.cat.selectExpr("product_id", "case when k % 2 = 0 then array('a', name) end as insights", "case when k % 3 = 0 then array(p_brand) end as not_for")
    return competitors.default_content(rows, ["insights", "not_for"]).select("product_id", F.size("insights").alias("insights"), F.array_join("not_for", "|").alias("not_for"), "schema_version")


@query("""SELECT cluster AS query_id, CASE WHEN k % 2 = 0 THEN 'before' ELSE 'after' END AS side, string_agg('[candidate_id: ' || k || ']' || chr(10) || 'Name: ' || name || chr(10) || 'Verified hard-constraint checks: '
  || CASE WHEN k % 3 = 0 THEN '[{"requirement":"fits","attribute":"size","status":"pass","actual":"' || p_size || '"},{"requirement":"made by","attribute":"brand","status":"fail","actual":"' || p_brand || '"}]' ELSE '[]' END
  || chr(10) || 'Content on file:' || chr(10) || left(description, 20), chr(10) || chr(10) ORDER BY k) AS prompt FROM cat WHERE p_size <= 10 GROUP BY 1, 2""")
def m4_rerank_requests(v):  # noqa: ANN001, ANN201
    some = v.cat.where("p_size <= 10").withColumns({"query_id": F.col("cluster"), "side": F.when(F.col("k") % 2 == 0, "before").otherwise("after"), "key": F.col("k")})
    gated = some.select("query_id", "side", "key", F.col("k").alias("candidate"), "name", F.col("description").alias("text"))
    checks = some.where("k % 3 = 0").selectExpr("query_id", "side", "key", "stack(2, 1, 'made by', 'brand', 'fail', p_brand, 0, 'fits', 'size', 'pass', cast(p_size as string)) as (pos, requirement, resolved, status, actual)")
    return model_io.rerank_requests(gated, checks, 20)


@query("SELECT cluster, persona_id, title || chr(10) || e.t AS prompt FROM personas JOIN (SELECT cluster, string_agg(x, chr(10) ORDER BY x) AS t FROM (SELECT DISTINCT cluster, 'brand: ' || min(p_brand) OVER (PARTITION BY cluster) AS x FROM cat UNION SELECT DISTINCT cluster, 'size: ' || max(p_size) OVER (PARTITION BY cluster) FROM cat) GROUP BY 1) e USING (cluster)")
def m11_criteria_requests(v):  # noqa: ANN001, ANN201
    of = v.cat.groupBy("cluster").agg(F.min("p_brand").alias("b"), F.max("p_size").cast("string").alias("s"))
    return model_io.criteria_requests(v.personas, of.selectExpr("cluster", "stack(2, 'brand', b, 'size', s) as (attr, example)"))


@query("""--CTE f AS (SELECT product_id, string_agg(attr || ': ' || value, ', ' ORDER BY ord) AS t FROM attributes GROUP BY 1), n AS (SELECT cluster, product_id, lead(product_id) OVER (PARTITION BY cluster ORDER BY position) AS other FROM cat)
SELECT f.product_id, 'Verified facts: ' || f.t || chr(10) || 'Competitors:' || chr(10) || coalesce(n.other || ' - ' || g.t, 'none') AS prompt FROM f JOIN n USING (product_id) LEFT JOIN f g ON g.product_id = n.other""")
def m11_content_requests(v):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    near = v.cat.select("product_id", F.lead("product_id").over(Window.partitionBy("cluster").orderBy("position")).alias("competitor_id"), F.lit(1).alias("rank")).where("competitor_id is not null")
    return model_io.content_requests(v.attributes, near)


@query("""SELECT product_id, CASE WHEN k % 2 = 0 THEN '{"id":"insights:0","statement":"' || name || '","evidence":["' || p_brand || '"]}' || chr(10) ELSE '' END || '{"id":"not_for:0","statement":"big","evidence":["' || p_size || '"]}' AS prompt FROM cat""")
def m11_review_requests(v):  # noqa: ANN001, ANN201
    claim = "named_struct('field', '{}', 'idx', {}, 'text1', {}, 'evidence', array({}), 'kept', {})"
    rows = v.cat.selectExpr("product_id", "inline(array(" + ", ".join(claim.format(*x) for x in (("insights", 1, "name", "p_brand", "k % 2 = 0"), ("not_for", 2, "'big'", "cast(p_size as string)", "true"), ("insights", 0, "'unproved'", "'x'", "false"))) + "))")
    return model_io.review_requests(rows)


@query(None)
def c7_cluster_by_embedding(v):  # noqa: ANN001, ANN201
    """Groups of all vectors; no SQL for k-means: tests hold it against groups that are far apart."""
    return clusters.cluster_by_embedding(v.index, 8, 5).select("key", F.col("cluster").cast("long").alias("cluster"))
