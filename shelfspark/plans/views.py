"""The catalog as views of the given tables: parts are products, embeddings vectors, events calls and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views for the SQL twins.
SQL_VIEWS = """
cat AS (SELECT 'P' || p_partkey AS product_id, p_partkey AS position, p_name AS name, p_type AS cluster,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'S$' || p_retailprice END AS price, p_name || ' by ' || p_brand AS description, p_size, p_brand, p_type, p_partkey AS k FROM part),
members AS (SELECT cluster, product_id, position AS member_pos FROM cat),
specs AS (SELECT product_id, 0 AS ord, 'size' AS key, p_size::VARCHAR AS value FROM cat UNION ALL SELECT product_id, 1, 'brand', p_brand FROM cat UNION ALL SELECT product_id, 2, 'type', p_type FROM cat),
attributes AS (SELECT product_id, 'size' AS attr, p_size::VARCHAR AS value, 0 AS ord, position FROM cat WHERE k % 5 <> 0 UNION ALL SELECT product_id, 'brand', p_brand, 1, position FROM cat WHERE k % 7 <> 0
  UNION ALL SELECT product_id, 'type', p_type, 2, position FROM cat WHERE k % 11 <> 0 UNION ALL SELECT product_id, 'color', split_part(name, ' ', 1), 3, position FROM cat WHERE k % 3 = 0),
schema_ AS (SELECT DISTINCT cluster, a.attr, a.attr_pos FROM cat, (VALUES ('size', 0), ('brand', 1), ('type', 2), ('color', 3)) AS a(attr, attr_pos)),
applic AS (SELECT product_id, cluster, CASE WHEN k % 13 = 0 THEN ['size', 'brand'] END AS applicable FROM cat),
presence AS (SELECT m.cluster, m.product_id, m.member_pos, s.attr, s.attr_pos, (a.applicable IS NULL OR list_contains(a.applicable, s.attr)) AS applies,
  (a.applicable IS NULL OR list_contains(a.applicable, s.attr)) AND (x.value IS NOT NULL AND trim(x.value) <> '') AS present
  FROM members m JOIN schema_ s USING (cluster) JOIN applic a USING (product_id) LEFT JOIN attributes x ON x.product_id = m.product_id AND x.attr = s.attr),
pc AS (SELECT cluster, product_id, count(*) FILTER (applies AND present) AS n_present, count(*) FILTER (applies AND NOT present) AS n_missing, count(*) FILTER (NOT applies) AS n_off,
  coalesce(string_agg(attr, '|' ORDER BY attr_pos) FILTER (applies AND NOT present), '') AS missing, coalesce(string_agg(attr, '|' ORDER BY attr_pos) FILTER (applies AND present), '') AS present FROM presence GROUP BY ALL),
comp AS (SELECT *, CASE WHEN n_present + n_missing = 0 THEN 100.0 ELSE round_even(100.0 * n_present::DOUBLE / (n_present + n_missing), 1) END AS pct FROM pc),
personas AS (SELECT cluster, cluster || '-' || p.id AS persona_id, p.pos, p.title, p.seed AS narrative_seed, p.supporting FROM (SELECT DISTINCT cluster FROM cat),
  (VALUES ('compact', 0, 'Small space owner', '', ['size', 'brand']), ('colour', 1, 'Colour matcher', 'wants one colour', ['color', 'type', 'weight'])) AS p(id, pos, title, seed, supporting)),
criteria AS (SELECT cluster, persona_id, c.pos, c.attribute, c.operator, c.value, c.options, c.rationale FROM personas p JOIN (VALUES ('compact', 0, 'size', '<=', '20', NULL, 'fits a small room'),
  ('compact', 1, 'brand', 'IN', NULL, ['brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5'], 'known to last'), ('compact', 2, 'color', 'present', NULL, NULL, ''), ('colour', 0, 'color', 'eq', 'Red', NULL, 'must match'),
  ('colour', 1, 'size', 'gt', '10', NULL, 'visible from afar'), ('colour', 2, 'weight', 'lt', '5', NULL, 'light'), ('colour', 3, 'type', 'like', 'x', NULL, 'none')) AS c(id, pos, attribute, operator, value, options, rationale) ON p.persona_id = p.cluster || '-' || c.id)
"""


def with_views(sql: str) -> str:
    return f"WITH {SQL_VIEWS.strip()}{',' if sql.lstrip().upper().startswith('--CTE') else ''} {sql.replace('--CTE', '')}"


class Views:
    """DataFrames of the same names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def cat(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('P', p_partkey) as product_id", "p_partkey as position", "p_name as name", "p_type as cluster", "case when p_partkey % 17 = 0 then null else concat('S$', p_retailprice) end as price",
            "concat(p_name, ' by ', p_brand) as description", "p_size", "p_brand", "p_type", "p_partkey as k",
        )

    @property
    def products(self) -> DataFrame:
        return self.cat.withColumn("specs", F.expr("map('size', cast(p_size as string), 'brand', p_brand, 'type', p_type)")).withColumn("spec_keys", F.expr("array('size', 'brand', 'type')"))

    @property
    def members(self) -> DataFrame:
        return self.cat.select("cluster", "product_id", F.col("position").alias("member_pos"))

    @property
    def specs(self) -> DataFrame:
        return self.cat.selectExpr("product_id", "stack(3, 0, 'size', cast(p_size as string), 1, 'brand', p_brand, 2, 'type', p_type) as (ord, key, value)")

    @property
    def attributes(self) -> DataFrame:
        rows = "stack(4, 'size', cast(p_size as string), 0, k % 5 <> 0, 'brand', p_brand, 1, k % 7 <> 0, 'type', p_type, 2, k % 11 <> 0, 'color', split_part(name, ' ', 1), 3, k % 3 = 0) as (attr, value, ord, ok)"
        return self.cat.selectExpr("product_id", "position", rows).where("ok").drop("ok")

    @property
    def schema(self) -> DataFrame:
        return self.cat.select("cluster").distinct().selectExpr("cluster", "stack(4, 'size', 0, 'brand', 1, 'type', 2, 'color', 3) as (attr, attr_pos)")

    @property
    def applicability(self) -> DataFrame:
        return self.cat.selectExpr("product_id", "cluster", "case when k % 13 = 0 then array('size', 'brand') end as applicable")

    def presence(self, fallback: bool = False) -> DataFrame:
        from shelfspark.operators.completeness import attribute_presence

        return attribute_presence(self.members, self.schema, self.applicability, self.attributes, self.products, fallback)

    @property
    def personas(self) -> DataFrame:
        rows = "stack(2, 'compact', 0, 'Small space owner', '', array('size', 'brand'), 'colour', 1, 'Colour matcher', 'wants one colour', array('color', 'type', 'weight')) as (id, pos, title, narrative_seed, supporting)"
        return self.cat.select("cluster").distinct().selectExpr("cluster", rows).withColumn("persona_id", F.concat_ws("-", "cluster", "id")).drop("id")

    @property
    def criteria(self) -> DataFrame:
        none = "cast(null as string)"
        rows = f"""stack(7, 'compact', 0, 'size', '<=', '20', {none}, 'fits a small room', 'compact', 1, 'brand', 'IN', cast(null as string), 'brand#1|Brand#2|Brand#3|Brand#4|Brand#5', 'known to last',
            'compact', 2, 'color', 'present', cast(null as string), {none}, '', 'colour', 0, 'color', 'eq', 'Red', {none}, 'must match', 'colour', 1, 'size', 'gt', '10', {none}, 'visible from afar',
            'colour', 2, 'weight', 'lt', '5', {none}, 'light', 'colour', 3, 'type', 'like', 'x', {none}, 'none') as (id, pos, attribute, operator, value, options, rationale)"""
        return self.cat.select("cluster").distinct().selectExpr("cluster", rows).withColumn("persona_id", F.concat_ws("-", "cluster", "id")).withColumn("options", F.split("options", r"\|")).drop("id", "cluster")

    @property
    def index(self) -> DataFrame:
        return self.table("embeddings").selectExpr("'raw' as side", "vec_id as key", "embedding as vec", "label")
