"""Completeness, personas, fit, gaps, competitors and readiness over the catalog view."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import competitors, completeness, export, fit, gaps, normalize, readiness, summary
from shelfspark.tables import Work

from .views import Views, with_views

QUERIES, ORACLES = {}, {}


def query(sql: str | None):  # noqa: ANN201
    def add(fn):  # noqa: ANN001, ANN202
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = with_views(sql)
        return fn

    return add


def joined(df, *columns):  # noqa: ANN001, ANN201
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


@query("SELECT cluster, product_id, attr, applies, present FROM presence")
def a1_presence(v):  # noqa: ANN001, ANN201
    return v.presence().select("cluster", "product_id", "attr", "applies", "present")


@query("""SELECT c.product_id, s.attr, CASE WHEN n.n IS NOT NULL THEN x.value IS NOT NULL ELSE s.attr IN ('size', 'brand', 'type') OR contains(lower(c.description), s.attr) END AS present
  FROM cat c JOIN schema_ s USING (cluster) LEFT JOIN (SELECT product_id, count(*) AS n FROM attributes WHERE position % 4 <> 0 GROUP BY 1) n ON n.product_id = c.product_id
  LEFT JOIN (SELECT * FROM attributes WHERE position % 4 <> 0) x ON x.product_id = c.product_id AND x.attr = s.attr""")
def a1_presence_fallback(v):  # noqa: ANN001, ANN201
    all_ = v.applicability.withColumn("applicable", F.lit(None).cast("array<string>"))
    return completeness.attribute_presence(v.members, v.schema, all_, v.attributes.where("position % 4 <> 0"), v.products).select("product_id", "attr", "present")


@query("SELECT cluster, product_id, present, missing, n_off AS not_applicable, pct FROM comp")
def a2_product_completeness(v):  # noqa: ANN001, ANN201
    return joined(completeness.product_completeness(v.presence()), "present", "missing").withColumn("not_applicable", F.size("not_applicable").cast("long"))


@query("SELECT cluster, attr, count(*) FILTER (applies AND NOT present) AS missing FROM presence GROUP BY ALL")
def a3_missing_counts(v):  # noqa: ANN001, ANN201
    return completeness.missing_counts(v.presence())


@query("SELECT cluster, round_even(sum(pct::DECIMAL(10,1))::DOUBLE / count(*), 1) AS completeness FROM comp GROUP BY cluster")
def a4_cluster_completeness(v):  # noqa: ANN001, ANN201
    return completeness.cluster_completeness(completeness.product_completeness(v.presence()))


@query("SELECT DISTINCT cluster, attr FROM presence WHERE present")
def a5_present_anywhere(v):  # noqa: ANN001, ANN201
    return completeness.present_anywhere(v.presence())


RATING_SQL = """rating AS (SELECT cluster, persona_id, round_even(100.0 * sum(share::DECIMAL(20,12))::DOUBLE / count(*), 1) AS rating FROM (
  SELECT w.cluster, w.persona_id, p.product_id, count(*) FILTER (p.present)::DOUBLE / count(*) AS share FROM (SELECT cluster, persona_id, unnest(supporting) AS attr FROM personas) w JOIN presence p USING (cluster, attr) GROUP BY ALL) GROUP BY ALL)"""


@query(f"--CTE {RATING_SQL} SELECT cluster, persona_id, rating FROM rating")
def a6_persona_rating(v):  # noqa: ANN001, ANN201
    return completeness.persona_rating(v.personas, v.presence()).select("cluster", "persona_id", "rating")


@query("""--CTE w AS (SELECT cluster, persona_id, s.attr, s.i FROM personas, LATERAL (SELECT unnest(supporting) AS attr, generate_subscripts(supporting, 1) AS i) s), t AS (SELECT DISTINCT cluster, attr FROM presence WHERE present)
SELECT w.cluster, persona_id, coalesce(string_agg(w.attr, '|' ORDER BY i) FILTER (t.attr IS NOT NULL), '') AS covered, coalesce(string_agg(w.attr, '|' ORDER BY i) FILTER (t.attr IS NULL), '') AS missing FROM w LEFT JOIN t ON t.cluster = w.cluster AND t.attr = w.attr GROUP BY 1, 2""")
def a7_persona_coverage(v):  # noqa: ANN001, ANN201
    return joined(completeness.persona_coverage(v.personas, v.presence()), "covered", "missing").select("cluster", "persona_id", "covered", "missing")


@query(f"--CTE {RATING_SQL} SELECT cluster, arg_min(persona_id, (CASE WHEN cluster = 'LARGE' THEN -pos ELSE 0 END, -rating, pos)) AS persona_id FROM rating JOIN personas USING (cluster, persona_id) GROUP BY cluster")
def a8_pick_persona(v):  # noqa: ANN001, ANN201
    rated = completeness.persona_rating(v.personas, v.presence()).withColumn("selected", F.when(F.col("cluster") == "LARGE", F.col("pos") == 1))
    return completeness.pick_persona(rated).select("cluster", "persona_id")


FIT_SQL = """verdicts AS (SELECT c.cluster, c.persona_id, m.product_id, c.pos, c.attribute || ' ' || CASE c.operator WHEN '<=' THEN 'lte' ELSE lower(c.operator) END || coalesce(' ' || coalesce(array_to_string(c.options, ', '), c.value), '') AS label,
  CASE WHEN a.value IS NULL THEN NULL WHEN lower(c.operator) = 'present' THEN true WHEN c.operator = '<=' THEN a.value::DOUBLE <= 20 WHEN c.operator = 'gt' THEN a.value::DOUBLE > 10
    WHEN c.operator = 'IN' THEN list_contains(list_transform(c.options, lambda o: lower(o)), lower(a.value)) WHEN c.operator = 'eq' THEN lower(a.value) = 'red' END AS verdict
  FROM criteria c JOIN members m USING (cluster) LEFT JOIN attributes a ON a.product_id = m.product_id AND a.attr = c.attribute WHERE c.attribute <> 'weight' AND c.operator <> 'like'),
fits AS (SELECT cluster, persona_id, product_id, coalesce(string_agg(label, '|' ORDER BY pos) FILTER (verdict), '') AS passed, coalesce(string_agg(label, '|' ORDER BY pos) FILTER (NOT verdict), '') AS failed,
  coalesce(string_agg(label, '|' ORDER BY pos) FILTER (verdict IS NULL), '') AS unknown, round_even(100.0 * count(verdict)::DOUBLE / count(*), 1) AS coverage,
  CASE WHEN count(verdict) = 0 THEN 0 ELSE round_even(100.0 * count(*) FILTER (verdict)::DOUBLE / count(verdict), 1) END AS fit, count(*) FILTER (verdict) = count(*) AS qualifies FROM verdicts GROUP BY ALL)"""


def _fits(v):  # noqa: ANN001, ANN202
    clean = fit.clean_criteria(v.criteria, v.personas, v.schema)
    return fit.product_fit(fit.check_criterion(clean, v.members, v.attributes))


@query("SELECT cluster, persona_id, attribute, CASE operator WHEN '<=' THEN 'lte' ELSE lower(operator) END AS operator FROM criteria WHERE attribute <> 'weight' AND operator <> 'like'")
def f1_clean_criteria(v):  # noqa: ANN001, ANN201
    return fit.clean_criteria(v.criteria, v.personas, v.schema).select("cluster", "persona_id", "attribute", "operator")


@query(f"--CTE {FIT_SQL} SELECT persona_id, product_id, pos, verdict FROM verdicts")
def f2_verdicts(v):  # noqa: ANN001, ANN201
    return fit.check_criterion(fit.clean_criteria(v.criteria, v.personas, v.schema), v.members, v.attributes).select("persona_id", "product_id", "pos", "verdict")


@query(f"--CTE {FIT_SQL} SELECT * FROM fits")
def f3_product_fit(v):  # noqa: ANN001, ANN201
    return joined(_fits(v), "passed", "failed", "unknown")


@query(f"--CTE {FIT_SQL} SELECT cluster, persona_id, round_even(sum(coverage::DECIMAL(10,1))::DOUBLE / count(*), 1) AS coverage, round_even(100.0 * count(*) FILTER (qualifies)::DOUBLE / count(*), 1) AS fit, count(*) FILTER (qualifies) AS qualifying, count(*) AS products FROM fits GROUP BY ALL")
def f4_cluster_fit(v):  # noqa: ANN001, ANN201
    return fit.cluster_fit(_fits(v))


REASON_SQL = """reasons AS (SELECT cluster, attribute AS attr, string_agg(p.title || ': ' || rationale, ' | ' ORDER BY p.pos, c.pos) AS reason FROM criteria c JOIN personas p USING (cluster, persona_id) WHERE rationale <> '' GROUP BY ALL)"""
ATTR_REQUEST_SQL = f"""{REASON_SQL}, areq AS (SELECT p.cluster, p.attr, count(*) AS applicable, count(*) FILTER (NOT present) AS missing, round_even(100.0 * count(*) FILTER (NOT present)::DOUBLE / count(*), 1) AS missing_pct,
  coalesce(any_value(r.reason), 'Expected for this category by buyers and shopping agents') AS reason, string_agg(c.name, ', ' ORDER BY member_pos) FILTER (NOT present) AS missing_products
  FROM presence p JOIN cat c USING (product_id) LEFT JOIN reasons r ON r.cluster = p.cluster AND r.attr = p.attr WHERE applies GROUP BY p.cluster, p.attr HAVING count(*) FILTER (NOT present) > 0)"""
PRODUCT_REQUEST_SQL = """preq AS (SELECT p.cluster, p.product_id, any_value(c.name) AS name, count(*) AS applicable, count(*) FILTER (NOT present) AS missing, round_even(100.0 * count(*) FILTER (NOT present)::DOUBLE / count(*), 1) AS missing_pct,
  string_agg(attr, ', ' ORDER BY attr_pos) FILTER (NOT present) AS missing_attributes FROM presence p JOIN cat c USING (product_id) WHERE applies GROUP BY p.cluster, p.product_id HAVING count(*) FILTER (NOT present) > 0)"""


def _names(v):  # noqa: ANN001, ANN202
    return v.cat.select("product_id", "name")


@query(f"--CTE {REASON_SQL} SELECT * FROM reasons")
def d1_attribute_reasons(v):  # noqa: ANN001, ANN201
    return gaps.attribute_reasons(v.personas, v.criteria)


@query(f"--CTE {ATTR_REQUEST_SQL} SELECT * FROM areq")
def d2_attribute_requests(v):  # noqa: ANN001, ANN201
    return gaps.attribute_requests(v.presence(), _names(v), gaps.attribute_reasons(v.personas, v.criteria))


@query("--CTE r AS (SELECT p.cluster, p.attr, c.name, row_number() OVER (PARTITION BY p.cluster, p.attr ORDER BY member_pos) - 1 AS r FROM presence p JOIN cat c USING (product_id) WHERE applies AND NOT present) SELECT cluster, attr, r // 50 AS chunk, count(*) AS n, string_agg(name, ', ' ORDER BY r) AS missing_products FROM r GROUP BY cluster, attr, r // 50")
def d5_missing_names(v):  # noqa: ANN001, ANN201
    """The names behind the attribute work order, 50 to a row."""
    return gaps.missing_names(v.presence(), _names(v), 50)


@query(f"--CTE {PRODUCT_REQUEST_SQL} SELECT cluster, product_id, name, applicable::VARCHAR AS applicable, missing::VARCHAR AS missing, missing_attributes FROM preq")
def e8_written_requests(v):  # noqa: ANN001, ANN201
    """The product work order as it is read back from its CSV files."""
    p = v.presence()
    with Work(v.spark, "requests") as work:
        export.write_requests(gaps.attribute_requests(p, _names(v), first=gaps.NAMES), gaps.product_requests(p, _names(v)), f"{work.folder}/requests")
        found = v.spark.read.option("header", True).option("escape", '"').csv(f"{work.folder}/requests/by_product")
        return work.result(found.select("cluster", "product_id", "name", "applicable", "missing", "missing_attributes"))


@query(f"--CTE {PRODUCT_REQUEST_SQL} SELECT * FROM preq")
def d3_product_requests(v):  # noqa: ANN001, ANN201
    return gaps.product_requests(v.presence(), _names(v))


@query(f"--CTE {ATTR_REQUEST_SQL}, {PRODUCT_REQUEST_SQL} SELECT (SELECT count(*) FROM areq) AS attribute_rows, (SELECT count(*) FROM preq) AS product_rows, (SELECT count(*) FROM members) AS products, w.cluster AS worst_cluster, w.attr AS worst_attr, w.missing AS worst_missing FROM (SELECT * FROM areq ORDER BY missing DESC, cluster, attr LIMIT 1) w")
def d4_gap_headline(v):  # noqa: ANN001, ANN201
    p = v.presence()
    return gaps.gap_headline(gaps.attribute_requests(p, _names(v)), gaps.product_requests(p, _names(v)), v.members)


@query("""--CTE p AS (SELECT cluster, product_id, position, CASE WHEN price IS NOT NULL THEN regexp_extract(price, '[0-9][0-9.]*')::DOUBLE END AS p FROM cat),
pairs AS (SELECT a.cluster, a.product_id, b.product_id AS competitor_id, b.position AS bp, CASE WHEN a.p IS NOT NULL THEN abs(a.p - b.p) END AS d FROM p a JOIN p b ON a.cluster = b.cluster AND a.product_id <> b.product_id),
r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY d NULLS LAST, bp) AS rank FROM pairs) SELECT cluster, product_id, rank, competitor_id FROM r WHERE rank <= 3""")
def v2_competitors(v):  # noqa: ANN001, ANN201
    return competitors.competitors(v.members.join(v.cat.select("product_id", "price"), "product_id")).select("cluster", "product_id", "rank", "competitor_id")


@query("SELECT product_id, attr, value FROM attributes UNION ALL SELECT product_id, 'catalog_price', price FROM cat WHERE price IS NOT NULL")
def v3_verified(v):  # noqa: ANN001, ANN201
    return competitors.verified_attributes(v.cat, v.attributes).select("product_id", "attr", "value")


@query("SELECT product_id, 'No agent content was generated because this product has no verified normalized attributes.' AS message FROM cat WHERE k % 4 = 0")
def v4_unverified(v):  # noqa: ANN001, ANN201
    own = v.attributes.withColumn("value", F.when(F.col("position") % 4 == 0, " ").otherwise(F.col("value"))).unionByName(v.attributes.where("attr = 'type'").withColumn("position", F.col("position")).limit(0))
    some = own.unionByName(v.cat.where("k % 4 <> 0").selectExpr("product_id", "position", "'x' as attr", "'1' as value", "9 as ord"))
    return competitors.gate_unverified(v.cat, some).select("product_id", F.array_join("unsupported_claims", "|").alias("message"))


#: Content measures of a product, derived from its key.
CONTENT = {"has_content": "k % 3 <> 0", "n_not_for": "k % 4", "n_kept": "k % 7", "n_unsupported": "k % 5"}
READY_SQL = """ready AS (SELECT c.cluster, c.product_id, m.pct, x.k, round_even(m.pct / 100, 4) AS c0,
  CASE WHEN k % 3 <> 0 THEN round_even(least(k % 6, 4) / 4.0 * CASE WHEN k % 2 = 0 AND k % 6 > 0 THEN 1.0 ELSE 0.7 END, 4) ELSE 0 END AS c1, CASE WHEN k % 3 <> 0 THEN round_even(least(k % 4, 2) / 2.0, 4) ELSE 0 END AS c2,
  CASE WHEN k % 3 <> 0 THEN round_even(least(k % 5, 3) / 3.0, 4) ELSE 0 END AS c3, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 7 + k % 5 = 0 THEN 0.5 ELSE round_even((k % 7) / ((k % 7) + (k % 5))::DOUBLE, 4) END ELSE 0 END AS c4
  FROM members c JOIN comp m USING (product_id) JOIN cat x USING (product_id)),
scores AS (SELECT *, round_even(round(100 * (c0 * 0.25 + c1 * 0.20 + c2 * 0.15 + c3 * 0.15 + c4 * 0.25)::DOUBLE, 6), 1) AS readiness FROM ready),
cscores AS (SELECT cluster, round_even(sum(readiness::DECIMAL(10,1))::DOUBLE / count(*), 1) AS readiness FROM scores GROUP BY cluster)"""


def _scores(v):  # noqa: ANN001, ANN202
    comp = completeness.product_completeness(v.presence()).select("cluster", "product_id", F.col("pct").alias("completeness"), "missing")
    rows = comp.join(v.cat.select("product_id", "k"), "product_id").withColumns({c: F.expr(e) for c, e in CONTENT.items()})
    some = lambda n, f: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), f), lambda x: x.isNotNull()) if n is None else F.slice(F.transform(F.sequence(F.lit(1), F.lit(9)), f), 1, F.expr(n))
    rows = rows.withColumns({
        "labels": some("int(k % 6)", lambda i: F.concat(F.lit("Label "), i.cast("string"))), "fits": some("int(k % 6)", lambda i: F.when((i == 1) & (F.col("k") % 2 == 0), "poor").otherwise("good")),
        "tradeoffs": some("int(k % 5)", lambda i: F.concat(F.lit("t"), i.cast("string"))),
    })
    return readiness.readiness_score(readiness.score_components(rows))


@query(f"--CTE {READY_SQL} SELECT product_id, c0 AS c_completeness, c1 AS c_personas, c2 AS c_not_for, c3 AS c_comparisons, c4 AS c_grounding FROM ready")
def r1_components(v):  # noqa: ANN001, ANN201
    return _scores(v).select("product_id", "c_completeness", "c_personas", "c_not_for", "c_comparisons", "c_grounding")


@query(f"--CTE {READY_SQL} SELECT product_id, readiness FROM scores")
def r2_readiness(v):  # noqa: ANN001, ANN201
    return _scores(v).select("product_id", "readiness")


@query(f"--CTE {READY_SQL} SELECT * FROM cscores")
def r3_cluster_readiness(v):  # noqa: ANN001, ANN201
    return readiness.cluster_readiness(_scores(v))


@query(f"--CTE {READY_SQL} SELECT round_even(sum(readiness::DECIMAL(10,1))::DOUBLE / count(*), 1) AS readiness FROM cscores")
def r4_catalog_readiness(v):  # noqa: ANN001, ANN201
    return readiness.catalog_readiness(readiness.cluster_readiness(_scores(v)))


@query("""--CTE g AS (SELECT product_id, k, missing, unnest([1, 2, 3, 4, 5]) AS i FROM comp JOIN cat USING (product_id)),
m AS (SELECT product_id, k, i, CASE i WHEN 1 THEN CASE WHEN missing <> '' THEN 'Missing filterable attributes: ' || replace(missing, '|', ', ') END
  WHEN 2 THEN CASE WHEN k % 3 = 0 THEN 'No persona selected yet — pick one to generate content' WHEN NOT (k % 2 = 0 AND k % 6 > 0) THEN 'No ''poor fit'' persona — a card that suits everyone ranks for no one' END
  WHEN 3 THEN CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN 'No negative information — nothing stops a wrong recommendation' END WHEN 4 THEN CASE WHEN k % 3 <> 0 AND k % 5 = 0 THEN 'No comparison states a tradeoff, so agents can''t rank this against siblings' END
  ELSE CASE WHEN k % 3 <> 0 AND k % 5 > 0 THEN (k % 5) || ' claim(s) flagged unsupported and pending review' END END AS t FROM g)
SELECT c.product_id, coalesce(string_agg(m.t, '|' ORDER BY CASE WHEN m.k % 3 = 0 THEN 0 ELSE -length(t) END, i), '') AS gaps FROM cat c LEFT JOIN m ON m.product_id = c.product_id AND m.t IS NOT NULL GROUP BY c.product_id""")
def r5_top_gaps(v):  # noqa: ANN001, ANN201
    return joined(readiness.top_gaps(_scores(v)), "gaps").select("product_id", "gaps")


@query(f"--CTE {READY_SQL}, {FIT_SQL} SELECT c.cluster, c.members, x.completeness, r.readiness, 'Small space owner' AS title, f.fit, l.missing, 4 AS schema_size, c.members AS total, st.with_values, st.rejected, 0 AS failed_batches, false AS applicability FROM (SELECT cluster, count(*) AS members FROM members GROUP BY 1) c JOIN (SELECT cluster, round_even(sum(pct::DECIMAL(10,1))::DOUBLE / count(*), 1) AS completeness FROM comp GROUP BY 1) x USING (cluster) JOIN cscores r USING (cluster) JOIN (SELECT cluster, round_even(100.0 * count(*) FILTER (qualifies)::DOUBLE / count(*), 1) AS fit FROM fits WHERE persona_id LIKE '%compact' GROUP BY 1) f USING (cluster) JOIN (SELECT cluster, string_agg(DISTINCT attr, '|' ORDER BY attr) AS missing FROM presence WHERE applies AND NOT present GROUP BY 1) l USING (cluster) JOIN (SELECT m.cluster, count(DISTINCT CASE WHEN a.ord <> 3 THEN a.product_id END) AS with_values, count(*) FILTER (a.ord = 3) AS rejected FROM attributes a JOIN members m USING (product_id) GROUP BY 1) st USING (cluster)")
def r6_dashboard(v):  # noqa: ANN001, ANN201
    p = v.presence()
    picked = v.personas.where("pos = 0")
    values = v.attributes.select("product_id", F.when(F.col("ord") == 3, "rejected").otherwise("kept").alias("verdict"))
    stats = normalize.normalization_stats(v.members, values, v.applicability, v.spark.createDataFrame([], "cluster string, ok boolean"), v.schema)
    board = readiness.cluster_dashboard(v.members, completeness.cluster_completeness(completeness.product_completeness(p)), readiness.cluster_readiness(_scores(v)), picked, fit.cluster_fit(_fits(v)), completeness.missing_counts(p), stats)
    return joined(board, "missing").drop("fit_coverage")


@query("""--CTE r AS (SELECT cluster, price, position, row_number() OVER (PARTITION BY cluster ORDER BY position) AS r FROM cat)
SELECT c.cluster, count(*) AS product_count, (SELECT coalesce(string_agg(price, '|' ORDER BY position), '') FROM r WHERE r.cluster = c.cluster AND r <= 8 AND price IS NOT NULL) AS sample_prices, (SELECT string_agg(attr, '|' ORDER BY attr_pos) FROM schema_ s WHERE s.cluster = c.cluster) AS available_attributes,
  (SELECT coalesce(string_agg(attr, '|' ORDER BY attr_pos), '') FROM (SELECT DISTINCT attr, attr_pos FROM presence p WHERE p.cluster = c.cluster AND applies AND NOT present)) AS missing_attributes, (SELECT string_agg(coalesce(nullif(narrative_seed, ''), title), '|' ORDER BY pos) FROM personas p WHERE p.cluster = c.cluster) AS shopper_intents FROM members c GROUP BY c.cluster""")
def u1_catalog_summary(v):  # noqa: ANN001, ANN201
    return joined(summary.catalog_summary(v.members, v.cat, v.schema, completeness.missing_counts(v.presence()), v.personas), "sample_prices", "available_attributes", "missing_attributes", "shopper_intents")


@query("""SELECT l_shipmode AS attr, missing_quantity FROM (SELECT p.attr AS l_shipmode, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS missing_quantity FROM lineitem JOIN presence p ON p.product_id = 'P' || l_partkey WHERE applies AND NOT present GROUP BY p.attr)""")
def w1_demand_weighted_gaps(v):  # noqa: ANN001, ANN201
    """Missing attributes weighted by ordered quantity: the large join of the catalog audit."""
    lacks = v.presence().where("applies and not present").select(F.expr("cast(substring(product_id, 2) as bigint)").alias("l_partkey"), "attr")
    sold = v.table("lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    return sold.join(lacks, "l_partkey").groupBy("attr").agg(F.sum("q").cast("double").alias("missing_quantity"))
