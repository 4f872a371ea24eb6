"""The batch jobs, from paths and tables of model answers to written results.

Answers of models arrive as tables (see operators.model_io for the requests that they answer), so each job is one Spark
plan a result and can be run again after lost executors. Results are versions under `out` (see versions): Parquet tables, and
work orders and exports as CSV, JSON and JSON-LD besides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.ranks import positions
from shelfspark.operators import clusters, competitors, completeness, content, export, fit, gaps, identity, normalize, passages, readiness, retrieval, signature
from shelfspark.sources import catalog
from shelfspark.tables import Work
from shelfspark.versions import Version, latest


@dataclass
class Answers:
    """Tables of an audit that models or people supply.

    labels (cluster_pos, cluster, item_pos, index text); mapping (source, final, pos); schema (cluster, attr, attr_pos);
    applicability (product_id, attrs); candidates (product_id, cluster, attr, value, ord); personas (cluster, persona_id,
    pos, title, narrative_seed, supporting, and perhaps selected); criteria (cluster, persona_id, pos, attribute, operator,
    value, options, rationale); attempts (cluster, batch, attempt, ok) of the normalize requests, if known."""

    labels: DataFrame
    mapping: DataFrame
    schema: DataFrame
    applicability: DataFrame
    candidates: DataFrame
    personas: DataFrame
    criteria: DataFrame
    attempts: DataFrame | None = None


def load(spark: SparkSession, path: str, format: str | None = None, lines: bool = False) -> DataFrame:
    """Products of a catalog file with positions and unique ids. lines: no field holds a line end, so a CSV file can be split."""
    rows = catalog.load_catalog(spark, path, format, lines)
    placed = rows if "position" in rows.columns else positions(rows.withColumn("__file", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id()), [F.col("__file"), F.col("__at")]).drop("__at", "__file")
    return identity.ensure_product_ids(placed)


def audit(spark: SparkSession, path: str, given: Answers, out: str, format: str | None = None, lines: bool = False) -> dict[str, DataFrame]:
    """Read, identify, cluster, normalize, measure completeness, coverage and fit, and write the work orders.

    Product-level tables are bucketed by product_id when they are written: each is dealt out once, and what is made of them
    (presence, completeness, verdicts, work orders) joins and groups by product without a further exchange."""
    done = Version(spark, out)
    products = done.bucketed(load(spark, path, format, lines), "products", "product_id")
    members = done.bucketed(clusters.merge_labels(clusters.validate_membership(given.labels, products), given.mapping), "members", "product_id")
    schema = done.table(normalize.clean_schema(given.schema), "schema")
    applies = done.bucketed(normalize.validate_applicability(given.applicability, schema, members), "applicability", "product_id")
    specs = products.select("product_id", F.posexplode("specs").alias("ord", "key", "value"))
    checked = done.bucketed(normalize.verify_attributes(given.candidates, normalize.raw_text(products, specs)), "candidates", "product_id")
    attributes = done.bucketed(checked.where("verdict = 'kept'").select("product_id", "attr", "value", "ord"), "attributes", "product_id")
    tries = normalize.batch_status(given.attempts) if given.attempts is not None else spark.createDataFrame([], "cluster string, batch long, ok boolean")
    done.table(normalize.normalization_stats(members, checked.select("product_id", "verdict"), applies, tries, schema), "stats")

    named = products.select("product_id", F.map_keys("specs").alias("spec_keys"), "description")
    presence = done.bucketed(completeness.attribute_presence(members, schema, applies, attributes, named, fallback=False), "presence", "product_id")
    per_product = done.table(completeness.product_completeness(presence), "completeness")
    done.table(completeness.missing_counts(presence), "missing")
    done.table(completeness.cluster_completeness(per_product), "cluster_completeness")
    rated = completeness.persona_coverage(completeness.persona_rating(given.personas, presence), presence)
    rated = done.table(rated if "selected" in rated.columns else rated.withColumn("selected", F.lit(False)), "personas")
    done.table(completeness.pick_persona(rated), "picked")

    criteria = done.table(fit.clean_criteria(given.criteria.drop("cluster"), given.personas, schema), "criteria")
    verdicts = done.table(fit.check_criterion(criteria, members, attributes), "verdicts")
    fits = done.table(fit.product_fit(verdicts), "product_fit")
    done.table(fit.cluster_fit(fits), "cluster_fit")

    names = products.select("product_id", "name")
    by_attribute = done.table(gaps.attribute_requests(presence, names, gaps.attribute_reasons(given.personas, criteria.drop("cluster")), gaps.NAMES), "by_attribute")
    done.table(gaps.missing_names(presence, names), "by_attribute_names")
    done.table(clusters.member_chunks(members), "member_chunks")
    by_product = done.table(gaps.product_requests(presence, names), "by_product")
    done.table(gaps.gap_headline(by_attribute, by_product, members), "headline")
    export.write_requests(by_attribute, by_product, f"{done.folder}/requests")
    for name, rows in (("by_attribute", by_attribute), ("by_product", by_product)):
        done.add(f"requests/{name}", "csv", rows)
    return done.commit()


def publish(spark: SparkSession, audited: str, generated: DataFrame, approvals: DataFrame, rejections: DataFrame, stories: DataFrame, out: str) -> dict[str, DataFrame]:
    """Gate generated content, export what is left, and score it.

    audited: the folder of an audit; generated: content as a model gave it (see operators.content); approvals, rejections: a
    reviewer's answers; stories (cluster, user_story). Every export and every score is made of the rebuilt content."""
    of = latest(spark, audited)
    products, members, attributes = of["products"], of["members"], of["attributes"]
    done = Version(spark, out)
    near = done.table(competitors.competitors(members.join(products.select("product_id", "price"), "product_id")), "competitors")
    named = near.join(products.select(F.col("product_id").alias("competitor_id"), F.col("name").alias("competitor_name")), "competitor_id")
    with Work(spark, "publish") as work:
        told = done.table(content.gate_content(work, generated, competitors.verified_attributes(products, attributes), named, approvals, rejections), "content")
    spoken = done.table(passages.render_passage(told.withColumnRenamed("derived_insights", "insights")).join(told.select("product_id", *export.KNOWLEDGE), "product_id"), "passages")
    personas = of["picked"].join(stories.select("cluster", "user_story"), "cluster", "left")
    rows = done.table(export.export_rows(members, products.select("product_id", "name", "price", "description", "specs"), personas, spoken, attributes), "export_rows")
    export.write_csv(rows, f"{done.folder}/csv")
    export.write_json(rows, f"{done.folder}/json")
    done.add("csv", "csv", export.csv_rows(rows))
    done.add("json", "json", export.json_rows(rows))
    currency = export.detect_currency(products).first()
    done.table(export.jsonld_nodes(rows, currency["currency"] if currency else None), "jsonld")

    has = members.select("cluster", "product_id").join(of["completeness"].select("product_id", "pct", "missing"), "product_id", "left")  # nothing is expected in a cluster without a schema
    has = has.select("cluster", "product_id", F.coalesce("pct", F.lit(100.0)).alias("completeness"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))
    parts = content.score_inputs(has, told)
    scores = done.table(readiness.top_gaps(readiness.readiness_score(readiness.score_components(parts))), "readiness")
    of_clusters = done.table(readiness.cluster_readiness(scores), "cluster_readiness")
    done.table(readiness.catalog_readiness(of_clusters), "catalog_readiness")
    done.table(readiness.cluster_dashboard(members, of["cluster_completeness"], of_clusters, of["picked"], of["cluster_fit"], of["missing"], of["stats"]), "dashboard")
    return done.commit()


def index(spark: SparkSession, audited: str, published: str, out: str, schema_version: int = competitors.SCHEMA_VERSION, seen: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Texts to embed of both sides, how much of the catalog has content, and the clusters that lack content of this version.

    Only products that changed since the version before (see signature) get new texts, and are listed in `changed`, so that
    only they need new vectors; the entries of the others are taken over. seen: what was compared."""
    of, told, before = latest(spark, audited), latest(spark, published), latest(spark, out)
    members = of["members"].select("product_id", "cluster")
    products = of["products"].join(members, "product_id")
    passage = told["passages"].select("product_id", "passage")
    specs = products.select("product_id", F.posexplode("specs").alias("ord", "key", "value"))
    done = Version(spark, out)
    with Work(spark, "index") as work:
        listed = of["attributes"].groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("ord", "attr", "value"))).alias("attributes"))
        whole = products.join(listed, "product_id", "left").join(passage, "product_id", "left")
        values = [F.col(c) for c in ("product_id", "position", "name", "price", "description", "attributes", "passage")] + [F.map_entries("specs").alias("specs")]
        now = signature.tree(work, whole, values)
        now.write(f"{done.folder}/tree")
        nothing = signature.Tree(*(getattr(now, level).limit(0) for level in ("clusters", "parts", "leaves")))
        was = signature.Tree(*(before[f"tree/{level}"] for level in ("clusters", "parts", "leaves"))) if "tree/leaves" in before else nothing
        changed = done.table(signature.changes(work, was, now, seen)[1], "changed")
    for level in ("clusters", "parts", "leaves"):
        done.add(f"tree/{level}", "parquet", spark.read.parquet(f"{done.folder}/tree/{level}"))
    ids = changed.select("product_id").distinct()
    some = lambda df: df.join(ids, "product_id", "left_semi")
    raw = passages.raw_index_text(some(products), some(specs))
    optimized = passages.optimized_index_text(some(products), some(of["attributes"]), some(passage))
    entries = retrieval.index_entries(some(products), some(passage), raw, optimized)
    kept = before["entries"].join(ids.withColumnRenamed("product_id", "key"), "key", "left_anti").select(*entries.columns) if "entries" in before else entries.limit(0)
    done.table(entries.unionByName(kept), "entries")
    has = passage.where(F.trim("passage") != "")
    done.table(retrieval.content_coverage(products, has), "coverage")
    done.table(retrieval.pending_clusters(of["members"], told["content"], schema_version), "pending")
    facts = competitors.verified_attributes(products, of["attributes"]).select(F.col("product_id").alias("key"), "attr", F.col("value").cast("string").alias("value"), "ord")
    done.table(facts, "facts")
    return done.commit()


def evaluate(spark: SparkSession, queries: DataFrame, index: DataFrame, facts: DataFrame, constraints: DataFrame, rankings: DataFrame, out: str) -> dict[str, DataFrame]:
    """Search both sides for all queries, check, gate and rank, and compare the sides. Tables as run_queries takes them; index:
    the entries of the index job with a vector each (side, key, text, vec), not of unit length perhaps; blank texts go."""
    done = Version(spark, out)
    unit = retrieval.normalize_vectors(index, text="text")
    final = done.table(retrieval.run_queries(queries, unit, facts, constraints, rankings), "final_ranks")
    done.table(retrieval.rank_movement(final), "movement")
    return done.commit()
