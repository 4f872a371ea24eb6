"""Shopper queries over product vectors: top-k search, hard-constraint gate, ranking, before/after movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import blank_to_null, canonical, constraint_number, ordered_list
from shelfspark.operators import vector_index
from shelfspark.tables import Work

CANDIDATES, SHOWN = 20, 5
#: Fixed word lists.
RELATIVE_TERMS = ["low", "lower", "high", "higher", "light", "lighter", "lightweight", "heavy", "heavier", "excellent", "good", "better", "best", "extra", "strong", "stronger", "fast", "faster", "affordable", "budget"]
STOPWORDS = ["must", "have", "need", "they", "with", "that", "specific", "offer", "shoes", "running", "under", "than", "from"]
CLIMATE_TERMS = ["humid", "humidity", "hot weather", "warm weather", "tropical", "heat"]
CLIMATE_EVIDENCE = ["ventilation", "ventilated", "breathable", "breathability", "airflow", "moisture wicking", "moisture-wicking", "quick dry", "quick-dry"]
ENDURANCE_TERMS = ["half marathon", "marathon", "long-distance", "long distance", "distance race"]
ENDURANCE_EVIDENCE = ["half marathon", "marathon", "long-distance", "long distance", "endurance", "distance running", "racing shoe", "racing shoes", "tempo running", "tempo shoe", "tempo"]
CLIMATE_GAP = "suitability for the requested hot or humid conditions"
ENDURANCE_GAP = "suitability for the requested distance-running task"
GAP_REASON, FALLBACK_REASON = "Not recommended because the available content does not establish ", "Assistant ranking response unavailable; showing semantic retrieval order."
OPERATOR_ALIASES = {"=": "eq", "==": "eq", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}


def index_entries(products: DataFrame, content: DataFrame, raw: DataFrame, optimized: DataFrame) -> DataFrame:
    """(side, key, name, cluster, text): products with generated content, the first of an id, the same on both sides."""
    first = products.withColumn("__r", F.row_number().over(Window.partitionBy("product_id").orderBy("position"))).where("__r = 1")
    some = first.join(content.where(blank_to_null(F.col("passage")).isNotNull()).select("product_id"), "product_id", "left_semi").select("product_id", "name", "cluster")
    side = lambda name, texts: some.join(texts, "product_id").select(F.lit(name).alias("side"), F.col("product_id").alias("key"), "name", "cluster", "text")
    return side("before", raw).unionByName(side("after", optimized))


def content_coverage(products: DataFrame, content: DataFrame) -> DataFrame:
    joined = products.select("product_id").join(content.select("product_id").distinct().withColumn("__c", F.lit(1)), "product_id", "left")
    return joined.agg(F.count("__c").alias("with_content"), F.count("*").alias("total"))


def pending_clusters(members: DataFrame, content: DataFrame, version: int) -> DataFrame:
    done = content.where(F.col("schema_version") == version).select("product_id")
    return members.join(done, "product_id", "left_anti").select("cluster").distinct()


def content_signature(products: DataFrame, content: DataFrame) -> DataFrame:
    """One hash of all values: per product, per cluster and first four digits of those, per cluster, then over clusters. No
    row holds more than a 65,536th of a cluster's hashes, or the hashes of 65,536 parts."""
    row = F.sha2(F.to_json(F.struct("product_id", "name", "price", "passage"), {"ignoreNullFields": "false"}), 256)
    each = products.join(content.select("product_id", "passage"), "product_id", "left").select("cluster", row.alias("h"))
    over = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), ""), 256).alias("h")
    parts = each.groupBy("cluster", F.substring("h", 1, 4).alias("part")).agg(over("h"))
    clusters = parts.groupBy("cluster").agg(over(F.concat("part", F.lit(":"), "h")))
    return clusters.agg(over(F.concat("cluster", F.lit(":"), "h")).alias("signature"))


def normalize_vectors(index: DataFrame, vec: str = "vec", text: str | None = None) -> DataFrame:
    """Unit length; a zero vector stays; entries with a blank text go."""
    rows = index if text is None else index.where(blank_to_null(F.col(text)).isNotNull())
    norm = F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.withColumn("__n", norm).withColumn(vec, F.transform(vec, lambda x: F.when(F.col("__n") == 0, x.cast("double")).otherwise(x.cast("double") / F.col("__n")).cast("float"))).drop("__n")


def search(queries: DataFrame, index: DataFrame, k: int = CANDIDATES, lists: int | None = None, visits: list[dict] | None = None) -> DataFrame:
    """queries (query_id, vec), index (side, key, vec), unit vectors -> (query_id, side, key, score, rank), ties by key.

    The rows of a full scan, found in an index of lists that is pruned by bounds (vector_index); visits gets what each round
    read."""
    with Work(index.sparkSession, "search") as work:
        built = vector_index.build(work, index, lists)
        return work.result(vector_index.top_k(work, queries, built, k, visits))


def sanitize_constraints(constraints: DataFrame, queries: DataFrame) -> DataFrame:
    """constraints (query_id, pos, requirement, normalized_attribute, operator, value, unit, strength, source_text):
    invented precision becomes a preference, doubles go. Adds `ambiguity` (null, or what was changed)."""
    rows = constraints.join(queries.select("query_id", F.lower("query").alias("__q")), "query_id")
    op = F.lower(F.coalesce("operator", F.lit("eq")))
    text = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    numeric = text.rlike(r"^-?\d+(?:\.\d+)?$")
    named = op.isin("eq", "contains") & (text != "") & ~numeric & ~F.col("__q").contains(text)
    literal = F.regexp_like(F.col("__q"), F.concat(F.lit(r"(?<!\d)\Q"), text, F.lit(r"\E(?!\d)")))
    bound = op.isin("lt", "lte", "gt", "gte") & numeric & ~literal
    rows = rows.withColumn("__named", named).withColumn("__bound", bound).withColumn("__text", text)
    loose = F.col("__named") | F.col("__bound")
    label = F.regexp_replace(F.coalesce("normalized_attribute", F.lit("product attribute")), "_", " ")
    rows = rows.withColumns({
        "operator": F.when(loose, "exists").otherwise(op), "value": F.when(loose, F.lit(None)).otherwise(F.col("value")), "unit": F.when(loose, F.lit(None)).otherwise(F.col("unit")),
        "strength": F.when(loose, "preference").otherwise(F.col("strength")), "requirement": F.when(F.col("__named"), F.concat(F.lit("preferred "), label)).otherwise(F.col("requirement")),
    })
    words = F.lower(F.concat_ws(" ", F.coalesce("requirement", F.lit("")), F.coalesce("source_text", F.lit("")), "__text"))
    vague = (F.col("operator") == "exists") & (F.col("strength") == "hard") & words.rlike(r"\b(?:" + "|".join(RELATIVE_TERMS) + r")\b")
    rows = rows.withColumn("__vague", vague).withColumn("strength", F.when(F.col("__vague"), "preference").otherwise(F.col("strength")))
    told = (
        F.when(F.col("__named"), F.concat(F.lit("'"), F.col("__text"), F.lit("' was not explicitly requested, so it was not used as a hard constraint.")))
        .when(F.col("__bound"), F.concat(F.lit("No numeric threshold was supplied for '"), F.coalesce("requirement", F.lit("")), F.lit("', so it is ranked relatively.")))
        .when(F.col("__vague"), F.concat(F.lit("'"), F.coalesce("requirement", F.lit("")), F.lit("' has no objective threshold, so it is ranked relatively.")))
    )
    same = [F.lower(F.coalesce(c, F.lit(""))) for c in ("normalized_attribute", "operator", "value", "strength")]
    rows = rows.withColumn("ambiguity", told).withColumn("__r", F.row_number().over(Window.partitionBy("query_id", *same).orderBy("pos")))
    return rows.where("__r = 1").drop("__q", "__named", "__bound", "__text", "__vague", "__r")


INTENT = "task struct<goal:string,source_text:string>, context array<struct<value:string,source_text:string>>, constraints array<struct<requirement:string,normalized_attribute:string,operator:string,value:string,unit:string,strength:string,source_text:string>>, derived_needs array<struct<need:string,source_text:string>>, ambiguities array<string>"


def default_intent(answers: DataFrame) -> DataFrame:
    """answers (query_id, query, json): parts of the wrong type become empty, the task falls back to the query."""
    part = lambda name, kind: F.from_json(F.get_json_object("json", f"$.{name}"), kind)
    kinds = {"context": "array<struct<value:string,source_text:string>>", "constraints": "array<struct<requirement:string,normalized_attribute:string,operator:string,value:string,unit:string,strength:string,source_text:string>>", "derived_needs": "array<struct<need:string,source_text:string>>", "ambiguities": "array<string>"}
    task = part("task", "struct<goal:string,source_text:string>")
    own = F.struct(F.coalesce(task["goal"], F.col("query")).alias("goal"), F.coalesce(task["source_text"], F.col("query")).alias("source_text"))
    array = lambda n, k: F.coalesce(F.when(F.trim(F.get_json_object("json", f"$.{n}")).startswith("["), part(n, k)), F.array().cast(k))
    return answers.select("query_id", "query", own.alias("task"), *[array(n, k).alias(n) for n, k in kinds.items()])


def resolve_constraint_attribute(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs (query_id, side, key, pos, normalized_attribute, operator, value, requirement), facts (key, attr, value, ord) ->
    adds actual, resolved, by_value: the exact name, else the first fact whose canonical name holds or is held by it, else
    the first fact whose value holds the expected text."""
    name, want = canonical(F.coalesce("normalized_attribute", F.lit(""))), F.lower(F.trim(F.coalesce("value", F.lit(""))))
    f = facts.select("key", F.col("attr").alias("__a"), F.col("value").alias("__v"), F.col("ord").alias("__o"), canonical(F.col("attr")).alias("__k"))
    keyed = pairs.withColumn("__n", name).withColumn("__w", want)
    named = F.coalesce("normalized_attribute", F.lit("")) != ""
    level = (
        F.when(F.col("__a") == F.col("normalized_attribute"), 0)
        .when(named & (F.col("__k").contains(F.col("__n")) | F.col("__n").contains(F.col("__k"))), 1)
        .when((F.col("__w") != "") & F.lower("__v").contains(F.col("__w")), 2)
    )
    joined = keyed.join(f, "key", "left").withColumn("__l", level)
    ids = ["query_id", "side", "key", "pos"]
    usable = (F.col("__l") < 2) & (blank_to_null(F.col("__v")).isNotNull() | (F.col("__l") == 0)) | (F.col("__l") == 2)
    best = joined.groupBy(*ids).agg(F.min_by(F.struct("__a", "__v", "__l"), F.when(usable, F.struct("__l", "__o"))).alias("b"))
    return pairs.join(best, ids, "left").withColumn("actual", F.col("b.__v")).withColumn("resolved", F.coalesce("b.__a", "normalized_attribute")).withColumn("by_value", F.coalesce(F.col("b.__l") == 2, F.lit(False))).drop("b")


def check_constraints(resolved: DataFrame) -> DataFrame:
    """Adds status: pass, fail or unknown."""
    aliases = F.create_map(*[F.lit(x) for kv in OPERATOR_ALIASES.items() for x in kv])
    low = F.lower(F.coalesce("operator", F.lit("eq")))
    op = F.coalesce(F.try_element_at(aliases, low), low)
    have, want = F.lower("actual"), F.lower(F.coalesce("value", F.lit("")))
    a, b = constraint_number(F.col("actual")), constraint_number(F.col("value"))
    numeric = F.when(op == "lt", a < b).when(op == "lte", a <= b).when(op == "gt", a > b).otherwise(a >= b)
    passed = (
        F.when(op == "exists", F.lit(True))
        .when(op.isin("lt", "lte", "gt", "gte"), numeric)
        .when(F.col("by_value") & op.isin("eq", "contains"), F.lit(True))
        .when(want == "", F.lit(None).cast("boolean"))
        .when(op == "contains", have.contains(want))
        .otherwise(have == want)
    )
    status = F.when(blank_to_null(F.col("actual")).isNull() | passed.isNull(), "unknown").when(passed, "pass").otherwise("fail")
    return resolved.withColumn("status", status)


def hard_checks(hits: DataFrame, constraints: DataFrame, facts: DataFrame) -> DataFrame:
    """One check per (query, side, product, hard constraint)."""
    hard = constraints.where("strength = 'hard'").select("query_id", "pos", "requirement", "normalized_attribute", "operator", "value")
    return check_constraints(resolve_constraint_attribute(hits.select("query_id", "side", "key").join(hard, "query_id"), facts))


def _any_term(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: text.contains(t))


def evidence_gaps(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (query_id, side, key, evidence: facts and text) -> adds gaps: what the query asks and the text can't show."""
    asked = queries.select("query_id", F.lower("query").alias("__q"))
    text = F.lower(F.coalesce("evidence", F.lit("")))
    climate = _any_term(F.col("__q"), CLIMATE_TERMS) & ~_any_term(text, CLIMATE_EVIDENCE)
    endurance = _any_term(F.col("__q"), ENDURANCE_TERMS) & ~_any_term(text, ENDURANCE_EVIDENCE)
    return hits.join(asked, "query_id").withColumn("gaps", F.array_compact(F.array(F.when(climate, CLIMATE_GAP), F.when(endurance, ENDURANCE_GAP)))).drop("__q")


def gate_candidates(hits: DataFrame, checks: DataFrame) -> DataFrame:
    """hits (query_id, side, key, rank, gaps): those that pass all hard checks, or all if none does; of these, those
    without evidence gaps, or all if none. Adds candidate (0-based, by rank)."""
    ok = checks.groupBy("query_id", "side", "key").agg(F.bool_and(F.col("status") == "pass").alias("__ok"))
    group = Window.partitionBy("query_id", "side")
    rows = hits.join(ok, ["query_id", "side", "key"], "left").withColumn("__ok", F.coalesce("__ok", F.lit(True)))
    rows = rows.withColumn("__any", F.bool_or("__ok").over(group)).where(F.col("__ok") | ~F.col("__any"))
    rows = rows.withColumn("__clear", F.size("gaps") == 0).withColumn("__any", F.bool_or("__clear").over(group)).where(F.col("__clear") | ~F.col("__any"))
    return rows.withColumn("candidate", F.row_number().over(group.orderBy("rank")) - 1).drop("__ok", "__any", "__clear")


def apply_ranking(gated: DataFrame, rankings: DataFrame, limit: int = SHOWN) -> DataFrame:
    """rankings (query_id, side, item_pos, candidate_id text, recommend, reason, failed, unanswered): bad, repeated and
    out-of-range ids are skipped, the first `limit` stay."""
    asked = rankings.withColumn("candidate", F.col("candidate_id").try_cast("int")).where("candidate >= 0")
    joined = gated.join(asked, ["query_id", "side", "candidate"])
    once = joined.withColumn("__r", F.row_number().over(Window.partitionBy("query_id", "side", "candidate").orderBy("item_pos"))).where("__r = 1")
    order = F.row_number().over(Window.partitionBy("query_id", "side").orderBy("item_pos"))
    return once.withColumn("pos", order).where(F.col("pos") <= limit).drop("__r", "item_pos", "candidate_id")


def requirement_tokens(x: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def same_requirement(a: Column, b: Column) -> Column:
    return F.arrays_overlap(requirement_tokens(a), requirement_tokens(b))


def reconcile(ranked: DataFrame, checks: DataFrame) -> DataFrame:
    """ranked (query_id, side, key, recommend, reason, failed, unanswered, gaps): a verified pass can't be turned back;
    failed and unknown checks and evidence gaps are added and rule out a recommendation."""
    names = lambda s: ordered_list([F.col("pos")], F.when(F.col("status") == s, F.col("requirement")))
    of = checks.groupBy("query_id", "side", "key").agg(names("pass").alias("__p"), names("fail").alias("__f"), names("unknown").alias("__u"))
    rows = ranked.join(of, ["query_id", "side", "key"], "left")
    empty = F.array().cast("array<string>")
    p, f, u = (F.coalesce(c, empty) for c in ("__p", "__f", "__u"))
    left = lambda c: F.filter(F.coalesce(c, empty), lambda x: ~F.exists(p, lambda y: F.coalesce(same_requirement(x, y), F.lit(False))))
    bad, gap = (F.size(f) > 0) | (F.size(u) > 0), F.size("gaps") > 0
    return rows.withColumns({
        "failed": F.when(bad, F.array_distinct(F.concat(left("failed"), f))).otherwise(left("failed")),
        "unanswered": F.when(bad | gap, F.array_distinct(F.concat(left("unanswered"), u, "gaps"))).otherwise(left("unanswered")),
        "recommend": F.coalesce("recommend", F.lit(False)) & ~bad & ~gap,
        "reason": F.when(gap, F.concat(F.lit(GAP_REASON), F.array_join("gaps", " or "), F.lit("."))).otherwise(F.col("reason")),
    }).drop("__p", "__f", "__u")


def fallback_ranking(gated: DataFrame, ranked: DataFrame, limit: int = SHOWN) -> DataFrame:
    """Retrieval order for queries without any valid ranking."""
    lost = gated.join(ranked.select("query_id", "side").distinct(), ["query_id", "side"], "left_anti").where(F.col("candidate") < limit)
    empty = F.array().cast("array<string>")
    return lost.withColumns({"pos": F.col("candidate") + 1, "recommend": F.lit(False), "reason": F.lit(FALLBACK_REASON), "failed": empty, "unanswered": empty})


def final_ranks(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id", "side").orderBy(F.col("recommend").desc(), "pos")
    return rows.withColumn("final_rank", F.row_number().over(order))


def rank_movement(final: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    b = final.where(F.col("side") == before).select("query_id", "key", F.col("final_rank").alias("before"))
    a = final.where(F.col("side") == after).select("query_id", "key", F.col("final_rank").alias("after"))
    return a.join(b, ["query_id", "key"], "left").withColumn("moved", ~F.col("before").eqNullSafe(F.col("after")))


def run_queries(queries: DataFrame, index: DataFrame, facts: DataFrame, constraints: DataFrame, rankings: DataFrame, k: int = CANDIDATES, limit: int = SHOWN) -> DataFrame:
    """queries (query_id, query, vec), index (side, key, vec, text), ... -> final rows of all queries and both sides."""
    with Work(index.sparkSession, "queries") as work:
        told = facts.groupBy("key").agg(F.array_join(ordered_list([F.col("ord")], F.concat_ws(" ", "attr", "value")), " ").alias("__f"))
        hits = search(queries, index, k).join(index.select("side", "key", "text"), ["side", "key"]).join(told, "key", "left")
        hits = work.table(hits.withColumn("evidence", F.concat_ws(" ", "__f", "text")).drop("__f", "text"), "hits")
        checks = work.table(hard_checks(hits, sanitize_constraints(constraints, queries), facts), "checks")
        gated = work.table(gate_candidates(evidence_gaps(queries, hits), checks), "gated")
        ranked = work.table(apply_ranking(gated, rankings, limit), "ranked")
        done = reconcile(ranked, checks).select("query_id", "side", "key", "score", "pos", "recommend", "reason", "failed", "unanswered")
        rest = fallback_ranking(gated, ranked, limit).select(*done.columns)
        return work.result(final_ranks(done.unionByName(rest)))


def intent_summary(intents: DataFrame) -> DataFrame:
    """(query_id, task, context, hard, preferences, derived): distinct texts joined by a middle dot, or a stand-in."""
    text = lambda items, key, other: F.coalesce(F.nullif(F.array_join(F.array_distinct(F.filter(F.transform(items, lambda i: F.trim(F.coalesce(F.nullif(i[key], F.lit("")), i["source_text"], F.lit("")))), lambda t: t != "")), " · "), F.lit("")), F.lit(other))
    hard = lambda c: c["strength"].eqNullSafe("hard")
    return intents.select(
        "query_id", F.coalesce(F.nullif(F.col("task.source_text"), F.lit("")), F.nullif(F.col("task.goal"), F.lit("")), F.lit("Not identified")).alias("task"),
        text(F.col("context"), "value", "Not stated").alias("context"), text(F.filter("constraints", hard), "requirement", "None").alias("hard"),
        text(F.filter("constraints", lambda c: ~hard(c)), "requirement", "None").alias("preferences"), text(F.col("derived_needs"), "need", "None").alias("derived"),
    )


def clamp_confidence(df: DataFrame, col: str = "confidence") -> DataFrame:
    """An integer from 0 to 100, 0 where it can't be read."""
    value = F.coalesce(F.col(col).cast("string").try_cast("double").cast("int"), F.lit(0))
    return df.withColumns({col: F.greatest(F.lit(0), F.least(F.lit(100), value)), "recommend": F.coalesce("recommend", F.lit(False)), "reason": F.coalesce("reason", F.lit(""))})
