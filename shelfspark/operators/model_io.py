"""The model boundary: request tables, caches, answers, spend. The library calls no model; a user's function may be
applied to a request table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.ranks import ranks
from shelfspark.functions.text import ordered_list

#: USD per million tokens in and out (fixed values).
PRICES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00), "text-embedding-3-small": (0.02, 0.00)}


def _specs(col: str = "specs") -> Column:
    return F.coalesce(F.to_json(col), F.lit("{}"))


def _listing(group: list[str], order: Column, line: Column, joiner: str) -> tuple[list[str], Column]:
    return group, F.array_join(ordered_list([order], line), joiner).alias("prompt")


def cluster_requests(products: DataFrame, size: int = 20) -> DataFrame:
    """(batch, n, prompt): `i: name | desc: ... | specs: ...` for each product of a batch."""
    at = F.pmod("position", F.lit(size))
    line = F.concat(at.cast("string"), F.lit(": "), F.coalesce("name", F.lit("Unnamed product")), F.lit(" | desc: "), F.substring(F.coalesce("description", F.lit("")), 1, 150), F.lit(" | specs: "), _specs())
    keys, prompt = _listing(["batch"], at, line, "\n")
    return products.withColumn("batch", F.floor(F.col("position") / size).cast("long")).groupBy(*keys).agg(F.count("*").alias("n"), prompt)


def schema_requests(members: DataFrame, products: DataFrame, sample: int = 8, cut: int = 200) -> DataFrame:
    """(cluster, n, prompt) over the first `sample` members."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("member_pos"))
    some = members.withColumn("__r", rank).where(F.col("__r") <= sample).join(products, "product_id")
    line = F.concat(F.lit("- "), F.coalesce("name", F.lit("Unnamed")), F.lit("\n  description: "), F.substring(F.coalesce("description", F.lit("")), 1, cut), F.lit("\n  raw fields: "), _specs())
    keys, prompt = _listing(["cluster"], F.col("__r"), line, "\n\n")
    return some.groupBy(*keys).agg(F.count("*").alias("n"), prompt)


def normalize_requests(members: DataFrame, products: DataFrame, schema: DataFrame, size: int = 10, cut: int = 400) -> DataFrame:
    """(cluster, batch, n, attributes, prompt) of batches of `size` members."""
    rows = ranks(members, "cluster", ["member_pos"], "__i").withColumn("batch", F.floor(F.col("__i") / size).cast("long")).join(products, "product_id")
    line = F.concat(F.pmod("__i", F.lit(size)).cast("string"), F.lit(": "), F.coalesce("name", F.lit("Unnamed product")), F.lit(" | description: "), F.substring(F.coalesce("description", F.lit("")), 1, cut), F.lit(" | raw: "), _specs())
    keys, prompt = _listing(["cluster", "batch"], F.col("__i"), line, "\n")
    names = schema.groupBy("cluster").agg(F.array_join(ordered_list([F.col("attr_pos")], F.col("attr")), ", ").alias("attributes"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), prompt).join(names, "cluster", "left")


def rerank_requests(gated: DataFrame, checks: DataFrame, cut: int = 2400) -> DataFrame:
    """gated (query_id, side, key, candidate, name, text) -> (query_id, side, prompt)."""
    of = checks.groupBy("query_id", "side", "key").agg(F.to_json(ordered_list([F.col("pos")], F.struct("requirement", F.col("resolved").alias("attribute"), "status", "actual"))).alias("__c"))
    line = F.concat(F.lit("[candidate_id: "), F.col("candidate").cast("string"), F.lit("]\nName: "), "name", F.lit("\nVerified hard-constraint checks: "), F.coalesce("__c", F.lit("[]")), F.lit("\nContent on file:\n"), F.substring("text", 1, cut))
    keys, prompt = _listing(["query_id", "side"], F.col("candidate"), line, "\n\n")
    return gated.join(of, ["query_id", "side", "key"], "left").groupBy(*keys).agg(prompt)


def persona_requests(present: DataFrame) -> DataFrame:
    """(cluster, prompt): attributes present somewhere in a cluster."""
    return present.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("attr")), ", ").alias("prompt"))


def criteria_requests(personas: DataFrame, examples: DataFrame) -> DataFrame:
    """(persona_id, prompt): `attr: example` of the persona's cluster."""
    told = examples.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "attr", "example"))), "\n").alias("__e"))
    return personas.join(told, "cluster", "left").select("cluster", "persona_id", F.concat("title", F.lit("\n"), F.coalesce("__e", F.lit(""))).alias("prompt"))


def content_requests(verified: DataFrame, competitors: DataFrame) -> DataFrame:
    """(product_id, prompt): verified facts, then a line of facts for each competitor."""
    facts = verified.groupBy("product_id").agg(F.array_join(ordered_list([F.col("ord")], F.concat_ws(": ", "attr", "value")), ", ").alias("__f"))
    other = competitors.join(facts.select(F.col("product_id").alias("competitor_id"), "__f"), "competitor_id").groupBy("product_id").agg(F.array_join(ordered_list([F.col("rank")], F.concat_ws(" - ", "competitor_id", "__f")), "\n").alias("__o"))
    return facts.join(other, "product_id", "left").select("product_id", F.concat(F.lit("Verified facts: "), "__f", F.lit("\nCompetitors:\n"), F.coalesce("__o", F.lit("none"))).alias("prompt"))


def review_requests(claims: DataFrame) -> DataFrame:
    """(product_id, prompt): kept claims as `field:index`, statement and evidence."""
    number = F.row_number().over(Window.partitionBy("product_id", "field").orderBy("idx")) - 1
    rows = claims.where("kept").withColumn("__id", F.concat("field", F.lit(":"), number.cast("string")))
    line = F.to_json(F.struct(F.col("__id").alias("id"), F.col("text1").alias("statement"), "evidence"))
    return rows.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__id", line.alias("l")))), lambda s: s["l"]), "\n").alias("prompt"))


def cache_key(*parts: Column) -> Column:
    """sha256 over the parts, each followed by a zero byte."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\0"))]), 256)


def split_cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known answers, requests still to be sent: one of equal keys)."""
    known = requests.join(cache, "cache_key")
    return known, requests.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def parse_responses(responses: DataFrame, col: str = "response") -> DataFrame:
    """Adds json and ok: the text if it is JSON, else what lies between its first `{` and last `}`, else an error."""
    whole, inner = F.col(col), F.regexp_substr(F.col(col), F.lit(r"(?s)\{.*\}"))
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    found = F.coalesce(valid(whole), valid(inner))
    return responses.withColumn("ok", found.isNotNull()).withColumn("json", F.coalesce(found, F.to_json(F.struct(F.lit("unparsable response").alias("error")))))


def price_table(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, usd_in double, usd_out double")


def call_costs(calls: DataFrame) -> DataFrame:
    prices = price_table(calls.sparkSession)
    usd = (F.col("in_tokens") * F.coalesce("usd_in", F.lit(0.0)) + F.col("out_tokens") * F.coalesce("usd_out", F.lit(0.0))) / 1e6
    return calls.join(F.broadcast(prices), "model", "left").withColumn("usd", F.when(F.col("cached"), F.lit(0.0)).otherwise(usd)).drop("usd_in", "usd_out")


def spend_summary(calls: DataFrame) -> DataFrame:
    """Per model: calls, cached calls, tokens and cost; unknown models cost nothing."""
    own = lambda c: F.sum(F.when(F.col("cached"), 0).otherwise(F.col(c))).alias(c)
    return call_costs(calls).groupBy("model").agg(F.count("*").alias("calls"), F.count_if("cached").alias("cached"), own("in_tokens"), own("out_tokens"), F.round(F.sum(F.col("usd").cast("decimal(30,12)")).cast("double"), 9).alias("usd"))


def within_budget(calls: DataFrame, cap: float, ranges: int = 256) -> DataFrame:
    """Adds spent_before and allowed: earlier spend is below the cap. Calls (call_id, usd) lie in ranges of call_id with
    about as many calls each (256 and more); sums of ranges give offsets, so no window covers all calls. Calls of one id,
    and those without an id, which come last, stand in the order of their cost."""
    at = F.coalesce(F.col("call_id"), F.lit((1 << 63) - 1))
    n = calls.count()
    cuts = max(ranges, min(10_000, n // 500_000))
    bounds = sorted(set(calls.agg(F.percentile_approx(at, F.array(*[F.lit(i / cuts) for i in range(1, cuts)]), F.lit(20 * cuts))).first()[0] or []))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    rows = calls.withColumn("__g", F.size(F.filter(edges, lambda e: e <= at))).withColumn("__u", F.col("usd").cast("decimal(30,12)"))
    before = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__g").agg(F.sum("__u").alias("__s")).withColumn("__o", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    inside = Window.partitionBy("__g").orderBy(at, "__u").rowsBetween(Window.unboundedPreceding, -1)
    spent = (F.col("__o") + F.coalesce(F.sum("__u").over(inside), F.lit(0))).cast("double")
    return rows.join(F.broadcast(sums.select("__g", "__o")), "__g").withColumn("spent_before", spent).withColumn("allowed", F.col("spent_before") < cap).drop("__g", "__u", "__o")


def usage_delta(now: DataFrame, base: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Usage since a baseline, never negative."""
    old = base.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    return now.join(old, keys, "left").select(*keys, *[F.greatest(F.lit(0), F.col(v) - F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values])


def apply_model(requests: DataFrame, fn: Callable[[list[str]], list], returns: str, batch_size: int = 100, prompt: str = "prompt") -> DataFrame:
    """Adds `answer` of a user's batch function: batches of batch_size prompts, a blank prompt goes as one blank. Equal
    order and number of answers are checked. Runs on the executors."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [t if t and t.strip() else " " for t in pdf[prompt].fillna("")]
            answers = []
            for i in range(0, len(texts), batch_size):
                part = list(fn(texts[i : i + batch_size]))
                if len(part) != len(texts[i : i + batch_size]):
                    raise ValueError("the function must return one answer per prompt")
                answers += part
            yield pdf.assign(answer=answers)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{kinds}, answer {returns}")


