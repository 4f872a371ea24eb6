"""Stable, unique product ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.ranks import ranks
from shelfspark.functions.text import blank_to_null

#: Spec keys that may hold a source id, best first (fixed values).
ID_KEYS = ["variant sku", "sku", "handle", "product id", "id"]


def source_product_id(specs: Column) -> Column:
    """First non-blank value among the id keys; keys are compared trimmed and in lower case."""
    entries = F.transform(F.map_entries(specs), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), blank_to_null(e["value"]).alias("v")))
    value = lambda k: F.get(F.transform(F.filter(entries, lambda e: (e["k"] == k) & e["v"].isNotNull()), lambda e: e["v"]), F.lit(0))
    return F.coalesce(*[value(k) for k in ID_KEYS])


def hash_product_id(position: Column, name: Column, description: Column) -> Column:
    text = F.concat_ws("|", position.cast("string"), F.coalesce(name, F.lit("None")), F.coalesce(description, F.lit("None")))
    return F.substring(F.sha2(text, 256), 1, 16)


def ensure_product_ids(products: DataFrame, base: Column | None = None) -> DataFrame:
    """The n-th holder of a base id (by position) becomes `base-n`, with the next free n where another product's base id
    already has that name. Only repeated ids are put in a window."""
    source = base if base is not None else F.coalesce(blank_to_null(F.col("product_id")), source_product_id(F.col("specs")), hash_product_id(F.col("position"), F.col("name"), F.col("description")))
    rows = products.withColumn("__base", source)
    counts = rows.groupBy("__base").agg(F.count("*").alias("__n"))
    marked = rows.join(counts, "__base")
    single = marked.where("__n = 1").withColumn("product_id", F.col("__base"))
    ranked = ranks(marked.where("__n > 1"), "__base", ["position"], "__k").withColumn("__k", F.col("__k") + 1)
    taken = counts.select(F.col("__base").alias("__name"))
    stem = F.regexp_extract("__name", r"^(.*)-(\d+)$", 1)
    blocked = taken.where(stem != "").select(stem.alias("__base"), F.regexp_extract("__name", r"-(\d+)$", 1).cast("long").alias("__m")).where("__m >= 2").groupBy("__base").agg(F.array_sort(F.collect_set("__m")).alias("__blocked"))
    # the k-th holder takes the k-th number from 2 on that no natural id has
    free = F.aggregate(F.coalesce("__blocked", F.array().cast("array<bigint>")), F.col("__k").cast("long"), lambda k, b: F.when(b <= k, k + 1).otherwise(k))
    several = ranked.join(blocked, "__base", "left").withColumn("product_id", F.when(F.col("__k") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), free.cast("string"))))
    return single.drop("__base", "__n").unionByName(several.drop("__base", "__n", "__k", "__blocked"))
