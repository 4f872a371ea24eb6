"""Cluster labels -> one cluster per product."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.ranks import chunks, positions, ranks  # noqa: F401
from shelfspark.functions.text import blank_to_null

BATCH, LABEL_BATCH = 10, 20
UNCATEGORIZED = "Uncategorized"


def assign_batches(df: DataFrame, size: int, position: str = "position", by: str | None = None) -> DataFrame:
    """Batch number: of the position itself, or of the rank by position within `by`."""
    if by is None:
        return df.withColumn("batch", F.floor(F.col(position) / size).cast("long"))
    return ranks(df, by, [position], "__rank").withColumn("batch", F.floor(F.col("__rank") / size).cast("long")).drop("__rank")


def globalize_indices(labels: DataFrame, size: int = LABEL_BATCH) -> DataFrame:
    return labels.withColumn("index", F.col("index") + F.col("batch") * size)


def validate_membership(labels: DataFrame, products: DataFrame) -> DataFrame:
    """labels (cluster_pos, cluster, item_pos, index text), products (position, product_id) -> cluster_members: each
    product in the first cluster that names it, blank names numbered, the rest Uncategorized."""
    at = labels.withColumn("position", F.col("index").try_cast("long")).where("position is not null")
    first = at.withColumn("__r", F.row_number().over(Window.partitionBy("position").orderBy("cluster_pos", "item_pos"))).where("__r = 1")
    named = first.withColumn("cluster", F.coalesce(blank_to_null(F.col("cluster")), F.concat(F.lit("Cluster "), (F.col("cluster_pos") + 1).cast("string"))))
    rest = products.select("position", "product_id").join(named.select("position", "cluster"), "position", "left")
    return rest.select(F.coalesce("cluster", F.lit(UNCATEGORIZED)).alias("cluster"), "product_id", F.col("position").alias("member_pos"))


def merge_labels(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping (source, final, pos): labels by their final name, the first of several; others are Uncategorized. Groups
    of one final name are one cluster. An empty mapping leaves labels as they are."""
    first = mapping.groupBy("source").agg(F.min_by("final", "pos").alias("final"))
    if first.isEmpty():
        return members
    joined = members.join(first, members.cluster == first.source, "left")
    return joined.select(F.coalesce("final", F.lit(UNCATEGORIZED)).alias("cluster"), "product_id", "member_pos")


def cluster_summary(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(F.count("*").alias("members"), F.array_sort(F.collect_list("product_id")).alias("product_ids"))


#: Members of a row of member_chunks.
MEMBERS = 10_000


def member_chunks(members: DataFrame, size: int = MEMBERS) -> DataFrame:
    """(cluster, chunk, n, product_ids): ids of a cluster in ascending order, `size` to a row, joined by a line end."""
    return chunks(members, ["cluster"], ["product_id"], "product_id", "\n", size).withColumnRenamed("text", "product_ids")


def nearest_centroid(index: DataFrame, label: str = "label", vec: str = "vec", key: str = "key") -> DataFrame:
    """Each vector's nearest mean vector of the given labels, by cosine; ties to the smaller label. The means are one row a
    label and dimension."""
    long = index.select(key, label, F.posexplode(vec).alias("i", "x"))
    means = long.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    of = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    one = of.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("c")))).alias("cs"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    scored = index.crossJoin(F.broadcast(one)).select(key, F.transform("cs", lambda c: F.struct(F.round(-dot(F.col(vec), c["c"]) / F.sqrt(dot(c["c"], c["c"])), 9).alias("d"), c["l"].alias("l"))).alias("s"))
    return scored.select(key, F.array_min("s")["l"].alias("cluster"))


#: Rows that seeds are chosen from, steps, and the fixed point of summed unit vectors.
SEED_ROWS, STEPS, POINT = 10_000, 25, 1 << 24


def _unit(x: np.ndarray) -> np.ndarray:
    long = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, long, out=np.zeros_like(x), where=long > 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of the largest cosine; ties, to nine decimals, to the first."""
    return np.argmax(np.round(_unit(x) @ centres.T, 9), axis=1)


def first_centres(rows: np.ndarray, k: int) -> np.ndarray:
    """k of the rows, the first and then always the one that is farthest from those chosen; fewer if no others differ."""
    unit = _unit(rows)
    chosen = [0]
    near = np.round(unit @ unit[0], 9)
    while len(chosen) < min(k, len(unit)) and near.min() < 1:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, np.round(unit @ unit[chosen[-1]], 9))
    return unit[chosen]


def next_centres(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unit means; a centre without rows stays."""
    means = _unit(sums.astype(np.float64))
    return np.where((counts > 0)[:, None] & (np.abs(means).sum(axis=1) > 0)[:, None], means, centres)


def cluster_by_embedding(index: DataFrame, k: int, seed: int, vec: str = "vec", key: str = "key") -> DataFrame:
    """Spherical k-means; adds `cluster`. The result follows from the rows and the seed, however they are dealt.

    Seeds come from the SEED_ROWS rows of the least hashes of key and seed; every step assigns all rows and sums unit vectors
    as whole numbers, so the order of rows doesn't matter; the driver holds k centres and their sums. Null vectors are in
    no cluster."""
    spark = index.sparkSession
    rows = index.where(F.col(vec).isNotNull()).select(key, F.transform(vec, lambda x: x.cast("double")).alias("__v"))
    some = rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(SEED_ROWS).select("__v").collect()
    if not some:
        return index.withColumn("cluster", F.lit(None).cast("int"))
    centres = first_centres(np.array([r["__v"] for r in some], np.float64), k)
    width = centres.shape[1]
    matrix = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for _ in range(STEPS):
        sent = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total, n = np.zeros((len(sent.value), width), np.int64), np.zeros(len(sent.value), np.int64)
            for b in batches:
                x = matrix(b.column("__v"))
                of = _nearest(x, sent.value)
                np.add.at(total, of, np.rint(_unit(x) * POINT).astype(np.int64))
                n += np.bincount(of, minlength=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

        each = rows.select("__v").mapInArrow(sums, "cluster int, n long, sums array<long>")
        found = each.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # k x width numbers
        total, counts = np.zeros((len(centres), width), np.int64), np.zeros(len(centres), np.int64)
        for r in found:
            total[r["cluster"], r["i"]], counts[r["cluster"]] = r["x"], r["n"]
        before, centres = centres, next_centres(centres, total, counts)
        if np.array_equal(before, centres):
            break
    final = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cluster(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.array(v.tolist(), np.float64).reshape(-1, width), final.value), dtype="int32") if len(v) else pd.Series([], dtype="int32")

    told = F.when(F.col(vec).isNotNull(), cluster(F.coalesce(F.transform(vec, lambda x: x.cast("double")), F.array(*[F.lit(0.0)] * width))))
    return index.withColumn("cluster", told)
