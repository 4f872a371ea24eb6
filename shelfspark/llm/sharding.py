"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

Rows lie in source buckets by a hash of their keys. How many rows of each bucket go to each block of each shard is drawn
exactly, from the multivariate hypergeometric law, so that every shard gets its exact size; rows are permuted inside
their bucket, dealt out by the drawn counts, and permuted again inside their block. The result is a uniform shuffle.
Law `rows`: shard sizes differ by one row at most. Rows that are equal in all keys, and only they, are numbered, so the
result follows from the keys and the seed, however the input is split.

DataFrame functions only. The matrix has at most 4,096 x (40 x 64) counts whatever the input (84 MB, handed on as one
Arrow table) and is all that the driver holds. A block is an even slice of a shard, so no window covers a whole shard. Null texts are empty; null ids, ties and
repeated rows are dealt like any other row; extra columns stay, but those called shard, slot or by one of the working names
in HIDDEN are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stage, text_or_empty
from .order import numbered

SHARDS = 40
#: Rows of a bucket or block that are aimed at; their numbers are bounded.
AIM, MOST_BUCKETS, MOST_BLOCKS = 50_000, 4_096, 64
HIDDEN = ("__row", "__bucket", "__rank", "__shards", "__blocks", "__block")


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Counts of rows from each source (row sums: counts) to each target (column sums: sizes) of a uniform permutation."""
    left, draw = np.array(sizes, np.int64), np.random.default_rng(seed)
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for i, n in enumerate(counts):
        out[i] = draw.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


def _told_apart(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with __row: 0, or for rows that are equal in all keys a number of their own, by the order of keys among such rows."""
    several = stage(rows.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]), "repeated")
    alone = F.lit(0).cast("long")
    if several.isEmpty():
        return rows.withColumn("__row", alone)
    same = None
    for i, k in enumerate(keys):
        one = rows[k].eqNullSafe(several[f"__{i}"])
        same = one if same is None else same & one
    placed = numbered(rows.join(several, same, "left_semi"), [F.col(k).asc_nulls_first() for k in keys], "equal-rows")
    return rows.join(several, same, "left_anti").withColumn("__row", alone).unionByName(placed.withColumnRenamed("at", "__row"))


def shard(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard) to rows. keys tell rows apart; rows that are equal in all of them
    change places freely."""
    rows = stage(_told_apart(stage(rows.drop("shard", "slot", *HIDDEN), "rows"), keys), "numbered")
    keys = [*keys, "__row"]
    total = rows.count()
    buckets = min(MOST_BUCKETS, max(256, total // AIM))
    blocks = min(MOST_BLOCKS, max(8, total // (shards * AIM)))
    mixed = lambda k: F.xxhash64(F.lit(seed * 16 + k), *keys)
    dealt = rows.withColumn("__bucket", F.pmod(mixed(1), F.lit(buckets)).cast("int"))
    found = {r[0]: r[1] for r in dealt.groupBy("__bucket").count().toLocalIterator()}
    counts = [found.get(i, 0) for i in range(buckets)]
    base, more = divmod(sum(counts), shards)
    size = [base + (s < more) for s in range(shards)]
    part = [m * (j + 1) // blocks - m * j // blocks for m in size for j in range(blocks)]
    ends = np.cumsum(communication_matrix(counts, part, seed), axis=1)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], np.int32)), pa.array(x.ravel()))
    matrix = rows.sparkSession.createDataFrame(pa.table({"__bucket": pa.array(np.arange(buckets, dtype=np.int32)), "__shards": lists(ends[:, blocks - 1 :: blocks]), "__blocks": lists(ends)}))
    first = Window.partitionBy("__bucket").orderBy(mixed(2), *keys)
    ranked = dealt.withColumn("__rank", (F.row_number().over(first) - 1).cast("long")).join(F.broadcast(matrix), "__bucket")
    placed = ranked.withColumn("shard", F.size(F.filter("__shards", lambda e: e <= F.col("__rank"))))
    placed = placed.withColumn("__block", F.size(F.filter(F.slice("__blocks", F.col("shard") * blocks + 1, blocks), lambda e: e <= F.col("__rank"))))
    second = Window.partitionBy("shard", "__block").orderBy(mixed(3), *keys)
    rows_of = F.lit(base).cast("long") + (F.col("shard") < more).cast("long")
    slot = F.call_function("div", rows_of * F.col("__block"), F.lit(blocks).cast("long")) + F.row_number().over(second) - 1
    return placed.withColumn("slot", slot.cast("long")).drop(*HIDDEN)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_sharding": op4_sharding}
ORACLES: dict[str, str] = {}
