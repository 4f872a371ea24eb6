"""Exact top-k search over product vectors in an index of lists, pruned by bounds.

Lists are the vectors nearest to a centroid; centroids are fitted on at most SAMPLE rows of the least key hashes, whatever
the size of the index. A list knows its radius, the largest distance of a row from the centroid, so no row of it can
score more than `q . c + |q| * radius`. A query visits its lists in the order of that bound, one, then two, then four more
and so on, and is done when its k-th score beats the bound of every list left: the result is that of a full scan.

All sides are rows. Rows of a list lie in chunks of about CHUNK, each one row of the table, so a list that holds a third of
all vectors is many rows in many tasks. In each round the pairs (query, list) become blocks of at most QUERY_BLOCK queries a
list, and meet the chunks of that list in a join: a chunk is read once a round, however many queries ask for it, lists that
no query asks for are not read (they are folders), and neither queries nor vectors pass through the driver. It holds the
centroids and radii, at most MOST_LISTS numbers a side and dimension."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.tables import Work

SAMPLE, MOST_LISTS, LIST_ROWS = 20_000, 1_024, 2_048
CHUNK, QUERY_BLOCK = 4_096, 512
#: Decimals of a score; a bound is rounded up by a little more than the error of a float.
DIGITS, SLACK = 4, 1e-6
SWEEPS = 8


@dataclass
class VectorIndex:
    """chunks (side, list, chunk, keys array, vecs binary of 32-bit floats, row after row); lists (side, list, n, radius)."""

    centroids: np.ndarray
    chunks: DataFrame
    lists: DataFrame
    key_kind: str


def fit_centroids(rows: np.ndarray, n: int) -> np.ndarray:
    """n means of rows by Lloyd's steps, from evenly spaced rows; a mean without rows stays where it is."""
    if len(rows) <= n or n <= 1:
        return rows[:n].astype(np.float64) if len(rows) and n > 1 else np.zeros((1, rows.shape[1] if rows.ndim == 2 else 0))
    rows = rows.astype(np.float64)
    means = rows[np.linspace(0, len(rows) - 1, n).astype(int)].copy()
    for _ in range(SWEEPS):
        of = nearest(rows, means)
        counts = np.bincount(of, minlength=n)
        sums = np.zeros_like(means)
        np.add.at(sums, of, rows)
        means[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return means


def nearest(rows: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.argmin((means**2).sum(axis=1)[None, :] - 2 * rows @ means.T, axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), width) if len(column) else np.zeros((0, width), np.float32)


def build(work: Work, index: DataFrame, lists: int | None = None) -> VectorIndex:
    """index (side, key, vec of one length). lists: their number; by default one for LIST_ROWS rows, MOST_LISTS at most."""
    spark = index.sparkSession
    rows = index.where("vec is not null").select("side", "key", "vec")
    total = rows.count()
    n = min(MOST_LISTS, max(1, total // LIST_ROWS)) if lists is None else lists
    near = rows if total <= 4 * SAMPLE else rows.where(F.xxhash64("key", "side") < F.lit(-(1 << 63) + (1 << 64) * 4 * SAMPLE // total))
    some = near.orderBy(F.xxhash64("key", "side"), "key", "side").limit(SAMPLE if n > 1 else 1)
    sample = np.array([r["vec"] for r in some.select("vec").collect()], np.float32)
    centroids = fit_centroids(sample, n)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                x = _matrix(part.column("vec"), means.shape[1]).astype(np.float64)
                of = nearest(x, means)
                away = np.sqrt(((x - means[of]) ** 2).sum(axis=1))
                packed = pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("side"), part.column("key"), packed, pa.array(of.astype(np.int32)), pa.array(away)], ["side", "key", "v", "list", "away"])

    kind = index.schema["key"].dataType.simpleString()
    placed = work.table(rows.mapInArrow(assign, f"side string, key {kind}, v binary, list int, away double"), "assigned")
    told = work.table(placed.groupBy("side", "list").agg(F.count("*").alias("n"), F.max("away").alias("radius")), "lists")
    parts = F.ceil(F.col("n") / CHUNK)
    # equal rows are told apart by their place in the table, which is written
    dealt = placed.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(told), ["side", "list"]).withColumn("chunk", F.pmod(F.xxhash64("key", "row"), parts))
    grouped = dealt.groupBy("side", "list", "chunk").agg(F.sort_array(F.collect_list(F.struct("key", "v"))).alias("rows"))
    joined = lambda x: F.unhex(F.array_join(F.transform(x, lambda r: F.hex(r["v"])), ""))
    chunks = grouped.select("side", "chunk", F.transform("rows", lambda r: r["key"]).alias("keys"), joined(F.col("rows")).alias("vecs"), "list")
    return VectorIndex(centroids, work.table(chunks, "chunks", ["list"]), told, kind)


def _wanted(index: VectorIndex, query_kind: str, first: int, last: int, radii: dict[str, dict[int, float]]):  # noqa: ANN202
    """Queries (query_id, vec, best: side -> k-th score) -> the lists at places first to last in the order of their bounds
    that may still hold a better row."""
    sent = index.chunks.sparkSession.sparkContext.broadcast((index.centroids, {s: (np.array(sorted(r), np.int64), np.array([r[i] for i in sorted(r)])) for s, r in radii.items()}))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, of_side = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                q = _matrix(part.column("vec"), means.shape[1]).astype(np.float64)
                dots, long = q @ means.T, np.sqrt((q**2).sum(axis=1))
                best = [dict(x or ()) for x in part.column("best").to_pylist()]
                rows, sides, lists, floors = [], [], [], []
                for side, (own, radius) in of_side.items():
                    bounds = np.round(dots[:, own] + long[:, None] * radius[None, :] + SLACK, DIGITS)
                    order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
                    for i in range(len(q)):
                        least = best[i].get(side)
                        for j in order[i]:
                            if least is None or bounds[i, j] >= least:
                                rows.append(i)
                                sides.append(side)
                                lists.append(int(own[j]))
                                floors.append(least)
                take = part.take(pa.array(rows, pa.int64()))
                packed = [q[i].astype(np.float32).tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([take.column("query_id"), pa.array(packed, pa.binary()), pa.array(sides, pa.string()), pa.array(lists, pa.int32()), pa.array(floors, pa.float64())], ["query_id", "q", "side", "list", "floor"])

    return run, f"query_id {query_kind}, q binary, side string, list int, floor double"


def _scored(width: int, k: int):  # noqa: ANN202
    """Chunks with a block of queries -> each query's k best rows of the chunk, those under its floor left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                keys = row.column("keys").flatten()
                asked = row.column("asked").flatten()
                ids, floors = pc.struct_field(asked, "query_id"), pc.struct_field(asked, "floor").to_pylist()
                x = np.frombuffer(row.column("vecs")[0].as_py(), np.float32).reshape(-1, width).astype(np.float64)
                q = np.frombuffer(b"".join(pc.struct_field(asked, "q").to_pylist()), np.float32).reshape(-1, width).astype(np.float64)
                scores = np.round(x @ q.T, DIGITS)
                take_q, take_k, out = [], [], []
                for j in range(len(q)):
                    s = scores[:, j]
                    good = np.arange(len(s)) if floors[j] is None else np.flatnonzero(s >= floors[j])
                    if len(good) > k:  # ties by key: rows are in key order, so the first of equals stay
                        good = good[np.argsort(-s[good], kind="stable")[:k]]
                    take_q.append(np.full(len(good), j))
                    take_k.append(good)
                    out.append(s[good])
                pick = pa.array(np.concatenate(take_q)), pa.array(np.concatenate(take_k))
                side = pa.array([row.column("side")[0].as_py()] * len(pick[0]), pa.string())
                yield pa.RecordBatch.from_arrays([ids.take(pick[0]), side, keys.take(pick[1]), pa.array(np.concatenate(out))], ["query_id", "side", "key", "score"])

    return run


def top_k(work: Work, queries: DataFrame, index: VectorIndex, k: int, visits: list[dict] | None = None) -> DataFrame:
    """queries (query_id, vec) -> (query_id, side, key, score, rank): the k best rows of each side, ties by key. visits gets a
    record of each round: lists asked for, and rows scored."""
    query_kind = queries.schema["query_id"].dataType.simpleString()
    radii: dict[str, dict[int, float]] = {}
    for r in index.lists.toLocalIterator():  # at most MOST_LISTS rows a side
        radii.setdefault(r["side"], {})[r["list"]] = r["radius"]
    asked = work.table(queries.where("vec is not null").select("query_id", "vec"), "queries")
    kind = f"query_id {query_kind}, side string, key {index.key_kind}, score double"
    best = work.spark.createDataFrame([], kind)
    order = Window.partitionBy("query_id", "side").orderBy(F.col("score").desc(), "key")
    first, step, most = 0, 1, max((len(x) for x in radii.values()), default=0)
    while first < most:
        full = best.groupBy("query_id", "side").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        of = full.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("side", "least"))).alias("best"))
        known = asked.join(of, "query_id", "left") if first else asked.withColumn("best", F.lit(None).cast("map<string,double>"))
        run, wanted_kind = _wanted(index, query_kind, first, first + step, radii)
        wanted = work.table(known.select("query_id", "vec", "best").mapInArrow(run, wanted_kind), "wanted")
        sizes = work.table(wanted.groupBy("side", "list").agg(F.count("*").alias("asking")), "asking")
        if visits is not None:
            seen = sizes.join(index.lists, ["side", "list"]).agg(F.sum("asking").alias("pairs"), F.sum(F.col("asking") * F.col("n")).alias("rows"), F.sum("n").alias("read")).first()
            visits.append({"round": len(visits), "lists": seen["pairs"] or 0, "scored": seen["rows"] or 0, "read": seen["read"] or 0})
        lists = sorted({r["list"] for r in sizes.select("list").distinct().toLocalIterator()})
        if first and not lists:
            break
        told = wanted.join(F.broadcast(sizes), ["side", "list"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("asking") / QUERY_BLOCK)))
        blocks = work.table(told.groupBy("side", "list", "block").agg(F.collect_list(F.struct("query_id", "q", "floor")).alias("asked")), "blocks")
        met = index.chunks.where(F.col("list").isin(lists)).join(blocks, ["side", "list"]).select("side", "keys", "vecs", "asked").mapInArrow(_scored(index.centroids.shape[1], k), kind)
        both = met.unionByName(best)
        best = work.table(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
        first, step = first + step, 2 * step
    return best.withColumn("rank", F.row_number().over(order))
