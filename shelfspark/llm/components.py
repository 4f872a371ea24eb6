"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each task first turns its own edges into stars. A small table, whose partitions Spark unites, is done with that."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage


#: Edges that a task turns into stars at a time. They change the work, never the result.
AT_ONCE = 500_000


def _least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges that is not the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(apart := np.flatnonzero(root[a] != root[b])):
        a, b = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> stars (u, v), u > v, that connect what up to AT_ONCE of them connect."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        kind = held[0].schema.field(0).type
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x in _least_reached(u, v)], ["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= AT_ONCE:
            yield done()
            held = []
    if held:
        yield done()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge hangs on a root: no node has two parents, and none is both a child and a parent."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("parent")).unionAll(edges.select("v", F.lit(None)))
    each = ends.groupBy("node").agg(F.min("parent").alias("least"), F.max("parent").alias("most"), F.count_if(F.col("parent").isNull()).alias("children"))
    return each.where("least <> most or least is not null and children > 0").count() == 0


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): for every node the least of itself and its neighbours, aggregated before the shuffle."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(edges), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs, strings or another type that Spark and numpy order alike -> (node, root): root is the least node
    reachable. Nodes without an edge don't appear. Every round is written to the shared folder; null ends and self-loops are
    left out."""
    kind = edges.schema["u"].dataType.simpleString()
    given = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    now = stage(given.mapInArrow(_stars, f"u {kind}, v {kind}"), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        last, now = now, stage(_small_star(_large_star(now)), "edges")
        release(last)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
