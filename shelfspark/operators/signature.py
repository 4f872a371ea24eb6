"""A catalog's signature as a tree of hashes, and what changed between two of them.

Leaves are hashes of products; PARTS parts of a cluster, by a hash of the product's id, cover their leaves; a cluster covers
its parts, and the root the clusters. The tree is a table a level. Two trees are compared from the top: clusters that differ,
then the parts of these, then the leaves of those parts alone, so a few changed products cost a few parts, not the catalog.
Leaves lie in folders by part, which a comparison of few parts picks out. No row holds more than a part of a cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.joins import join_small
from shelfspark.tables import Work

#: Parts of a cluster: enough for clusters of about 10^9 products to have parts of some thousands.
PARTS_DIGITS, FOLDER_DIGITS = 4, 1
#: Parts that are picked by name; more are joined.
FEW = 500


@dataclass
class Tree:
    """root (one row), clusters (cluster, h), parts (cluster, part, h), leaves (folder, cluster, part, product_id, h)."""

    clusters: DataFrame
    parts: DataFrame
    leaves: DataFrame

    @property
    def root(self) -> DataFrame:
        return self.clusters.agg(_over(F.concat(F.coalesce("cluster", F.lit("")), F.lit(":"), "h")).alias("h"))

    def write(self, path: str) -> None:
        self.clusters.write.parquet(f"{path}/clusters")
        self.parts.write.parquet(f"{path}/parts")
        self.leaves.write.partitionBy("folder").parquet(f"{path}/leaves")


def read(spark, path: str) -> Tree:  # noqa: ANN001
    kind = "cluster string, part string, product_id string, h string, folder string"
    return Tree(spark.read.parquet(f"{path}/clusters"), spark.read.parquet(f"{path}/parts"), spark.read.schema(kind).parquet(f"{path}/leaves"))


def _over(x: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(x)), ""), 256)


def tree(work: Work, products: DataFrame, values: list[Column]) -> Tree:
    """products (cluster, product_id and what values are made of) -> the tree over their values. Repeated rows count as often as
    they are there; null clusters are one."""
    digits = F.sha2(F.coalesce("product_id", F.lit("")), 256)
    row = F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)
    leaves = products.select("cluster", F.substring(digits, 1, PARTS_DIGITS).alias("part"), "product_id", row.alias("h"), F.substring(digits, 1, FOLDER_DIGITS).alias("folder"))
    leaves = work.table(leaves.repartition("folder").sortWithinPartitions("folder", "cluster", "part"), "leaves", ["folder"])
    parts = work.table(leaves.groupBy("cluster", "part").agg(_over(F.concat(F.coalesce("product_id", F.lit("")), F.lit(":"), "h")).alias("h")), "parts")
    clusters = work.table(parts.groupBy("cluster").agg(_over(F.concat("part", F.lit(":"), "h")).alias("h")), "clusters")
    return Tree(clusters, parts, leaves)


def _unlike(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys whose hashes differ, or that only one side has."""
    both = old.select(*keys, F.lit(0).alias("side"), "h").unionByName(new.select(*keys, F.lit(1).alias("side"), "h"))
    hash_of = lambda side: F.max(F.when(F.col("side") == side, F.col("h")))
    return both.groupBy(*keys).agg(hash_of(0).alias("was"), hash_of(1).alias("now")).where(~F.col("was").eqNullSafe(F.col("now")))


def _of(rows: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    few = picked.limit(FEW + 1).collect()
    if len(few) <= FEW:
        last = keys[-1]
        values = [r[last] for r in few]
        rows = rows.where(F.col(last).isin(values) | F.col(last).isNull()) if last != "part" else rows.where(F.col("part").isin(values))
        if "folder" in rows.columns:
            rows = rows.where(F.col("folder").isin(sorted({v[:FOLDER_DIGITS] for v in values})))
    same = None
    named = picked.select(*[F.col(k).alias(f"__{k}") for k in keys])
    for k in keys:
        one = rows[k].eqNullSafe(named[f"__{k}"])
        same = one if same is None else same & one
    return join_small(rows, named, same, "left_semi")


def changes(work: Work, old: Tree, new: Tree, seen: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cluster, change) and (cluster, product_id, change): added, removed or changed; as tables. seen gets how many rows were
    compared at each level. A product that is there several times is changed if any of its rows is."""
    told = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change")
    clusters = work.table(_unlike(old.clusters, new.clusters, ["cluster"]), "changed-clusters")
    own = [_of(t.parts, clusters, ["cluster"]) for t in (old, new)]
    parts = work.table(_unlike(*own, ["cluster", "part"]), "changed-parts")
    leaves = [work.table(_of(t.leaves, parts, ["cluster", "part"]), "compared-leaves") for t in (old, new)]
    rows = [x.groupBy("cluster", "product_id").agg(_over(F.col("h")).alias("h")) for x in leaves]
    products = work.table(_unlike(*rows, ["cluster", "product_id"]).select("cluster", "product_id", told), "changed-products")
    if seen is not None:
        seen |= {"clusters": old.clusters.count() + new.clusters.count(), "parts": sum(x.count() for x in own), "leaves": sum(x.count() for x in leaves)}
    return clusters.select("cluster", told), products
