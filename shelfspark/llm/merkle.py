"""Merkle dataset manifest in a van Emde Boas layout.

Every row is a leaf; leaves of one group (language) stand by id and are hashed in runs of FAN up to the group's subroot, and
the subroots, by group, up to the root. The tree is cut into aligned subtrees of LEVELS levels (4,096 leaves); each is one
row of the manifest, its digests in one binary in van Emde Boas order: the upper half of the levels first, then the lower
subtrees one after the other, each split again. `addresses` is that order as arithmetic, for subtrees of any height, and
serves both to build subtrees and to find siblings. The roots of subtrees are the leaves of the next tier, so a tier has a
4,096th of the rows of the one below, and a group with a third of all rows is many rows in many tasks.

Proofs go down again: a subtree row and what stands above it (one path a subtree, joined by subtree) give the paths of the
subtrees below and at last of the leaves.

A null field is `-`. Leaves of one id stand by their digest; null ids and groups come first; repeated rows are leaves of
their own; extra columns are ignored; an empty table gives no rows. Texts are hashed where they are read, and only digests
are shuffled. One group's subroot is a run of its own if there is no other group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, each_batch, join_small, stage
from .order import numbered

FAN, LEVELS = 8, 4
#: Leaves of an aligned subtree.
LEAVES = FAN**LEVELS
#: Paths (about 500 bytes a level of the tree) that may be broadcast.
MOST_PATHS = 8_192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIZE = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 (hex) of the fields: each `-` if null, else its bytes in UTF-8, `:` and the value."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


@cache
def addresses(depths: int) -> tuple[np.ndarray, ...]:
    """Of a whole subtree with `depths` levels of nodes: the place of each node in van Emde Boas order, by depth."""
    if depths == 1:
        return (np.zeros(1, np.int64),)
    upper = depths // 2
    top, below = addresses(upper), addresses(depths - upper)
    room, each = sum(map(len, top)), sum(map(len, below))
    first = room + each * np.arange(FAN**upper)
    return (*top, *((first[:, None] + b).ravel() for b in below))


def height_of(leaves: int) -> int:
    """Levels above the leaves of a tree that is whole: the least in which runs of FAN come down to one node."""
    height = 0
    while FAN**height < leaves:
        height += 1
    return height


def digest(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode()


def layout(leaves: list[bytes], height: int) -> bytes:
    """Digests (32 bytes each) of the subtree over leaves, in van Emde Boas order; places without a node are zero."""
    at = addresses(height + 1)
    out = np.zeros((sum(map(len, at)), _SIZE), np.uint8)
    now = [x.hex().encode() for x in leaves]
    for depth in range(height, -1, -1):
        out[at[depth][: len(now)]] = np.frombuffer(bytes.fromhex(b"".join(now).decode()), np.uint8).reshape(-1, _SIZE)
        if depth:
            now = [digest(b"".join(now[i : i + FAN])) for i in range(0, len(now), FAN)]
    return out.tobytes()


class Subtree:
    """Reads of a stored subtree: nodes (hex) by depth and place."""

    def __init__(self, nodes: bytes, leaves: int, height: int):
        self.height, self.at = height, addresses(height + 1)
        self.counts = [-(-leaves // FAN ** (height - d)) for d in range(height + 1)]
        self.hex = nodes.hex().encode()

    def node(self, depth: int, i: int) -> bytes:
        a = int(self.at[depth][i]) * 2 * _SIZE
        return self.hex[a : a + 2 * _SIZE]

    def run(self, depth: int, i: int) -> list[bytes]:
        """The run of a node: it and its siblings."""
        first = i - i % FAN
        return [self.node(depth, j) for j in range(first, min(first + FAN, self.counts[depth]))]


def _steps(path: bytes) -> list[tuple[int, list[bytes]]]:
    """path: for each level upwards the place in the run, its length, and its digests -> [(place, run as hex)]."""
    out, i = [], 0
    while i < len(path):
        place, n = path[i], path[i + 1]
        text = path[i + 2 : i + 2 + n * _SIZE].hex().encode()
        out.append((place, [text[k : k + 2 * _SIZE] for k in range(0, len(text), 2 * _SIZE)]))
        i += 2 + n * _SIZE
    return out


def _step(place: int, run: list[bytes]) -> bytes:
    return bytes((place, len(run))) + bytes.fromhex(b"".join(run).decode())


def _siblings(steps: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(x for place, run in steps for j, x in enumerate(run) if j != place)


def _folded(start: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    for place, run in steps:
        start = digest(b"".join([*run[:place], start, *run[place + 1 :]]))
    return start


@dataclass
class Manifest:
    """tiers[k] (tree long, block long, total long: leaves of the tree in this tier, height int, nodes binary, and in tier 0
    leaves: the rows of the subtree), trees (tree, group, size, subroot), top: the tiers over the subroots, root (hex)."""

    tiers: list[DataFrame]
    trees: DataFrame
    top: list[DataFrame]
    root: str | None


_NODES = "tree long, block long, total long, height int, nodes binary, root binary"


def _built(levels: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(tree, block, total, leaves: structs in order with a digest) -> the rows of a tier, leaves kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 64):
            leaves = b.column("leaves")
            digests = pc.struct_field(leaves.flatten(), "digest")
            ends = np.cumsum([0, *leaves.value_lengths().to_pylist()])
            nodes, roots, heights = [], [], []
            for i, total in enumerate(b.column("total").to_pylist()):
                heights.append(height_of(total) if total <= FAN**levels else levels)
                nodes.append(layout(digests.slice(ends[i], ends[i + 1] - ends[i]).to_pylist(), heights[-1]))
                roots.append(nodes[-1][:_SIZE])  # the root comes first in any such order
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), b.column("total"), pa.array(heights, pa.int32()), pa.array(nodes, pa.binary()), pa.array(roots, pa.binary()), leaves], ["tree", "block", "total", "height", "nodes", "root", "leaves"])

    return run


def _tier(nodes: DataFrame, kept: list[str], name: str) -> DataFrame:
    """nodes (tree, index, total, digest binary, kept) -> a tier, as a table."""
    block = F.call_function("div", F.col("index"), F.lit(LEAVES).cast("long")).alias("block")
    rows = nodes.groupBy("tree", block).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("index", "digest", *kept))).alias("leaves"))
    kind = rows.schema["leaves"].dataType.simpleString()
    return stage(rows.mapInArrow(_built(LEVELS), f"{_NODES}, leaves {kind}"), name)


def _tiers(nodes: DataFrame, kept: list[str], name: str) -> list[DataFrame]:
    """Tier by tier until every tree is one subtree."""
    out = [_tier(nodes, kept, f"{name}-0")]
    while not (more := out[-1].where(F.col("total") > LEAVES)).isEmpty():
        above = more.select("tree", F.col("block").alias("index"), F.ceil(F.col("total") / LEAVES).cast("long").alias("total"), F.col("root").alias("digest"))
        out.append(_tier(above, [], f"{name}-{len(out)}"))
    return out


def _roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, digest): of each tree the root of its last subtree."""
    found = [t.where(F.col("total") <= LEAVES).select("tree", F.col("root").alias("digest")) for t in tiers]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def manifest(rows: DataFrame, kept: list[str] = ()) -> Manifest:
    """rows (id, group, digest binary, kept) -> the manifest of the tree. rows: a scan with narrow steps, or a table."""
    placed = numbered(rows, [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest")], "leaves")
    sizes = stage(placed.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("size")), "groups")
    trees = numbered(sizes, [F.col("first")], "trees").withColumnRenamed("at", "tree").withColumnRenamed("group", "__group")
    told = join_small(placed, trees, placed.group.eqNullSafe(trees["__group"]), "inner")
    nodes = told.select("tree", (F.col("at") - F.col("first")).alias("index"), F.col("size").alias("total"), "digest", "id", *kept)
    tiers = _tiers(nodes, ["id", *kept], "tier")
    trees = stage(trees.join(_roots(tiers).select(F.col("tree").alias("__tree"), F.col("digest").alias("subroot")), F.col("tree") == F.col("__tree")).select("tree", F.col("__group").alias("group"), "size", "subroot"), "subroots")
    count = trees.count()
    top = _tiers(trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(count).cast("long").alias("total"), F.col("subroot").alias("digest")), [], "top")
    last = _roots(top).first()
    return Manifest(tiers, trees, top, bytes(last["digest"]).hex() if last else None)


def _below(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a tier with what stands above (path) -> (tree, block, path) of each of their leaves."""
    for b in each_batch(batches, 16):
        for r in b.to_pylist():
            sub = Subtree(r["nodes"], n := len(r["leaves"]), r["height"])
            paths: dict[tuple[int, int], bytes] = {(0, 0): r["path"]}
            for depth in range(1, sub.height + 1):
                for i in range(sub.counts[depth]):
                    paths[depth, i] = _step(i % FAN, sub.run(depth, i)) + paths[depth - 1, i // FAN]
            index = [x["index"] for x in r["leaves"]]
            for at in range(0, n, 512):
                some = range(at, min(at + 512, n))
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(some), pa.int64()), pa.array([index[i] for i in some], pa.int64()), pa.array([paths[sub.height, i] for i in some], pa.binary())], ["tree", "block", "path"])


def _paths(tiers: list[DataFrame], roots: DataFrame, name: str, down_to: int = 0) -> DataFrame:
    """(tree, block, path) of the subtrees of tier `down_to`; of the leaves of tier 0 if it is -1. roots (tree, path): what
    stands above each tree's root."""
    below: DataFrame | None = None
    for k in range(len(tiers) - 1, max(down_to, 0) - 1, -1):
        own = tiers[k].where(F.col("total") <= LEAVES).select("tree", "block")
        paths = join_small(roots, own, ["tree"], "inner").select("tree", "block", "path")
        paths = paths if below is None else paths.unionByName(below)
        paths = stage(paths, f"{name}-paths-{k}")
        if k == down_to and down_to >= 0:
            return paths
        joined = join_small(tiers[k], paths, ["tree", "block"], "inner", MOST_PATHS)
        below = joined.select("tree", "block", "height", "nodes", F.transform("leaves", lambda x: F.struct(x["index"].alias("index"))).alias("leaves"), "path").mapInArrow(_below, "tree long, block long, path binary")
    return below


def _proven(changed: str | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Subtrees of tier 0 with their paths -> the proof of each leaf, folded from the digest in `changed` where it is given."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 16):
            for k, (nodes, height, path, subroot, root) in enumerate(zip(*(b.column(c).to_pylist() for c in ("nodes", "height", "path", "subroot", "root")), strict=True)):
                rows = b.column("leaves").slice(k, 1).flatten()
                n = len(rows)
                sub = Subtree(nodes, n, height)
                above = _steps(path)
                tails = {(0, 0): _siblings(above)}
                folds = {(0, 0): _folded(sub.node(0, 0), above)}
                runs = {}
                for depth in range(1, height + 1):
                    for i in range(sub.counts[depth]):
                        if i % FAN == 0:
                            runs[depth, i // FAN] = sub.run(depth, i)
                        own = runs[depth, i // FAN]
                        tails[depth, i] = b"".join([*own[: i % FAN], *own[i % FAN + 1 :], tails[depth - 1, i // FAN]])

                def fold(depth: int, i: int, start: bytes) -> bytes:
                    """From a digest in the place of a node to the root; nodes as they are stored are folded once."""
                    if (same := start == sub.node(depth, i)) and (depth, i) in folds:
                        return folds[depth, i]
                    if depth == 0:
                        return _folded(start, above)
                    own = runs[depth, i // FAN]
                    up = fold(depth - 1, i // FAN, digest(b"".join([*own[: i % FAN], start, *own[i % FAN + 1 :]])))
                    if same:
                        folds[depth, i] = up
                    return up

                starts = [None] * n if changed is None else pc.struct_field(rows, changed).to_pylist()
                leaves = [sub.node(height, i) for i in range(n)]
                found = [fold(height, i, leaves[i] if x is None else x.hex().encode()).decode() for i, x in enumerate(starts)]
                texts = [[x.decode() for x in leaves], [bytes(subroot).hex()] * n, [root] * n, [hashlib.sha256(tails[height, i]).hexdigest() for i in range(n)], found]
                yield pa.RecordBatch.from_arrays([pc.struct_field(rows, "id"), *(pa.array(x, pa.string()) for x in texts), pa.array([x == root for x in found], pa.bool_())], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def proofs(of: Manifest, changed: str | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf; `changed`: a kept column with the digest
    (binary, or null for the stored one) that is claimed for the leaf and folded with its siblings."""
    kind = of.tiers[0].schema["leaves"].dataType.elementType["id"].dataType.simpleString()
    whole = of.top[-1].sparkSession.createDataFrame([(0, b"")], "tree long, path binary")
    groups = _paths(of.top, whole, "top", -1).select(F.col("block").alias("tree"), "path")
    named = stage(groups.join(of.trees.select("tree", "subroot"), "tree"), "group-paths")
    paths = _paths(of.tiers, named.select("tree", "path"), "tier")
    told = join_small(paths, named.select("tree", "subroot"), ["tree"], "inner")
    rows = join_small(of.tiers[0].drop("root"), stage(told, "paths"), ["tree", "block"], "inner", MOST_PATHS)
    rows = rows.select("nodes", "height", "path", "subroot", F.lit(of.root).cast("string").alias("root"), "leaves")
    return rows.mapInArrow(_proven(changed), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), F.unhex(leaf([F.col(c) for c in FIELDS])).alias("digest"), F.when(tampered, F.unhex(leaf(lowered))).alias("claimed"))
    return proofs(manifest(rows, ["claimed"]), "claimed").withColumnRenamed("id", "doc_id")


_ORACLE = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({leaf}) AS h, sha256({low}) AS low,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
nodes AS (
  SELECT 0 AS lvl, tree, i, h FROM placed
  UNION ALL
  SELECT lvl + 1, tree, i // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, max(i) OVER (PARTITION BY tree) AS most FROM nodes) WHERE most > 0 GROUP BY lvl, tree, i // 8),
tops AS (SELECT tree, arg_max(h, lvl) AS subroot, max(lvl) AS height FROM nodes GROUP BY tree),
upper_nodes AS (
  SELECT 0 AS lvl, tree AS i, subroot AS h FROM tops
  UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, max(i) OVER () AS most FROM upper_nodes) WHERE most > 0 GROUP BY lvl, i // 8),
root AS (SELECT arg_max(h, lvl) AS root, max(lvl) AS height FROM upper_nodes),
climb AS (
  SELECT 0 AS lvl, p.tree, p.i AS leaf_i, p.i AS i, CASE WHEN xor(p.crc, 4294967295) % 3 = 0 THEN p.low ELSE p.h END AS h, '' AS sib FROM placed p
  UNION ALL
  SELECT c.lvl + 1, c.tree, c.leaf_i, c.i // 8, sha256(string_agg(CASE WHEN n.i = c.i THEN c.h ELSE n.h END, '' ORDER BY n.i)),
         c.sib || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i <> c.i), '')
  FROM climb c JOIN tops t ON t.tree = c.tree AND c.lvl < t.height JOIN nodes n ON n.tree = c.tree AND n.lvl = c.lvl AND n.i // 8 = c.i // 8
  GROUP BY c.lvl, c.tree, c.leaf_i, c.i, c.h, c.sib),
climbed AS (SELECT c.* FROM climb c JOIN tops t ON t.tree = c.tree AND t.height = c.lvl),
upper_climb AS (
  SELECT 0 AS lvl, tree, leaf_i, tree AS i, h, sib FROM climbed
  UNION ALL
  SELECT c.lvl + 1, c.tree, c.leaf_i, c.i // 8, sha256(string_agg(CASE WHEN n.i = c.i THEN c.h ELSE n.h END, '' ORDER BY n.i)),
         c.sib || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i <> c.i), '')
  FROM upper_climb c JOIN root r ON c.lvl < r.height JOIN upper_nodes n ON n.lvl = c.lvl AND n.i // 8 = c.i // 8
  GROUP BY c.lvl, c.tree, c.leaf_i, c.i, c.h, c.sib)
SELECT p.doc_id, p.h AS leaf, t.subroot, r.root, sha256(c.sib) AS proof_sha256, c.h AS folded_root, c.h = r.root AS verified
FROM placed p JOIN tops t ON t.tree = p.tree CROSS JOIN root r
JOIN upper_climb c ON c.tree = p.tree AND c.leaf_i = p.i AND c.lvl = r.height
"""


def _sql(text: str) -> str:
    one = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    return " || ".join(one(text if f == "text" else f) for f in FIELDS)


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES: dict[str, str] = {"op12_merkle_manifest": _ORACLE.format(leaf=_sql("text"), low=_sql(f"translate(text, '{_UPPER}', '{_LOWER}')"))}
