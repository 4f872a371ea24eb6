"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at `RADIUS` = 3 or fewer differing bits. For a pair with 1 to 3 differing bits, at least one of three
bit blocks (21, 21 and 22 bits) holds one of them; with that block masked out at most two bits differ, so the balls of
half that radius, 1, around both meet. Every distinct fingerprint therefore emits, for each masked block, itself and all
variants with one bit turned (131 keys); equal keys meet in the shuffle, the pairs are verified on all 64 bits, and
repeated pairs go in a distinct. Nothing is capped: inside a key the comparison is exact whatever its size, and a key of
more than FEW fingerprints hands on a spanning forest of its links, not the pairs.

Equal fingerprints are one node, so groups of copies cost one row. Null and empty texts have fingerprint zero and link
like any other; repeated doc_ids are repeated rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingle_join
from .common import documents, each_batch, join_small, let_go, release, stage, strings
from .components import components

RADIUS = 3
SEED = 42
#: Fingerprints of a key up to which it hands on its pairs: three and a half a fingerprint at most.
FEW = 8
BLOCKS = ((0, 21), (21, 42), (42, 64))


def fingerprint(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run of hashes: a bit is 1 if it is set in over half of them."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _shingles(text: str, width: int) -> list[bytes]:
    words = text.encode().lower().split()  # bytes: A-Z only; ASCII white space only
    if not words:
        return []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))) if len(words) >= width else [b" ".join(words)]


def xxh64_hashes(text: str, width: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in _shingles(text, width)]), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", hashes: Callable[[str, int], np.ndarray] = xxh64_hashes) -> DataFrame:
    """(doc_id, fp long): the SimHash of each whole text over `width`-word shingles, repeats included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("simhash")
        for b in each_batch(batches, 100, 1 << 20):
            each = [hashes(t, width) for t in strings(b)]
            sizes = np.array([len(x) for x in each], np.int64)
            full = np.flatnonzero(sizes)
            out = np.zeros(b.num_rows, np.uint64)
            if len(full):
                out[full] = fingerprint(np.concatenate(each), (np.cumsum(sizes) - sizes)[full], sizes[full])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


_LOW = np.array([low for low, _ in BLOCKS], np.uint64)
_INSIDE = np.array([(1 << (high - low)) - 1 for low, high in BLOCKS], np.uint64)
_KEEP = ~(_INSIDE << _LOW)


def _variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rest): key is a variant with one block masked out, marked there by the block's number; rest is what it takes
    to get the fingerprint back: the block's bits, its number (2 bits) and the turned bit (7 bits, 64 for none)."""
    block = np.array([j for j, (low, high) in enumerate(BLOCKS) for b in range(65) if b == 64 or not low <= b < high])
    turned = np.array([b for low, high in BLOCKS for b in range(65) if b == 64 or not low <= b < high], np.uint64)
    flip = np.where(turned < 64, np.uint64(1) << (turned & np.uint64(63)), np.uint64(0))
    mark = np.array([j + 1 for j in block], np.uint64) << _LOW[block]
    tail = block.astype(np.uint64) << np.uint64(7) | turned
    for b in each_batch(batches, 1000):
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
        keys = ((fp & _KEEP[block]) | mark) ^ flip
        rest = (fp >> _LOW[block] & _INSIDE[block]) << np.uint64(9) | tail
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rest.ravel().astype(np.int32))], ["key", "rest"])


def _fingerprint_of(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    rest = rest.astype(np.uint64)
    block, turned = (rest >> np.uint64(7) & np.uint64(3)).astype(np.int64), rest & np.uint64(127)
    flip = np.where(turned < 64, np.uint64(1) << (turned & np.uint64(63)), np.uint64(0))
    return (((key.view(np.uint64) ^ flip) & _KEEP[block]) | rest >> np.uint64(9) << _LOW[block]).view(np.int64)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[list, list]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return [a for a, _ in kept], [b for _, b in kept]


def _links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole runs of equal keys (sorted): every pair of a run is compared, one lag at a time."""
    heads = np.flatnonzero(np.diff(key, prepend=~key[0]))
    sizes = np.diff(np.append(heads, len(key)))
    us, vs = [], []
    small = sizes <= FEW
    for some, forest in ((small, False), (~small, True)):
        h, n = heads[some & (sizes > 1)], sizes[some & (sizes > 1)]
        for at, m in zip(h, n, strict=True) if forest else ():
            own = fp[at : at + m].view(np.uint64)
            fu, fv = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for lag in range(1, m):
                hit = np.flatnonzero(np.bitwise_count(own[lag:] ^ own[:-lag]) <= RADIUS)
                fu, fv = np.append(fu, own[hit].view(np.int64)), np.append(fv, own[hit + lag].view(np.int64))
                if len(fu) > 4 * m:
                    fu, fv = (np.array(x, np.int64) for x in _forest(fu, fv))
            fu, fv = _forest(fu, fv)
            us.append(np.array(fu, np.int64))
            vs.append(np.array(fv, np.int64))
        if not forest and len(h):
            for lag in range(1, int(n.max())):
                room = n > lag
                at = np.repeat(h[room], n[room] - lag)
                at = at + np.arange(len(at)) - np.repeat(np.cumsum(n[room] - lag) - (n[room] - lag), n[room] - lag)
                u, v = fp[at], fp[at + lag]
                hit = np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= RADIUS
                us.append(u[hit])
                vs.append(v[hit])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links; the last run of a batch waits for the next batch."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def done(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        u, v = _links(k, f) if len(k) else (k, f)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        held.append((keys, _fingerprint_of(keys, b.column(1).to_numpy(zero_copy_only=False))))
        rows += b.num_rows
        if rows < 200_000:
            continue
        key, fp = (np.concatenate([x, *(h[i] for h in held)]) for i, x in enumerate((key, fp)))
        held, rows = [], 0
        cut = int(np.searchsorted(key, key[-1], "left"))
        yield done(key[:cut], fp[:cut])
        key, fp = key[cut:], fp[cut:]
    key, fp = (np.concatenate([x, *(h[i] for h in held)]) for i, x in enumerate((key, fp)))
    yield done(key, fp)


def links(fps: DataFrame) -> DataFrame:
    """fps (fp long, distinct) -> (u, v), u < v: links that connect all fingerprints within the radius of one another;
    all of them but for keys of over FEW fingerprints, which give a spanning forest."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = fps.select("fp").mapInArrow(_variants, "key long, rest int")
    found = variants.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet, "u long, v long")
    return found.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _of_fingerprints(rows: DataFrame, name: str, nodes: DataFrame | None = None) -> DataFrame:
    """rows (doc_id, name) -> (name, component): the least doc_id reachable from each fingerprint, over the components
    (node, root) given or the links of the fingerprints."""
    fps = stage(rows.groupBy(F.col(name).alias("fp")).agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    nodes = components(links(fps)) if nodes is None else nodes
    member = stage(fps.join(nodes, fps.fp == nodes.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "members")
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    return member.join(least, "root").select(F.col("fp").alias(name), "component")


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links of fingerprints."""
    rows = stage(fingerprints(docs, width, id_col, text_col), "fingerprints")
    return rows.join(_of_fingerprints(rows, "fp"), "fp").select("doc_id", "fp", F.col("component").alias("component_id"))


def similar_texts(docs: DataFrame, width: int = shingle_join.WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, component_id): documents link if their sets of `width`-word shingles have a similarity of 0.8 or more.

    Ball hashing comes first: each text is a candidate of the least text of its component of fingerprints over the same
    shingles, and verified on the sets, which connects groups of near copies by one pair a text.
    Pairs near 0.8 mostly differ in more than RADIUS bits; the exact join of shingle_join finds them, and tries no pair that
    is connected already. node is the text's hash; where different texts have one (told by length and crc32), the others of
    a node stay alone."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    told = texts.select("node", F.struct(F.length("text").alias("n"), F.crc32(F.col("text").cast("binary")).alias("crc")).alias("other"))
    shared = stage(told.groupBy("node").agg(F.min("other").alias("own"), F.max("other").alias("last")).where("own <> last").select("node", "own"), "shared-hashes")
    if not shared.isEmpty():
        marked = join_small(texts.withColumn("other", F.struct(F.length("text").alias("n"), F.crc32(F.col("text").cast("binary")).alias("crc"))), shared, ["node"])
        alone = F.coalesce(F.col("other") != F.col("own"), F.lit(False))
        first = similar_texts(marked.where(~alone).select("id", "text"), width, "id")
        return first.unionByName(marked.where(alone).select(F.col("id").alias("doc_id"), "node", F.col("id").alias("component_id")))
    printed = fingerprints(texts.select(F.struct("id", "node").alias("doc_id"), "text"), width, hashes=shingle_join.shingle_hashes)
    release(shared)
    rows = stage(printed.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.node").alias("node"), "fp"), "fingerprints")
    balls = stage(rows.groupBy("fp").agg(F.min("node").alias("least")), "distinct-fingerprints")
    met = components(links(balls)).select(F.col("node").alias("fp"), "root")
    root = balls.select(F.col("fp").alias("root"), F.col("least").alias("first"))
    near = balls.join(met, "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(root, "root").select("fp", "first")
    pairs = rows.select("fp", "node").distinct().join(near, "fp").where("node <> first").select(F.least("node", "first").alias("u"), F.greatest("node", "first").alias("v"))
    known = shingle_join.verified(stage(pairs, "ball-pairs"), texts.select("node", "text"), width)
    _, nodes = shingle_join.connected(texts.select("node", "text"), width, known)
    return rows.join(_of_fingerprints(rows.select("doc_id", "node"), "node", nodes), "node").select("doc_id", "node", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = similar_texts) -> DataFrame:
    """docs, all columns, with one row of each component of `groups` (similar_texts or near_duplicates): the one of the
    least doc_id (nulls last), then of the least hash of the text. Rows are told apart by both, so neither rows without an
    id nor rows of one id and several texts stand for one another; of rows that are equal in both one stays."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), mark.alias("mark"))
    found = stage(groups(docs.select(key.alias("doc_id"), "text")), "components")
    same = lambda rows, others: rows["doc_id"].eqNullSafe(others["id"]) & (F.xxhash64(F.coalesce(rows["text"], F.lit(""))) == others["mark"])
    gone = stage(found.where("doc_id <> component_id").select(F.col("doc_id.id").alias("id"), F.col("doc_id.mark").alias("mark")).distinct(), "gone")
    kept = join_small(docs, gone, same(docs, gone), "left_anti")
    again = stage(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id.id").alias("id"), F.col("doc_id.mark").alias("mark")), "repeated")
    if again.isEmpty():
        return kept
    twice = kept.join(again, same(kept, again), "left_semi").withColumn("__mark", mark).dropDuplicates(["doc_id", "__mark"]).drop("__mark")
    return kept.join(again, same(kept, again), "left_anti").unionByName(twice)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
