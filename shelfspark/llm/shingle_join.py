"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8: an exact set join.

Two sets that are that similar share one of the first n - ceil(0.8 n) + 1 shingles of each in any order common to all
(prefix filter), and the first shingle that they share stands early enough in both to leave room for the overlap they need
(position filter). The order puts shingles that are common in a sample last, and is by hash otherwise; the sample changes
the work, never the result. Round one verifies each text of a key against the key's least one, which joins large groups
of near copies with a row a text. The next rounds verify each text of a key against those next to it, so that texts which
are similar to some of their group only meet by a few pairs a text; the last round verifies all pairs of a key that are
still in different components. Nothing is capped: a key costs the square of its different components, not of its texts.
A pair is handed on only if bitmaps of the two sets allow the similarity (each shingle turns one of BITS bits, so sets differ
in at least as many shingles as their bitmaps in bits): those tries stay inside the task.

Texts are nodes by their 64-bit hash, shingles by theirs; the similarity is counted from the whole texts of a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, join_small, release, stage, strings
from .components import components

WIDTH = 5
#: The least similarity of a pair is LEAST[0] / LEAST[1].
LEAST = (4, 5)
#: One in how many texts is sampled, how many of them make a shingle common, and how many common shingles are told apart.
SAMPLE, COMMON_FROM, MOST_COMMON = 4, 3, 2_000_000
#: Nodes whose list may be broadcast (8 bytes each).
MOST_NODES = 1_000_000
#: Bits of the bitmap of a set, and its columns of 64 bits.
BITS = 512
MARKS = [f"b{i}" for i in range(BITS // 64)]
#: Pairs handed on at a time.
PAIRS = 500_000
#: Texts of a key, in the order of their hashes, that a text is verified against in the rounds before the last. They change
#: the work, never the result.
BESIDE = (8, 32)


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of a text's shingles in order, repeats included (A-Z lower-cased; ASCII white space between words): of
    one for a text shorter than a shingle, of none for a text without words. A shingle's hash is made of its words'."""
    import xxhash

    words = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, text.encode().lower().split())), "<u8")
    n = len(words) - width + 1 if len(words) >= width else min(1, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = (out ^ (out >> np.uint64(29))) * _FACTOR + words[k : k + n]
    return out ^ (out >> np.uint64(32))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(1 << 63)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, width))


def prefix(each: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of a set of which a similar set holds at least one."""
    n = len(each)
    late = common[np.minimum(np.searchsorted(common, each), len(common) - 1)] == each if len(common) else np.zeros(n, bool)
    return np.concatenate([each[~late], each[late]])[: n - -(-LEAST[0] * n // LEAST[1]) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _common(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that several texts of a sample hold, ascending: of the lower half of the hashes, where prefixes lie. The
    sample is a share of the texts, so what it tells apart does not depend on their number. Copies of a text count once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 100):
            every = np.concatenate([shingle_set(t, width) for t in strings(b)])
            yield pa.RecordBatch.from_arrays([pa.array(every[every < _HALF].view(np.int64))], ["key"])

    some = texts.where(F.pmod("node", F.lit(SAMPLE)) == 0).dropDuplicates(["node"]).select("text").mapInArrow(run, "key long")
    often = some.groupBy("key").count().where(F.col("count") >= COMMON_FROM).orderBy(F.desc("count"), "key").limit(MOST_COMMON)
    return np.sort(often.select("key").toArrow().column(0).to_numpy().view(np.uint64))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, whole runs of the first column at a time."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        rows += b.num_rows
        if rows >= 200_000:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
            if cut:
                yield [c[:cut] for c in columns]
            held = [[c[cut:] for c in columns]]
            rows = 0
    if held:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        if len(columns[0]):
            yield columns


def _fits(size: np.ndarray, pos: np.ndarray, other_size: np.ndarray, other_pos: np.ndarray) -> np.ndarray:
    """Whether sets that share a shingle at these places of their orders, and none before, can be similar enough."""
    size, other_size = size.astype(np.int64), np.asarray(other_size, np.int64)
    room = np.minimum(size - pos, other_size - other_pos)  # the shared shingle and what follows
    return (LEAST[0] + LEAST[1]) * room >= LEAST[0] * (size + other_size)


def bitmap(each: np.ndarray) -> np.ndarray:
    """BITS // 64 words: a bit is 1 if an odd number of the set's shingles fall on it."""
    odd = np.bincount((each >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _allowed(size: np.ndarray, marks: np.ndarray, other_size: np.ndarray, other_marks: np.ndarray) -> np.ndarray:
    """Whether sets of these bitmaps can be similar enough: similar sets differ in few shingles."""
    apart = np.bitwise_count((marks ^ other_marks).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return (LEAST[0] + LEAST[1]) * apart <= (LEAST[1] - LEAST[0]) * (size.astype(np.int64) + np.asarray(other_size, np.int64))


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node -> one row a node of the keys of two nodes and more, with the key's least node and
    whether the two can be similar."""
    for key, node, size, pos in _runs(batches):
        once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node, size, pos = key[once], node[once], size[once], pos[once]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(heads, len(key)))
        first, many = np.repeat(heads, n), np.repeat(n > 1, n)
        out = key[many], node[many], size[many], pos[many], node[first][many], _fits(size, pos, size[first], pos[first])[many]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "node", "size", "pos", "least", "fits"])


def _beside(most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, node, root, size, pos, MARKS) sorted by key and node -> pairs of a key, at most `most` places apart, of different
    roots that can be similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, root, size, pos, *marks in _runs(batches):
            marks = np.stack(marks, axis=1)
            for lag in range(1, most + 1):
                at = np.flatnonzero(key[lag:] == key[:-lag])
                if not len(at):
                    break
                at = at[(root[at] != root[at + lag]) & _fits(size[at], pos[at], size[at + lag], pos[at + lag])]
                at = at[_allowed(size[at], marks[at], size[at + lag], marks[at + lag])]
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[at + lag])], ["u", "v"])

    return run


def _across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, root, node, size, pos, MARKS) sorted by key and root -> pairs of a key of different roots that can be
    similar."""

    def out(us: list, vs: list) -> pa.RecordBatch:
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    us, vs, held = [], [], 0
    for key, root, node, size, pos, *marks in _runs(batches):
        marks = np.stack(marks, axis=1)
        heads = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for at, end in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            if root[at] == root[end - 1]:
                continue
            after = at + np.searchsorted(root[at:end], root[at:end], "right")
            for i in range(at, end):
                rest = np.arange(after[i - at], end)
                rest = rest[_fits(size[rest], pos[rest], size[i], pos[i])]
                fit = rest[_allowed(size[rest], marks[rest], size[i], marks[i])]
                if len(fit):
                    us.append(np.full(len(fit), node[i]))
                    vs.append(node[fit])
                    held += len(fit)
                    if held >= PAIRS:
                        yield out(us, vs)
                        us, vs, held = [], [], 0
    if us:
        yield out(us, vs)


#: Pairs of one text that a task verifies against it.
PER_CENTRE = 2_000


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs (u, v), each given once in a table, that are similar, counted from their texts; as a table.

    The text of u is sent once for PER_CENTRE pairs, in front of the texts that are compared with it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held, own = 0, np.zeros(0, np.uint64)
        for b in each_batch(batches, 100):
            us, vs = [], []
            for u, v, text in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strings(b), strict=True):
                node = u if v is None else v
                if node not in sets:
                    if held > 2_000_000:
                        sets, held = {}, 0
                    sets[node] = shingle_set(text, width)
                    held += len(sets[node])
                if v is None:
                    own = sets[node]
                elif similar(own, sets[node]):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    if pairs.isEmpty():
        return pairs.select("u", "v").where(F.lit(False))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = stage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "candidates")
    own = join_small(texts, ends, ["node"], "left_semi", MOST_NODES).groupBy("node").agg(F.first("text").alias("text"))
    own = stage(own, "candidate-texts")
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PER_CENTRE).alias("parts"))
    part = F.pmod(F.xxhash64("v"), F.col("parts")).alias("part")
    others = pairs.join(parts, "u").select("u", part, "v").join(own.select(F.col("node").alias("v"), "text"), "v").select("u", "part", "v", "text")
    centres = parts.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(own.select(F.col("node").alias("u"), "text"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "text")
    dealt = others.unionByName(centres).repartition(n, "u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    good = stage(dealt.select("u", "v", "text").mapInArrow(run, "u long, v long"), "links")
    for used in (ends, own):
        release(used)
    return good


def bitmaps(texts: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, MARKS): the bitmap of each of the nodes, once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 500):
            marks = np.stack([bitmap(shingle_set(t, width)) for t in strings(b)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("node"), *map(pa.array, marks.T.copy())], ["node", *MARKS])

    own = join_small(texts.select("node", "text"), nodes.select("node").distinct(), ["node"], "left_semi", MOST_NODES)
    found = own.mapInArrow(run, "node long, " + ", ".join(f"{m} long" for m in MARKS))
    return found.groupBy("node").agg(*(F.first(m).alias(m) for m in MARKS))


def links(texts: DataFrame, width: int = WIDTH, known: DataFrame | None = None) -> DataFrame:
    """texts (node long, text), equal nodes having equal texts -> (u, v), u < v: similar pairs that connect all similar
    pairs. known (u, v): pairs that have been verified; what they connect is not tried again."""
    return connected(texts, width, known)[0]


def connected(texts: DataFrame, width: int = WIDTH, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The links, and their components (node, root) as a table. Components are made anew only when a round has found a pair,
    of the stars before it and what it found."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = _common(texts, width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 500):
            sets = [shingle_set(t, width) for t in strings(b)]
            keys = [prefix(s, common) if len(s) else np.zeros(1, np.uint64) for s in sets]  # texts without words are alike
            many = np.array([len(k) for k in keys], np.int64)
            node = np.repeat(b.column("node").to_numpy(zero_copy_only=False), many)
            size = np.repeat(np.array([max(1, len(s)) for s in sets], np.int32), many)
            pos = (np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node), pa.array(size), pa.array(pos)], ["key", "node", "size", "pos"])

    dealt: Callable[[DataFrame], DataFrame] = lambda df: df.repartition(n, "key")
    keys = texts.select("node", "text").mapInArrow(run, "key long, node long, size int, pos int")
    shared = stage(dealt(keys).sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, size int, pos int, least long, fits boolean"), "shared-shingles")
    tried = shared.where((F.col("node") > F.col("least")) & F.col("fits")).select(F.col("least").alias("u"), F.col("node").alias("v")).distinct()
    at = None
    if known is not None:
        at = stage(components(known), "components")
        placed = tried.join(at.select(F.col("node").alias("u"), F.col("root").alias("p")), "u", "left").join(at.select(F.col("node").alias("v"), F.col("root").alias("q")), "v", "left")
        tried = placed.where(~F.coalesce(F.col("p") == F.col("q"), F.lit(False))).select("u", "v")
    tried = stage(tried, "star-pairs")
    fresh = verified(tried, texts, width)
    found = fresh if known is None else fresh.unionAll(known.select("u", "v"))
    marked = stage(bitmaps(texts, shared, width), "bitmaps")
    rounds = [tried]
    for beside in (*BESIDE, None):
        at = _with(at, fresh)
        placed = shared.join(at, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "size", "pos").join(marked, "node").select("key", "node", "root", "size", "pos", *MARKS)
        if beside:
            rest = dealt(placed).sortWithinPartitions("key", "node").mapInArrow(_beside(beside), "u long, v long")
        else:
            rest = dealt(placed.select("key", "root", "node", "size", "pos", *MARKS)).sortWithinPartitions("key", "root").mapInArrow(_across, "u long, v long")
        done = reduce(DataFrame.unionAll, rounds)
        more = stage(rest.distinct().join(done, ["u", "v"], "left_anti"), "pairs-across" if beside is None else "pairs-beside")
        rounds.append(more)
        fresh = verified(more, texts, width)
        found = found.unionAll(fresh)
    at = _with(at, fresh)
    for used in (shared, marked, *rounds):
        release(used)
    return found, at


def _with(at: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The components `at` joined by the pairs `fresh`."""
    if at is None:
        return stage(components(fresh), "components")
    if fresh.isEmpty():
        return at
    stars = at.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    return stage(components(stars.unionAll(fresh.select("u", "v"))), "components")
