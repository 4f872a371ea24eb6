"""Packing of token sequences into windows by non-negative least squares over length combinations.

Every full window of a document is a sequence of its own. What is left of it (its tail, shorter than a window) is packed:
shallow combinations of two and three tail lengths that fill a window are enumerated, the repeat count of each is solved
by non-negative least squares against the histogram of tails, rounded and clipped to the histogram, and the residual
tails are packed greedily, longest first, one behind another, cut where a window ends. The last, part-filled window is
cut into sequences of powers of two, so nothing is padded.

The histogram (at most window - 1 numbers), the combinations and their counts are all that the driver holds. Ranks of
equal tails are counted in salted groups, so a length held by a third of all rows is split; places follow from ranks in
closed form. Null and empty texts hold the end id only; repeated rows and ids are rows of their own; extra columns are
dropped; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, join_small, stage
from .token_files import token_ids
from .tokens import public_path

FILE, END, WINDOW = "word_bpe_49k.json", 1, 2048
#: Combinations of three are made of this many of the commonest lengths and what fills the window.
COMMON = 64


def combinations(histogram: np.ndarray, window: int = WINDOW, common: int = COMMON) -> list[tuple[int, ...]]:
    """Lengths, longest first, that fill a window: all pairs, and triples of two common lengths and the rest."""
    held = np.flatnonzero(histogram)
    there = set(held.tolist())
    out = {(a, window - a) for a in there if a >= window - a and window - a in there}
    top = held[np.argsort(-histogram[held], kind="stable")][:common].tolist()
    for i, a in enumerate(top):
        out |= {tuple(sorted((a, b, window - a - b), reverse=True)) for b in top[i:] if window - a - b in there}
    return sorted(out)


def least_squares_counts(combos: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|^2 (A: how often a length occurs in a combination), by coordinate descent."""
    x = np.zeros(len(combos))
    gap = histogram.astype(float)
    columns = [(np.array(sorted(set(c))), np.array([c.count(v) for v in sorted(set(c))], float)) for c in combos]
    for _ in range(sweeps):
        most = 0.0
        for j, (at, n) in enumerate(columns):
            step = max(-x[j], float(n @ gap[at]) / float(n @ n))
            if step:
                x[j] += step
                gap[at] -= step * n
                most = max(most, abs(step))
        if most < 0.25:
            break
    return x


def whole_counts(x: np.ndarray, combos: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """Rounded counts that use no length more often than it occurs, best filled combinations first; what pairs are left
    over is used up at the end."""
    left = histogram.astype(np.int64).copy()
    out = np.zeros(len(combos), np.int64)
    for wanted in (np.rint(x).astype(np.int64), None):
        for j in np.argsort(-x, kind="stable"):
            c = combos[j]
            room = min(left[v] // c.count(v) for v in set(c))
            n = int(room if wanted is None else min(room, wanted[j]))
            if n:
                out[j] += n
                for v in c:
                    left[v] -= n
    return out


class Plan:
    """Where the tails of each length go, by their rank among equals: made from the histogram alone."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        combos = combinations(histogram, window)
        counts = whole_counts(least_squares_counts(combos, histogram), combos, histogram)
        self.window, self.histogram = window, histogram
        self.slots: dict[int, list[tuple[int, int, int]]] = {}  # length -> (ranks below which, first sequence, offset)
        used = np.zeros(len(histogram), np.int64)
        self.filled = 0
        for c, n in zip(combos, counts.tolist(), strict=True):
            if not n:
                continue
            at = 0
            for v in c:
                used[v] += n
                self.slots.setdefault(v, []).append((int(used[v]), self.filled, at))
                at += v
            self.filled += n
        rest = (histogram - used) * np.arange(len(histogram))
        self.used, self.base = used, np.zeros(len(histogram), np.int64)
        self.base[:] = rest[::-1].cumsum()[::-1] - rest  # residual tokens before a length: longest first
        self.total = int(rest.sum())
        full, last = divmod(self.total, window)
        bounds = [full * window]
        for bit in reversed(range(window.bit_length())):
            if last >> bit & 1:
                bounds.append(bounds[-1] + (1 << bit))
        self.bounds = bounds  # the starts of the short last sequences, and the end
        self.sequences = self.filled + full + len(bounds) - 1

    def rows(self) -> list[tuple]:
        return [(v, int(self.used[v]), int(self.base[v]), *([s[i] for s in self.slots.get(v, [])] for i in range(3))) for v in np.flatnonzero(self.histogram).tolist()]


def _tail_pieces(plan: Plan) -> Column:
    """Pieces of a tail from its rank and its length's slots."""
    w, end = plan.window, plan.bounds[0]
    slot = F.size(F.filter("below", lambda e: e <= F.col("rank")))
    before = F.when(slot == 0, F.lit(0)).otherwise(F.get("below", slot - 1))
    whole = F.array(F.struct(F.col("head").alias("start"), F.col("tail").alias("length"), (F.get("first", slot) + F.col("rank") - before).alias("sequence_id"), F.get("offset", slot).alias("offset")))
    g = F.col("base") + (F.col("rank") - F.col("used")) * F.col("tail")
    h = g + F.col("tail")
    next_window = (F.floor(g / F.lit(w)) + 1) * w
    short = F.array(*[F.lit(b).cast("long") for b in plan.bounds])
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(next_window.cast("long")), short)))
    cuts = F.filter(cuts, lambda c: (c > g) & (c < h) & ((c <= end) | F.array_contains(short, c)))
    starts, ends = F.concat(F.array(g), cuts), F.concat(cuts, F.array(h))
    of = lambda s: F.when(s < end, F.call_function("div", s, F.lit(w).cast("long"))).otherwise(F.lit(end // w).cast("long") + F.size(F.filter(short, lambda b: b <= s)) - 1)
    begin = lambda s: F.when(s < end, s - F.pmod(s, F.lit(w))).otherwise(F.array_max(F.filter(short, lambda b: b <= s)))
    cut = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.struct((F.col("head") + x["s"] - g).alias("start"), (x["e"] - x["s"]).alias("length"), (of(x["s"]) + plan.filled).alias("sequence_id"), (x["s"] - begin(x["s"])).alias("offset")))
    return F.when(F.col("tail") == 0, F.lit(None)).when(F.col("rank") < F.col("used"), whole).otherwise(cut)


def places(lengths: DataFrame, window: int = WINDOW) -> DataFrame:
    """lengths (uid unique, n tokens) -> (uid, pieces): array of (start, length, sequence_id, offset) of each row."""
    spark = lengths.sparkSession
    rows = lengths.select("uid", F.call_function("div", F.col("n"), F.lit(window).cast("long")).alias("windows"), F.pmod("n", F.lit(window)).cast("long").alias("tail"))
    histogram, total = np.zeros(window, np.int64), 0
    for r in rows.groupBy("tail").count().toLocalIterator():
        histogram[r["tail"]] = r["count"]
        total += r["count"]
    histogram[0] = 0
    plan = Plan(histogram, window)
    salts = min(4096, max(64, total // 50_000))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    group = rows.groupBy("tail", "salt").agg(F.count("*").alias("n"))
    running = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = group.select("tail", "salt", running("n", Window.partitionBy("tail").orderBy("salt")).alias("ranks_before"))
    full = rows.groupBy("salt").agg(F.sum("windows").alias("w")).select("salt", running("w", Window.orderBy("salt")).alias("windows_before"))
    table = spark.createDataFrame(plan.rows() or [(1, 0, 0, [], [], [])], "tail long, used long, base long, below array<long>, first array<long>, offset array<long>")
    joined = join_small(rows, ranks, ["tail", "salt"]).join(F.broadcast(full), "salt").join(F.broadcast(table), "tail", "left")
    ranked = joined.withColumn("rank", F.col("ranks_before") + F.row_number().over(Window.partitionBy("tail", "salt").orderBy("uid")) - 1)
    counted = ranked.withColumn("window_id", F.lit(plan.sequences) + F.col("windows_before") + running("windows", Window.partitionBy("salt").orderBy("uid"))).withColumn("head", F.col("windows") * window)
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1), lambda i: F.struct((i * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("window_id") + i).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    kind = "array<struct<start:long,length:long,sequence_id:long,offset:long>>"
    none = F.array().cast(kind)
    pieces = F.concat(F.when(F.col("windows") > 0, whole.cast(kind)).otherwise(none), F.coalesce(_tail_pieces(plan).cast(kind), none))
    return counted.select("uid", pieces.alias("pieces"))


def pack(ids: DataFrame, window: int = WINDOW, each: Callable[[np.ndarray], list] | None = None, columns: str = "ids array<int>") -> DataFrame:
    """ids (uid unique, doc_id, n_tokens, ids binary of unsigned 16 bits), kept in a table -> one row per piece: doc_id,
    start, length, doc_tokens, sequence_id, offset and columns (by default the piece's ids)."""
    each = each or (lambda x: [x.astype(np.int32)])
    names = [x.split()[0] for x in columns.split(", ")]
    placed = places(ids.select("uid", F.col("n_tokens").alias("n")), window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                rows, values, owner = [], [], []
                for k, (ids_, pieces) in enumerate(zip(part.column("ids").to_pylist(), part.column("pieces").to_pylist(), strict=True)):
                    tokens = np.frombuffer(ids_, "<u2")
                    for p in pieces:
                        rows.append((p["start"], p["length"], p["sequence_id"], p["offset"]))
                        values.append(each(tokens[p["start"] : p["start"] + p["length"]]))
                        owner.append(k)
                at = pa.array(owner, pa.int64())
                fields = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), pa.array(fields[:, 0]), pa.array(fields[:, 1]), part.column("n_tokens").take(at), pa.array(fields[:, 2]), pa.array(fields[:, 3]), *(pa.array([v[j] for v in values]) for j in range(len(names)))],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", *names],
                )

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.join(placed, "uid").select("doc_id", "n_tokens", "ids", "pieces").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, {columns}")


def packed_documents(docs: DataFrame, path: str, end_id: int = END, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with a checksum of their ids."""
    ids = stage(token_ids(docs, path, end_id).withColumn("uid", F.monotonically_increasing_id()), "ids")
    return pack(ids, window, lambda x: [zlib.crc32(x.astype("<u4").tobytes())], "ids_crc32 long").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), public_path(FILE))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
