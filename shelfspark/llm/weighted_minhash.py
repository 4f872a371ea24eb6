"""Document fingerprints by consistent weighted sampling (Ioffe's gamma-based samples).

Terms are words (A-Z lower-cased), weights their counts. For each of K samples a term of weight S draws, from hashes of
the term and the sample alone, r and c of Gamma(2, 1) and b of U(0, 1) (each by 16 bits of a hash); with t = floor(ln S / r + b) and
ln a = ln c - r (t - b) - r the term of least a is kept together with t. Two texts keep the same pair with a chance equal
to the generalised Jaccard similarity of their weights (sum of minima over sum of maxima).

A fingerprint is K values of 16 bits in hex; likeness is the share of equal values. A text without words has the
fingerprint of zeros (likeness 1 to another such text, else 0). Null texts are empty. Texts that are equal have equal
fingerprints. Documents follow one another by doc_id (nulls first), then text; extra columns are dropped.

The draws of a (term, count) pair don't depend on the document, so each worker keeps a bounded table of them. A drawn pair
is one number, ln a above its value, so that the sample of any set of pairs is a least number whatever their order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, each_batch, kept_in_worker, strings

K = 128
#: Pairs of term and count kept in a worker's table (K * 8 bytes each).
ROWS = 60_000
SEED = 10
#: Pairs drawn at a time, so that what is being worked on stays in the processor's cache.
_AT_ONCE = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """MurmurHash3's 32-bit finaliser, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        x ^= x >> np.uint32(shift)
        if factor:
            x *= np.uint32(factor)
    return x


def _gamma() -> np.ndarray:
    """Gamma(2, 1) at the middles of 2**16 equal shares of its probability, by bisection."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(50):
        x = (low + high) / 2
        above = 1 - np.exp(-x) * (1 + x) > p
        low, high = np.where(above, low, x), np.where(above, x, high)
    return x


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z only; ASCII white space only


_NONE = ~np.uint64(0)


def _values(least: np.ndarray) -> np.ndarray:
    """The kept values of a signature; zeros for a text without words."""
    return np.where(least == _NONE, np.uint16(0), least.astype(np.uint16))


class Samples:
    """ln a and the kept value of each (term, count) pair seen, for all K samples, as one number: bits 16 and up order
    like ln a, bits 0 to 15 are the value."""

    def __init__(self, k: int = K, rows: int = ROWS):
        self.k, self.rows = k, rows
        self.salt = np.random.default_rng(SEED).integers(0, 1 << 32, (2, k), np.uint64).astype(np.uint32)
        gamma = _gamma()
        self.gamma, self.log_gamma = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.at: dict[bytes | tuple[bytes, int], int] = {}  # a term that occurs once is its own key
        self.drawn, self.again = np.zeros((rows, k), np.uint64), np.zeros(rows, bool)

    def draw(self, terms: list[tuple[bytes, int]], out: np.ndarray) -> None:
        import xxhash

        every = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, SEED) for w, _ in terms]), "<u4").reshape(-1, 4)
        log_s = np.log(np.array([c for _, c in terms], np.float32))[:, None]
        for i in range(0, len(terms), _AT_ONCE):
            h, s = every[i : i + _AT_ONCE], log_s[i : i + _AT_ONCE]
            x, y = (_mix(h[:, j, None] ^ self.salt[j]) for j in range(2))
            r = self.gamma.take(x >> np.uint32(16), mode="clip")
            b = (y & np.uint32(0xFFFF)).astype(np.float32)
            b += np.float32(0.5)
            b *= np.float32(2.0**-16)
            t = s / r
            t += b
            np.floor(t, out=t)
            b -= t
            b -= np.float32(1)
            b *= r
            y >>= np.uint32(16)
            b += self.log_gamma.take(y, mode="clip")  # ln a
            order = b.view(np.uint32)
            order ^= (b.view(np.int32) >> np.int32(31)).view(np.uint32) | np.uint32(1 << 31)  # orders like the number
            x += t.astype(np.int32).view(np.uint32) * np.uint32(40503)
            x &= np.uint32(0xFFFF)  # the value
            part = out[i : i + _AT_ONCE]
            part[:] = order
            part <<= np.uint64(16)
            part |= x

    def signature(self, text: str) -> np.ndarray:
        return _values(self.least(Counter(_words(text)).items()))

    def edited(self, text: str, kept: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
        """The signatures of text and of its first `kept` characters with tail behind them. Terms whose count is the same
        in both are looked up once."""
        start = kept
        while start and text[start - 1] not in SPACES:
            start -= 1
        whole, old, new = Counter(_words(text)), Counter(_words(text[start:])), Counter(_words(text[start:kept] + tail))
        moved = {w: new[w] - old[w] for w in {*old, *new} if old[w] != new[w]}
        same = self.least([x for x in whole.items() if x[0] not in moved])
        before = self.least([(w, whole[w]) for w in moved if w in whole])
        after = self.least([(w, n) for w, d in moved.items() if (n := whole[w] + d)], remember=False)
        return _values(np.minimum(same, before)), _values(np.minimum(same, after))

    def least(self, pairs: Iterable[tuple[bytes, int]], remember: bool = True) -> np.ndarray:
        """For each sample the least number of all pairs (all bits set for none). remember: that a pair has been met again
        keeps it in the table."""
        keys = [w if n == 1 else (w, n) for w, n in pairs]
        best = np.full(self.k, _NONE)
        for i in range(0, len(keys), self.rows // 4):  # a text of very many terms goes through in parts
            at = self.rows_of(keys[i : i + self.rows // 4], remember)
            for k in range(0, len(at), 512):
                np.minimum(best, self.drawn.take(at[k : k + 512], axis=0).min(axis=0), out=best)
        return best

    def rows_of(self, keys: list, remember: bool = True) -> np.ndarray:
        get = self.at.get
        at = np.array([get(k, -1) for k in keys], np.int32)
        lack = np.flatnonzero(at < 0)
        if remember:
            self.again[at[at >= 0]] = True
        if len(lack):
            if len(self.at) + len(lack) > self.rows:
                self.make_room()
                return self.rows_of(keys, remember)
            n, new = len(self.at), [keys[i] for i in lack.tolist()]
            self.draw([k if isinstance(k, tuple) else (k, 1) for k in new], self.drawn[n : n + len(new)])
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
            at[lack] = np.arange(n, n + len(new))
        return at

    def make_room(self) -> None:
        """Keeps the pairs that were met again since they came or since the last time, if they fill half the table at most."""
        kept = np.flatnonzero(self.again[: len(self.at)])
        kept = kept if 2 * len(kept) <= self.rows else kept[:0]
        keys = list(self.at)  # in the order of their rows
        self.at = {keys[i]: k for k, i in enumerate(kept.tolist())}
        self.drawn[: len(kept)] = self.drawn[kept]
        self.again[:] = False


def samples() -> Samples:
    return kept_in_worker("fingerprints/samples", None, Samples)


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 500):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_hex(samples().signature(t)) for t in strings(b)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprint columns."""
    at = F.sequence(F.lit(0), F.lit(K - 1))
    equal = F.filter(at, lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)))
    return F.size(equal) / F.lit(float(K))


def _bucket(x: Column, bounds: list[int], low: int, high: int) -> Column:
    """Number of the last bound that is not above x, by binary search; 0 below all of them (and for null)."""
    if high - low <= 1:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(x >= F.lit(bounds[mid]), _bucket(x, bounds, mid, high)).otherwise(_bucket(x, bounds, low, mid))


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, ghost, doc_id, text) -> a row for each document that isn't a ghost. A ghost is the next
    bucket's first document; the first ghost of a bucket ends it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    table, out = samples(), []
    waits: tuple | None = None  # (bucket, doc_id, text): a document whose successor is not there yet
    held: list | None = None  # the row before it, with its signature in front, which lacks the likeness to it

    def close(own: np.ndarray) -> None:
        out.append((*held[1:], float((held[0] == own).mean())))

    for b in each_batch(batches, 200):
        for bucket, ghost, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            if waits and waits[0] == bucket:
                n = len(waits[2])
                cut = n // 4
                own, other = table.edited(waits[2], n - cut, text[:cut])
                if held:
                    close(own)
                edited = waits[2][: n - cut] + text[:cut]
                held = [own, waits[1], n, hashlib.sha256(edited.encode()).hexdigest(), to_hex(own), to_hex(other), float((own == other).mean())]
                if ghost:
                    close(table.signature(text))
            if ghost:
                waits = held = None
            else:
                waits = bucket, doc_id, text
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)
        out.clear()


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness to each other and to the next document's. Ids are
    integers (others are refused).

    Texts are shuffled once. Bounds of buckets are document ids (quantiles); a bucket's first document also goes, as a
    ghost, to the bucket before it (the very first to the last bucket), so every document meets its successor."""
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer column")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = min(2048, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = rows.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n)).alias("bounds"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted({found["least"], *(found["bounds"] or [])} - {None})
    id_ = F.col("doc_id")
    own = _bucket(id_, bounds, 0, max(1, len(bounds)))
    last = max(1, len(bounds)) - 1
    before = F.when(own == 0, F.lit(last)).otherwise(own - 1)
    starts = F.expr("doc_id is null") if found["nulls"] else id_ == F.lit(bounds[0] if bounds else None)
    first = starts | id_.isin(bounds[1:]) if len(bounds) > 1 else starts
    places = F.when(first, F.array(F.struct(own.alias("b"), F.lit(False).alias("g")), F.struct(before.alias("b"), F.lit(True).alias("g")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("g"))))
    dealt = rows.select(F.explode(places).alias("p"), "doc_id", "text").select(F.col("p.b").alias("bucket"), F.col("p.g").alias("ghost"), "doc_id", "text")
    ordered = dealt.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "ghost", "doc_id", "text")
    return ordered.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir))


QUERIES = {"op10_fingerprints": op10_fingerprints}
ORACLES: dict[str, str] = {}
