"""A corpus-wide table of distinct chunks: each is segmented once, and its ids are joined back to the texts by position.

Three passes: tasks count their distinct chunks and Spark adds the counts up (texts are not shuffled, chunks are); the
chunks found twice or more are segmented, once each, and become a table; texts are encoded from that table. A chunk that
the corpus holds once is in no table: the one task that meets it segments it, once as well.

The table that all workers get holds the MOST_WORDS commonest chunks at most (about 20 bytes each), so its size does not
grow with the corpus. If the corpus has more repeated chunks than that the table is not `complete`; callers that promise
one segmentation a chunk then join the other chunks from Spark (see sentencepiece_table).
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_batch, kept_in_worker, stage, strings

#: Bound of the table that is broadcast, in chunks.
MOST_WORDS = 3_000_000
#: Distinct chunks that a task counts before it hands its counts on.
HELD = 300_000
#: Chunks whose ids a worker keeps at hand.
AT_HAND = 400_000


def _digests(keys: list[str]) -> np.ndarray:
    """Two columns of 64 bits for each key."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


class Table:
    """Keys by their hashes (64 bits in order, 32 more to check), each with its ids."""

    def __init__(self, first: np.ndarray, check: np.ndarray, sizes: np.ndarray, ids: bytes):
        """Rows in any order; ids has the ids of all rows, sizes their bytes."""
        order = np.argsort(first, kind="stable")
        self.first, self.check, self.ids = first[order], check[order], ids
        self.end = np.cumsum(sizes, dtype=np.int64)[order]
        self.size = sizes[order].astype(np.int32)

    @staticmethod
    def empty() -> Table:
        return Table(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), b"")

    def find(self, keys: list[str]) -> list[bytes | None]:
        if not len(self.first) or not keys:
            return [None] * len(keys)
        digest = _digests(keys)
        at = np.minimum(np.searchsorted(self.first, digest[:, 0]), len(self.first) - 1)
        hit = (self.first[at] == digest[:, 0]) & (self.check[at] == digest[:, 1].astype(np.uint32))
        end, start, ids = self.end[at], self.end[at] - self.size[at], self.ids
        return [ids[a:b] if h else None for h, a, b in zip(hit.tolist(), start.tolist(), end.tolist(), strict=True)]


class Encoder:
    """Texts -> ids, from a table and a segmenter with `split` (text -> keys) and `key` (key -> bytes of its ids)."""

    def __init__(self, segmenter, table: Table, at_hand: int = AT_HAND):
        self.segmenter, self.table, self.most, self.known = segmenter, table, at_hand, {}

    def encode(self, texts: list[str], more: list[dict[str, bytes]] | None = None) -> list[bytes]:
        """Keys outside the table are segmented here; `more` has a text's own keys with their ids already."""
        parts = list(map(self.segmenter.split, texts))
        every = set().union(*parts)
        lack = every.difference(self.known)
        if len(self.known) + len(lack) > self.most:
            self.known, lack = {}, every
        keys = list(lack)
        once = []
        given = {k: v for m in more or () for k, v in m.items()}
        for k, v in zip(keys, self.table.find(keys), strict=True):
            if v is None:
                once.append(k)
                v = given[k] if k in given else self.segmenter.key(k)
            self.known[k] = v
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for k in once:
            del self.known[k]
        return out

    def lacking(self, texts: list[str]) -> list[set[str]]:
        """Of each text the distinct keys that the table does not hold."""
        sets = [set(self.segmenter.split(t)) for t in texts]
        keys = list(set().union(*sets))
        none = {k for k, v in zip(keys, self.table.find(keys), strict=True) if v is None}
        return [s & none for s in sets]


@dataclass
class Chunks:
    """What tasks need to encode: the kind of segmenter and its file, the broadcast table, a name for both."""

    kind: Callable
    path: str
    table: Broadcast
    name: str
    complete: bool
    #: (key, n, class): repeated chunks that the table leaves out.
    others: DataFrame | None

    @property
    def for_tasks(self) -> tuple:
        """Arguments of encoder()."""
        return self.kind, self.path, self.table, self.name


def segmenter(kind: Callable, path: str):
    return kept_in_worker("chunks/segmenter", (kind.__name__, path), lambda: kind(path))


def encoder(kind: Callable, path: str, table: Broadcast, name: str) -> Encoder:
    return kept_in_worker("chunks/encoder", name, lambda: Encoder(segmenter(kind, path), table.value))


def counts(docs: DataFrame, kind: Callable, path: str, text_col: str = "text") -> DataFrame:
    """(key, n) of the chunks that the corpus holds twice or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = segmenter(kind, path).split, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["key", "n"])

        for b in each_batch(batches, 500):
            for t in strings(b):
                found.update(split(t))
            if len(found) > HELD:
                yield out()
                found.clear()
        yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 2")


def segmented(words: DataFrame, kind: Callable, path: str) -> DataFrame:
    """words (key) -> (key, first, check, ids): each row is segmented."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = segmenter(kind, path)
        for b in each_batch(batches, 5000):
            keys = b.column("key").to_pylist()
            digest = _digests(keys)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].astype(np.uint32).view(np.int32)), pa.array(list(map(one.key, keys)), pa.binary())],
                ["key", "first", "check", "ids"],
            )

    return words.select("key").mapInArrow(run, "key string, first long, check int, ids binary")


def _class(n: Column) -> Column:
    """Eight classes for each doubling of the count: some hundreds for any corpus."""
    return F.floor(F.log2(n) * 8).cast("int")


def build(docs: DataFrame, kind: Callable, path: str, text_col: str = "text", most: int = MOST_WORDS) -> Chunks:
    words = stage(counts(docs, kind, path, text_col).withColumn("class", _class(F.col("n"))), "chunks")
    held, least, complete = 0, 1 << 30, True
    for r in words.groupBy("class").count().orderBy(F.desc("class")).collect():
        if held + r["count"] > most:
            complete = False
            break
        held, least = held + r["count"], r["class"]
    got = segmented(words.where(F.col("class") >= least), kind, path).select("first", "check", "ids").toArrow()
    ids = got.column("ids").combine_chunks()
    ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    flat = bytes(ids.buffers()[2])[ends[0] : ends[-1]] if len(ids) else b""
    table = Table(got.column("first").to_numpy().view(np.uint64), got.column("check").to_numpy().view(np.uint32), np.diff(ends), flat)
    return Chunks(kind, path, docs.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex, complete, None if complete else words.where(F.col("class") < least))
