"""Helpers shared by the corpus operators: table access, shared-folder staging, word rules, bounded joins."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.joins import is_small

#: Word characters of every contract here: anything but the six ASCII white space characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: Rows of a table that may be broadcast: rows and bytes are checked before the hint is given.
BROADCAST_ROWS = 200_000

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a folder of our own only where it is unset and
    driver and executors are one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


_scratch: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stage() writes inside the block are deleted at its end, but for those it is told to keep."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.remove(folder)
        _delete(spark, folder)


def stage(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark) if keep or not _scratch else _scratch[-1]}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table that stage() wrote for df: nothing may read it any more, neither df nor what was made from it."""
    _delete(df.sparkSession, df._staged_at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; an empty array for none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


def join_small(left: DataFrame, right: DataFrame, keys: list[str] | Column, how: str = "left", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join on keys. right is broadcast only if it has at most `bound` rows and BROADCAST_BYTES bytes; beyond that Spark
    shuffles both sides and splits skewed partitions (adaptive skew join)."""
    return left.join(F.broadcast(right) if is_small(right, bound) else right, keys, how)


def least_by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, of the least hashes of key: a sample that does not depend on the order of rows. A threshold on the
    hash, from a count, leaves about four times n rows, so that what tasks send to be sorted doesn't grow with them."""
    total = rows.count()
    if total > 8 * n:
        rows = rows.where(F.xxhash64(key) < F.lit(-(1 << 63) + (1 << 64) * 4 * n // total))
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def each_batch(batches: Iterable[pa.RecordBatch], rows: int = 2000, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows and about `most` bytes of strings (one row at least), so that very long texts don't
    pile up in one Python call."""
    for b in batches:
        texts = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in b.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        ends = np.cumsum(sum(texts, np.zeros(b.num_rows, np.int64)))
        i = 0
        while i < b.num_rows:
            room = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right"))
            j = max(i + 1, min(i + rows, room, b.num_rows))
            yield b.slice(i, j - i)
            i = j


_held: dict[str, tuple] = {}


def let_go(operator: str) -> None:
    """Drops what other operators keep in this Python worker."""
    if any(s.split("/")[0] != operator for s in _held):
        _held.clear()


def kept_in_worker(slot: str, key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task (workers are reused): one thing a slot, made anew for another key.
    Slots are named operator/thing; when another operator starts, the things of the one before are let go."""
    let_go(slot.split("/")[0])
    if slot not in _held or _held[slot][0] != key:
        _held.pop(slot, None)
        _held[slot] = key, make()
    return _held[slot][1]


class WordTable(dict):
    """Distinct words of a worker, each with its value, in two generations of at most `cap` words: when the young one
    is full it becomes the old one, and words found in the old one move back. Memory stays bounded, common words stay.
    A word that is in neither is given to `learn`."""

    def __init__(self, learn: Callable[[str], bytes], cap: int = 500_000):
        super().__init__()
        self.learn, self.cap, self.old = learn, cap, {}

    def __missing__(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = self.learn(word)
        self[word] = value
        return value

    def make_room(self) -> None:
        """To be called now and then, between texts."""
        if len(self) > self.cap:
            self.old = dict(self)
            self.clear()
