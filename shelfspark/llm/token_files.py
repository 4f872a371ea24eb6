"""Token-ID output: canonical length-limited Huffman files in ascending id order, and their reader.

A file set is a folder: `segments` (Parquet rows written and committed by Spark's own writer, so any shared store will
do and a lost executor only repeats its tasks) and `codebook` (one row). A segment holds documents in ascending order:
their ids and token counts, their coded bits, and the bit offset of every block of 256 tokens, so that any block can be
decoded by itself. The codebook is made from the counts of all ids of the corpus; its size is that of the vocabulary.

Null texts are empty and hold the end id only. Rows of equal id are kept, ordered by their ids' bytes. A null document
id sorts first. Extra columns are dropped. An empty table gives a folder without segments.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, each_batch, shared_folder, stage
from .huffman import BLOCK, Codebook, code_lengths
from .tokens import encoded, public_path

FILE = "byte_bpe_50k.json"
#: Tokens of a segment, but for a longer last document.
SEGMENT = 1 << 18
#: Stands for a null document id.
NO_ID = -(1 << 63)
SEGMENTS = "part int, segment int, n_tokens long, doc_ids binary, doc_tokens binary, offsets binary, bits binary"


def token_ids(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", counted: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids binary): little-endian unsigned 16-bit ids with the end id behind them. If counted, with a
    column `counts`, null but for one further row a task (all else null) that says how often each id occurs in its rows."""
    end = np.array([end_id], "<u2").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids", *["counts"] * counted]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of_ids = np.zeros(1 << 16, np.int64), None
        for b, ids in encoded(batches, path):
            ids = [x + end for x in ids]
            columns, of_ids = [b.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], b.column(0).type
            if counted:
                for i in range(0, len(ids), 200):
                    total += np.bincount(np.frombuffer(b"".join(ids[i : i + 200]), "<u2"), minlength=1 << 16)
                columns.append(pa.nulls(len(ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)
        if counted and of_ids is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, of_ids), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", counts binary" * counted)


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows: counted in each task, summed by Spark; as long as the vocabulary. From the
    column `counts` where there is one, else from the ids."""
    counted = "counts" in ids.columns
    some = ids.where("counts is not null").select("counts") if counted else ids.select("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in each_batch(batches, 500):
            each = b.column(0).to_pylist()
            total += sum(np.frombuffer(x, np.int64) for x in each) if counted else np.bincount(np.frombuffer(b"".join(each), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in some.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    return counts


def _segments(lengths: bytes) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted documents of a partition -> coded segments. Bit offsets of a document move by what stands before it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(np.frombuffer(lengths, np.uint8))
        part, segment, held, tokens = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            sizes = np.array([r["n_tokens"] for r in held], "<i8")
            coded = book.encode(np.frombuffer(b"".join(r["ids"] for r in held), "<u2"), sizes)
            base = np.cumsum([0] + [len(bits) * 8 for bits, _ in coded])
            moved = [offsets.astype("<u8") + np.uint64(at) for (_, offsets), at in zip(coded, base, strict=False)]
            ids = np.array([NO_ID if r["doc_id"] is None else r["doc_id"] for r in held], "<i8")
            row = [part, segment, tokens, ids.tobytes(), sizes.tobytes(), np.concatenate(moved).tobytes(), b"".join(bits for bits, _ in coded)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in SEGMENTS.split(", ")])

        for b in batches:
            for i in range(0, b.num_rows, 500):
                for r in b.slice(i, 500).to_pylist():
                    held.append(r)
                    tokens += r["n_tokens"]
                    if tokens >= SEGMENT:
                        yield closed()
                        segment, held, tokens = segment + 1, [], 0
        if held:
            yield closed()

    return run


def write_token_files(ids: DataFrame, path: str) -> None:
    """ids (doc_id long, n_tokens, ids binary; counts, if token_ids counted) -> a file set at path. The ids are shuffled
    once, by ranges of doc_id, and coded behind that: Spark runs what stands before a range shuffle twice, as it samples it
    for the ranges."""
    spark = ids.sparkSession
    lengths = code_lengths(id_counts(ids)).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ids.where("n_tokens is not null").select("doc_id", "n_tokens", "ids").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    placed.mapInArrow(_segments(lengths), SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")


def read_token_files(spark: SparkSession, path: str, each: Callable[[np.ndarray], list] | None = None, columns: str = "ids array<int>") -> DataFrame:
    """(doc_id, start, n_tokens, columns): start is the number of ids before the document in the whole set. `each` turns a
    document's ids into the values of columns inside the worker (by default: the ids)."""
    lengths = bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"])
    segments = spark.read.parquet(f"{path}/segments")
    names = [x.split()[0] for x in columns.split(", ")]
    each = each or (lambda ids: [ids.astype(np.int32)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(np.frombuffer(lengths, np.uint8))
        for b in batches:
            for r in b.to_pylist():
                n = np.frombuffer(r["doc_tokens"], "<i8")
                blocks = -(-n // BLOCK)
                sizes = np.full(int(blocks.sum()), BLOCK, np.int64)
                sizes[np.cumsum(blocks) - 1] = n - (blocks - 1) * BLOCK
                ids = book.decode(r["bits"], np.frombuffer(r["offsets"], "<u8").astype(np.int64), sizes)
                ends = np.cumsum(n)
                values = [each(x) for x in np.split(ids, ends[:-1])]
                k = len(n)
                head = [pa.array(np.full(k, r["part"], np.int32)), pa.array(np.full(k, r["segment"], np.int32)), pa.array([None if x == NO_ID else x for x in np.frombuffer(r["doc_ids"], "<i8").tolist()], pa.int64()), pa.array(ends - n), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array([v[i] for v in values]) for i in range(len(names)))], ["part", "segment", "doc_id", "__in", "n_tokens", *names])

    docs = segments.mapInArrow(run, f"part int, segment int, doc_id long, __in long, n_tokens long, {columns}")
    # ids before each segment: within its part, then before its part; one row a segment, then one row a part
    rows = segments.select("part", "segment", "n_tokens")
    inside = rows.withColumn("__before", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = parts.withColumn("__parts", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = inside.join(before, "part").select("part", "segment", (F.col("__before") + F.col("__parts")).alias("__base"))
    return docs.join(base, ["part", "segment"]).select("doc_id", (F.col("__base") + F.col("__in")).alias("start"), "n_tokens", *names)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = stage(token_ids(documents(spark, sf_dir), public_path(FILE), 0, counted=True), "ids")
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(ids, path)
    return read_token_files(spark, path, lambda x: [zlib.crc32(x.astype("<u4").tobytes())], "ids_crc32 long")


QUERIES = {"op6_token_files": op6_token_files}
ORACLES: dict[str, str] = {}
