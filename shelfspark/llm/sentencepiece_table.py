"""SentencePiece encoding and decoding with a table of distinct marked chunks.

No piece of the model has a white space marker behind another character, so no merge reaches over the place before a
marker: each distinct chunk (markers, then other characters) of the corpus is segmented once by the library and the ids
of a text are those of its chunks, joined back by position. Commonest chunks come from a broadcast table of bounded size
(see chunk_table). Where the corpus has more repeated chunks than that holds, the others are segmented in a table of
their own, joined to the documents that lack them by (document, chunk), and only then are texts shuffled.

A model with pieces that cross markers is refused. Null texts are empty; an empty text has the begin and end ids only;
repeated rows give repeated results; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_table
from .common import documents, each_batch, stage, strings
from .tokens import public_path

MODEL = "piece_bpe_32k.model"


class PieceTable:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size())):
            raise ValueError("the model has pieces that cross white space markers")
        self.begin, self.end, self.blank = self.model.bos_id(), self.model.eos_id(), self.model.piece_to_id("▁")

    @staticmethod
    def split(text: str) -> list[str]:
        """Keys: a word after one marker stands for itself; chunks of more markers, or of none but markers, keep them."""
        if not text:
            return []
        if "▁" in text:
            text = text.replace("▁", " ")
        parts = text.split(" ")
        if "" not in parts:
            return parts
        return [c[1:] if len(c) > 1 and c[1] != " " else c for c in re.findall(" +[^ ]*", " " + text)]

    def key(self, key: str) -> bytes:
        """Ids of one marked chunk; the library puts one marker before what it is given."""
        if key == " ":
            return np.array([self.blank], "<u2").tobytes()
        return array("H", self.model.encode(key[1:] if key[0] == " " else key)).tobytes()

    def whole(self, ids: bytes) -> np.ndarray:
        """With the begin and end ids."""
        return np.concatenate([[self.begin], np.frombuffer(ids, "<u2"), [self.end]]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


def _encoded(docs: DataFrame, path: str, each: Callable[[PieceTable, list[np.ndarray]], list[pa.Array]], columns: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, columns): each makes the columns of a batch from its ids, inside the worker."""
    chunks = chunk_table.build(docs, PieceTable, path, text_col, most)
    tasks, kind = chunks.for_tasks, docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 200):
            one = chunk_table.encoder(*tasks)
            more = [dict(zip(k or (), v or (), strict=True)) for k, v in zip(b.column("__keys").to_pylist(), b.column("__ids").to_pylist(), strict=True)] if b.num_columns > 2 else None
            ids = [one.segmenter.whole(x) for x in one.encode(strings(b, text_col), more)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *each(one.segmenter, ids)], names)

    rows = docs.select(id_col, text_col)
    if chunks.complete:
        return rows.mapInArrow(run, f"`{id_col}` {kind}, {columns}")

    def lacking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 200):
            sets = chunk_table.encoder(*tasks).lacking(strings(b, text_col))
            at = pa.array([i for i, s in enumerate(sets) for _ in s], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("__row").take(at), pa.array([k for s in sets for k in s], pa.string())], ["__row", "key"])

    rows = stage(rows.withColumn("__row", F.monotonically_increasing_id()), "texts")
    rest = stage(chunk_table.segmented(chunks.others, PieceTable, path).select("key", "ids"), "other-chunks")
    found = rows.select("__row", text_col).mapInArrow(lacking, "__row long, key string").join(rest, "key")
    own = found.groupBy("__row").agg(F.collect_list(F.struct("key", "ids")).alias("x")).select("__row", F.col("x.key").alias("__keys"), F.col("x.ids").alias("__ids"))
    return rows.join(own, "__row", "left").select(id_col, text_col, "__keys", "__ids").mapInArrow(run, f"`{id_col}` {kind}, {columns}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = chunk_table.MOST_WORDS) -> DataFrame:
    """(id, ids array<int>) with begin and end ids."""

    def each(_: PieceTable, ids: list[np.ndarray]) -> list[pa.Array]:
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))]

    return _encoded(docs, path, each, "ids array<int>", id_col, text_col, most)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) by the library's decode of each row's ids; null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 200):
            texts = [chunk_table.segmenter(PieceTable, path).model.decode(x or []) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = chunk_table.MOST_WORDS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode of each whole text, ids never leaving the worker."""

    def each(one: PieceTable, ids: list[np.ndarray]) -> list[pa.Array]:
        of_ids = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
        of_text = [hashlib.sha256(one.decode(x).encode()).hexdigest() for x in ids]
        return [pa.array(list(map(len, ids)), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    return _encoded(docs, path, each, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col, most)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(documents(spark, sf_dir), public_path(MODEL))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
