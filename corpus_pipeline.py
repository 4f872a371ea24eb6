"""Corpus pipeline: toxic and poor documents go, one document of each near-duplicate group stays, the rest is packed.

Every stage takes (spark, docs, sf_dir), docs being the Parquet result of the stage before, and returns a DataFrame;
all but the last return the columns of `documents`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import packing, quality_classifier, simhash, toxicity
from shelfspark.llm.common import documents, release, scratch, stage, table
from shelfspark.llm.tokens import public_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lexicon and curve from all labelled rows; documents that reach the threshold go. A null or empty text has no hit and
    stays; repeated rows fare alike; without labels no row goes; extra columns stay; an empty table stays empty."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of good quality is below one half go; one on the line stays. A null text is
    empty, a null source or language is a site of its own; repeated rows count and fare as rows; extra columns stay; an
    empty table stays empty."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word similarity of 0.8 or more the document of the least doc_id stays; null ids
    come last, ties go by a hash of the text, and of rows equal in both one stays. Texts without words, null ones too, are
    one group; extra columns stay; an empty table stays empty."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of sequences of 2,048 tokens. A null text is its end id; repeated rows and ids are packed as
    rows of their own; extra columns go; an empty table gives no pieces."""
    return packing.packed_documents(docs, public_path(packing.FILE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]
#: The learned stages and the packing are not SQL; run() is tested stage by stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. A stage's working tables go when its result is written, and that goes when the next is;
    those of the last stage stay, as its rows are read by the caller."""
    docs = documents(spark, sf_dir)
    for i, (name, step) in enumerate(STAGES[:-1]):
        with scratch(spark):
            done = stage(step(spark, docs, sf_dir), name, keep=True)
        if i:
            release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
