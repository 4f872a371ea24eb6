"""Answers of models by cache key, kept from run to run.

Runs append their answers; of one key the answer of the latest run counts. The table is bucketed by key, so a lookup deals
out the requests to the buckets and reads the answers where they lie: no exchange of the store, however large it is.
`compact` writes the latest answers as a new version (see versions) and readers go over to it; the version before stays for
those that still read it. One writer at a time."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.tables import delete
from shelfspark.versions import Version, newest

BUCKETS = 64


class AnswerStore:
    """A store at a path of the shared folders. Null keys are not kept."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        if newest(spark, path) is None:
            self._commit(Version(spark, path))

    @property
    def _table(self) -> str:
        return self._named(f"{self.path}/version={newest(self.spark, self.path)}")

    def _named(self, folder: str) -> str:
        name = "answers_" + hashlib.sha256(folder.encode()).hexdigest()[:24]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (cache_key STRING, answer STRING, run BIGINT) USING parquet CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {self.buckets} BUCKETS LOCATION '{folder}/answers'")
        return name

    def _commit(self, version: Version, rows: DataFrame | None = None) -> None:
        name = self._named(version.folder)
        if rows is not None:
            self._insert(rows, name)
        version.add("answers", f"bucketed {self.buckets} cache_key", self.spark.table(name))
        version.commit()

    def _insert(self, rows: DataFrame, name: str) -> None:
        rows.select("cache_key", "answer", "run").repartition(self.buckets, "cache_key").sortWithinPartitions("cache_key").write.insertInto(name)

    def record(self, answers: DataFrame) -> int:
        """answers (cache_key, answer) of one run, the largest if a key has several -> the run's number."""
        name = self._table
        run = (self.spark.table(name).agg(F.max("run")).first()[0] or 0) + 1
        once = answers.where("cache_key is not null").groupBy("cache_key").agg(F.max(F.col("answer").cast("string")).alias("answer"))
        self._insert(once.withColumn("run", F.lit(run).cast("long")), name)
        return run

    def latest(self) -> DataFrame:
        """(cache_key, answer): one row a key."""
        return self.spark.table(self._table).groupBy("cache_key").agg(F.max_by("answer", "run").alias("answer"))

    def compact(self) -> None:
        rows = self.spark.table(self._table).groupBy("cache_key").agg(F.max_by("answer", "run").alias("answer"), F.max("run").alias("run"))
        version = Version(self.spark, self.path)
        self._commit(version, rows)
        delete(self.spark, f"{self.path}/version={version.number - 2}")

    def close(self) -> None:
        """Forgets the table's name in this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table}")
