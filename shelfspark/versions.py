"""Versions of a job's results: a folder of tables, seen by readers only when its manifest is there.

A table may be bucketed by a key: jobs that join such tables on it, in this run or a later one, don't shuffle them again.
A job writes every table under `out/version=N` and its manifest, one row a table, last. Readers take the newest manifest, so a
job that dies half-way leaves the version before it as it was; the next run writes its number again. One writer at a time."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.tables import delete

_MANIFEST = "version long, name string, format string, path string"


def _manifests(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{out}/manifest").select("version", "name", "format", "path")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], _MANIFEST)


def _named(path: str) -> str:
    return "version_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _opened(spark: SparkSession, path: str, format: str) -> DataFrame:
    rows = spark.read.parquet(path)
    if format == "parquet":
        return rows
    _, n, key = format.split()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_named(path)} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(_named(path))


def newest(spark: SparkSession, out: str) -> int | None:
    """The number of the newest version."""
    return _manifests(spark, out).agg(F.max("version")).first()[0]


class Version:
    """The version that a job is writing."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out
        self.number = (newest(spark, out) or 0) + 1
        self.folder = f"{out}/version={self.number}"
        self.tables: dict[str, tuple[str, DataFrame]] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df as Parquet, read back."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.add(name, "parquet", self.spark.read.schema(df.schema).parquet(path))

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """df as Parquet in buckets by key, as many as there are shuffle partitions, read back."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{self.folder}/{name}"
        delete(self.spark, path)  # what a run that died has left
        rows = df.repartition(n, key).sortWithinPartitions(key)
        self.spark.sql(f"DROP TABLE IF EXISTS {_named(path)}")
        rows.write.bucketBy(n, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(_named(path))
        return self.add(name, f"bucketed {n} {key}", self.spark.table(_named(path)))

    def add(self, name: str, format: str, df: DataFrame) -> DataFrame:
        """A table that is written under folder/name already."""
        self.tables[name] = format, df
        return df

    def commit(self) -> dict[str, DataFrame]:
        rows = [(self.number, name, kind, f"version={self.number}/{name}") for name, (kind, _) in self.tables.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.out}/manifest")
        return {name: df for name, (_, df) in self.tables.items()}


def latest(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The Parquet tables of the newest version, bucketed ones as such."""
    number = newest(spark, out)
    rows = _manifests(spark, out).where(F.col("version") == number).collect() if number else []  # a row a table of one version
    return {r["name"]: _opened(spark, f"{out}/{r['path']}", r["format"]) for r in rows if r["format"].split()[0] in ("parquet", "bucketed")}
