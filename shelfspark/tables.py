"""Working tables of a job in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and driver and executors are one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


class Work:
    """A folder of tables that cut lineage and outlive executors. It is deleted at the end of its block; what the block
    returns is written by `result`, outside of it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Work:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        delete(self.spark, self.folder)

    def table(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """df written under a new name and read back; by: columns that become folders."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        return _written(df, path, by)

    def result(self, df: DataFrame) -> DataFrame:
        return _written(df, f"{self.folder}-result", None)


def _written(df: DataFrame, path: str, by: list[str] | None) -> DataFrame:
    df.write.partitionBy(*by or []).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
