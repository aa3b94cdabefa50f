"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` and, where SQL can say it, its SQL twin."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Staged:
    """Tables written once to the folder all executors share, so that a lost executor loses nothing.

    ``put`` writes and rereads a table; ``drop`` deletes those that no later
    step reads.  What the final result still reads stays until the session's
    owner empties the folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Let Spark delete the shuffle files of finished steps now; it does so when the driver's garbage is collected."""
        for _ in range(2):  # what the first round frees holds references itself
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keeping(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def no_nul(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
