"""Reading scraped listings and writing merged races."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline import fixed_values as V
from paceline.functions.parse import lookup
from paceline.functions.text import is_blank
from paceline.session import stage

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in V.RAW_FIELDS])
CORRUPT = "_corrupt"


def dataset_glob(root: str) -> str:
    """One path pattern over all dataset folders; a missing folder simply has no match."""
    return f"{root.rstrip('/')}/{{{','.join(V.SOURCE_DIRS)}}}/{V.DATASET_SUBDIR}"


def with_provenance(df: DataFrame) -> DataFrame:
    """Add ``source``, ``source_rank`` and ``file_name`` from the file a row came from."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), f"({'|'.join(V.SOURCE_DIRS)})/{V.DATASET_SUBDIR}", 1)
    ranks = {name: i for i, name in enumerate(V.SOURCE_DIRS)}
    return df.select(
        "*",
        lookup(V.SOURCE_DIRS, folder).alias("source"),
        lookup(ranks, folder).alias("source_rank"),
        F.col("_metadata.file_name").alias("file_name"),
    )


def read_listings(spark: SparkSession, root: str, multi_line: bool = True, names: str = "*.json") -> DataFrame:
    """Every file called ``names`` under the dataset folders, unreadable rows kept in ``_corrupt``.

    Files hold one object or array each, or, without ``multi_line``, an object a
    line.  ``position`` orders the rows of a file.
    """
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    df = (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("pathGlobFilter", names)
        .json(dataset_glob(root))
    )
    return with_provenance(df).withColumn("position", F.monotonically_increasing_id())


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and unreadable ones for quarantine.

    Both keep a data column: Spark refuses a read of the corrupt text alone.
    """
    bad = F.col(CORRUPT).isNotNull()
    return df.filter(~bad).drop(CORRUPT), df.filter(bad).select("source", "file_name", "title", CORRUPT)


def require_fields(df: DataFrame, *names: str) -> DataFrame:
    """Drop rows where a required text is missing or blank."""
    for name in names or ("title", "date"):
        df = df.filter(~is_blank(F.col(name)))
    return df


def union_sources(*batches: DataFrame) -> DataFrame:
    """Concatenate sources; the order lives in the ``ord`` column, not in row position."""
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch)
    return out


def with_order(df: DataFrame, *columns: str) -> DataFrame:
    """Number rows by a total order: a range-partitioned sort, then partition-wise ids."""
    columns = columns or tuple(c for c in ("source_rank", "file_name", "position") if c in df.columns)
    return df.orderBy(*columns).withColumn("ord", F.monotonically_increasing_id()).drop("position")


def load_sources(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """Readable, complete listings of all sources in load order, stored once so that every reader sees the same order."""
    good, _ = split_corrupt(read_listings(spark, root, multi_line))
    return stage(with_order(require_fields(good)), "listings")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, one file per partition."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
