"""Inputs of the operators: given tables, row ids, and rows kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure, written

ROW = "_row"
BATCH_BYTES = "8m"  # of an Arrow batch, so that long texts do not fill a worker


def prepared(spark: SparkSession) -> SparkSession:
    """Apply the settings of the library, and the size of Arrow batches."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written once with a row id, so that every branch that reads it sees the same ids."""
    return written(df.drop(ROW).withColumn(ROW, F.monotonically_increasing_id()))


def plain(df: DataFrame, *new: str) -> DataFrame:
    """``df`` without columns named like ``new`` ones, in any case, and without names that begin with an underscore."""
    gone = {n.lower() for n in new}
    return df.drop(*[c for c in df.columns if c.lower() in gone or (c.startswith("_") and c != ROW)])


def schema_with(df: DataFrame, **columns: T.DataType) -> T.StructType:
    """The schema of ``df`` with columns added at the end; those of the same name go."""
    gone = {n.lower() for n in columns}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    return T.StructType([*kept, *(T.StructField(n, t) for n, t in columns.items())])
