"""Stage files and exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import STAGES

_NESTED = (T.ArrayType, T.StructType, T.MapType)


def _stamp(run_ts: datetime) -> str:
    return run_ts.strftime("%Y%m%d_%H%M%S")


def write_stage(df: DataFrame, base: str, stage: str, run_ts: datetime) -> str:
    """One folder of JSON lines per stage and run; null fields are kept."""
    path = f"{base}/{stage}/run={_stamp(run_ts)}"
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def read_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    return spark.read.schema(STAGES[stage]).json(path)


def export_json(df: DataFrame, base: str, run_ts: datetime) -> str:
    path = f"{base}/analysis_{_stamp(run_ts)}.json"
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def csv_rows(df: DataFrame) -> DataFrame:
    """Columns in order, lists and structs as JSON text."""
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, _NESTED) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def export_csv(df: DataFrame, base: str, run_ts: datetime) -> str:
    path = f"{base}/analysis_{_stamp(run_ts)}.csv"
    csv_rows(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path
