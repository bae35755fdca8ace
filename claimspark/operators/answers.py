"""A table of a service's answers: equal prompts are asked once, known ones not at all.

Every task writes its answers to the table as they come. A task that runs again, or a run that is started again under its
name, reads them and asks only the rest.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .enrich import STATUS, Row, caller
from .joins import hot_cold_lookup

# A prompt of more than one of HOT_SHARE rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 200
NO_PROMPT = "no prompt"


def digest(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def _table_type(added: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("digest", T.StringType()), *added.fields, *STATUS.fields])


def read_answers(spark: SparkSession, table: str, schema: T.StructType | str) -> DataFrame:
    """``digest``, the columns of ``schema``, ``ok, error, attempts, run``: one row for each prompt asked in a run."""
    added = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    stored = T.StructType([*_table_type(added).fields, T.StructField("run", T.StringType()), T.StructField("slot", T.IntegerType())])
    reader = spark.read.schema(stored).option("basePath", table)
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], stored).drop("slot")
    return reader.parquet(table).drop("slot")


def _file_system(table: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or uri as workers reach it; s3a is s3 to them."""
    return fs.FileSystem.from_uri(table.replace("s3a://", "s3://", 1) if "://" in table else table.removeprefix("file:"))


def _asked_before(system: fs.FileSystem, folder: str) -> set[str]:
    listed = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    files = [f.path for f in listed if f.base_name.startswith("answers-")]
    return {d for path in files for d in pq.read_table(path, columns=["digest"], filesystem=system, partitioning=None).column(0).to_pylist()}


def ask(
    prompts: DataFrame,
    make_fn: Callable[[], Callable[[str], Mapping[str, Any]]],
    schema: T.StructType | str,
    fallback: Mapping[str, Any],
    table: str,
    run: str,
    callers: int,
    every: int = 20,
    max_attempts: int = 3,
    backoff: float = 1.0,
    pause: float = 0.0,
    sleep: Callable[[float], None] = time.sleep,
) -> int:
    """Ask the prompts of ``digest, prompt`` that the table has no good answer to; returns how many were asked by now.

    At most ``callers`` tasks call, each with a ``pause`` between calls, so that all of them make at most ``callers / pause``
    calls a second. Answers are written in files of ``every``: a lost task asks at most so many prompts again, with 1 only one
    whose answer was on its way. Keep speculative execution off, as two copies of a task would both ask.
    A prompt that failed is not asked again in the same run, but in the next one.
    """
    spark = prompts.sparkSession
    added = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(_table_type(added))
    call = caller(added.fieldNames(), fallback, max_attempts, backoff, sleep)
    answers = read_answers(spark, table, added)
    settled = answers.where(F.col("ok") | (F.col("run") == run)).select("digest").distinct()
    unknown = prompts.join(settled, "digest", "left_anti").repartition(callers, "digest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(table)
        folder = f"{root}/run={run}/slot={TaskContext.get().partitionId()}"
        before = _asked_before(system, folder)
        fn, open_rows, asked = make_fn(), [], 0

        def save() -> None:
            if open_rows:
                system.create_dir(folder, recursive=True)
                name = uuid.uuid4().hex
                pq.write_table(pa.Table.from_pylist(open_rows, schema=arrow), f"{folder}/_{name}", filesystem=system)
                system.move(f"{folder}/_{name}", f"{folder}/answers-{name}.parquet")
                open_rows.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["digest"] in before:
                    continue
                if asked and pause:
                    sleep(pause)
                open_rows.append({"digest": row["digest"], **call(lambda r: fn(r["prompt"]), row)})
                asked += 1
                if len(open_rows) >= every:
                    save()
        save()
        yield pa.RecordBatch.from_pydict({"asked": [asked + len(before)]}, schema=pa.schema([("asked", pa.int64())]))

    counted = unknown.select("digest", "prompt").mapInArrow(work, "asked long")
    return counted.agg(F.sum("asked")).first()[0] or 0


def answered(
    df: DataFrame,
    prompt: str,
    key: str,
    make_fn: Callable[[], Callable[[str], Mapping[str, Any]]],
    schema: T.StructType | str,
    fallback: Mapping[str, Any],
    table: str,
    run: str,
    callers: int,
    keep: Callable[[DataFrame], DataFrame],
    **options: Any,
) -> DataFrame:
    """``df`` with the columns of ``schema`` and ``ok, error, attempts, run``, ``run`` being the one that gave the answer.

    ``options`` are those of :func:`ask`. Prompts are counted before the shuffle and stored once by ``keep``, such as
    ``session.written``; answers to hot ones are broadcast to their rows, the others joined. A row without a prompt gets the
    fallback. ``df`` must not have columns of the added names.
    """
    added = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    spark = df.sparkSession
    named = df.withColumn("_digest", digest(F.col(prompt)))
    given = named.where(F.col("_digest").isNotNull()).groupBy(F.col("_digest").alias("digest"))
    prompts = keep(given.agg(F.any_value(prompt).alias("prompt"), F.count(F.lit(1)).alias("n")))
    ask(prompts.select("digest", "prompt"), make_fn, added, fallback, table, run, callers, **options)

    fields = [*added.fieldNames(), *STATUS.fieldNames(), "run"]
    usable = read_answers(spark, table, added).where(F.col("ok") | (F.col("run") == run))
    best = usable.groupBy("digest").agg(F.max_by(F.struct(*fields), F.struct("ok", "run")).alias("_answer"))
    lookup = best.withColumnRenamed("digest", "_digest")
    total = prompts.agg(F.sum("n")).first()[0] or 0
    hot = lookup.join(prompts.where(F.col("n") * HOT_SHARE > total).select(F.col("digest").alias("_digest")), "_digest", "left_semi")
    # Rows without a prompt must not meet in one task.
    spread = named.withColumn("_digest", F.coalesce("_digest", F.concat(F.lit("\x00"), F.col(key).cast("string"))))
    joined = hot_cold_lookup(spread, lookup, "_digest", key, "_answer", hot)
    missing = {**{f.name: F.lit(fallback.get(f.name)).cast(f.dataType) for f in added.fields},
               "ok": F.lit(False), "error": F.lit(NO_PROMPT), "attempts": F.lit(0), "run": F.lit(None).cast("string")}
    none = F.struct(*(value.alias(name) for name, value in missing.items()))
    result = F.coalesce("_answer", none)
    return joined.withColumn("_answer", result).select(*df.columns, *(F.col("_answer")[f].alias(f) for f in fields))
