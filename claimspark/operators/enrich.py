"""Per-row calls to a model or service, with retry, fallback and pacing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Row = dict[str, Any]
STATUS = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)


def caller(
    names: list[str], fallback: Mapping[str, Any], max_attempts: int, backoff: float, sleep: Callable[[float], None]
) -> Callable[[Callable[[Row], Mapping[str, Any]], Row], Row]:
    """A function that calls another on a row, again after an error, and gives its values or the fallback with a status."""

    def call(fn: Callable[[Row], Mapping[str, Any]], row: Row) -> Row:
        error = None
        for attempt in range(max_attempts):
            if attempt:
                sleep(backoff * 2 ** (attempt - 1))
            try:
                values = fn(row)
                return {**{n: values.get(n) for n in names}, "ok": True, "error": None, "attempts": attempt + 1}
            except Exception as e:  # a failing row must not fail the task
                error = f"{type(e).__name__}: {e}"
        return {**{n: fallback.get(n) for n in names}, "ok": False, "error": error, "attempts": max_attempts}

    return call


def enrich(
    df: DataFrame,
    make_fn: Callable[[], Callable[[Row], Mapping[str, Any]]],
    schema: T.StructType | str,
    fallback: Mapping[str, Any],
    max_attempts: int = 3,
    backoff: float = 1.0,
    pause: float = 0.0,
    callers: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Adds the columns of ``schema`` and ``ok, error, attempts``.

    ``make_fn`` runs once per task and returns the function that is called per row: one client
    per task. Between attempts the task waits ``backoff`` seconds, doubled each time (1, 2, ...), between
    rows ``pause``. After the last attempt the row gets ``fallback``; other rows go on.
    ``callers`` bounds the tasks that call at the same time.

    Spark may run a task again, so calls can repeat: keep the function idempotent and write the
    result once (``session.checkpointed`` or a table) before using it in several actions.
    """
    added = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    source = df if callers is None else df.repartition(callers)
    output = T.StructType([*df.schema.fields, *added.fields, *STATUS.fields])
    arrow_added = to_arrow_schema(T.StructType([*added.fields, *STATUS.fields]))
    call = caller(added.fieldNames(), fallback, max_attempts, backoff, sleep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make_fn()
        first = True
        for batch in batches:
            results = []
            for row in batch.to_pylist():
                if pause and not first:
                    sleep(pause)
                first = False
                results.append(call(fn, row))
            new = pa.RecordBatch.from_pylist(results, schema=arrow_added)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *new.columns], names=[*batch.schema.names, *new.schema.names]
            )

    return source.mapInArrow(run, output)
