"""Counts of the terms of each row, taken inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .joins import BROADCAST_ROWS


def term_list(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of the distinct terms of a list: in the sorted list equal terms are neighbours."""

    def runs(listed: Column) -> Column:
        n = F.size(listed)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(listed, i) != F.get(listed, i - 1)))

        def each(starts: Column) -> Column:
            def one(start: Column, i: Column) -> Column:
                end = F.coalesce(F.get(starts, i + 1), n)
                return F.struct(F.get(listed, start).alias("term"), (end - start).cast("long").alias("tf"))

            return F.transform(starts, one)

        return F.when(n > 0, text.bind(first, each))

    return text.bind(F.sort_array(terms), runs)


def row_terms(df: DataFrame, keys: list[str], terms: Column) -> DataFrame:
    """``keys, term, tf``: the counts of the terms of all rows of equal keys, the first of which names a row.

    A row whose first key no other row has is counted in itself, without a shuffle. Rows that share one, and those
    without one, are counted together. The first keys are read once before, to know whether there are any.
    """
    key = keys[0]
    shared = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).select(key)
    if shared.isEmpty():
        return df.select(*keys, F.inline(term_list(terms)))
    known = F.col(key).isNotNull()
    alone = df.where(known).join(shared, key, "left_anti")
    others = df.where(known).join(shared, key, "left_semi").unionByName(df.where(~known))
    together = others.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    return alone.select(*keys, F.inline(term_list(terms))).unionByName(together)


def first_values(table: DataFrame, value: str, max_rows: int = BROADCAST_ROWS) -> Column:
    """A condition that holds for the rows of highest ``value``, of at most ``max_rows``.

    Values, which are at least 0, are told apart by eighths of their binary logarithm; their counts are all that the driver gets.
    """
    grade = F.floor(F.log2(F.col(value) + 1.0) * 8)
    counts = table.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, rows = None, 0
    for found, n in sorted(counts, reverse=True):
        rows += n
        if rows > max_rows:
            break
        least = found
    return F.lit(False) if least is None else grade >= F.lit(least)


def looked_up(terms: DataFrame, lookup: DataFrame, on: str, common: Column) -> DataFrame:
    """Rows of ``terms`` with the columns of ``lookup``, which has one row a term and is read several times.

    The ``common`` rows of ``lookup``, which the caller holds few, are broadcast. Only rows of ``terms`` that are none of these
    are shuffled.
    """
    near = lookup.where(common)
    served = terms.join(F.broadcast(near), on)
    far = lookup.where(~common)
    if far.isEmpty():
        return served
    rest = terms.join(F.broadcast(near.select(on)), on, "left_anti")
    return served.unionByName(rest.join(far, on))
