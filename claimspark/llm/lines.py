"""Columns that split and hash the lines of a text. JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normal(line: Column) -> Column:
    """A line without outer white space and with single spaces inside."""
    return F.regexp_replace(trimmed(line), SPACE_RUN, " ")


def line_key(*parts: Column) -> Column:
    """128 bits that stand for a line, as one column that joins and groups."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))
