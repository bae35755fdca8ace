"""Line dedup by distinct-site spread.

Lines that many sites share are boilerplate. Every normalised line has a HyperLogLog sketch of its
sites; sketches merge by partial aggregation, so a line of a third of all rows sends one sketch a
task. An estimate well above or below the limit decides; lines near it get an exact distinct count.
Boilerplate is removed everywhere but where it first occurs, so a mass-copied text keeps one copy.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import written
from .lines import line_key, normal, split_lines
from .tables import ROW, numbered, plain

MIN_SITES = 8
LOG_K = 10  # the sketch's standard error is 1.04 / sqrt(2**LOG_K), here 3.3 %
BAND = 3  # standard errors that count as near


def line_table(rows: DataFrame, text: str, site: str, key: str) -> DataFrame:
    """Lines with a word: ``at`` (key, row and place), ``site, line``. A null site is a site of its own."""
    split = rows.select(ROW, F.col(key).alias("_key"), F.coalesce(F.col(site).cast("string"), F.lit("\x00null")).alias("site"), F.posexplode(split_lines(text)).alias("pos", "_line"))
    return split.withColumn("_line", normal(F.col("_line"))).where("_line != ''").select(
        F.struct("_key", ROW, "pos").alias("at"), "site", line_key(F.col("_line")).alias("line")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, log_k: int = LOG_K) -> DataFrame:
    """Lines on at least ``min_sites`` sites: ``line, first`` (where the first one is)."""
    error = BAND * 1.04 / math.sqrt(2**log_k)
    low, high = math.floor(min_sites * (1 - error)), math.ceil(min_sites * (1 + error))
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", log_k)).alias("sites"), F.min("at").alias("first")
    )
    shared = written(spread.where(F.col("sites") >= low))
    near = shared.where(F.col("sites") <= high).select("line")
    exact = (
        salted_join(lines, near, "line", "at")
        .select("line", "site")
        .distinct()
        .groupBy("line")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return shared.where(F.col("sites") > high).select("line", "first").unionByName(shared.join(exact.select("line"), "line").select("line", "first"))


def _without(text: str, places: Column) -> Column:
    split = split_lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), places)
    return F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")


def dedup_lines(
    docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id", min_sites: int = MIN_SITES, log_k: int = LOG_K
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines, n_removed_lines``.

    Lines are compared without outer white space and with single spaces; lines without a word stay.
    The first occurrence, by ``key``, row and line, stays. All documents stay, a text that loses all lines as
    ''; a null text stays null with no lines, an empty one has one line. Repeated rows each count,
    yet as one site. Columns of ``docs`` stay, but those named like a new one are replaced.
    """
    rows = numbered(plain(docs, "n_lines", "n_removed_lines"))
    lines = written(line_table(rows, text, site, key))
    removed = written(boilerplate(lines, min_sites, log_k))
    hits = salted_join(lines.select("at", "line"), removed, "line", "at")
    places = (
        hits.where("not (first <=> at)")
        .groupBy(F.col("at")[ROW].alias(ROW))
        .agg(F.collect_list("at.pos").alias("_places"))  # of one text
    )
    out = rows.join(places, ROW, "left")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(split_lines(text)))
    return out.withColumns(
        {
            "n_lines": n_lines.cast("long"),
            "n_removed_lines": F.coalesce(F.size("_places"), F.lit(0)).cast("long"),
            text: F.when(F.col("_places").isNull(), F.col(text)).otherwise(_without(text, F.col("_places"))),
        }
    ).drop(ROW, "_places")
