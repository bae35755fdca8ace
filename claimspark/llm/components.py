"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _stars(both: DataFrame) -> DataFrame:
    """Each neighbour with the least of its node's neighbourhood; ``u, v, least``."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return both.join(least, "u")  # adaptive execution splits nodes of very many neighbours


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``edges`` (``u, v``): the least node of its component.

    Every round links nodes to the least node of their neighbourhood, first those above them and
    then themselves, and is written; it ends when a round changes nothing.
    """
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_stars(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct())
        down = _stars(large)
        small = down.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = written(small.unionByName(down.select("u", F.col("least").alias("v"))).where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
