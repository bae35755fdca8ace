"""Conflicting reviews of one claim: publishers and claims are weighed in turn.

A claim is believed as far as the publishers who call it a fact carry weight, and a publisher carries
weight as far as it agrees with what is believed. Reviews are first reduced to one stand for each claim and
publisher, so a claim that many copies of a review judge sends one row a publisher.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import factcheck
from .joins import lookup_join, salted_join

ROUNDS = 16
FEW_PUBLISHERS = 1000  # up to so many, all stands of a claim are one short list
SMOOTHING = 0.01  # keeps the weight of a publisher that always agrees finite


def stands(reviews: DataFrame, claim: str = "norm", rating: str = "textual_rating") -> DataFrame:
    """``claim, publisher, stand, n``: the share of a publisher's ``n`` reviews of a claim that call it a fact.

    Rows without a claim or publisher do not count; any rating but true or fact is a denial, as is none.
    """
    fact = (factcheck.rating_status(F.col(rating)) == "Fact").cast("int")
    known = reviews.where(F.col(claim).isNotNull() & F.col("publisher").isNotNull())
    return known.groupBy(F.col(claim).alias("claim"), "publisher").agg(F.avg(fact).alias("stand"), F.count(F.lit(1)).alias("n"))


def _believed(weighed: DataFrame) -> DataFrame:
    total = F.sum("weight")
    belief = F.when(total > 0, F.round(F.sum(F.col("weight") * F.col("stand")) / total, 9)).otherwise(F.lit(0.5))
    return weighed.groupBy("claim").agg(belief.alias("belief"), F.sum("n").alias("reviews"))


def _weight(agreement: Column) -> Column:
    """Log odds of agreeing; a publisher that agrees no more often than not has none."""
    odds = (agreement + SMOOTHING) / (F.lit(1.0) - agreement + SMOOTHING)
    return F.round(F.greatest(F.log(odds), F.lit(0.0)), 9)


def _status(beliefs: DataFrame) -> DataFrame:
    status = F.when(F.col("belief") > 0.5, "Fact").when(F.col("belief") < 0.5, "Myth").otherwise("Unsure")
    return beliefs.withColumn("belief", F.round("belief", 6)).withColumn("status", status)


def _listed(taken: DataFrame, names: list[str]) -> DataFrame:
    """``claim, stands``: all stands of a claim, ``at`` being the place of the publisher in ``names``."""
    places = taken.sparkSession.createDataFrame(list(enumerate(names)), "at int, publisher string")
    known = taken.join(F.broadcast(places), "publisher")
    return known.groupBy("claim").agg(F.sort_array(F.collect_list(F.struct("at", "stand", "n"))).alias("stands"))


def _belief(weights: list[float]) -> Column:
    """What :func:`_believed` sums up, of the list ``stands``."""
    of = F.array(*map(F.lit, weights)).cast("array<double>")

    def added(acc: Column, s: Column) -> Column:
        weight = F.get(of, s["at"])
        return F.struct((acc["total"] + weight).alias("total"), (acc["facts"] + weight * s["stand"]).alias("facts"))

    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("facts"))
    return F.aggregate("stands", zero, added, lambda a: F.when(a["total"] > 0, F.round(a["facts"] / a["total"], 9)).otherwise(F.lit(0.5)))


def _discover_listed(spark: SparkSession, claims: DataFrame, names: list[str], rounds: int) -> tuple[DataFrame, DataFrame]:
    """:func:`discover` over lists: a round scans them without the claims' texts and shuffles a row a publisher and task."""
    weights = [1.0] * len(names)
    for _ in range(rounds):
        judged = claims.select(_belief(weights).alias("belief"), "stands").select("belief", F.inline("stands"))
        agreement = F.lit(1.0) - F.abs(F.col("stand") - F.col("belief"))
        found = dict(judged.groupBy("at").agg(_weight(F.avg(agreement))).collect())
        before, weights = weights, [found[i] for i in range(len(names))]
        if weights == before:
            break
    reviews = F.aggregate("stands", F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    beliefs = claims.select("claim", _belief(weights).alias("belief"), reviews.alias("reviews"))
    return _status(beliefs), spark.createDataFrame(list(zip(names, weights)), "publisher string, weight double")


def discover(taken: DataFrame, keep: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``claim, belief, reviews, status`` and ``publisher, weight`` after ``rounds`` rounds from equal weights, or as soon as
    a round changes no weight.

    ``taken`` are :func:`stands`. ``keep``, such as ``session.written``, stores these once and the weights of each round, so
    that a lost task repeats one round. A claim believed above one half is Fact, below it Myth, else
    Unsure, as is one whose publishers all have no weight.

    The stands of a claim are listed once if there are at most ``FEW_PUBLISHERS`` publishers, which bounds the lists; their weights
    are then all that a round moves. With more publishers each round joins the stands.
    """
    taken = keep(taken)
    publishers = taken.select("publisher").distinct()
    names = [r[0] for r in publishers.limit(FEW_PUBLISHERS + 1).collect()]
    if len(names) <= FEW_PUBLISHERS:
        return _discover_listed(taken.sparkSession, keep(_listed(taken, sorted(names))), sorted(names), rounds)
    weights = publishers.withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        beliefs = _believed(lookup_join(taken, weights, "publisher", "claim"))
        agreement = F.lit(1.0) - F.abs(F.col("stand") - F.col("belief"))
        judged = salted_join(taken, beliefs.select("claim", "belief"), "claim", "publisher")
        before, weights = weights, keep(judged.groupBy("publisher").agg(_weight(F.avg(agreement)).alias("weight")))
        if weights.exceptAll(before).isEmpty():
            break
    beliefs = _believed(lookup_join(taken, weights, "publisher", "claim"))
    return _status(beliefs), weights
