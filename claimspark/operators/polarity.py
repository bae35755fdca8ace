"""Mood of an article by words whose polarity is learned from a few seeds.

A word is as positive as it stands in sentences with positive seeds more often than in those with negative ones (the
difference of their pointwise mutual information). The words after a negation count the other way round.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .counted import term_list
from .joins import is_small

# Seeds and negations of the invented test prose; replace them for real text.
SEEDS: dict[str, int] = {"for": 1, "with": 1, "pour": 1, "mit": 1, "con": 1, "by": 1, "but": -1, "from": -1, "on": -1, "que": -1, "von": -1, "para": -1}
NEGATIONS = ("not", "no", "nicht", "pas", "sans", "sin")
SCOPE = 3  # words after a negation that it turns round
MIN_COUNT = 5  # sentences with a seed that a learned word stands in
MIN_WEIGHT = 0.5
SEED_WEIGHT = 2.0
SMOOTHING = 0.5
RATIO = 2.0
MICRO = 1_000_000
BROADCAST_WEIGHTS = 500_000


def signed_tokens(sentence: Column, negations: Sequence[str] = NEGATIONS, scope: int = SCOPE) -> Column:
    """``array<struct<token, sign>>``: sign -1 for a token with a negation among the ``scope`` tokens before it."""

    def each(words: Column) -> Column:
        def one(token: Column, i: Column) -> Column:
            # Single look-ups: a slice would copy the whole list for each token.
            before = (F.coalesce(F.get(words, i - k).isin(*negations), F.lit(False)) for k in range(1, scope + 1))
            negated = functools.reduce(Column.__or__, before, F.lit(False))
            return F.struct(token.alias("token"), F.when(negated, -1).otherwise(1).alias("sign"))

        unsigned = F.transform(words, lambda t: F.struct(t.alias("token"), F.lit(1).alias("sign")))
        any_negation = F.arrays_overlap(words, F.array(*map(F.lit, negations)))
        return F.when(any_negation, F.transform(words, one)).otherwise(unsigned)

    return text.bind(text.tokens(sentence), each)


def _sentences(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, words``: the signed tokens of each sentence."""
    listed = df.select(key, F.explode(text.sentences(F.col(content))).alias("sentence"))
    return listed.select(key, signed_tokens(F.col("sentence")).alias("words"))


def _is_seed(seeds: Mapping[str, int], sign: int) -> Callable[[Column], Column]:
    plus = [t for t, s in seeds.items() if s > 0]
    minus = [t for t, s in seeds.items() if s < 0]
    return lambda w: (w["token"].isin(*plus) & (w["sign"] == sign)) | (w["token"].isin(*minus) & (w["sign"] == -sign))


def learn(
    df: DataFrame, key: str = "article_id", content: str = "content", seeds: Mapping[str, int] = SEEDS,
    min_count: int = MIN_COUNT, min_weight: float = MIN_WEIGHT, keep: Callable[[DataFrame], DataFrame] = lambda counts: counts,
) -> DataFrame:
    """``token, positive, negative, weight`` of the words learned from all sentences with a seed.

    ``positive`` and ``negative`` count sentences with a seed of that side, once a sentence and word. A seed behind a negation is
    of the other side, and so is a word. They are counted before the one shuffle, so a frequent word sends a row a task.
    ``keep``, such as ``session.written``, stores the counts, which are read twice.
    """
    found = _sentences(df, key, content).select(
        "words",
        F.exists("words", _is_seed(seeds, 1)).cast("int").alias("p"),
        F.exists("words", _is_seed(seeds, -1)).cast("int").alias("n"),
    ).where("p + n > 0")
    # An empty token in each sentence counts the sentences themselves.
    plain = F.filter(F.array_distinct("words"), lambda w: ~w["token"].isin(*seeds, *NEGATIONS))
    plain = F.concat(plain, F.array(F.struct(F.lit("").alias("token"), F.lit(1).alias("sign"))))
    each = found.select("p", "n", F.inline(plain))
    with_sign = F.col("sign") > 0
    counts = keep(each.groupBy("token").agg(
        F.sum(F.when(with_sign, F.col("p")).otherwise(F.col("n"))).alias("positive"),
        F.sum(F.when(with_sign, F.col("n")).otherwise(F.col("p"))).alias("negative"),
    ))
    totals = counts.where("token = ''").first()
    p_total, n_total = (totals["positive"], totals["negative"]) if totals else (0, 0)
    odds = ((F.col("positive") + SMOOTHING) * (n_total + 1)) / ((F.col("negative") + SMOOTHING) * (p_total + 1))
    weighed = counts.where("token <> ''").withColumn("weight", F.round(F.log2(odds), 6))
    return weighed.where((F.col("positive") + F.col("negative") >= min_count) & (F.abs("weight") >= min_weight))


def with_seeds(learned: DataFrame, seeds: Mapping[str, int] = SEEDS) -> DataFrame:
    """``token, weight`` of learned words and seeds."""
    own = [(t, s * SEED_WEIGHT) for t, s in seeds.items()]
    return learned.select("token", "weight").unionByName(learned.sparkSession.createDataFrame(own, "token string, weight double"))


def learned_sentiment(
    df: DataFrame, weights: DataFrame, key: str = "article_id", content: str = "content", ratio: float = RATIO
) -> DataFrame:
    """``key, positive, negative, sentiment`` of every row: the weights of its words on either side, and which one prevails.

    positive or negative if that side has at least ``ratio`` times the other, neutral without any, else mixed. ``weights`` are
    broadcast after a count, and then only a row a text and task is shuffled. More than ``BROADCAST_WEIGHTS`` are joined with the
    words as each text counts them in itself. ``key`` must be unique.
    """
    if is_small(weights, BROADCAST_WEIGHTS):
        words = _sentences(df, key, content).select(key, F.inline("words"), F.lit(1).cast("long").alias("tf"))
        hits = words.join(F.broadcast(weights), "token")
    else:
        each = F.flatten(F.transform(text.sentences(F.col(content)), lambda s: signed_tokens(s)))
        words = df.select(key, F.inline(term_list(each))).select(key, "term.token", "term.sign", "tf")
        hits = words.join(weights, "token")
    # Whole millionths, so that sums do not depend on their order.
    size = F.round(F.abs("weight") * MICRO).cast("long") * F.col("tf")
    kept = (F.col("weight") > 0) == (F.col("sign") > 0)
    sides = hits.groupBy(key).agg(
        F.sum(F.when(kept, size).otherwise(F.lit(0))).alias("positive"),
        F.sum(F.when(kept, F.lit(0)).otherwise(size)).alias("negative"),
    )
    shown = df.select(key).join(sides, key, "left").select(
        key, *(F.coalesce(F.col(c) / MICRO, F.lit(0.0)).alias(c) for c in ("positive", "negative"))
    )
    plus, minus = F.col("positive"), F.col("negative")
    name = (
        F.when((plus == 0) & (minus == 0), "neutral")
        .when(plus >= minus * ratio, "positive")
        .when(minus >= plus * ratio, "negative")
        .otherwise("mixed")
    )
    return shown.withColumn("sentiment", name)
