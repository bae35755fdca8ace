"""Key themes of an article: its most specific words, and its phrases of two words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .counted import first_values, looked_up, row_terms

# A token in more than one of HOT_SHARE documents may be broadcast, the most frequent first.
HOT_SHARE = 10_000
MIN_COUNT = 3  # of a phrase in the corpus
MIN_RATIO = 10.83  # log-likelihood ratio that chance exceeds once in a thousand


Keep = Callable[[DataFrame], DataFrame]


def _ranked(scored: DataFrame, key: str, term: str, score: Column, n: int) -> DataFrame:
    """``key, ranked``: the ``n`` terms of the highest score, ties by term. The limit holds before the shuffle, too."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), term)
    ranked = scored.select(key, term, score.alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", term))).alias("ranked"))


def key_themes(
    df: DataFrame, key: str = "article_id", content: str = "content", n: int = 5, keep: Keep = lambda counts: counts
) -> DataFrame:
    """``key, key_themes``: the ``n`` tokens of highest TF-IDF, best first, ties by token.

    Texts without tokens have no row. ``keep``, such as ``session.written``, stores the counts of the articles
    and of the tokens, which are read several times.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = keep(row_terms(df, [key], text.tokens(F.col(content))).withColumnRenamed("term", "token"))
    weights = keep(counts.groupBy("token").agg(F.count("tf").alias("df")))
    often = F.col("df") * HOT_SHARE > total
    weighted = looked_up(counts, weights, "token", often & first_values(weights.where(often), "df"))
    idf = F.log((total + 1) / (F.col("df") + 1)) + 1
    return _ranked(weighted, key, "token", F.round(F.col("tf") * idf, 6), n).select(key, F.col("ranked.token").alias("key_themes"))


def neighbours(content: Column) -> Column:
    """Each token but the last with the next one, joined by a blank. Linear in the text."""

    def pairs(tokens: Column) -> Column:
        return F.array_compact(F.zip_with(tokens, F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b)))

    return F.when(content.isNotNull(), text.bind(text.tokens(content), pairs))


def phrases(both: DataFrame, min_count: int = MIN_COUNT, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``phrase, ratio`` of the pairs that stand together more often than their words alone explain.

    ``both``, which is read four times, has each ``phrase`` with its count ``n12``. ``ratio`` is the log-likelihood ratio of the
    two-by-two table of first and second words.
    """
    words = both.select("phrase", "n12", F.substring_index("phrase", " ", 1).alias("first"), F.substring_index("phrase", " ", -1).alias("second"))
    total = both.agg(F.sum("n12").alias("n")).scalar()
    firsts = words.groupBy("first").agg(F.sum("n12").alias("n1"))
    seconds = words.groupBy("second").agg(F.sum("n12").alias("n2"))
    table = words.where(F.col("n12") >= min_count).join(firsts, "first").join(seconds, "second").withColumn("n", total)
    n12, n1, n2, n = (F.col(c).cast("double") for c in ("n12", "n1", "n2", "n"))

    def h(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    cells = h(n12) + h(n1 - n12) + h(n2 - n12) + h(n - n1 - n2 + n12)
    ratio = F.round(2 * (cells + h(n) - h(n1) - h(n - n1) - h(n2) - h(n - n2)), 4)
    found = table.where(n12 * n > n1 * n2).select("phrase", ratio.alias("ratio"))
    return found.where(F.col("ratio") >= min_ratio)


def key_phrases(df: DataFrame, keep: Keep, key: str = "article_id", content: str = "content", n: int = 5) -> DataFrame:
    """``key, key_phrases``: the ``n`` phrases of the highest count times ratio, best first, ties by phrase.

    ``keep``, such as ``session.written``, stores the counts of the articles and of the corpus, which are read several
    times. Texts without a phrase have no row.
    """
    counts = keep(row_terms(df, [key], neighbours(F.col(content))).withColumnRenamed("term", "phrase"))
    both = keep(counts.groupBy("phrase").agg(F.sum("tf").alias("n12")))
    found = keep(phrases(both))
    named = looked_up(counts, found, "phrase", first_values(found, "ratio"))
    return _ranked(named, key, "phrase", F.round(F.col("tf") * F.col("ratio"), 3), n).select(key, F.col("ranked.phrase").alias("key_phrases"))
