"""Ranked retrieval: the best articles for each topic of a table of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .joins import lookup_join, salted_join

K1 = 1.2
B = 0.75


def search_topk(
    topics: DataFrame,
    articles: DataFrame,
    k: int = 10,
    topic: str = "topic",
    key: str = "article_id",
    content: str = "text",
) -> DataFrame:
    """``topic, rank, key, score`` of the ``k`` best articles per topic by BM25, ties by key.

    Only tokens that some topic asks for are shuffled. Term counts per article feed both the
    document frequencies and the scores from one exchange. The rank limit is applied on the map
    side too, so a topic that matches every article sends ``k`` rows per task.
    """
    terms = topics.select(
        topic, F.explode(F.array_distinct(text.tokens(F.col(topic)))).alias("token")
    ).distinct()
    wanted = terms.select("token").distinct()
    tokens = text.tokens(F.col(content))
    length = F.size(tokens)
    corpus = articles.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean_len"))
    size, mean_len = corpus.select("n").scalar(), corpus.select("mean_len").scalar()

    # The length comes first: next to the generator it would be computed again for every token.
    sized = articles.select(key, content, length.alias("len"))
    words = sized.select(key, "len", F.explode(tokens).alias("token"))
    counts = (
        lookup_join(words, wanted, "token", key, "left_semi")
        .groupBy(key, "len", "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = F.col("df")
    idf = F.log(1 + (size - df + 0.5) / (df + 0.5))
    weights = (
        counts.groupBy("token").agg(F.count("tf").alias("df"))
        .select("token", idf.alias("idf"))
        .join(terms, "token")
    )
    damped = F.col("tf") + K1 * (1 - B + B * F.col("len") / mean_len)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / damped
    best = Window.partitionBy(topic).orderBy(F.desc("score"), key)
    return (
        salted_join(counts, weights, "token", key)
        .groupBy(topic, key)
        .agg(F.round(F.sum(part), 6).alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(topic, "rank", key, "score")
    )
