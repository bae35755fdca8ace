"""Claim lookup in a table of fact-check reviews, and the vote per article.

The lookup is an inner join of claim keys with reviews, so only matched claims are carried
further: they are grouped per article (at most one row per claim of it) and joined back, and
the result list with its defaults for unmatched claims is built inside the article row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import REVIEW_RESULT
from .claims import MAX_CLAIMS, claim_list, explode_claims
from .joins import salted_join

_REVIEW_FIELDS = ["textual_rating", "publisher", "publisher_site", "review_url", "review_date"]


def rating_status(rating: Column) -> Column:
    """Fact for the ratings true and fact in any case, Myth for all others and for none."""
    return F.when(F.lower(F.coalesce(rating, F.lit(""))).isin("true", "fact"), "Fact").otherwise("Myth")


def _result(claim, status, rating, publisher, site, url, date, confidence) -> Column:
    values = [claim, status, rating, publisher, site, url, date, confidence]
    return F.struct(*[v.alias(f.name) for v, f in zip(values, REVIEW_RESULT.fields)])


def review_result(claim, found, rating, publisher, site, url, date) -> Column:
    """Result struct of one claim: the review with defaults, or the no-match row."""
    empty = F.lit("")
    match = _result(
        claim,
        rating_status(rating),
        F.coalesce(rating, F.lit("Unknown")),
        F.coalesce(publisher, F.lit("Unknown")),
        F.coalesce(site, empty),
        F.coalesce(url, empty),
        F.coalesce(date, empty),
        F.lit("high"),
    )
    return F.when(found, match).otherwise(unsure_result(claim, "No fact-check found"))


def unsure_result(claim: Column, rating: str) -> Column:
    """Result struct of a claim without a usable review."""
    none = [F.lit(v) for v in ("Unsure", rating, "None", "", "", "", "low")]
    return _result(claim, *none)


def error_result(claim: Column) -> Column:
    """Result struct of a claim whose lookup failed."""
    return unsure_result(claim, "Error occurred")


def overall_status(facts: Column, myths: Column, unsure: Column) -> Column:
    """The status that beats both others; Unsure on ties and without claims."""
    return (
        F.when((facts > myths) & (facts > unsure), "Fact")
        .when((myths > facts) & (myths > unsure), "Myth")
        .otherwise("Unsure")
    )


def status_vote(results: Column) -> Column:
    """:func:`overall_status` of a result list."""

    def count(status: str) -> Column:
        return F.size(F.filter(results, lambda r: r["status"] == status))

    return overall_status(count("Fact"), count("Myth"), count("Unsure"))


def review_index(reviews: DataFrame) -> DataFrame:
    """One review per normalised claim text, the lowest id first: ``norm, review_id, review``."""
    review = F.struct("review_id", *_REVIEW_FIELDS)
    return (
        reviews.select(text.normalised(F.col("claim_text")).alias("norm"), review.alias("review"))
        .where(F.col("norm") != "")
        .groupBy("norm")
        .agg(F.min_by("review", F.col("review.review_id")).alias("review"))
    )


def match_exact(claims: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """``key, pos, review, score`` of claims whose normalised text equals that of a review."""
    keyed = claims.select(key, "pos", text.normalised(F.col("claim")).alias("norm"))
    return salted_join(keyed.where(F.col("norm") != ""), review_index(reviews), "norm", key).select(
        key, "pos", "review", F.lit(1.0).alias("score")
    )


def _digest(c: str) -> Column:
    return F.unhex(F.sha2(F.col(c), 256))


def _prefix_len(n: Column, threshold: float) -> Column:
    """How many of the rarest tokens of a set must be indexed to miss no partner.

    Two sets with Jaccard >= t share at least ceil(t * n) tokens of either, so the n - ceil(t * n)
    + 1 first ones of both, in one common order, have a token in common.
    """
    return (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")


def match_fuzzy(
    claims: DataFrame,
    reviews: DataFrame,
    key: str,
    threshold: float = 0.5,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``key, pos, review, score`` of the best review by Jaccard similarity of token sets.

    Exact: no candidate is lost. Copies of a claim are first reduced to one. Tokens are ordered
    by how many reviews hold them, rarest first; tokens that no review holds come before all
    others and produce no candidates. Only the prefix of each set goes to the token join, as
    narrow rows; the sets come back for the candidate pairs alone.

    Several steps read the claims. ``keep``, such as ``session.written``, stores their keys and
    normalised texts once; without it each step takes the articles apart again.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    keyed = claims.select(key, "pos", text.normalised(F.col("claim")).alias("norm"))
    keyed = keyed.where(F.col("norm") != "")
    if keep is not None:
        keyed = keep(keyed)
    sets = _token_sets(keyed.select("norm").distinct())
    index = review_index(reviews)
    review_sets = _token_sets(index.select("norm")).select(
        F.col("id").alias("rid"), F.col("words").alias("rwords"), F.col("n").alias("rn")
    )

    review_tokens = review_sets.select("rid", "rn", F.explode("rwords").alias("token"))
    frequency = review_tokens.groupBy("token").agg(F.count("rid").alias("df"))
    ranked_reviews = salted_join(review_tokens, frequency, "token", "rid")
    posting = _first_by_rarity(ranked_reviews, "rid", "rn", threshold).select("token", "rid", "rn")

    set_tokens = sets.select("id", "n", F.explode("words").alias("token"))
    ranked_sets = salted_join(set_tokens, frequency, "token", "id", "left")
    probes = (
        _first_by_rarity(ranked_sets, "id", "n", threshold)
        .where(F.col("df").isNotNull())
        .select("token", "id", "n")
    )
    in_reach = (F.col("rn") >= F.col("n") * threshold) & (F.col("n") >= F.col("rn") * threshold)
    pairs = salted_join(probes, posting, "token", "id").where(in_reach).select("id", "rid").distinct()

    shared = F.size(F.array_intersect("words", "rwords"))
    score = F.round(shared / (F.col("n") + F.col("rn") - shared), 6)
    reviews_by_id = index.select(_digest("norm").alias("rid"), "review")
    best = (
        salted_join(pairs, review_sets, "rid", "id")
        .join(sets, "id")
        .where(shared >= F.lit(threshold) * (F.col("n") + F.col("rn") - shared) - F.lit(1e-9))
        .select("id", "rid", score.alias("score"))
    )
    best = (
        salted_join(best, reviews_by_id, "rid", "id")
        .groupBy("id")
        .agg(F.max_by(F.struct("review", "score"), F.struct("score", -F.col("review.review_id"))).alias("b"))
    )
    hits = best.join(sets.select("id", "norm"), "id").select("norm", "b.review", "b.score")
    return salted_join(keyed, hits, "norm", key).select(key, "pos", "review", "score")


def _token_sets(norms: DataFrame) -> DataFrame:
    """``id, norm, words, n`` per distinct text, ``id`` being its 256-bit digest."""
    words = F.array_distinct(F.split("norm", " "))
    return norms.select(_digest("norm").alias("id"), "norm", words.alias("words")).withColumn(
        "n", F.size("words")
    )


def _first_by_rarity(tokens: DataFrame, key: str, size: str, threshold: float) -> DataFrame:
    """The rows of each set's prefix: rarest tokens first, ties by token."""
    order = Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "token")
    return tokens.withColumn("_rank", F.row_number().over(order)).where(
        F.col("_rank") <= _prefix_len(F.col(size), threshold)
    )


def fact_check(
    articles: DataFrame,
    reviews: DataFrame | None,
    key: str = "article_id",
    summary: str = "summary",
    max_claims: int | None = MAX_CLAIMS,
    threshold: float | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Adds ``claims, fact_check_results, overall_status``; ``key`` must be unique.

    Without reviews articles pass with no claims and Unsure. ``threshold`` switches from exact
    to fuzzy lookup. A null summary is a failed article: no claims, no results, Unsure.
    """
    if reviews is None:
        return articles.select(
            "*",
            F.array().cast("array<string>").alias("claims"),
            F.array().cast(f"array<{REVIEW_RESULT.simpleString()}>").alias("fact_check_results"),
            F.lit("Unsure").alias("overall_status"),
        )
    claims = claim_list(F.col(summary), max_claims)
    exploded = explode_claims(articles, key, claims)
    if threshold is None:
        matched = match_exact(exploded, reviews, key)
    else:
        matched = match_fuzzy(exploded, reviews, key, threshold, keep)
    per_article = matched.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "review"))).alias("_matches")
    )

    def result(claim: Column, pos: Column) -> Column:
        review = F.try_element_at(F.col("_matches"), pos)
        return review_result(claim, review.isNotNull(), *[review[f] for f in _REVIEW_FIELDS])

    # The claims come before the join, so that the summaries stay behind where nobody asks for them.
    listed = articles.withColumn("claims", F.coalesce(claims, F.array().cast("array<string>")))
    return (
        listed.join(per_article, key, "left")
        .withColumn("fact_check_results", F.transform("claims", result))
        .withColumn("overall_status", status_vote(F.col("fact_check_results")))
        .drop("_matches")
    )


def claim_results(checked: DataFrame, key: str = "article_id") -> DataFrame:
    """One row per claim of checked articles: ``key, pos`` and the result fields."""
    return checked.select(key, F.posexplode("fact_check_results").alias("pos", "r")).select(
        key, "pos", "r.*"
    )


def vote_counts(checked: DataFrame, key: str = "article_id") -> DataFrame:
    """Counts per status and the overall status of each checked article."""

    def count(status: str) -> Column:
        return F.size(F.filter("fact_check_results", lambda r: r["status"] == status)).alias(
            f"{status.lower()}_count"
        )

    return checked.select(
        key, F.size("claims").alias("claim_count"), count("Fact"), count("Myth"), count("Unsure"),
        "overall_status",
    )
