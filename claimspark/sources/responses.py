"""Readers of search and review service responses that arrive as a JSON column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import factcheck

_SEARCH = "STRUCT<organic: ARRAY<STRUCT<link: STRING>>>"
_REVIEW = (
    "STRUCT<claims: ARRAY<STRUCT<claimReview: ARRAY<STRUCT<textualRating: STRING, url: STRING, "
    "reviewDate: STRING, publisher: STRUCT<name: STRING, site: STRING>>>>>>"
)


def search_hits(responses: DataFrame, key: str, body: str = "body", k: int = 10) -> DataFrame:
    """``key, rank, url`` of the first ``k`` hits. The cut comes first, then hits without a link go."""
    hits = F.slice(F.from_json(body, _SEARCH)["organic"], 1, k)
    return (
        responses.select(key, F.posexplode(hits).alias("pos", "hit"))
        .where(F.col("hit.link").isNotNull())
        .select(key, (F.col("pos") + 1).alias("rank"), F.col("hit.link").alias("url"))
    )


def review_results(responses: DataFrame, key: str, claim: str, body: str = "body") -> DataFrame:
    """``key`` and the review result fields from the first review of the first returned claim."""
    first_claim = F.try_element_at(F.from_json(body, _REVIEW)["claims"], F.lit(1))
    review = F.try_element_at(first_claim["claimReview"], F.lit(1))
    parsed = responses.select(key, F.col(claim).alias("claim"), review.alias("_review"))
    result = factcheck.review_result(
        F.col("claim"),
        F.col("_review").isNotNull(),
        F.col("_review.textualRating"),
        F.col("_review.publisher.name"),
        F.col("_review.publisher.site"),
        F.col("_review.url"),
        F.col("_review.reviewDate"),
    )
    return parsed.select(key, result.alias("r")).select(key, "r.*")
