"""Stage schemas and vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# Category names, statuses, levels and moods, in their fixed order.
CATEGORIES = [
    "Health",
    "Environmental",
    "Social economics",
    "Conspiracy theory",
    "Corporate control",
    "Ethical/religious issues",
    "Seed ownership",
    "Scientific authority",
    "Other",
]
CLAIM_STATUSES = ["Fact", "Myth", "Unsure"]
STORE_STATUSES = ["Fact", "Myth", "Unclear"]
CONFIDENCES = ["high", "medium", "low"]
SENTIMENTS = ["positive", "negative", "neutral", "mixed"]

# Texts that mark failed stages.
SUMMARY_FAILED = "Summarization failed - unable to process content"
CLASSIFICATION_FAILED = "Classification failed due to processing error"
FIELDS_DEFAULTED = "Analysis completed with default values for missing fields"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_text, _long, _real = T.StringType(), T.LongType(), T.DoubleType()
_texts = T.ArrayType(_text)
_time = T.TimestampNTZType()

PAGES = _struct(page_id=_long, url=_text, html=_text)
REVIEWS = _struct(
    review_id=_long, claim_text=_text, textual_rating=_text, publisher=_text,
    publisher_site=_text, review_url=_text, review_date=_text,
)
REVIEW_RESULT = _struct(
    claim=_text, status=_text, rating=_text, publisher=_text,
    publisher_site=_text, review_url=_text, review_date=_text, confidence=_text,
)

# `article_id` is the unique key of a row in every stage; urls may repeat.
SCRAPED = _struct(article_id=_long, url=_text, content=_text, title=_text)
SUMMARISED = _struct(article_id=_long, url=_text, content=_text, title=_text, summary=_text)
FACT_CHECKED = _struct(
    article_id=_long, url=_text, content=_text, title=_text, summary=_text,
    claims=_texts, fact_check_results=T.ArrayType(REVIEW_RESULT), overall_status=_text,
)
ANALYSED = _struct(
    article_id=_long, url=_text, title=_text, content=_text, summary=_text,
    claims=_texts, fact_check_results=T.ArrayType(REVIEW_RESULT), overall_fact_status=_text,
    classification=_text, confidence=_text, key_themes=_texts, analysis_notes=_text,
    sentiment=_text, credibility_score=_real,
)
STAGES = {
    "scraped": SCRAPED,
    "summarised": SUMMARISED,
    "fact_checked": FACT_CHECKED,
    "analysed": ANALYSED,
}

ARTICLE_LOG = _struct(
    url=_text, title=_text, summary=_text, classification=_text,
    fact_myth_status=_text, created_at=_time, seq=_long,
)
SESSION_LOG = _struct(
    topic=_text, articles_found=_long, facts_count=_long, myths_count=_long,
    unclear_count=_long, created_at=_time,
)
