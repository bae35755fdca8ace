"""Counts and rates over analysed articles. Each report is one aggregation of one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (
    CATEGORIES,
    CLAIM_STATUSES,
    CLASSIFICATION_FAILED,
    CONFIDENCES,
    SENTIMENTS,
    STORE_STATUSES,
    SUMMARY_FAILED,
)

DEFAULT_CREDIBILITY = 0.5
WORKFLOW = "article_analysis"
SUCCEEDED = "succeeded"


def vocabulary_counts(df: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """``position, value, n`` for every value of the vocabulary, zero included; others are not counted."""
    counted = df.agg(F.array(*[F.count_if(F.col(column) == v) for v in vocabulary]).alias("n"))
    rows = F.arrays_zip(
        F.sequence(F.lit(1), F.lit(len(vocabulary))).alias("position"),
        F.array(*map(F.lit, vocabulary)).alias("value"),
        F.col("n"),
    )
    return counted.select(F.inline(rows).alias("position", "value", "n"))


def classification_counts(df: DataFrame) -> DataFrame:
    return vocabulary_counts(df, "classification", CATEGORIES)


def fact_status_counts(df: DataFrame) -> DataFrame:
    return vocabulary_counts(df, "overall_fact_status", CLAIM_STATUSES)


def confidence_counts(df: DataFrame) -> DataFrame:
    return vocabulary_counts(df, "confidence", CONFIDENCES)


def sentiment_counts(df: DataFrame) -> DataFrame:
    return vocabulary_counts(df, "sentiment", SENTIMENTS)


def _count_map(column: str, vocabulary: Sequence[str]) -> Column:
    return F.create_map(*[x for v in vocabulary for x in (F.lit(v), F.count_if(F.col(column) == v))])


def succeeded() -> Column:
    """False only for articles that carry both marks of a failed classification."""
    return ~(
        F.col("classification").eqNullSafe("Other")
        & F.col("analysis_notes").eqNullSafe(CLASSIFICATION_FAILED)
    )


def _succeeded(df: DataFrame) -> Column:
    """:func:`succeeded`, or the column of that name, which spares a join the notes."""
    return F.col(SUCCEEDED) if SUCCEEDED in df.columns else succeeded()


def analysis_summary(df: DataFrame) -> DataFrame:
    """One row with totals, count maps and mean credibility; no row for no articles."""
    return df.agg(
        F.count(F.lit(1)).alias("total_articles"),
        _count_map("classification", CATEGORIES).alias("classification_counts"),
        _count_map("overall_fact_status", CLAIM_STATUSES).alias("fact_status_counts"),
        _count_map("confidence", CONFIDENCES).alias("confidence_counts"),
        _count_map("sentiment", SENTIMENTS).alias("sentiment_counts"),
        F.round(F.avg(F.coalesce("credibility_score", F.lit(DEFAULT_CREDIBILITY))), 3).alias(
            "average_credibility_score"
        ),
        F.count_if(_succeeded(df)).alias("successful_analyses"),
    ).where(F.col("total_articles") > 0)


def workflow_summary(df: DataFrame) -> DataFrame:
    """:func:`analysis_summary` under the counts of processed, successful and failed articles."""
    summary = analysis_summary(df)
    return summary.select(
        F.lit(WORKFLOW).alias("workflow_type"),
        F.col("total_articles").alias("total_articles_processed"),
        "successful_analyses",
        (F.col("total_articles") - F.col("successful_analyses")).alias("failed_analyses"),
        F.struct(*summary.columns).alias("analysis_summary"),
    )


def session_stats(df: DataFrame, *by: str, **more: Column) -> DataFrame:
    """Articles found and counts per store status, one row per group; ``more`` aggregates go along."""
    status = F.col("fact_myth_status")
    fact, myth, unclear = STORE_STATUSES
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("articles_found"),
        F.count_if(status == fact).alias("facts_count"),
        F.count_if(status == myth).alias("myths_count"),
        F.count_if(status == unclear).alias("unclear_count"),
        *[value.alias(name) for name, value in more.items()],
    )


def summary_metrics(df: DataFrame, failure_mark: str = SUMMARY_FAILED) -> DataFrame:
    """One row: total, counts per store status, their percentages and the success rate; 0 when empty."""
    made = F.count_if(~F.col("summary").eqNullSafe(failure_mark))
    status = F.col("fact_myth_status")
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(name) for s, name in zip(STORE_STATUSES, ("facts", "myths", "unclear"))],
        made.alias("successful"),
    )

    def percent(part: str) -> Column:
        return F.when(F.col("total") > 0, F.round(F.col(part) * 100.0 / F.col("total"), 1)).otherwise(0.0)

    return counts.select(
        "*",
        *[percent(p).alias(f"{p}_percent") for p in ("facts", "myths", "unclear")],
        percent("successful").alias("success_percent"),
    )


def stage_counts(df: DataFrame) -> DataFrame:
    """One row: articles that went through all stages, and how many each stage worked on or failed."""
    total = F.count(F.lit(1))
    summary_failed = F.count_if(F.col("summary").eqNullSafe(SUMMARY_FAILED))
    with_claims = F.count_if(F.coalesce(F.size("claims"), F.lit(0)) > 0)
    classified = F.count_if(_succeeded(df))
    return df.agg(
        total.alias("articles"),
        (total - summary_failed).alias("summarised"),
        with_claims.alias("fact_checked"),
        classified.alias("classified"),
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts of the values that occur, most frequent first, ties by value; nulls are left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )
