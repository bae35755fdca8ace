"""Pages to analysed articles, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, factcheck, prompts, responses, scrape, summarize, themes

KEY = "article_id"


def summarised(scraped: DataFrame) -> DataFrame:
    """Scraped articles with an extractive summary."""
    summary = summarize.extractive_summary(F.col("content"))
    return scraped.withColumn("summary", summarize.summary_or_failed(summary))


def classified_by_rules(checked: DataFrame, articles: DataFrame) -> DataFrame:
    """Fact-checked articles with category, themes, mood and scores from the built-in rules."""
    ranked = themes.key_themes(articles.select(KEY, "summary"), KEY, "summary")
    return (
        rule_columns(checked)
        .join(ranked, KEY, "left")
        .withColumn("key_themes", F.coalesce("key_themes", F.array().cast("array<string>")))
    )


def rule_columns(checked: DataFrame) -> DataFrame:
    """What the rules find in an article by itself: all but the themes."""
    results = F.col("fact_check_results")
    return checked.withColumns(
        {
            "classification": classify.category(F.col("summary")),
            "confidence": classify.confidence(results),
            "analysis_notes": classify.notes(results),
            "sentiment": classify.sentiment(F.col("summary")),
            "credibility_score": classify.credibility(results),
        }
    )


def classified_by_model(
    ask: Callable[[DataFrame], DataFrame],
) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Classification by the parsed answers of a model.

    ``ask`` gets ``article_id, prompt`` and returns ``article_id, response``; ``enrich`` makes
    such a function from a client. An article without an answer gets the failure row.
    """

    def classify_articles(checked: DataFrame, articles: DataFrame) -> DataFrame:
        prompt = prompts.classification_prompt(
            F.col("url"), F.col("title"), F.col("summary"), F.col("overall_status"),
            F.col("fact_check_results"),
        )
        answers = ask(checked.select(KEY, prompt.alias("prompt"))).select(KEY, "response")
        return responses.parse_responses(checked.join(answers, KEY, "left"))

    return classify_articles


def analyse_scraped(
    scraped: DataFrame,
    reviews: DataFrame | None,
    summarise: Callable[[DataFrame], DataFrame] = summarised,
    classify_articles: Callable[[DataFrame, DataFrame], DataFrame] = classified_by_rules,
    threshold: float | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The analysed-article rows of scraped articles.

    Claims and tokens are shuffled as narrow rows next to the articles. The articles themselves,
    content included, move at most once, by key, to meet their matched claims and themes.

    Claims, themes and the rows themselves each read the summarised articles. ``keep``, such as
    ``session.written``, stores them once; without it each reader scrapes the pages again.
    """
    articles = summarise(scraped)
    if keep is not None:
        articles = keep(articles)
    checked = factcheck.fact_check(articles, reviews, KEY, threshold=threshold, keep=keep)
    return classify_articles(checked, articles).select(
        KEY, "url", "title", "content", "summary", "claims", "fact_check_results",
        F.coalesce("overall_status", F.lit("Unsure")).alias("overall_fact_status"),
        "classification", "confidence", "key_themes", "analysis_notes", "sentiment",
        "credibility_score",
    )


def analyse_pages(pages: DataFrame, reviews: DataFrame | None, **stages) -> DataFrame:
    """The analysed-article rows of all pages with a valid url and usable content."""
    scraped = pages.transform(scrape.valid_urls).transform(scrape.scrape)
    return analyse_scraped(scraped, reviews, **stages)
