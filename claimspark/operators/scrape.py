"""Pages to articles. All narrow: one scan, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text


def valid_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose url starts with http:// or https://, in lower case."""
    return df.where(text.is_web_url(F.col(url)))


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("article_id", "url", html.main_text(F.col("html")).alias("text"))


def page_metadata(pages: DataFrame) -> DataFrame:
    page = F.col("html")
    return pages.select(
        "article_id",
        "url",
        html.title(page).alias("title"),
        *[html.meta(page, field).alias(field) for field in html.META],
    )


def _extracted(pages: DataFrame) -> DataFrame:
    """One pass over the page text, with the reason in ``reject`` where a page gives no article."""
    page = F.col("html")

    def outcome(extracted: Column) -> Column:
        content = text.clean_content(extracted)
        return text.bind(
            content,
            lambda c: F.struct(
                c.alias("content"),
                F.when(F.coalesce(F.length(page), F.lit(0)) == 0, "download")
                .when(F.coalesce(extracted, F.lit("")) == "", "extract")
                .when(c == "", "content")
                .alias("reject"),
            ),
        )

    done = text.add_columns_once(pages, text.bind(html.main_text(page), outcome))
    title = F.coalesce(F.nullif(html.title(page), F.lit("")), text.url_title(F.col("url")))
    return done.select("article_id", "url", "content", title.alias("title"), "reject")


def scrape(pages: DataFrame) -> DataFrame:
    """``article_id, url, content, title`` of the pages that give usable content."""
    return _extracted(pages).where(F.col("reject").isNull()).drop("reject")


def scrape_rejects(pages: DataFrame) -> DataFrame:
    """The pages :func:`scrape` drops, with the first step that failed."""
    return _extracted(pages).where(F.col("reject").isNotNull()).select("article_id", "url", "reject")


def scrape_counts(pages: DataFrame) -> DataFrame:
    """One row: pages seen, articles scraped, and rejects per step."""
    reject = F.col("reject")
    return _extracted(pages).agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(reject.isNull()).alias("scraped"),
        *[F.count_if(reject == step).alias(f"rejected_{step}") for step in ("download", "extract", "content")],
    )
