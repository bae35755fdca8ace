"""Parquet tables and the views on them that stand in for outside services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.claims import claim_list, explode_claims
from ..schemas import CATEGORIES, CONFIDENCES, SENTIMENTS


# Tables whose rows cost much more to work on than to move, with their keys.
_TEXT_KEYS = {"pages": "page_id", "documents": "doc_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df, _TEXT_KEYS[name]) if name in _TEXT_KEYS else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` hash-partitioned by its key if it comes in fewer splits than there are cores.

    A file of one row group is one split, however many cores wait for it. Tables that fill the
    cluster are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, F.col(key))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched pages, ``article_id`` being the page id."""
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("article_id"), "url", "html"
    )


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Page urls of which some are broken: wrong case, leading blank, other scheme, null."""
    pick = F.col("page_id") % 6
    broken = (
        F.when(pick == 1, F.upper("url"))
        .when(pick == 2, F.concat(F.lit(" "), "url"))
        .when(pick == 3, F.concat(F.lit("ftp"), F.substr("url", F.lit(5))))
        .when(pick == 4, F.lit(None))
        .otherwise(F.col("url"))
    )
    return table(spark, folder, "pages").select(F.col("page_id"), broken.alias("url"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles: ``article_id, url, text``."""
    url = F.concat(
        F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id")
    )
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("article_id"), url.alias("url"), "text"
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Fact-check reviews: one per long sentence of a benchmark item."""
    item = F.col("item_id")
    rating = (
        F.when(item % 5 == 0, "True")
        .when(item % 5 == 1, "FACT")
        .when(item % 5 == 2, "False")
        .when(item % 5 == 3, "Mostly True")
    )
    publisher = F.when(item % 7 != 0, F.concat(F.lit("Desk "), item % 7))
    site = F.when(item % 7 != 0, F.concat(F.lit("desk"), item % 7, F.lit(".example.org")))
    date = F.when(
        item % 6 != 0, F.concat(F.lit("2024-01-"), F.lpad((item % 28 + 1).cast("string"), 2, "0"))
    )
    review_id = item * 100000 + F.col("pos")
    return (
        table(spark, folder, "benchmark")
        .select("item_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "claim_text"))
        .where(F.length("claim_text") > 20)
        .select(
            review_id.alias("review_id"),
            "claim_text",
            rating.alias("textual_rating"),
            publisher.alias("publisher"),
            site.alias("publisher_site"),
            F.concat(F.lit("https://reviews.example.org/"), review_id).alias("review_url"),
            date.alias("review_date"),
        )
    )


def disputed_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Five publishers on the first claims of all documents, who disagree: ``norm, publisher, textual_rating``.

    Desk 4 always contradicts, desk 3 one time in three, the others now and then; each leaves some out.
    """
    doc, pos, desk = F.col("article_id"), F.col("pos"), F.col("desk")
    listed = explode_claims(articles(spark, folder), "article_id", claim_list(F.col("text")))
    each = listed.select("article_id", "pos", text.normalised(F.col("claim")).alias("norm"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("desk"))
    flipped = (desk == 4) | ((desk == 3) & ((doc + pos) % 3 == 0)) | ((desk < 3) & ((doc * 7 + pos * 3 + desk) % 11 == 0))
    true = ((doc + pos) % 2 == 0) != flipped
    rating = F.when(true, "True").when((doc + pos) % 5 > 0, "False")
    return each.where((F.col("norm") != "") & ((doc + desk) % 4 != 0)).select(
        "norm", F.concat(F.lit("Desk "), desk).alias("publisher"), rating.alias("textual_rating")
    )


def _json_string(c):
    """Text as a JSON string literal; written by hand so that other engines can repeat it."""
    for char, escape in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        c = F.replace(c, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _choice(values: list[str], key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def model_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers over all documents, in twelve well- and ill-formed shapes."""
    doc = F.col("doc_id")
    kind = doc % 12
    label = F.when(doc % 17 == 0, F.lit("Sports")).otherwise(_choice(CATEGORIES, doc))
    score = F.format_string("0.%02d", doc % 100)
    head = F.concat(
        F.lit('{"classification": "'), label,
        F.lit('", "confidence": "'), _choice(CONFIDENCES, F.floor(doc / 2)),
        F.lit('", "key_themes": ["'), "lang", F.lit('", "'), "source",
        F.lit('"], "analysis_notes": '), _json_string(F.col("text")),
    )
    mood = F.concat(F.lit(', "sentiment": "'), _choice(SENTIMENTS, F.floor(doc / 3)), F.lit('"'))
    tail = F.concat(F.lit(', "credibility_score": '), score, F.lit("}"))
    whole = F.concat(head, mood, tail)
    fence, newline = F.lit("```"), F.lit("\n")
    response = (
        F.when(kind == 0, whole)
        .when(kind == 1, F.concat(fence, F.lit("json\n"), whole, newline, fence))
        .when(kind == 2, F.concat(F.lit("Here: "), fence, newline, whole, newline, fence, F.lit(" done")))
        .when(kind == 3, F.concat(fence, F.lit("json\n"), whole))
        .when(kind == 4, F.concat(F.lit("Sure: "), whole, F.lit(" Anything else?")))
        .when(kind == 5, F.concat(head, tail))
        .when(kind == 6, F.concat(head, F.lit(', "sentiment": null'), tail))
        .when(kind == 7, F.concat(F.lit("["), doc.cast("string"), F.lit("]")))
        .when(kind == 8, F.concat(fence, F.lit("json\n"), whole, F.lit(" trailing"), newline, fence))
        .when(kind == 9, F.replace(whole, F.lit('"'), F.lit("'")))
        .when(kind == 10, F.lit(" \n "))
        .otherwise(F.concat(F.lit(" No answer for "), "source", F.lit(" ")))
    )
    return table(spark, folder, "documents").select(
        doc.alias("article_id"), response.alias("response")
    )
