"""Category, sentiment, confidence, credibility and notes of an article.

Lexicons are fixed word lists of a few dozen terms. They become literals of the expression, so
an article is classified inside its row, without a join or a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import CATEGORIES
from .joins import lookup_join

MAX_LITERAL_TERMS = 5000
_LEXICON_TYPE = "array<struct<name string, order int, terms map<string, double>>>"

# Terms per category with their weights. The test corpus is invented prose, so the terms are
# words that occur in it; replace them for real text.
LEXICON: dict[str, dict[str, float]] = {
    "Health": {"thhe": 2.0, "ing": 0.75, "von": 0.5, "des": 0.25},
    "Environmental": {"inin": 3.0, "be": 0.5, "und": 0.25, "los": 0.5},
    "Social economics": {"erwh": 2.0, "on": 0.25, "mit": 0.5, "au": 0.5},
    "Conspiracy theory": {"onor": 2.5, "that": 0.25, "im": 0.5, "est": 0.5},
    "Corporate control": {"license": 6.0, "apache": 6.0, "copyright": 6.0},
    "Ethical/religious issues": {"and": 0.125, "nicht": 0.75, "que": 0.25, "en": 0.5},
    "Seed ownership": {"from": 0.5, "para": 0.5, "enlich": 2.0, "anelle": 2.5},
    "Scientific authority": {"of": 0.125, "der": 0.25, "su": 0.75, "re": 0.5},
}
# Signs of polar words; same remark.
POLARITY: dict[str, int] = {
    "for": 1, "with": 1, "pour": 1, "mit": 1, "con": 1, "by": 1,
    "not": -1, "but": -1, "from": -1, "nicht": -1, "sans": -1, "sin": -1, "on": -1,
}


def _check_literal(terms: int) -> None:
    if terms > MAX_LITERAL_TERMS:
        raise ValueError(f"{terms} terms are too many for a literal; use category_by_join")


def category(content: Column, lexicon: Mapping[str, Mapping[str, float]] | None = None) -> Column:
    """The category with the highest summed term weight; the earlier one on ties, Other without hits."""
    lexicon = LEXICON if lexicon is None else lexicon
    _check_literal(sum(map(len, lexicon.values())))
    every = sorted({term for terms in lexicon.values() for term in terms})
    entries = [
        {"name": name, "order": -CATEGORIES.index(name), "terms": dict(terms)}
        for name, terms in lexicon.items()
    ]
    literal = F.from_json(F.lit(json.dumps(entries)), _LEXICON_TYPE)

    def score(hits: Column, entry: Column) -> Column:
        weight = F.aggregate(
            hits,
            F.lit(0.0),
            lambda total, term: total + F.coalesce(F.try_element_at(entry["terms"], term), F.lit(0.0)),
        )
        return F.struct(F.round(weight, 6).alias("score"), entry["order"], entry["name"])

    def best(hits: Column) -> Column:
        return F.array_max(F.transform(literal, lambda entry: score(hits, entry)))

    return text.bind(
        text.bind(F.filter(text.tokens(content), lambda t: t.isin(every)), best),
        lambda top: F.when(top["score"] > 0, top["name"]).otherwise("Other"),
    )


def category_by_join(df: DataFrame, lexicon: DataFrame, key: str, content: str) -> DataFrame:
    """``key, classification`` for a lexicon table ``category, term, weight`` of any size."""
    order = F.create_map(*[F.lit(x) for i, name in enumerate(CATEGORIES) for x in (name, -i)])
    hits = (
        df.select(key, F.explode(text.tokens(F.col(content))).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hits = lookup_join(hits, lexicon, "term", key)
    scored = hits.groupBy(key, "category").agg(F.round(F.sum(F.col("n") * F.col("weight")), 6).alias("score"))
    best = scored.groupBy(key).agg(
        F.max_by("category", F.struct("score", F.try_element_at(order, F.col("category")))).alias("best")
    )
    return df.select(key).join(best, key, "left").select(
        key, F.coalesce("best", F.lit("Other")).alias("classification")
    )


def polarity_counts(content: Column, polarity: Mapping[str, int] | None = None) -> Column:
    """Struct of the number of positive and negative words."""
    polarity = POLARITY if polarity is None else polarity
    _check_literal(len(polarity))
    plus = [term for term, sign in polarity.items() if sign > 0]
    minus = [term for term, sign in polarity.items() if sign < 0]
    return text.bind(
        F.filter(text.tokens(content), lambda t: t.isin(plus + minus)),
        lambda hits: F.struct(
            F.size(F.filter(hits, lambda t: t.isin(plus))).alias("positive"),
            F.size(F.filter(hits, lambda t: t.isin(minus))).alias("negative"),
        ),
    )


def sentiment(content: Column, polarity: Mapping[str, int] | None = None, ratio: float = 2.0) -> Column:
    """positive or negative if that side has at least ``ratio`` times the other; mixed or neutral."""

    def name(counts: Column) -> Column:
        plus, minus = counts["positive"], counts["negative"]
        return (
            F.when((plus == 0) & (minus == 0), "neutral")
            .when(plus >= minus * ratio, "positive")
            .when(minus >= plus * ratio, "negative")
            .otherwise("mixed")
        )

    return text.bind(polarity_counts(content, polarity), name)


def _with_status(results: Column, *statuses: str) -> Column:
    return F.size(F.filter(results, lambda r: r["status"].isin(*statuses)))


def confidence(results: Column) -> Column:
    """By share of claims with a review: half or more high, some medium, none low."""
    reviewed = _with_status(results, "Fact", "Myth")
    return (
        F.when(reviewed == 0, "low").when(reviewed * 2 >= F.size(results), "high").otherwise("medium")
    )


def credibility(results: Column) -> Column:
    """Share of true claims, an unreviewed one counting half; 0.5 without claims."""
    weight = _with_status(results, "Fact") + _with_status(results, "Unsure") * 0.5
    return F.when(F.size(results) == 0, 0.5).otherwise(F.round(weight / F.size(results), 3))


def notes(results: Column) -> Column:
    """A sentence on how many claims were reviewed and how."""
    return F.concat(
        F.size(results), F.lit(" claims: "),
        _with_status(results, "Fact"), F.lit(" confirmed, "),
        _with_status(results, "Myth"), F.lit(" refuted, "),
        _with_status(results, "Unsure"), F.lit(" without review"),
    )


def train_classifier(
    labelled: DataFrame, content: str, label: str, features: int = 1 << 16, iterations: int = 20
) -> PipelineModel:
    """A text classifier on hashed TF-IDF features; stands in for a model that classifies."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
            RegexTokenizer(inputCol=content, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
            LogisticRegression(
                featuresCol="_features", labelCol="_label", predictionCol="_class",
                maxIter=iterations, regParam=0.01,
            ),
        ]
    ).fit(labelled)


def surface(content: Column) -> dict[str, Column]:
    """How a text is written, whatever its words: shares of kinds of characters, and of distinct words and lines.

    All are 0 for a null or empty text.
    """
    words, lines = F.split(content, r"\s+"), F.split(content, "\n")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.when(whole > 0, whole), F.lit(0.0))

    def characters(pattern: str) -> Column:
        return share(F.regexp_count(content, F.lit(pattern)), F.length(content))

    return {
        "_letters": characters(r"\p{L}"),
        "_capitals": characters(r"\p{Lu}"),
        "_digits": characters(r"\p{Nd}"),
        "_stops": characters("[.!?]"),
        "_symbols": characters("[#*$%&|<>]"),
        "_word_length": share(F.length(content), F.size(words)),
        "_distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "_distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


def train_surface_classifier(labelled: DataFrame, content: str, label: str, iterations: int = 50) -> PipelineModel:
    """A classifier on the :func:`surface` of texts, for labels such as quality that do not depend on topic."""
    columns = surface(F.col(content))
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=list(columns), outputCol="_features"),
            LogisticRegression(
                featuresCol="_features", labelCol="_label", predictionCol="_class",
                maxIter=iterations, regParam=0.001,
            ),
        ]
    ).fit(labelled.withColumns(columns))


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str], output: str) -> DataFrame:
    """``keep`` columns and the predicted label name; rows need no label."""
    indexer, *stages = model.stages
    scored = df
    for stage in stages:
        scored = stage.transform(scored)
    names = IndexToString(inputCol="_class", outputCol=output, labels=indexer.labels)
    return names.transform(scored).select(*keep, output)
