"""Extractive summary, and assembly of summaries that came from elsewhere."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import SUMMARY_FAILED

MAX_CHARS = 3000
MAX_SENTENCES = 3
DAMPING = 0.85
TOLERANCE = 1e-3
# A round shrinks the distance to the limit, at most 2, by DAMPING: so many rounds hold the tolerance for any text.
CENTRAL_ROUNDS = math.ceil(math.log(TOLERANCE / 2) / math.log(DAMPING))


def extractive_summary(
    content: Column, max_chars: int = MAX_CHARS, max_sentences: int = MAX_SENTENCES
) -> Column:
    """The sentences whose words are most frequent in the text, in order; null without sentences.

    A sentence scores the mean frequency of its tokens within the summarised text, its first
    ``max_chars`` characters. Ties go to the earlier sentence. That text is short, so counting
    inside the row beats taking it apart: no rows are made, sorted or shuffled.
    """
    body = F.substring(content, 1, max_chars)

    def scored(counts: Column) -> Column:
        def entry(sentence: Column, pos: Column) -> Column:
            def mean(own: Column) -> Column:
                total = F.aggregate(own, F.lit(0.0), lambda sum_, token: sum_ + F.element_at(counts, token))
                return F.round(total / F.nullif(F.size(own), F.lit(0)), 6)

            rank = -text.bind(text.tokens(sentence), mean)
            return F.struct(rank.alias("rank"), pos.alias("pos"), sentence.alias("sentence"))

        entries = F.filter(F.transform(text.sentences(body), entry), lambda e: e["rank"].isNotNull())
        best = F.slice(F.array_sort(entries), 1, max_sentences)
        in_order = F.array_sort(F.transform(best, lambda e: F.struct(e["pos"], e["sentence"])))
        return F.array_join(F.transform(in_order, lambda e: e["sentence"]), ". ")

    summary = text.bind(text.token_counts(text.tokens(body)), scored)
    return text.bind(summary, lambda s: F.when(s != "", F.concat(s, F.lit("."))))


def _shown(chosen: Column) -> Column:
    """Sentences as a text that ends in a full stop; null without any."""
    return text.bind(F.array_join(chosen, ". "), lambda s: F.when(s != "", F.concat(s, F.lit("."))))


def centrality(words: np.ndarray, owners: np.ndarray, sentences: int, rounds: int = CENTRAL_ROUNDS) -> np.ndarray:
    """Rank of each sentence by a walk between sentences that share words; ``words`` are numbers, ``owners`` their sentences.

    The walk goes on by the cosine of the sets of words, a sentence with itself included, and starts anew with
    probability ``1 - DAMPING``. A sentence without words has no rank (nan) and takes no part.
    """
    _, column = np.unique(words, return_inverse=True)
    present = np.zeros((sentences, int(column.max(initial=-1)) + 1))
    present[owners, column] = 1.0
    size = present.sum(axis=1)
    live = size > 0
    ranks = np.full(sentences, np.nan)
    if live.any():
        unit = present[live] / np.sqrt(size[live])[:, None]
        similar = unit @ unit.T
        steps = similar / similar.sum(axis=1)[:, None]
        rank = np.full(len(unit), 1.0 / len(unit))
        for _ in range(rounds):
            rank = (1 - DAMPING) / len(unit) + DAMPING * (rank @ steps)
        ranks[live] = np.round(rank, 6)
    return ranks


def _central_positions(most: int):
    """For each list of sentences, each a list of words, the positions of the ``most`` central ones, ascending."""

    @F.arrow_udf("array<int>")
    def positions(texts: pa.Array) -> pa.Array:
        lists = texts.flatten()  # of a null text there are none
        codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        per_text = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        per_sentence = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(per_sentence)])
        first, found = 0, []
        for n in per_text:
            lengths = per_sentence[first : first + n]
            words = codes[ends[first] : ends[first + n]]
            ranks = centrality(words, np.repeat(np.arange(n), lengths), int(n))
            order = np.argsort(-ranks, kind="stable")  # nan comes last, ties in order
            found.append(sorted(int(i) for i in order[:most] if not np.isnan(ranks[i])))
            first += n
        return pa.array(found, pa.list_(pa.int32()))

    return positions


def central_summary(content: Column, max_chars: int = MAX_CHARS, max_sentences: int = MAX_SENTENCES) -> Column:
    """The sentences most central among all of the text's first ``max_chars`` characters, in order; null without sentences.

    Ties go to the earlier sentence. The bound on the text bounds the graph, which stays inside the row: words cross to
    Python in Arrow batches and positions come back.
    """
    listed = text.sentences(F.substring(content, 1, max_chars))
    best = _central_positions(max_sentences)(F.transform(listed, text.tokens))
    return _shown(F.transform(best, lambda i: F.get(listed, i)))


def with_summary(articles: DataFrame, summaries: DataFrame, key: str = "article_id") -> DataFrame:
    """Articles with their stripped summary; the failure text where there is none."""
    return articles.join(summaries, key, "left").withColumn("summary", summary_or_failed(F.col("summary")))


def summary_or_failed(summary: Column) -> Column:
    return F.coalesce(text.strip(summary), F.lit(SUMMARY_FAILED))
