"""Quality rules with cross-document line frequency.

Normalised lines are hashed with their host and counted in distinct documents. Lines above the
limits of their host are taken away; a document of which too little is left is depleted and
rejected, as is one that fails the base rules. DataFrame functions only; texts are read once and do
not move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import written
from .lines import SPACE_RUN, SPACES, line_key, normal, split_lines, trimmed
from .tables import ROW, plain

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "depleted", "kept",
)
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_DOCS = 20  # documents of a host that may share a line, ...
MAX_PER_MILLE = 5  # ... or that share of the host's documents, whichever is more
MIN_LEFT_PERCENT = 50  # of a document's words must be left


def _hashed_words(text: Column) -> Column:
    plain = trimmed(text)
    split = F.transform(F.split(plain, SPACE_RUN), lambda w: F.xxhash64(w))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(split)


def _windows(words: str) -> Column:
    last = F.size(words) - WINDOW
    run = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(last >= 0, run).otherwise(F.array().cast("array<bigint>"))


def base_measures(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``_lines``.

    Each step is a projection that the next one uses more than once, so nothing is computed twice.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    wordy = F.filter(split_lines(text), lambda line: trimmed(line) != "")
    out = docs.withColumn("_plain", plain).withColumns({"_words": _hashed_words(F.col("_plain")), "_wordy": wordy})
    out = out.withColumn("_windows", _windows("_words"))
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    several = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_placed", F.when(several, placed))
    same = lambda k, x: F.coalesce(F.get("_placed", k)["h"] == x["h"], F.lit(False))
    repeated = F.filter("_placed", lambda x, k: same(k - 1, x) | same(k + 1, x))
    out = out.withColumn("_at", F.array_sort(F.transform(repeated, lambda x: x["i"])))
    steps = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda n, s: n + s), F.lit(0))
    without = lambda chars: F.length(F.translate("_plain", chars, ""))
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": without(SPACES).cast("long"),
            "n_symbols": (F.length("_plain") - without(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_wordy") - F.size(F.array_distinct("_wordy"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
        }
    )


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    max_docs: int = MAX_DOCS,
    max_per_mille: int = MAX_PER_MILLE,
    min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """``docs`` less the text, with the measures, ``n_removed_words, base_failed, depleted, kept``.

    A null text has no words and fails, as does an empty one. Null hosts are one host. A line that
    a document repeats counts once for it, and is taken away wholly. Repeated rows are documents of
    their own. Columns of ``docs`` stay, but those named like a new one are replaced.
    """
    docs = plain(docs, *MEASURES, ROW)
    site = F.coalesce(F.col(host).cast("string"), F.lit("\x00null"))
    rows = base_measures(docs.withColumns({ROW: F.monotonically_increasing_id(), "_host": site}), text)
    lines = F.transform(
        "_wordy",
        lambda line: F.struct(
            line_key(F.col("_host"), normal(line)).alias("line"), F.size(F.split(trimmed(line), SPACE_RUN)).alias("words")
        ),
    )
    inner = [c for c in rows.columns if c.startswith("_") and c not in docs.columns and c not in (ROW, "_host")]
    rows = written(rows.withColumn("_lines", lines).drop(text, *inner))
    each = rows.select(ROW, F.explode("_lines").alias("x")).select(ROW, "x.line", "x.words")
    counts = (
        rows.select("_host", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["line"]))).alias("line"))
        .groupBy("line")
        .agg(F.count("*").alias("n"), F.first("_host").alias("_host"))
        .where(F.col("n") > max_docs)
    )
    hosts = rows.groupBy("_host").agg(F.count("*").alias("docs"))
    above = written(counts.join(hosts, "_host").where(F.col("n") * 1000 > F.col("docs") * max_per_mille).select("line"))
    removed = salted_join(each, above, "line", ROW).groupBy(ROW).agg(F.sum("words").alias("n_removed_words"))
    out = rows.drop("_lines", "_host").join(removed, ROW, "left").drop(ROW)
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "depleted": (left < MIN_WORDS) | (100 * left < min_left_percent * F.col("n_words"))})
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
