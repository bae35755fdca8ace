"""Claims of an article: its long sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

MIN_CHARS = 20
MAX_CLAIMS = 5


def claim_list(summary: Column, max_claims: int | None = MAX_CLAIMS) -> Column:
    """Sentences longer than 20 characters; the whole text if there is none; the first five."""
    long = F.filter(text.sentences(summary), lambda s: F.length(s) > MIN_CHARS)
    chosen = text.bind(long, lambda s: F.when(F.size(s) == 0, F.array(summary)).otherwise(s))
    return chosen if max_claims is None else F.slice(chosen, 1, max_claims)


def explode_claims(df: DataFrame, key: str, claims: Column) -> DataFrame:
    """``key, pos, claim``, one row per claim, ``pos`` from 0.

    Takes the list as an expression: for a generator over a plain column the optimizer adds a
    filter for empty lists below it, which would split the text a second time.
    """
    return df.select(key, F.posexplode(claims).alias("pos", "claim"))
