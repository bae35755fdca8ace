"""Counts inside a row, and look-ups of which only the rare part is shuffled."""

from collections import Counter

from pyspark.sql import functions as F

from claimspark.operators import counted, themes
from claimspark.session import written

SHUFFLE = "Exchange hashpartitioning"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_key_are_counted_together_and_others_without_a_shuffle(spark):
    rows = [(1, "a b a"), (2, "c"), (2, "c a"), (None, "a a"), (None, "a b"), (3, None), (4, "")]
    expected = {1: "a b a", 2: "c c a", None: "a a a b"}
    schema = "id long, t string"
    words = F.filter(F.split("t", " "), lambda w: w != "")
    got = counted.row_terms(spark.createDataFrame(rows, schema), ["id"], words).collect()
    assert sorted(got, key=str) == sorted(((k, t, n) for k, x in expected.items() for t, n in Counter(x.split()).items()), key=str)
    single = counted.row_terms(spark.createDataFrame(rows[:2], schema), ["id"], words)
    assert len(single.collect()) == 3 and "Exchange" not in plan(single)


def test_lookup_broadcasts_the_highest_values_and_loses_none(spark):
    terms = spark.createDataFrame([(i, f"t{j}") for i in range(20) for j in range(i)], "id long, term string")
    lookup = written(spark.createDataFrame([(f"t{j}", 2**j) for j in range(0, 20, 2)], "term string, v long"))
    for rows in (0, 3, 10):
        common = counted.first_values(lookup, "v", rows)
        assert lookup.where(common).count() == rows
        got = counted.looked_up(terms, lookup, "term", common)
        assert sorted(map(tuple, got.collect())) == sorted((f"t{j}", i, 2**j) for i in range(20) for j in range(0, i, 2))


def test_themes_and_phrases_shuffle_only_ranked_rows(spark):
    texts = [(i, f"one two three four five {i % 7}") for i in range(40)]
    df = written(spark.createDataFrame(texts, "article_id long, content string"))
    for out in (themes.key_themes(df, keep=written), themes.key_phrases(df, written)):
        assert plan(out).count(SHUFFLE) == 1
