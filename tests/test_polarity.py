"""Learned polarity against plain Python, and on planted words."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from claimspark.operators import polarity


def signed(sentence):
    words = re.findall(r"[^\W_]+", sentence.lower())
    return [(w, -1 if set(words[max(0, i - polarity.SCOPE) : i]) & set(polarity.NEGATIONS) else 1) for i, w in enumerate(words)]


def brute_weights(texts):
    sides, plus, minus = Counter(), Counter(), Counter()
    for content in texts:
        for sentence in re.split("[.!?]+", content or ""):
            words = signed(sentence)
            found = {polarity.SEEDS[w] * s for w, s in words if w in polarity.SEEDS}
            sides.update(found)
            for word, sign in set(words):
                if word not in polarity.SEEDS and word not in polarity.NEGATIONS:
                    plus[word] += sign in found
                    minus[word] += -sign in found
    k = polarity.SMOOTHING
    weights = {w: math.log2((plus[w] + k) * (sides[-1] + 1) / ((minus[w] + k) * (sides[1] + 1))) for w in plus}
    return {w: v for w, v in weights.items() if plus[w] + minus[w] >= polarity.MIN_COUNT and abs(round(v, 6)) >= polarity.MIN_WEIGHT}


GOOD, BAD = [f"good{i}" for i in range(12)], [f"bad{i}" for i in range(12)]
PLAIN = [f"plain{i}" for i in range(40)]


def article(draw, mood, seeded):
    """Sentences of words of one mood; a quarter is negated, with words and seed of the other mood behind the negation."""
    out = []
    for _ in range(10):
        negated = draw.random() < 0.25
        side = mood != negated
        words = [draw.choice(GOOD if side else BAD), draw.choice(GOOD if side else BAD)]
        seed = [draw.choice([t for t, s in polarity.SEEDS.items() if (s > 0) == side])] if seeded else []
        head = draw.sample(PLAIN, 3)
        out.append(" ".join(head + (["not"] if negated else []) + seed + words))
    return ". ".join(out)


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(3)
    rows = [(i, i % 2 == 0, article(draw, i % 2 == 0, seeded=i < 300)) for i in range(400)]
    return rows, spark.createDataFrame(rows, "article_id long, mood boolean, content string").repartition(4)


def test_weights_equal_brute_force(spark, planted):
    rows, df = planted
    extra = [(1000, True, None), (1001, True, ""), (1002, True, "no not nicht. with!? with with good0 not good0")]
    both = df.union(spark.createDataFrame(extra, df.schema))
    expected = brute_weights([r[2] for r in rows + extra])
    got = {r["token"]: r["weight"] for r in polarity.learn(both).collect()}
    assert got == pytest.approx(expected, abs=2e-6)
    assert all(got[w] > 0 for w in GOOD) and all(got[w] < 0 for w in BAD)


def test_mood_of_articles_held_out(spark, planted):
    """Weights of 300 articles tell the mood of 100 others, which have no seed; without scope of negations they do worse."""
    rows, df = planted
    weights = polarity.learn(df.where("article_id < 300"))
    found = {r["article_id"]: r for r in polarity.learned_sentiment(df.where("article_id >= 300"), weights).collect()}
    assert len(found) == 100
    agree = sum((found[i]["positive"] > found[i]["negative"]) == mood for i, mood, _ in rows if i >= 300)
    named = sum(found[i]["sentiment"] == ("positive" if mood else "negative") for i, mood, _ in rows if i >= 300)
    assert agree >= 98 and named >= 95


def test_sides_equal_brute_force(spark, planted):
    rows, _ = planted
    weights = {"good0": 1.25, "bad0": -2.0, "plain0": 0.1}
    table = spark.createDataFrame(list(weights.items()), "token string, weight double")
    extra = [(1000, None), (1001, ""), (1002, "not good0 bad0 x y good0. bad0"), (1003, "nothing")]
    texts = [(i, t) for i, _, t in rows[:40]] + extra
    got = polarity.learned_sentiment(spark.createDataFrame(texts, "article_id long, content string"), table)
    expected = {}
    for i, content in texts:
        sides = defaultdict(float)
        for sentence in re.split("[.!?]+", content or ""):
            for word, sign in signed(sentence):
                value = weights.get(word, 0.0) * sign
                sides[value > 0] += abs(value)
        expected[i] = (sides[True], sides[False])
    shown = {r["article_id"]: r for r in got.collect()}
    assert {i: (r["positive"], r["negative"]) for i, r in shown.items()} == {i: pytest.approx(v, abs=1e-9) for i, v in expected.items()}
    assert [shown[i]["sentiment"] for i in (1000, 1001, 1003)] == ["neutral"] * 3
    assert shown[1002]["positive"] == pytest.approx(3.25) and shown[1002]["negative"] == pytest.approx(3.25)
    assert shown[1002]["sentiment"] == "mixed"


def test_many_weights_and_few_give_the_same_sides(spark, planted, monkeypatch):
    """Few weights shuffle sides only, many also the words, as counted inside their text."""
    rows, df = planted
    texts = df.where("article_id < 60").select("article_id", "content").union(spark.createDataFrame([(1000, None), (1001, "not good0 good0")], "a long, c string"))
    table = spark.createDataFrame([("good0", 1.25), ("bad0", -2.0), ("not", 0.5)], "token string, weight double")
    found = []
    for limit, exchanges in ((10, 2), (2, 4)):  # two of them join the sides to the articles
        monkeypatch.setattr(polarity, "BROADCAST_WEIGHTS", limit)
        out = polarity.learned_sentiment(texts, table)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= exchanges
        found.append(sorted(map(str, out.collect())))
    assert found[0] == found[1] and len(found[0]) == 62


def test_empty_table(spark):
    empty = spark.createDataFrame([], "article_id long, content string")
    assert polarity.learn(empty).count() == 0
    assert polarity.learned_sentiment(empty, polarity.with_seeds(polarity.learn(empty))).count() == 0


def test_a_sentence_without_end_takes_linear_time(spark):
    """Quadratic work would take many minutes here."""
    content = "good0 with not bad0 " * 100_000
    df = spark.createDataFrame([(1, content)], "article_id long, content string")
    started = time.perf_counter()
    found = polarity.learned_sentiment(df, polarity.with_seeds(polarity.learn(df))).first()
    assert time.perf_counter() - started < 60
    assert found["positive"] == 2 and found["negative"] == 199_998  # all seeds but the first stand after a negation
