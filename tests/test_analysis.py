import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimspark.operators import classify, enrich, prompts, responses, retrieval, stats, themes
from claimspark.schemas import ANALYSED, CATEGORIES, CLASSIFICATION_FAILED, FIELDS_DEFAULTED, SUMMARY_FAILED

FULL = {
    "classification": "Health", "confidence": "high", "key_themes": ["a", "b"],
    "analysis_notes": "n", "sentiment": "mixed", "credibility_score": 0.7,
}
FAILED = (False, "Other", "low", [], CLASSIFICATION_FAILED, "neutral", 0.3)


def without(*names, **changed):
    return json.dumps({**{k: v for k, v in FULL.items() if k not in names}, **changed})


def parse(spark, response):
    df = spark.createDataFrame([(1, response)], "article_id INT, response STRING")
    row = responses.parse_responses(df).first()
    return tuple(row[2:])


def test_parse_complete(spark):
    assert parse(spark, json.dumps(FULL)) == (True, "Health", "high", ["a", "b"], "n", "mixed", 0.7)
    assert parse(spark, without(classification="Sports"))[1] == "Sports"
    assert parse(spark, f"Yes:\n```json\n{json.dumps(FULL)}\n```\nok")[1] == "Health"


def test_parse_repairs_only_incomplete_objects(spark):
    assert parse(spark, without("sentiment")) == (True, "Health", "high", ["a", "b"], "n", "neutral", 0.7)
    assert parse(spark, without("sentiment", confidence=None))[2] == "medium"
    assert parse(spark, without(confidence=None))[2] is None
    assert parse(spark, "{}") == (True, "Other", "medium", [], FIELDS_DEFAULTED, "neutral", 0.5)


@pytest.mark.parametrize(
    "response",
    [None, "", "  \n", "[1]", "null", "3", '"x"', "{bad", "{'a': 1}", '```json\n{"a":1} more\n```', "no json"],
)
def test_parse_failures(spark, response):
    assert parse(spark, response) == FAILED


def test_enrich_retries_isolates_and_waits(spark, tmp_path):
    log = str(tmp_path / "waits")

    def make():
        tries = Counter()

        def fn(row):
            tries[row["id"]] += 1
            if row["id"] == 1 and tries[1] < 3 or row["id"] == 2:
                raise RuntimeError("down")
            return {"answer": f"a{row['id']}"}

        return fn

    def sleep(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    df = spark.range(4).coalesce(1)
    got = enrich.enrich(df, make, "answer STRING", {"answer": "none"}, sleep=sleep, pause=0.25)
    rows = {r.id: (r.answer, r.ok, r.attempts, r.error) for r in got.collect()}
    assert rows[0] == ("a0", True, 1, None)
    assert rows[1] == ("a1", True, 3, None)
    assert rows[2] == ("none", False, 3, "RuntimeError: down")
    assert rows[3] == ("a3", True, 1, None)
    waits = [float(w) for w in open(log).read().split()]
    assert sorted(waits) == [0.25, 0.25, 0.25, 1.0, 1.0, 2.0, 2.0]


def test_enrich_bounds_callers(spark):
    def make():
        return lambda row: {}

    got = enrich.enrich(spark.range(100), make, "x STRING", {}, callers=2)
    assert got.rdd.getNumPartitions() == 2


def analysed(spark, *rows):
    names = ANALYSED.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ANALYSED)


def test_summary_statistics(spark):
    df = analysed(
        spark,
        {"classification": "Other", "analysis_notes": CLASSIFICATION_FAILED, "confidence": "low", "credibility_score": 0.3},
        {"classification": "Other", "analysis_notes": "fine", "sentiment": "mixed", "overall_fact_status": "Fact"},
        {"classification": "Health", "analysis_notes": CLASSIFICATION_FAILED, "credibility_score": 1.0},
        {"classification": "Sports", "overall_fact_status": "Myth"},
    )
    row = stats.analysis_summary(df).first()
    assert (row.total_articles, row.successful_analyses) == (4, 3)
    assert row.classification_counts == {**dict.fromkeys(CATEGORIES, 0), "Other": 2, "Health": 1}
    assert row.fact_status_counts == {"Fact": 1, "Myth": 1, "Unsure": 0}
    assert row.average_credibility_score == pytest.approx(0.575)
    flow = stats.workflow_summary(df).first()
    assert (flow.total_articles_processed, flow.successful_analyses, flow.failed_analyses) == (4, 3, 1)
    counts = stats.classification_counts(df).orderBy("position").collect()
    assert [r.value for r in counts] == CATEGORIES and sum(r.n for r in counts) == 3


def test_statistics_of_nothing(spark):
    assert stats.analysis_summary(analysed(spark)).count() == 0
    assert stats.workflow_summary(analysed(spark)).count() == 0
    assert [r.n for r in stats.sentiment_counts(analysed(spark)).collect()] == [0] * 4


def joined_columns(plan):
    """The columns that reach any join of an optimized plan."""
    children = plan.children()
    below = [children.apply(i) for i in range(children.size())]
    found = set().union(*map(joined_columns, below))
    if plan.nodeName() == "Join":
        found |= {c.output().apply(i).name() for c in below for i in range(c.output().size())}
    return found


def test_workflow_summary_joins_no_texts(spark, small):
    from claimspark.plans import queries

    out = queries.REGISTRY["workflow_summary"](spark, small)
    columns = joined_columns(out._jdf.queryExecution().optimizedPlan())
    assert {"claims", "succeeded"} <= columns and not columns & {"summary", "text", "analysis_notes", "response"}


def test_metrics(spark):
    rows = [("Fact", "s"), ("Myth", SUMMARY_FAILED), (None, None)]
    df = spark.createDataFrame(rows, "fact_myth_status STRING, summary STRING")
    row = stats.summary_metrics(df).first()
    assert (row.total, row.facts, row.myths, row.unclear) == (3, 1, 1, 0)
    assert (row.facts_percent, row.success_percent) == (33.3, 66.7)
    empty = stats.summary_metrics(df.limit(0)).first()
    assert (empty.total, empty.facts_percent, empty.success_percent) == (0, 0.0, 0.0)


def results(*statuses):
    return F.array(*[F.struct(F.lit(s).alias("status")) for s in statuses])


@pytest.mark.parametrize(
    ("statuses", "confidence", "score"),
    [
        (["Fact", "Unsure"], "high", 0.75),
        (["Myth", "Unsure", "Unsure"], "medium", 0.333),
        (["Unsure"], "low", 0.5),
        (["Fact", "Fact"], "high", 1.0),
    ],
)
def test_confidence_and_credibility(spark, statuses, confidence, score):
    r = results(*statuses)
    row = spark.range(1).select(classify.confidence(r).alias("c"), classify.credibility(r).alias("s")).first()
    assert (row.c, row.s) == (confidence, score)


def test_category_and_sentiment(one):
    lexicon = {"Health": {"pill": 1.0}, "Seed ownership": {"seed": 1.0, "patent": 2.0}}
    got = one(lambda c: classify.category(c, lexicon), ["Seed patent pill", "pill, SEED", "none", "", "pill pill pill patent"])
    assert got == ["Seed ownership", "Health", "Other", "Other", "Health"]
    polar = {"good": 1, "bad": -1}
    moods = one(lambda c: classify.sentiment(c, polar), ["good", "bad bad good", "good bad", "so so", "good good bad bad bad"])
    assert moods == ["positive", "negative", "mixed", "neutral", "mixed"]
    with pytest.raises(ValueError):
        classify.category(F.lit("x"), {"Health": {str(i): 1.0 for i in range(6000)}})


def docs(spark):
    texts = ["the cat sat", "the dog sat on the cat", "the the the", "", "zebra cat zebra", "dog"] * 3
    return spark.createDataFrame(list(enumerate(texts)), "article_id BIGINT, text STRING"), texts


def test_themes_equal_plain_python(spark, monkeypatch):
    df, texts = docs(spark)
    bags = [Counter(t.split()) for t in texts]
    found = Counter(t for b in bags for t in b)
    expected = {}
    for i, bag in enumerate(bags):
        weight = {t: round(tf * (math.log((len(texts) + 1) / (found[t] + 1)) + 1), 6) for t, tf in bag.items()}
        if bag:
            expected[i] = sorted(bag, key=lambda t: (-weight[t], t))[:2]
    for share in (200, 2):  # all tokens hot, and a mix of hot and cold ones
        monkeypatch.setattr(themes, "HOT_SHARE", share)
        got = {r.article_id: r.key_themes for r in themes.key_themes(df, "article_id", "text", 2).collect()}
        assert got == expected


def test_search_equals_plain_python(spark):
    df, texts = docs(spark)
    topics = ["cat zebra", "the", "absent"]
    bags = [Counter(t.split()) for t in texts]
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    expected = set()
    for topic in topics:
        scores = {}
        for i, bag in enumerate(bags):
            for t in set(topic.split()) & set(bag):
                n = sum(t in b for b in bags)
                idf = math.log(1 + (len(bags) - n + 0.5) / (n + 0.5))
                tf = bag[t]
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
        best = sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:4]
        expected |= {(topic, rank, i) for rank, i in enumerate(best, 1)}
    table = spark.createDataFrame([(t,) for t in topics], "topic STRING")
    got = {(r.topic, r["rank"], r.article_id) for r in retrieval.search_topk(table, df, k=4).collect()}
    assert got == expected


def test_search_limits_ranks_before_the_shuffle(spark):
    df, _ = docs(spark)
    table = spark.createDataFrame([("cat",)], "topic STRING")
    plan = retrieval.search_topk(table, df, k=4)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit \[topic.*Partial", plan)


def test_prompts(spark):
    row = spark.range(1).select(
        prompts.summary_prompt(F.lit("http://u"), F.lit(None).cast("string"), F.lit("x" * 4000)).alias("s"),
        prompts.classification_prompt(
            F.lit("http://u"), F.lit("T"), F.lit("S"), F.lit("Fact"),
            F.array(*[
                F.struct(F.lit(f"{i}" * 150).alias("claim"), F.lit("Fact").alias("status"),
                         F.lit("True").alias("rating"), F.lit("P").alias("publisher"))
                for i in range(5)
            ]),
        ).alias("c"),
        prompts.classification_prompt(
            F.lit("u"), F.lit("T"), F.lit("S"), F.lit("Fact"),
            F.array().cast("array<struct<claim:string,status:string,rating:string,publisher:string>>"),
        ).alias("bare"),
    ).first()
    assert "Title: Untitled\n" in row.s and "x" * 3000 + "\n" in row.s and "x" * 3001 not in row.s
    assert "1. Claim: " + "0" * 100 + "...\n   Status: Fact (Rating: True)\n   Publisher: P\n\n2." in row.c
    assert "3. Claim" in row.c and "4. Claim" not in row.c
    assert '"credibility_score": 0.5\n        }' in row.c and "Other" in row.c
    assert "Fact-check Results" not in row.bare


def test_quality_of_held_out_rows(spark):
    """Nine of ten and more of the held-out labels of either side are found; other folds' rows teach."""
    from claimspark.plans.queries import REGISTRY

    folder = "/root/testdata/sf0.01"
    out = REGISTRY["classify_ml"](spark, folder).where("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    rows = [(r.quality, r.predicted) for r in out.join(labels, "doc_id").collect()]
    for quality, name in ((0, "doubtful"), (1, "credible")):
        found = [p == name for q, p in rows if q == quality]
        assert len(found) > 10 and sum(found) >= 0.9 * len(found)


def test_surface_of_awkward_texts(spark):
    texts = [None, "", "Ab1. #", "a a\na a\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    columns = classify.surface(F.col("t"))
    rows = df.withColumns(columns).orderBy("i").collect()
    assert all(rows[0][c] == 0 for c in columns)
    assert rows[1]["_letters"] == 0 and rows[1]["_word_length"] == 0
    assert rows[2]["_letters"] == 2 / 6 and rows[2]["_capitals"] == rows[2]["_digits"] == rows[2]["_symbols"] == 1 / 6
    assert rows[3]["_distinct_words"] == 2 / 5 and rows[3]["_distinct_lines"] == 2 / 3


def test_classifier_on_words(spark):
    rows = [(i, f"{'soil seed crop' if i % 2 else 'vote law court'} text{i % 7}", "farm" if i % 2 else "state") for i in range(80)]
    df = spark.createDataFrame(rows, "i INT, t STRING, label STRING")
    model = classify.train_classifier(df.where("i < 60"), "t", "label")
    out = classify.predict(model, df.where("i >= 60").select("i", "t"), ["i"], "predicted").collect()
    assert all(r.predicted == ("farm" if r.i % 2 else "state") for r in out)
