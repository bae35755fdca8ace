import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimspark.operators import factcheck, joins
from claimspark.schemas import REVIEWS
from claimspark.sources import responses as service


def review(rid, claim, rating="True", publisher="P", site="s", url="u", date="d"):
    return (rid, claim, rating, publisher, site, url, date)


def articles(spark, *rows):
    return spark.createDataFrame(list(rows), "article_id BIGINT, summary STRING")


def test_rating_status(one):
    ratings = ["True", "TRUE", "fact", "False", "Mostly True", "True ", "", None]
    assert one(factcheck.rating_status, ratings) == ["Fact"] * 3 + ["Myth"] * 5


@pytest.mark.parametrize(
    ("counts", "status"),
    [
        ((0, 0, 0), "Unsure"), ((1, 0, 0), "Fact"), ((0, 2, 1), "Myth"), ((1, 1, 0), "Unsure"),
        ((2, 2, 1), "Unsure"), ((2, 1, 2), "Unsure"), ((3, 1, 1), "Fact"),
    ],
)
def test_vote(spark, counts, status):
    row = spark.range(1).select(factcheck.overall_status(*map(F.lit, counts)).alias("s")).first()
    assert row.s == status


def test_results_with_defaults_and_order(spark):
    known, bare, unknown = "The first claim is well known", "The second claim has a bare review", "Nobody looked at this third claim"
    reviews = spark.createDataFrame(
        [
            review(2, "the FIRST claim, is well known!", "False"),
            review(1, known, "Fact", "Desk", "desk.org", "http://r", "2024-01-01"),
            review(3, bare, None, None, None, None, None),
        ],
        REVIEWS,
    )
    row = factcheck.fact_check(articles(spark, (7, f"{unknown}. {bare}. {known}.")), reviews).first()
    assert row.claims == [unknown, bare, known]
    assert [tuple(r) for r in row.fact_check_results] == [
        (unknown, "Unsure", "No fact-check found", "None", "", "", "", "low"),
        (bare, "Myth", "Unknown", "Unknown", "", "", "", "high"),
        (known, "Fact", "Fact", "Desk", "desk.org", "http://r", "2024-01-01", "high"),
    ]
    assert row.overall_status == "Unsure"


def test_null_summary_and_no_reviews(spark):
    df = articles(spark, (1, None), (2, "A perfectly fine claim to check here."))
    empty = spark.createDataFrame([], REVIEWS)
    failed, checked = factcheck.fact_check(df, empty).orderBy("article_id").collect()
    assert (failed.claims, failed.fact_check_results, failed.overall_status) == ([], [], "Unsure")
    assert [r.status for r in checked.fact_check_results] == ["Unsure"]
    for row in factcheck.fact_check(df, None).collect():
        assert (row.claims, row.fact_check_results, row.overall_status) == ([], [], "Unsure")


def test_error_result(spark):
    row = spark.range(1).select(factcheck.error_result(F.lit("c")).alias("r")).first().r
    assert (row.claim, row.status, row.rating, row.confidence) == ("c", "Unsure", "Error occurred", "low")


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_fuzzy_equals_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))
    vocabulary = ["the", "of", "and"] * 4 + [f"w{i}" for i in range(25)]

    def sentence():
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))

    # A third of the claims are copies of one text, and every text holds frequent words.
    claim_texts = [sentence() for _ in range(120)] + ["the of and w1 w2"] * 60
    # Some reviews are claims with their words in another order, so all thresholds have hits.
    shuffled = [" ".join(rng.sample(c.split(), len(c.split()))) for c in claim_texts[:20]]
    review_texts = [sentence() for _ in range(60)] + ["the of and w1 w3", *shuffled]
    claim_df = spark.createDataFrame(list(enumerate(claim_texts)), "article_id BIGINT, claim STRING")
    claim_df = claim_df.select("article_id", F.lit(0).alias("pos"), "claim")
    review_df = spark.createDataFrame([review(i, t) for i, t in enumerate(review_texts)], REVIEWS)

    first_of = {}
    for rid, t in enumerate(review_texts):
        first_of.setdefault(t, rid)
    expected = {}
    for cid, c in enumerate(claim_texts):
        scores = [(-round(jaccard(c, t), 6), rid) for t, rid in first_of.items() if jaccard(c, t) >= threshold]
        if scores:
            score, rid = min(scores)
            expected[cid] = (rid, -score)
    got = factcheck.match_fuzzy(claim_df, review_df, "article_id", threshold)
    found = {r.article_id: (r.review.review_id, r.score) for r in got.collect()}
    assert found == expected
    assert len(expected) > 10


def test_hot_claim_is_split(spark):
    """Copies of one claim, a third of all rows and more, do not end in one task."""
    hot = "everybody repeats this very same claim"
    rows = [(i, hot if i % 3 else f"claim number {i} of its own kind") for i in range(3000)]
    left = spark.createDataFrame(rows, "article_id BIGINT, norm STRING")
    right = spark.createDataFrame([(hot, "r")], "norm STRING, review STRING")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.salted_join(left, right.hint("merge"), "norm", "article_id", salts=16)
        per_task = [n for n, in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(per_task) == 2000
        assert len(per_task) > 1 and max(per_task) < 1400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_counted_join_cuts_hot_keys_alone(spark, monkeypatch):
    """Cold keys have one row on the right, hot ones as many as their count needs; all ways give the same rows."""
    rows = [(i, "hot" if i % 3 else f"k{i % 40}" if i % 2 else None) for i in range(3000)]
    left = spark.createDataFrame(rows, "id BIGINT, k STRING")
    counts = Counter(k for _, k in rows if k)
    right = spark.createDataFrame([(k, n, k.upper()) for k, n in [*counts.items(), ("none", 0)]], "k STRING, n BIGINT, v STRING")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in ("inner", "left"):
            expected = sorted(left.join(right, "k", how).collect(), key=str)
            cut = joins.counted_join(left, right.hint("merge"), "k", "id", "n", how, slice_rows=100)
            assert cut.columns == ["k", "id", "n", "v"] and sorted(cut.collect(), key=str) == expected
            hot = cut.where("k = 'hot'").groupBy(F.spark_partition_id()).count().select("count").collect()
            assert len(hot) > 1 and sum(n for n, in hot) == 2000
            monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
            assert sorted(joins.counted_join(left, right, "k", "id", "n", how, slice_rows=100).collect(), key=str) == expected
            monkeypatch.undo()
            plain = joins.counted_join(left, right, "k", "id", "n", how)
            assert sorted(plain.collect(), key=str) == expected and "_salt" not in plain._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_lookup_join_beyond_its_bound(spark, monkeypatch):
    left = spark.createDataFrame([(i, f"k{i % 5}") for i in range(50)], "id BIGINT, k STRING")
    right = spark.createDataFrame([("k1",), ("k2",), ("k9",)], "k STRING")
    for how in ("inner", "left_semi"):
        small = joins.lookup_join(left, right, "k", "id", how)
        monkeypatch.setattr(joins, "is_small", lambda df: False)
        large = joins.lookup_join(left, right, "k", "id", how)
        monkeypatch.undo()
        assert sorted(small.collect()) == sorted(large.collect())
        assert small.count() == 20
    assert joins.is_small(right, 3) and not joins.is_small(right, 2)


def test_same_result_for_any_partitioning(spark):
    texts = [f"Claim {i % 7} is here for a good reason. Another statement numbered {i} stands." for i in range(60)]
    df = articles(spark, *enumerate(texts))
    reviews = spark.createDataFrame([review(i, f"claim {i} is here for a good reason") for i in range(3)], REVIEWS)
    results = []
    for parts in (1, 8):
        checked = factcheck.fact_check(df.repartition(parts), reviews)
        results.append(sorted((r.article_id, r.overall_status, str(r.fact_check_results)) for r in checked.collect()))
    assert results[0] == results[1]


def test_votes_add_up(spark, small):
    from claimspark.plans.queries import REGISTRY

    votes = REGISTRY["claim_votes"](spark, small).collect()
    assert all(1 <= v.claim_count <= 5 for v in votes)
    assert all(v.fact_count + v.myth_count + v.unsure_count == v.claim_count for v in votes)
    status = {r.value: r.n for r in REGISTRY["fact_status_counts"](spark, small).collect()}
    assert sum(status.values()) == len(votes)


def test_review_responses(spark):
    bodies = [
        (1, '{"claims":[{"claimReview":[{"textualRating":"TRUE","publisher":{"name":"N"}},{"textualRating":"x"}]}]}'),
        (2, '{"claims":[]}'),
        (3, "{}"),
        (4, '{"claims":[{"text":"no review"}]}'),
    ]
    df = spark.createDataFrame(bodies, "id INT, body STRING").withColumn("claim", F.lit("c"))
    got = [(r.status, r.rating, r.publisher) for r in service.review_results(df, "id", "claim").orderBy("id").collect()]
    assert got == [("Fact", "TRUE", "N")] + [("Unsure", "No fact-check found", "None")] * 3


def test_search_responses(spark):
    body = '{"organic":[{"link":"a"},{"title":"no link"},{"link":"c"},{"link":"d"}]}'
    df = spark.createDataFrame([("t", body), ("u", "{}"), ("v", None)], "topic STRING, body STRING")
    got = [(r.topic, r["rank"], r.url) for r in service.search_hits(df, "topic", k=3).collect()]
    assert got == [("t", 1, "a"), ("t", 3, "c")]
