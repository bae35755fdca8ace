"""Streams with state: newest rows, late reviews, sessions."""

import datetime
import random
from collections import defaultdict

from pyspark.sql import functions as F

from claimspark.operators import store
from claimspark.schemas import ARTICLE_LOG
from claimspark.streaming import state

START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def arriving(spark, folder, schema, batches):
    """A stream that reads one file of ``batches`` after the other."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_newest_rows_pass_on_changes_only(spark, tmp_path):
    state.stateful(spark)
    draw = random.Random(3)
    rows = [("hot" if i % 3 else f"u{i % 11}", f"t{i}", "", "", "", None if i % 13 == 5 else at(draw.randrange(40)), i) for i in range(120)]
    rows.append((None, "no url", "", "", "", at(1), 500))
    shuffled = draw.sample(rows, len(rows))
    batches = [shuffled[:50], shuffled[50:80] + shuffled[:30], shuffled[80:], shuffled[::-1]]
    stream = arriving(spark, tmp_path / "in", ARTICLE_LOG, batches)
    out = str(tmp_path / store.ARTICLES)
    state.drained_changes(state.newest_rows(stream), out, str(tmp_path / "checkpoint"))
    log = store.read_log(spark, str(tmp_path), store.ARTICLES)
    emitted = defaultdict(list)
    for r in log.orderBy("run").collect():
        emitted[r["url"]].append((r["created_at"] or datetime.datetime.min, r["seq"]))
    assert all(x == sorted(set(x)) for x in emitted.values())  # each change is newer than the one before
    assert len(log.where("run = 'batch000000000003'").collect()) == 0  # a replay changes nothing
    newest = {}
    for r in rows:
        order = r[5] or datetime.datetime.min, r[6]
        if r[0] is not None and order > newest.get(r[0], (datetime.datetime.min, -1)):
            newest[r[0]] = order
    assert {u: x[-1] for u, x in emitted.items()} == newest
    whole = spark.createDataFrame(rows, ARTICLE_LOG).where("url is not null")
    assert sorted(map(str, store.current_articles(log).drop("run").collect())) == sorted(map(str, store.current_articles(whole).collect()))


def test_newest_rows_stay_out_of_python(spark, tmp_path):
    stream = arriving(spark, tmp_path / "in", ARTICLE_LOG, [[("u", "t", "", "", "", at(1), 1)]])
    plan = state.newest_rows(stream)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan
    assert not [n for n in ("Python", "Pandas", "PySpark", "Arrow") if n in plan]


def test_newest_rows_of_a_url_touched_by_older_rows(spark, tmp_path):
    """A url's state is touched in each batch, but its row comes out only when it changes, and is whole."""
    state.stateful(spark)

    def row(minutes, seq, title="t", url="u"):
        return url, title, f"summary {title}", None, "", None if minutes is None else at(minutes), seq

    batches = [
        [row(None, 9, "no time"), row(None, 3)],
        [row(5, 2, "first"), row(5, 1), row(4, 7)],
        [row(5, 1), row(None, 99), row(5, 2, "same rank, later")],
        [row(5, 3, "same time, higher seq"), row(1, 1, "other", "v")],
        [row(5, 2, "first"), row(0, 500, "other", "v")],
    ]
    stream = arriving(spark, tmp_path / "in", ARTICLE_LOG, batches)
    out = str(tmp_path / store.ARTICLES)
    query = state.drained_changes(state.newest_rows(stream), out, str(tmp_path / "checkpoint"))
    log = store.read_log(spark, str(tmp_path), store.ARTICLES)
    assert log.columns == [*ARTICLE_LOG.fieldNames(), "run"]
    passed = {(int(r["run"].removeprefix("batch")), *r[:7]) for r in log.collect()}
    changes = [(0, batches[0][0]), (1, batches[1][0]), (3, batches[3][0]), (3, batches[3][1])]
    assert passed == {(k, *r) for k, r in changes} and log.count() == len(changes)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # one a url, however many rows came


def test_newest_rows_with_a_ttl_are_those_without(spark, tmp_path):
    state.stateful(spark)
    draw = random.Random(7)
    rows = [(f"u{draw.randrange(9)}", f"t{i}", None, "", "", None if i % 7 == 5 else at(draw.randrange(40)), i) for i in range(90)]
    batches = [rows[:40], rows[30:70], rows[60:], rows[::-1]]
    stream = arriving(spark, tmp_path / "in", ARTICLE_LOG, batches)
    passed = []
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for ttl_ms in (None, 86_400_000):
            base = str(tmp_path / f"ttl-{ttl_ms}")
            state.drained_changes(state.newest_rows(stream, ttl_ms), f"{base}/{store.ARTICLES}", f"{base}/checkpoint")
            passed.append(sorted(map(str, store.read_log(spark, base, store.ARTICLES).collect())))
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert passed[0] == passed[1] and len(passed[0]) > 9


CLAIMS = "article_id long, pos int, claim string, claimed_at timestamp"
REVIEWS = "review_id long, claim_text string, textual_rating string, publisher string, publisher_site string, review_url string, review_date string, reviewed_at timestamp"


def test_reviews_may_come_after_their_claims(spark, tmp_path):
    state.stateful(spark)
    text = "The moon is made of {}"

    def review(number, thing, minutes, rating="True"):
        return number, text.format(thing).upper(), rating, None, None, None, None, at(minutes)

    claims = [
        [(1, 0, text.format("cheese"), at(0)), (1, 1, text.format("sand"), at(0)), (2, 0, "", at(5)), (3, 0, text.format("cheese"), at(6))],
        [(4, 0, text.format("iron"), at(300))],
        [(9, 0, "the last claim", at(5000))],
        [(5, 0, text.format("cheese"), at(1)), (9, 1, "the very last claim", at(9000))],  # the first is late
    ]
    reviews = [
        [(0, "nothing", None, None, None, None, None, at(0))],
        [review(8, "cheese", 30, "False"), review(7, "cheese!", 40), review(6, "sand", 90), review(3, "iron", 290)],
        [(1, "the last review", None, None, None, None, None, at(5000))],
        [(2, "the very last review", None, None, None, None, None, at(9000))],
    ]
    left, right = (arriving(spark, tmp_path / n, s, b) for n, s, b in (("claims", CLAIMS, claims), ("reviews", REVIEWS, reviews)))
    found = state.reviewed_claims(left, right, "60 minutes", "10 minutes", salts=3)
    query = state.drained(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    log = spark.read.parquet(str(tmp_path / "out"))
    results = {(r["article_id"], r["pos"]): (r["status"], r["rating"]) for r in state.claim_results(log).where("article_id < 9").collect()}
    none = "Unsure", "No fact-check found"
    # The review of sand comes after the wait; of two reviews the least id counts.
    assert results == {(1, 0): ("Fact", "True"), (1, 1): none, (2, 0): none, (3, 0): ("Fact", "True"), (4, 0): ("Fact", "True")}
    assert state.late_rows(query) >= 1


def test_sessions_end_after_a_gap(spark, tmp_path):
    state.stateful(spark)
    draw = random.Random(5)
    minutes = {"hot": sorted(draw.randrange(2000) for _ in range(300)), "edge": [0, 10, 20, 31, 39], "one": [7], None: [3]}
    rows = [(t, at(m), ("Fact", "Myth", "Unclear", None)[m % 4]) for t, ms in minutes.items() for m in ms]
    draw.shuffle(rows)
    batches = [rows[k::3] for k in range(3)]
    stream = arriving(spark, tmp_path / "in", "topic string, at timestamp, fact_myth_status string", [*batches, [("end", at(90_000), None)]])
    found = state.session_rows(stream, "topic", "at", "10 minutes", "3000 minutes")
    state.drained(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    expected = set()
    for t, ms in minutes.items():
        run = []
        for m in [*sorted(ms), None]:
            if run and (m is None or m - run[-1] > 10):
                counts = [sum(x % 4 == k for x in run) for k in range(3)]
                expected.add((t, at(run[0]), at(run[-1] + 10), len(run), *counts))
                run = []
            run.append(m)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == ["topic", "started", "ended", "articles_found", "facts_count", "myths_count", "unclear_count"]
    ntz = out.select("topic", F.col("started").cast("timestamp_ntz"), F.col("ended").cast("timestamp_ntz"), *out.columns[3:])
    assert {tuple(r) for r in ntz.collect()} == expected
