import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimspark.operators import export, publish, scrape, store
from claimspark.plans import analysis
from claimspark.schemas import ANALYSED
from claimspark.sources import tables
from claimspark.streaming import ingest

ARTICLE = "article_id BIGINT, url STRING, title STRING, summary STRING, classification STRING, fact_myth_status STRING"


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), ARTICLE)


def test_store_upserts_and_reads(spark, tmp_path):
    base = str(tmp_path / "store")
    store.init_store(spark, base)
    store.init_store(spark, base)
    assert store.read_log(spark, base, store.ARTICLES).count() == 0
    first = batch(
        spark,
        (1, "http://a", "Gmo", "s", "Health", "Fact"),
        (2, "http://b", None, None, None, None),
        (3, None, "no url", "s", "Other", "Myth"),
        (4, "http://c", "old", "s", "Other", "Unclear"),
    )
    second = batch(spark, (4, "http://c", "new", "about gmo", "Health", "Myth"))
    counts = store.upsert_counts(first).first()
    assert (counts.received, counts.saved, counts.refused) == (4, 3, 1)
    for _ in range(2):  # a repeated run replaces its own folder
        store.save_articles(first, base, "r1", at("2024-01-01 10:00:00"))
        store.save_session(first, base, "r1", "gmo", at("2024-01-01 10:00:00"))
    store.save_articles(second, base, "r2", at("2024-01-02 10:00:00"))
    store.save_session(second, base, "r2", "seeds", at("2024-01-02 10:00:00"))

    log = store.read_log(spark, base, store.ARTICLES)
    assert log.count() == 4
    current = store.current_articles(log)
    rows = {r.url: r for r in current.collect()}
    assert set(rows) == {"http://a", "http://b", "http://c"}
    assert (rows["http://c"].title, rows["http://c"].created_at) == ("new", datetime(2024, 1, 2, 10))
    assert (rows["http://b"].title, rows["http://b"].fact_myth_status) == ("", "")

    assert [r.url for r in store.recent_articles(current, 2).collect()] == ["http://c", "http://a"]
    found = lambda topic: [r.url for r in store.articles_by_topic(current, topic).collect()]
    assert found("GMO") == ["http://c", "http://a"]
    assert len(found("%")) == len(found("")) == 3
    assert found("a_out") == ["http://c"]
    assert found("\\") == []

    sessions = store.read_log(spark, base, store.SESSIONS)
    latest = store.recent_sessions(sessions, 1).first()
    assert (latest.topic, latest.articles_found, latest.myths_count) == ("seeds", 1, 1)
    assert [r.timestamp for r in store.history_tail(sessions).collect()] == ["2024-01-02T10:00:00", "2024-01-01T10:00:00"]
    stats = {(r.stat, r.value): r.n for r in store.database_stats(current, sessions).collect()}
    assert stats == {
        ("total_articles", None): 3, ("total_sessions", None): 2,
        ("classification", "Health"): 2, ("classification", ""): 1,
        ("fact_myth_status", "Fact"): 1, ("fact_myth_status", ""): 1, ("fact_myth_status", "Myth"): 1,
    }


def test_statistics_of_an_empty_store(spark, tmp_path):
    base = str(tmp_path)
    store.init_store(spark, base)
    articles, sessions = (store.read_log(spark, base, n) for n in (store.ARTICLES, store.SESSIONS))
    stats = {(r.stat, r.value): r.n for r in store.database_stats(store.current_articles(articles), sessions).collect()}
    assert stats == {("total_articles", None): 0, ("total_sessions", None): 0}


def test_hot_url_is_cut_before_the_shuffle(spark):
    rows = [(i, "http://hot" if i % 3 else f"http://{i}", "t", "s", "c", "f") for i in range(900)]
    log = store.article_rows(batch(spark, *rows), at("2024-01-01"))
    current = store.current_articles(log)
    assert current.count() == 301
    assert current.where("url = 'http://hot'").first().seq == 899
    assert "Partial" in current._jdf.queryExecution().executedPlan().toString()


def published(spark, **changes):
    item = dict(
        article_id=1, url="http://a", title="T", content="c" * 2001, summary="s", key_claims=["a", "", None, "b"],
        fact_myth_status="fact", classification="seed OWNERSHIP ", confidence=None, analysis_date=None,
    )
    item.update(changes)
    schema = (
        "article_id BIGINT, url STRING, title STRING, content STRING, summary STRING, key_claims ARRAY<STRING>, "
        "fact_myth_status STRING, classification STRING, confidence STRING, analysis_date STRING"
    )
    df = spark.createDataFrame([tuple(item.values())], schema)
    return publish.publish_rows(df, at("2024-03-01 12:00:00")).first().asDict()


def test_publish_row(spark):
    row = published(spark)
    assert (row["Claims"], len(row["Content"])) == ("a, b", 2000)
    assert (row["Fact Status"], row["Classification"], row["Confidence"]) == ("Fact", "Seed ownership", "Medium")
    assert row["Analysis Date"] == "2024-03-01"
    row = published(
        spark, fact_myth_status="Unsure", classification=None, confidence=" HIGH ", summary=" ", url=None,
        title=None, key_claims=[], analysis_date="2024-02-02",
    )
    assert (row["Fact Status"], row["Classification"], row["Confidence"]) == ("Unclear", "Other", "High")
    assert (row["Title"], row["URL"], row["Analysis Date"]) == ("Untitled", "", "2024-02-02")
    kept = json.loads(row["properties"])
    assert "Summary" not in kept and "Claims" not in kept and kept["URL"] == ""
    assert published(spark, fact_myth_status=" MYTH ")["Fact Status"] == "Myth"


def test_publish_targets(spark, tmp_path):
    rows = spark.createDataFrame([(1, "T")], "article_id INT, Title STRING")
    base = str(tmp_path)
    assert publish.write_publish_rows(rows, None, "r") is None
    each = publish.write_publish_rows(rows, base + "/each", "topic_1")
    assert each.endswith("/run=topic_1") and spark.read.json(each).count() == 1
    for _ in range(2):
        fixed = publish.write_publish_rows(rows, base + "/fixed", "r", folder_each_run=False)
    assert spark.read.json(fixed).count() == 2
    schema = publish.target_schema(spark)
    assert schema.where("field = 'Classification'").count() == 9
    assert schema.select("field").distinct().count() == 9


def test_bridge(spark):
    df = spark.createDataFrame([("Unsure", ["c"]), ("Fact", [])], "overall_fact_status STRING, claims ARRAY<STRING>")
    assert [(r.fact_myth_status, r.key_claims) for r in publish.store_view(df).collect()] == [("Unclear", ["c"]), ("Fact", [])]


def test_run_name(spark):
    row = spark.range(1).select(publish.run_name(F.lit("gmo"), at("2024-03-01 01:02:03")).alias("r")).first()
    assert row.r == "gmo_20240301_010203"


def test_stage_files_and_exports(spark, tmp_path):
    when = datetime(2024, 3, 1, 1, 2, 3)
    rows = [
        (1, "u", "t", "é \"q\"\nline", None, ["a,b", 'c"d'], [], "Fact", "Health", "high", [], "n", "mixed", 0.5),
        (2, "v", None, "", "s", [], None, "Myth", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ANALYSED)
    path = export.write_stage(df, str(tmp_path), "analysed", when)
    assert path.endswith("analysed/run=20240301_010203")
    back = export.read_stage(spark, path, "analysed")
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    assert '"classification":null' in "".join(r.value for r in spark.read.text(path).collect())
    again = spark.read.schema(ANALYSED).json(export.export_json(df, str(tmp_path), when))
    assert sorted(again.collect()) == sorted(df.collect())
    csv = export.export_csv(df, str(tmp_path), when)
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(csv)
    assert got.columns == ANALYSED.fieldNames()
    first = got.where("article_id = 1").first()
    assert first.content == "é \"q\"\nline" and json.loads(first.claims) == ["a,b", 'c"d']


@pytest.fixture
def page_files(spark, small, tmp_path):
    tables.table(spark, small, "pages").repartition(3).write.json(str(tmp_path / "in"))
    return tmp_path


def test_stream_equals_batch_and_repeats_safely(spark, small, page_files):
    base, checkpoint = str(page_files / "store"), str(page_files / "checkpoint")
    reviews = tables.reviews(spark, small)

    def rules(checked, articles):
        return analysis.rule_columns(checked).withColumn("key_themes", F.array().cast("array<string>"))

    def analyse(scraped):
        return analysis.analyse_scraped(scraped, reviews, classify_articles=rules)

    def run():
        pages = ingest.read_pages(spark, str(page_files / "in"), files_per_batch=1)
        ingest.ingest(
            ingest.scraped_stream(pages), analyse, base, checkpoint, "pages", lambda b: at("2024-01-01")
        ).awaitTermination()

    run()
    run()  # nothing new: nothing is added
    log = store.read_log(spark, base, store.ARTICLES)
    assert log.select("run").distinct().count() == 3
    expected = publish.store_view(analyse(scrape.scrape(scrape.valid_urls(tables.pages(spark, small)))))
    columns = ["url", "title", "summary", "classification", "fact_myth_status"]
    assert sorted(log.select(columns).collect()) == sorted(expected.select(columns).collect())
    sessions = store.read_log(spark, base, store.SESSIONS)
    assert sessions.agg(F.sum("articles_found")).first()[0] == log.count()


def test_model_answers_plug_in(spark, small):
    """The composed plan with a model: prompts go out, answers come back and are parsed."""
    from claimspark.operators import enrich
    from claimspark.session import checkpointed

    def make():
        def ask(row):
            if row["article_id"] % 5 == 0:
                raise RuntimeError("no service")
            topic = "Health" if "Summary:" in row["prompt"] else "Other"
            return {"response": json.dumps({"classification": topic, "confidence": "high"})}

        return ask

    def ask(prompts):
        return checkpointed(enrich.enrich(prompts, make, "response STRING", {"response": None}, backoff=0))

    done = analysis.analyse_pages(
        tables.pages(spark, small), tables.reviews(spark, small), classify_articles=analysis.classified_by_model(ask)
    )
    assert [f.name for f in done.schema] == ANALYSED.fieldNames()
    counts = {bool(r.failed): r["count"] for r in done.groupBy((F.col("classification") == "Other").alias("failed")).count().collect()}
    ids = [r.article_id for r in done.select("article_id").collect()]
    assert counts == {True: sum(i % 5 == 0 for i in ids), False: sum(i % 5 != 0 for i in ids)}


def test_without_reviews_everything_is_unsure(spark, small):
    done = analysis.analyse_pages(tables.pages(spark, small), None)
    assert {r[0] for r in done.select("overall_fact_status").distinct().collect()} == {"Unsure"}
    assert done.where(F.size("claims") > 0).count() == 0
