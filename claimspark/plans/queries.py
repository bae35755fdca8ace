"""One query per operator, over the given tables. `oracle.py` holds the SQL of the same names."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext, text
from ..operators import (
    answers,
    classify,
    claims,
    enrich,
    export,
    factcheck,
    index,
    pagetext,
    polarity,
    prompts,
    publish,
    responses,
    retrieval,
    scrape,
    stats,
    store,
    summarize,
    themes,
    truth,
)
from ..schemas import ARTICLE_LOG, CATEGORIES, CLAIM_STATUSES, CONFIDENCES, SENTIMENTS
from ..session import configure, shared_dir, shuffles_dropped, written
from ..sources import responses as service
from ..sources import tables
from ..streaming import ingest, state
from . import analysis

Query = Callable[[SparkSession, str], DataFrame]
KEY = "article_id"
RUN_TS = datetime(2024, 3, 1, 12, 30, 45)
TOPICS = ["license apache", "the and", "enlich mit", "para los", "anelle", "thhe onor inin", "unheard"]
PATTERNS = ["LICEN_E", "h%lich%ung", "an", "t_e", "a\\b", "Example.ORG/d", "%", "qzqzq"]
FUZZY_THRESHOLD = 0.5

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its name, less a trailing underscore that avoids a module's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    REGISTRY[fn.__name__.removesuffix("_")] = run
    return fn


def ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _run_ts() -> Column:
    return ntz(RUN_TS)


def _shown(c: str = "created_at") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _joined(c: str) -> Column:
    return F.array_join(c, " | ").alias(c)


# --- inputs that several queries share -------------------------------------------------------


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the text as content and as summary."""
    docs = tables.articles(spark, folder)
    return docs.select(
        KEY, "url", text.url_title(F.col("url")).alias("title"),
        F.col("text").alias("content"), F.col("text").alias("summary"),
    )


def _checked(spark: SparkSession, folder: str, max_claims: int | None = claims.MAX_CLAIMS) -> DataFrame:
    narrow = _articles(spark, folder).drop("content")
    return factcheck.fact_check(narrow, tables.reviews(spark, folder), max_claims=max_claims)


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return responses.parse_responses(tables.model_responses(spark, folder)).drop("response")


def _analysed(spark: SparkSession, folder: str, parsed: DataFrame | None = None) -> DataFrame:
    """Checked documents with the parsed answer of the model."""
    checked = _checked(spark, folder).withColumnRenamed("overall_status", "overall_fact_status")
    return publish.store_view(checked.join(_parsed(spark, folder) if parsed is None else parsed, KEY))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`_analysed` with a mark of success in place of the notes, which have the length of the text."""
    return _analysed(spark, folder, _parsed(spark, folder).withColumn(stats.SUCCEEDED, stats.succeeded()).drop("analysis_notes"))


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    """One session per source and language; its time comes from the last article."""
    topic = F.regexp_extract("url", "//(.*)/[^/]*$", 1)
    rows = _analysed(spark, folder).withColumn("topic", topic)
    at = F.timestamp_add("MINUTE", F.max(KEY), F.lit("2024-01-01").cast("timestamp_ntz"))
    return stats.session_stats(rows, "topic", created_at=at)


def _submitted(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs of articles: all documents, then every third again with other values.

    A third of the first run has one and the same url, and some urls are missing.
    """
    doc = F.col(KEY)
    url = F.when(doc % 50 == 7, None).when(doc % 3 == 1, "https://hot.example.org/news").otherwise(F.col("url"))
    status = F.when(doc % 4 == 0, "Fact").when(doc % 4 == 1, "Myth").when(doc % 4 == 2, "Unclear")
    first = _articles(spark, folder).select(
        KEY, url.alias("url"), "title", "summary",
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (doc % 9 + 1).cast("int")).alias("classification"),
        status.alias("fact_myth_status"),
        F.timestamp_add("SECOND", doc, F.lit("2024-01-01").cast("timestamp_ntz")).alias("at"),
    )
    second = first.where(doc % 3 == 0).select(
        KEY, "url", F.concat(F.lit("Update "), "title").alias("title"), "summary",
        F.lit("Health").alias("classification"), F.lit("Fact").alias("fact_myth_status"),
        F.timestamp_add("SECOND", doc % 1000, F.lit("2024-06-01").cast("timestamp_ntz")).alias("at"),
    )
    return first.unionByName(second)


def _current(spark: SparkSession, folder: str) -> DataFrame:
    log = store.article_rows(_submitted(spark, folder), F.col("at"))
    return store.current_articles(log)


# --- sources, scraping, text -----------------------------------------------------------------


@query
def search_topk(spark, folder):
    topics = spark.createDataFrame([(t,) for t in TOPICS], "topic STRING")
    return retrieval.search_topk(topics, tables.articles(spark, folder), k=10)


@query
def search_postings(spark, folder):
    """The rows of ``search_topk`` from an index that is built first."""
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    index.build_postings(tables.articles(spark, folder), path)
    topics = spark.createDataFrame([(t,) for t in TOPICS], "topic STRING")
    return index.search_postings(topics, path, written)[0]


@query
def valid_urls(spark, folder):
    return scrape.valid_urls(tables.page_links(spark, folder))


@query
def page_text(spark, folder):
    return scrape.page_text(tables.pages(spark, folder))


@query
def page_formatted(spark, folder):
    """Main text with headings kept; every third page has no article element, so density decides."""
    plain = F.regexp_replace("html", "<(/?)article>", "<$1div>")
    return pagetext.formatted_text(tables.pages(spark, folder).withColumn("html", F.when(F.col(KEY) % 3 == 1, plain).otherwise(F.col("html"))))


@query
def page_metadata(spark, folder):
    return scrape.page_metadata(tables.pages(spark, folder))


@query
def clean_content(spark, folder):
    docs = tables.articles(spark, folder)
    return docs.select(KEY, text.clean_content(F.col("text")).alias("content"))


@query
def url_title(spark, folder):
    return tables.pages(spark, folder).select(KEY, "url", text.url_title(F.col("url")).alias("title"))


@query
def scraped_articles(spark, folder):
    return scrape.scrape(tables.pages(spark, folder))


@query
def scrape_rejects(spark, folder):
    return scrape.scrape_rejects(tables.pages(spark, folder))


@query
def scrape_counts(spark, folder):
    return scrape.scrape_counts(tables.pages(spark, folder))


@query
def search_json(spark, folder):
    """Search responses with four hits per page url, one of them without a link."""
    link = F.col("url")
    hits = F.array(
        F.struct(link.alias("link")),
        F.struct(F.lit(None).cast("string").alias("link")),
        F.struct(F.concat(link, F.lit("?second")).alias("link")),
        F.struct(F.concat(link, F.lit("?third")).alias("link")),
    )
    bodies = tables.pages(spark, folder).select(
        KEY, F.to_json(F.struct(hits.alias("organic"))).alias("body")
    )
    return service.search_hits(bodies, KEY, k=3)


@query
def review_json(spark, folder):
    """Review responses built from the review table, some without a review or a claim."""
    review = F.struct(
        F.col("textual_rating").alias("textualRating"),
        F.col("review_url").alias("url"),
        F.col("review_date").alias("reviewDate"),
        F.struct(F.col("publisher").alias("name"), F.col("publisher_site").alias("site")).alias("publisher"),
    )
    rid = F.col("review_id")
    body = F.to_json(F.struct(F.array(F.struct(F.array(review).alias("claimReview"))).alias("claims")))
    body = (
        F.when(rid % 9 == 7, F.lit('{"claims": []}'))
        .when(rid % 9 == 8, F.lit('{"claims": [{"claimReview": []}]}'))
        .otherwise(body)
    )
    answers = tables.reviews(spark, folder).select("review_id", "claim_text", body.alias("body"))
    return service.review_results(answers, "review_id", "claim_text")


# --- summaries, prompts ----------------------------------------------------------------------


@query
def extractive_summary(spark, folder):
    summary = summarize.extractive_summary(F.col("content"))
    return _articles(spark, folder).select(KEY, summary.alias("summary"))


@query
def central_summary(spark, folder):
    summary = summarize.central_summary(F.col("content"))
    return _articles(spark, folder).select(KEY, summary.alias("summary"))


@query
def summary_fallback(spark, folder):
    """Two thirds of the articles have a model summary, a third none."""
    docs = _articles(spark, folder)
    model = docs.where(F.col(KEY) % 3 != 0).select(KEY, F.concat(F.lit(" \n"), "title", F.lit(" ")).alias("summary"))
    return summarize.with_summary(docs.select(KEY, "url"), model)


@query
def summary_prompt(spark, folder):
    docs = _articles(spark, folder)
    title = F.when(F.col(KEY) % 4 != 0, F.col("title"))
    return docs.select(KEY, prompts.summary_prompt(F.col("url"), title, F.col("content")).alias("prompt"))


@query
def classification_prompt(spark, folder):
    checked = _checked(spark, folder)
    prompt = prompts.classification_prompt(
        F.col("url"), F.col("title"), F.col("summary"), F.col("overall_status"), F.col("fact_check_results")
    )
    return checked.select(KEY, prompt.alias("prompt"))


# --- claims and fact check -------------------------------------------------------------------


@query
def claims_(spark, folder):
    docs = tables.articles(spark, folder)
    return claims.explode_claims(docs, KEY, claims.claim_list(F.col("text")))


@query
def claim_review_exact(spark, folder):
    hits = factcheck.match_exact(claims_(spark, folder), tables.reviews(spark, folder), KEY)
    return hits.select(KEY, "pos", "review.review_id")


@query
def claim_review_fuzzy(spark, folder):
    hits = factcheck.match_fuzzy(
        claims_(spark, folder), tables.reviews(spark, folder), KEY, FUZZY_THRESHOLD, keep=written
    )
    return hits.select(KEY, "pos", "review.review_id", "score")


@query
def claim_status(spark, folder):
    return factcheck.claim_results(_checked(spark, folder))


@query
def claim_votes(spark, folder):
    return factcheck.vote_counts(_checked(spark, folder))


@query
def claim_votes_all(spark, folder):
    """The vote over all sentences of an article instead of the first five."""
    return factcheck.vote_counts(_checked(spark, folder, None))


def _truth(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return truth.discover(truth.stands(tables.disputed_reviews(spark, folder)), written)


@query
def claim_truth(spark, folder):
    """What is believed of each claim that publishers dispute."""
    return _truth(spark, folder)[0]


@query
def publisher_weights(spark, folder):
    return _truth(spark, folder)[1].withColumn("weight", F.round("weight", 6))


def _shown_checks(checked: DataFrame) -> DataFrame:
    shown = F.transform("fact_check_results", lambda r: F.concat_ws("/", r["status"], r["rating"], r["publisher"]))
    return checked.select(
        KEY, "url", "title", _joined("claims"), F.array_join(shown, " | ").alias("results"), "overall_status"
    )


@query
def fact_checked(spark, folder):
    return _shown_checks(_checked(spark, folder))


# --- model-like columns ----------------------------------------------------------------------


@query
def classify_lexicon(spark, folder):
    return tables.articles(spark, folder).select(KEY, classify.category(F.col("text")).alias("classification"))


@query
def classify_join(spark, folder):
    """The same classification with the lexicon as a table."""
    rows = [(c, t, w) for c, terms in classify.LEXICON.items() for t, w in terms.items()]
    lexicon = spark.createDataFrame(rows, "category STRING, term STRING, weight DOUBLE")
    return classify.category_by_join(tables.articles(spark, folder), lexicon, KEY, "text")


@query
def classify_ml(spark, folder):
    """Quality learned from three of four labelled documents, for all; ``held_out`` rows were not learned from."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = tables.table(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"))
    label = F.when(F.col("quality") == 1, "credible").when(F.col("quality") == 0, "doubtful")
    labels = tables.table(spark, folder, "labels").select("doc_id", label.alias("label")).where("label IS NOT NULL")
    model = classify.train_surface_classifier(docs.where("NOT held_out").join(labels, "doc_id"), "text", "label")
    return classify.predict(model, docs.withColumns(classify.surface(F.col("text"))), ["doc_id", "held_out"], "predicted")


@query
def key_themes(spark, folder):
    return themes.key_themes(tables.articles(spark, folder), KEY, "text", keep=written).select(KEY, _joined("key_themes"))


@query
def key_phrases(spark, folder):
    return themes.key_phrases(_articles(spark, folder), written).withColumn("key_phrases", F.array_join("key_phrases", " | "))


@query
def sentiment(spark, folder):
    body = F.col("text")
    return tables.articles(spark, folder).select(
        KEY, classify.polarity_counts(body).alias("c"), classify.sentiment(body).alias("sentiment")
    ).select(KEY, "c.positive", "c.negative", "sentiment")


@query
def polarity_weights(spark, folder):
    return polarity.learn(tables.articles(spark, folder), content="text", keep=written)


@query
def learned_sentiment(spark, folder):
    docs = tables.articles(spark, folder)
    weights = written(polarity.learn(docs, content="text", keep=written))
    return polarity.learned_sentiment(docs, polarity.with_seeds(weights), content="text")


@query
def failed_lookups(spark, folder):
    """Claim results and the vote where the lookup of some claims failed."""
    failed = lambda pos: (F.col(KEY) + pos) % 7 == 3
    results = F.transform(
        "fact_check_results", lambda r, pos: F.when(failed(pos), factcheck.error_result(r["claim"])).otherwise(r)
    )
    checked = _checked(spark, folder).withColumn("fact_check_results", results)
    voted = checked.withColumn("overall_status", factcheck.status_vote(F.col("fact_check_results")))
    return voted.select(KEY, "overall_status", F.posexplode("fact_check_results").alias("pos", "r")).select(KEY, "overall_status", "pos", "r.*")


@query
def votes_without_reviews(spark, folder):
    """The vote where there is no table of reviews."""
    return factcheck.vote_counts(factcheck.fact_check(_articles(spark, folder).drop("content"), None))


@query
def article_confidence(spark, folder):
    checked = _checked(spark, folder, None)
    return checked.select(KEY, classify.confidence(F.col("fact_check_results")).alias("confidence"))


@query
def credibility(spark, folder):
    results = F.col("fact_check_results")
    return _checked(spark, folder, None).select(
        KEY,
        classify.credibility(results).alias("credibility_score"),
        classify.notes(results).alias("analysis_notes"),
    )


@query
def extract_json(spark, folder):
    answers = tables.model_responses(spark, folder)
    return answers.select(KEY, jsontext.extract_json(F.col("response")).alias("json_text"))


@query
def parse_responses(spark, folder):
    return _parsed(spark, folder).withColumn("key_themes", _joined("key_themes"))


@query
def enrich_local(spark, folder):
    """A stand-in client that counts words and refuses some rows."""

    def client():
        def count(row):
            if row[KEY] % 7 == 3:
                raise ValueError("refused")
            return {"words": len(row["text"].split())}

        return count

    docs = tables.articles(spark, folder).select(KEY, "text")
    return enrich.enrich(docs, client, "words BIGINT", {"words": -1}, backoff=0.0).drop("text")


@query
def enrich_answers(spark, folder):
    """A stand-in client that refuses some texts, asked in two runs: first about the English documents, then about all."""

    def client():
        def count(prompt):
            if len(prompt) % 7 == 3:
                raise ValueError("refused")
            return {"words": len(prompt.split())}

        return count

    docs = tables.table(spark, folder, "documents").select(F.col("doc_id").alias(KEY), "text", "lang")
    table = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"

    def ask(some: DataFrame, run: str) -> DataFrame:
        done = answers.answered(
            some, "text", KEY, client, "words BIGINT", {"words": -1}, table, run, callers=4, keep=written, every=500, backoff=0.0
        )
        return done.drop("text", "lang")

    ask(docs.where(F.col("lang") == "en"), "first")
    return ask(docs, "second")


# --- statistics ------------------------------------------------------------------------------


@query
def classification_counts(spark, folder):
    return stats.classification_counts(_parsed(spark, folder))


@query
def fact_status_counts(spark, folder):
    checked = _checked(spark, folder, None)
    return stats.fact_status_counts(checked.withColumnRenamed("overall_status", "overall_fact_status"))


@query
def confidence_counts(spark, folder):
    return stats.confidence_counts(_parsed(spark, folder))


@query
def sentiment_counts(spark, folder):
    return stats.sentiment_counts(_parsed(spark, folder))


def _map_text(column: str, vocabulary: list[str]) -> Column:
    entries = [F.concat(F.lit(f"{v}="), F.element_at(column, F.lit(v))) for v in vocabulary]
    return F.concat_ws(";", *entries).alias(column.split(".")[-1])


_MAPS = {
    "classification_counts": CATEGORIES,
    "fact_status_counts": CLAIM_STATUSES,
    "confidence_counts": CONFIDENCES,
    "sentiment_counts": SENTIMENTS,
}


@query
def analysis_summary(spark, folder):
    return stats.analysis_summary(_marked(spark, folder)).select(
        "total_articles", *[_map_text(c, v) for c, v in _MAPS.items()],
        "average_credibility_score", "successful_analyses",
    )


@query
def workflow_summary(spark, folder):
    return stats.workflow_summary(_marked(spark, folder)).select(
        "workflow_type", "total_articles_processed", "successful_analyses", "failed_analyses",
        *[_map_text(f"analysis_summary.{c}", v) for c, v in _MAPS.items()],
        F.col("analysis_summary.average_credibility_score").alias("average_credibility_score"),
    )


@query
def session_stats(spark, folder):
    return _sessions(spark, folder).withColumn("created_at", _shown())


@query
def summary_metrics(spark, folder):
    return stats.summary_metrics(_analysed_with_failures(spark, folder))


def _analysed_with_failures(spark, folder):
    """Analysed documents of which some summaries failed."""
    failed = F.when(F.col(KEY) % 10 == 3, summarize.SUMMARY_FAILED).otherwise(F.col("summary"))
    return _analysed(spark, folder).withColumn("summary", failed)


@query
def stage_counts(spark, folder):
    return stats.stage_counts(_analysed_with_failures(spark, folder))


@query
def status_distribution(spark, folder):
    return stats.value_distribution(_analysed(spark, folder), "fact_myth_status")


@query
def class_distribution(spark, folder):
    return stats.value_distribution(_parsed(spark, folder), "classification")


# --- store -----------------------------------------------------------------------------------


@query
def article_upsert(spark, folder):
    return _current(spark, folder).withColumn("created_at", _shown())


@query
def store_log(spark, folder):
    """The current articles of a store that was made, written to, and made again, which leaves it as it is."""
    base = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store.init_store(spark, base)
    store.save_articles(_submitted(spark, folder), base, "1", F.col("at"))
    store.init_store(spark, base)
    return store.current_articles(store.read_log(spark, base, store.ARTICLES)).drop("run").withColumn("created_at", _shown())


@query
def upsert_counts(spark, folder):
    return store.upsert_counts(_submitted(spark, folder))


@query
def recent_articles(spark, folder):
    return store.recent_articles(_current(spark, folder)).withColumn("created_at", _shown())


@query
def recent_sessions(spark, folder):
    return store.recent_sessions(_sessions(spark, folder)).withColumn("created_at", _shown())


@query
def history_tail(spark, folder):
    return store.history_tail(_sessions(spark, folder))


@query
def articles_by_topic(spark, folder):
    return store.articles_by_topic(_current(spark, folder), "LICEN_E").withColumn("created_at", _shown())


@query
def pattern_index(spark, folder):
    """Articles by several patterns from a trigram index that is built first."""
    path = f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}"
    index.build_trigrams(_current(spark, folder), path)
    found = [index.articles_by_topic(spark, p, path).withColumn("pattern", F.lit(p)) for p in PATTERNS]
    return functools.reduce(DataFrame.unionByName, found).withColumn("created_at", _shown())


@query
def stats_by_classification(spark, folder):
    return store.stats_by(_current(spark, folder), "classification")


@query
def stats_by_status(spark, folder):
    return store.stats_by(_current(spark, folder), "fact_myth_status")


@query
def database_stats(spark, folder):
    return store.database_stats(_current(spark, folder), _sessions(spark, folder))


# --- publishing and exports ------------------------------------------------------------------


def _published(spark, folder):
    """Analysed documents with some values that the publisher must repair, as publish rows."""
    doc = F.col(KEY)
    items = _analysed(spark, folder).withColumn("content", F.col("summary"))
    repaired = items.withColumns(
        {
            "confidence": F.when(doc % 5 == 0, F.upper("confidence")).when(doc % 5 != 1, F.concat(F.lit(" "), "confidence")),
            "summary": F.when(doc % 6 == 0, "  ").when(doc % 6 != 1, F.col("summary")),
            "title": F.when(doc % 8 != 0, F.col("title")),
            "analysis_date": F.when(doc % 2 == 0, "2024-02-29"),
        }
    )
    return publish.publish_rows(repaired, _run_ts())


@query
def publish_rows(spark, folder):
    return _published(spark, folder).drop("properties")


@query
def publish_counts(spark, folder):
    """Counts where some rows lack the title or the date that the target requires."""
    kept = {"Title": F.when(F.col(KEY) % 9 != 0, F.col("Title")), "Analysis Date": F.when(F.col(KEY) % 11 != 0, F.col("`Analysis Date`"))}
    return publish.publish_counts(_published(spark, folder).withColumns(kept))


@query
def publish_options(spark, folder):
    return publish.option_counts(_published(spark, folder))


@query
def publish_payload(spark, folder):
    """The kept property names of each row's JSON, and its length."""
    kept = F.array_join(F.json_object_keys("properties"), ",")
    return _published(spark, folder).select(KEY, kept.alias("kept"), F.get_json_object("properties", "$.Title").alias("title"))


@query
def run_names(spark, folder):
    return _sessions(spark, folder).select("topic", publish.run_name(F.col("topic"), _run_ts()).alias("run_name"))


@query
def article_listing(spark, folder):
    doc = F.col(KEY)
    items = _analysed(spark, folder).withColumns(
        {
            "title": F.when(doc % 3 != 0, F.col("title")),
            "summary": F.when(doc % 4 != 0, F.col("summary")),
            "fact_myth_status": F.when(doc % 5 != 0, F.col("fact_myth_status")),
        }
    )
    return publish.article_listing(items).withColumn("key_claims", _joined("key_claims"))


@query
def csv_rows(spark, folder):
    shown = _checked(spark, folder).select(KEY, "url", "title", "claims", "overall_status")
    return export.csv_rows(shown)


@query
def stage_files(spark, folder):
    """Fact-checked articles from the stage file they were written to."""
    base = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
    path = export.write_stage(_checked(spark, folder), base, "fact_checked", RUN_TS)
    return _shown_checks(export.read_stage(spark, path, "fact_checked"))


@query
def json_export(spark, folder):
    """Analysed articles from the JSON they were exported to."""
    path = export.export_json(_analysed(spark, folder), f"{shared_dir(spark)}/export-{uuid.uuid4().hex}", RUN_TS)
    return export.read_stage(spark, path, "analysed").select(KEY, "url", _joined("claims"), "overall_fact_status", "classification")


# --- composed and streaming ------------------------------------------------------------------


def _flat(analysed: DataFrame) -> DataFrame:
    statuses = F.array_join(F.transform("fact_check_results", lambda r: r["status"]), ",")
    return analysed.withColumns(
        {"claims": _joined("claims"), "fact_check_results": statuses, "key_themes": _joined("key_themes")}
    )


@query
def analysed_articles(spark, folder):
    """All stages from pages to analysed articles."""
    pages, reviews = tables.pages(spark, folder), tables.reviews(spark, folder)
    return _flat(analysis.analyse_pages(pages, reviews, keep=written))


def _streamed(spark: SparkSession, folder: str) -> str:
    """The store after all pages came in as files through the stream, with all stages of the batch."""
    work = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    tables.table(spark, folder, "pages").write.option("maxRecordsPerFile", 1000).json(f"{work}/in")
    reviews = tables.reviews(spark, folder)

    def analyse(batch: DataFrame) -> DataFrame:
        return analysis.analyse_scraped(batch, reviews, keep=written)

    arrived = ingest.scraped_stream(ingest.read_pages(spark, f"{work}/in"))
    run = ingest.ingest(arrived, analyse, f"{work}/store", f"{work}/checkpoint", "pages", lambda batch: _run_ts())
    run.awaitTermination()
    return f"{work}/store"


@query
def stream_equals_batch(spark, folder):
    """The article log of the stream."""
    log = store.read_log(spark, _streamed(spark, folder), store.ARTICLES)
    return log.select(*ARTICLE_LOG.fieldNames()).withColumn("created_at", _shown())


@query
def stream_analysed(spark, folder):
    """The analysed articles of the stream, themes included: the rows of ``analysed_articles``."""
    rows = spark.read.parquet(f"{_streamed(spark, folder)}/{ingest.ANALYSED}")
    return _flat(rows.drop("run"))


@query
def stream_session_rows(spark, folder):
    """The session rows of the stream, one a micro-batch."""
    log = store.read_log(spark, _streamed(spark, folder), store.SESSIONS)
    return log.drop("run").withColumn("created_at", _shown())


# --- streams with state ----------------------------------------------------------------------


def _stream(df: DataFrame, folder: str, again: bool = False) -> DataFrame:
    """``df`` written to ``folder``, to be read as a stream of its files; ``again``: on top of what is there."""
    df.write.mode("append" if again else "errorifexists").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def _work(spark: SparkSession) -> str:
    return f"{shared_dir(state.stateful(spark))}/stream-{uuid.uuid4().hex}"


@query
def stream_upsert(spark, folder):
    """The last row of each url from a stream of all rows, which then come once more in another order."""
    work = _work(spark)
    rows = store.article_rows(_submitted(spark, folder), F.col("at"))
    with shuffles_dropped(spark):
        for turn in (0, 1):
            ordered = rows.repartition(F.xxhash64("url", "seq")) if turn else rows
            stream = _stream(ordered, f"{work}/in", again=turn > 0)
            state.drained_changes(state.newest_rows(stream), f"{work}/{store.ARTICLES}", f"{work}/checkpoint")
    return store.current_articles(store.read_log(spark, work, store.ARTICLES)).drop("run").withColumn("created_at", _shown())


@query
def stream_claim_status(spark, folder):
    """Claim results where all reviews come a day after the claims, and in a later run."""
    work = _work(spark)
    started = F.lit("2024-01-01").cast("timestamp")
    listed = claims.explode_claims(_articles(spark, folder), KEY, claims.claim_list(F.col("summary")))
    listed = listed.withColumn("claimed_at", F.timestamp_add("MILLISECOND", F.col(KEY), started))
    reviews = tables.reviews(spark, folder).withColumn("reviewed_at", F.timestamp_add("DAY", F.lit(1), started))

    def last(df: DataFrame, at: str, text: str) -> DataFrame:
        """A row that moves the watermark of its side past all waits. It needs a text, or a filter drops it before."""
        given = {at: F.lit("2025-01-01"), text: F.lit(f"last {text}")}
        return spark.range(1).select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema))

    left, right = _stream(listed, f"{work}/claims"), _stream(reviews.where("false"), f"{work}/reviews")

    def run() -> None:
        found = state.reviewed_claims(left, right, "60 days", "1 hour")
        state.drained(found, f"{work}/out", f"{work}/checkpoint")

    run()
    _stream(reviews, f"{work}/reviews", again=True)
    run()
    _stream(last(listed, "claimed_at", "claim"), f"{work}/claims", again=True)
    _stream(last(reviews, "reviewed_at", "claim_text"), f"{work}/reviews", again=True)
    run()
    return state.claim_results(spark.read.parquet(f"{work}/out").where(F.col(KEY).isNotNull()))


@query
def stream_sessions(spark, folder):
    """Sessions of the events of each user, as those of a topic, from a stream."""
    work = _work(spark)
    status = F.when(F.col("event_type") == "view", "Fact").when(F.col("event_type") == "error", "Myth")
    events = tables.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("topic"), F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") == "click", "Unclear").otherwise(status).alias("fact_myth_status"),
    )
    stream = _stream(events, f"{work}/in")
    # A last row moves the watermark past all sessions; its own stays open.
    last = spark.range(1).select(F.lit("").alias("topic"), F.lit("2100-01-01").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("fact_myth_status"))
    _stream(last, f"{work}/in", again=True)
    state.drained(state.session_rows(stream, "topic", "at", "30 minutes", "1 hour"), f"{work}/out", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/out").withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("started", "ended")})
