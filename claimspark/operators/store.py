"""The article and session store: append-only Parquet logs and a current view.

A log is a folder ``<base>/<name>/run=<id>``. A run is written by replacing its own folder, so a
repeated run or streaming batch leaves one copy. Nothing that is being read is overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ARTICLE_LOG, SESSION_LOG
from .stats import session_stats

ARTICLES = "articles"
SESSIONS = "sessions"
_LOGS = {ARTICLES: ARTICLE_LOG, SESSIONS: SESSION_LOG}
_COLUMNS = ["url", "title", "summary", "classification", "fact_myth_status", "created_at"]


def init_store(spark: SparkSession, base: str) -> None:
    """Create both logs, empty, unless they are there."""
    for name, schema in _LOGS.items():
        empty = spark.createDataFrame([], schema).withColumn("run", F.lit("0"))
        empty.write.mode("ignore").partitionBy("run").parquet(f"{base}/{name}")


def read_log(spark: SparkSession, base: str, name: str) -> DataFrame:
    """All rows of a log with the run they came from."""
    schema = T.StructType([*_LOGS[name].fields, T.StructField("run", T.StringType())])
    return spark.read.schema(schema).option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")


def _write_run(df: DataFrame, base: str, name: str, run: str) -> None:
    df.write.mode("overwrite").parquet(f"{base}/{name}/run={run}")


def article_rows(articles: DataFrame, created_at: Column, seq: str = "article_id") -> DataFrame:
    """Rows as the log keeps them: null urls refused, missing fields empty."""
    fields = ["title", "summary", "classification", "fact_myth_status"]
    return articles.where(F.col("url").isNotNull()).select(
        "url",
        *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields],
        created_at.cast("timestamp_ntz").alias("created_at"),
        F.col(seq).cast("bigint").alias("seq"),
    )


def upsert_counts(articles: DataFrame) -> DataFrame:
    """One row: rows handed in, accepted and refused."""
    accepted = F.count_if(F.col("url").isNotNull())
    total = F.count(F.lit(1))
    return articles.agg(
        total.alias("received"), accepted.alias("saved"), (total - accepted).alias("refused")
    )


def save_articles(articles: DataFrame, base: str, run: str, created_at: Column) -> None:
    _write_run(article_rows(articles, created_at), base, ARTICLES, run)


def save_session(articles: DataFrame, base: str, run: str, topic: str, created_at: Column) -> str:
    """Write one session row and return its id, the run."""
    row = session_stats(articles).select(
        F.lit(topic).alias("topic"), "*", created_at.cast("timestamp_ntz").alias("created_at")
    )
    _write_run(row, base, SESSIONS, run)
    return run


def current_articles(log: DataFrame) -> DataFrame:
    """The last row written per url.

    The rank limit is applied before the shuffle as well, so a url that fills a large part of
    the log sends one row per task.
    """
    latest = Window.partitionBy("url").orderBy(F.desc("created_at"), F.desc("seq"))
    return log.withColumn("_age", F.row_number().over(latest)).where(F.col("_age") == 1).drop("_age")


def recent_articles(current: DataFrame, limit: int = 50) -> DataFrame:
    return current.select(*_COLUMNS).orderBy(F.desc("created_at"), "url").limit(limit)


def recent_sessions(sessions: DataFrame, limit: int = 10) -> DataFrame:
    columns = SESSION_LOG.fieldNames()
    return sessions.select(*columns).orderBy(F.desc("created_at"), "topic").limit(limit)


def folded(spark: SparkSession, topic: str) -> str:
    """``%topic%`` in lower case, as ``ilike`` folds it: as a whole."""
    return spark.range(1).select(F.lower(F.lit(f"%{topic}%"))).first()[0]


def _holds(value: Column, parts: list[str]) -> Column:
    """Whether the parts, in which ``_`` stands for any character, follow one another in a text. Linear in the text.

    Each part is taken where it first ends, which leaves most to the next ones, so no other place has to be tried;
    ``like`` tries all of them, once a part is missing.
    """
    if not parts:
        return value.isNotNull()
    if len(parts) == 1 and "_" not in parts[0]:
        return F.contains(value, F.lit(parts[0]))

    def quoted(run: str) -> str:
        return "\\Q" + run.replace("\\E", "\\E\\\\E\\Q") + "\\E" if run else ""

    each = (".".join(map(quoted, part.split("_"))) for part in parts)
    return F.rlike(value, F.lit("(?s)\\A" + "".join(f"(?>.*?{part})" for part in each)))


def articles_by_topic(current: DataFrame, topic: str) -> DataFrame:
    """Articles with the topic in url, title or summary, in any case, newest first.

    ``%`` and ``_`` in the topic are wildcards; a backslash is an ordinary character.
    """
    parts = [p for p in folded(current.sparkSession, topic).split("%") if p]
    found = F.lit(False)
    for column in ("url", "title", "summary"):
        found = found | F.coalesce(_holds(F.lower(column), parts), F.lit(False))
    return current.where(found).select(*_COLUMNS).orderBy(F.desc("created_at"), "url")


def history_tail(sessions: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` history entries, newest first."""
    return (
        sessions.orderBy(F.desc("created_at"), "topic")
        .limit(n)
        .select(
            "topic",
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            F.col("articles_found").alias("articles_count"),
        )
    )


def stats_by(current: DataFrame, column: str) -> DataFrame:
    """Articles per value; null and '' are groups of their own."""
    return current.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def database_stats(current: DataFrame, sessions: DataFrame) -> DataFrame:
    """``stat, value, n``: totals, and articles per classification and per status.

    Long form, as the values are free text and their number has no bound. Grouping sets read
    the current view once for all three article statistics.
    """
    sets = current.groupingSets(
        [[], ["classification"], ["fact_myth_status"]], "classification", "fact_myth_status"
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_set"))
    stat = (
        F.when(F.col("_set") == 3, "total_articles")
        .when(F.col("_set") == 1, "classification")
        .otherwise("fact_myth_status")
    )
    value = F.when(F.col("_set") == 1, F.col("classification")).when(
        F.col("_set") == 2, F.col("fact_myth_status")
    )
    articles = sets.select(stat.alias("stat"), value.alias("value"), "n")
    total_sessions = sessions.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total_sessions").alias("stat"), F.lit(None).cast("string").alias("value"), "n"
    )
    # An empty store has no grouping-set rows; its article total is still 0.
    zero = sessions.sparkSession.range(1).select(
        F.lit("total_articles").alias("stat"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("n")
    )
    return (
        articles.unionByName(total_sessions)
        .unionByName(zero)
        .groupBy("stat", "value")
        .agg(F.sum("n").alias("n"))
    )
