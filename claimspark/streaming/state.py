"""Stateful streams: the newest row of a url, reviews that come after their claim, sessions.

State is kept in RocksDB, so it may outgrow memory, and checkpointed in the shared folder. Each
function takes and returns streaming frames; ``drained`` and ``drained_changes`` run one over all that is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text
from ..operators import factcheck, stats

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLAIM_SALTS = 16
_EPOCH = "1970-01-01"
_OLDEST = -(1 << 63)


def stateful(spark: SparkSession) -> SparkSession:
    """State in RocksDB, and sessions merged within a task before the shuffle."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # A batch adds its changes to the checkpoint instead of the files of the whole state.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # State may hold texts: they are compressed well, and all partitions of an executor share bounded buffers.
    spark.conf.set("spark.sql.streaming.stateStore.compression.codec", "zstd")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.compression", "zstd")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return spark


# --- the newest row of a url -----------------------------------------------------------------


def _order(created_at: str) -> Column:
    """Microseconds, with null before all."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col(created_at))
    return F.coalesce(micros, F.lit(_OLDEST))


@F.pandas_udf(T.BooleanType())
def _last_here(url: pd.Series, order_at: pd.Series, seq: pd.Series) -> pd.Series:
    """Whether a row is the newest of its url in its Arrow batch."""
    rows = pd.DataFrame({"url": url, "order_at": order_at, "seq": seq}).reset_index(drop=True)
    last = rows.sort_values(["order_at", "seq"], kind="stable").drop_duplicates("url", keep="last")
    return pd.Series(rows.index.isin(last.index))


def _rank(row: Row) -> tuple[int, int]:
    return row["order_at"], row["seq"]


class Newest(StatefulProcessor):
    """Passes on the newest row of a url, when it is newer than all that came before it."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("at", T.LongType()), T.StructField("seq", T.LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=_rank)
        if not self.seen.exists() or _rank(last) > tuple(self.seen.get()):
            self.seen.update(_rank(last))
            yield Row(**{c: v for c, v in last.asDict().items() if c != "order_at"})

    def close(self) -> None:
        pass


def newest_rows(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Of a stream of log rows (``url, ..., created_at, seq``) those that are the newest of their url so far.

    Order is that of ``created_at`` (null before all), then ``seq``, not of arrival; rows that came before, or
    come again, are not passed on, so ``store.current_articles`` over what is passed on is what it is over all
    rows. ``seq`` must not be null.

    State is an aggregate of a row a url, reduced within a task before the shuffle. Of equal ranks the one that came
    in the earliest batch stays, so a row of this batch's time is one that is newer than all before it.

    A url that gets no newer row for ``ttl_ms`` is forgotten: an older row is then passed on, which the view above
    puts right. An aggregate forgets nothing by that, so such a stream keeps the ranks alone, in a Python processor, which
    costs a millisecond or two a url and batch. With a ``ttl_ms`` Spark goes on with empty batches, so such a stream is for triggers
    that do not end, or needs those switched off. A checkpoint goes on only with or without a ``ttl_ms``, as it began.
    """
    keyed = rows.where(F.col("url").isNotNull()).withColumn("order_at", _order("created_at"))
    if ttl_ms:
        slim = keyed.where(_last_here.asNondeterministic()("url", "order_at", "seq"))
        return slim.groupBy("url").transformWithState(Newest(ttl_ms), rows.schema, "Update", "ProcessingTime")
    came = F.unix_micros(F.current_timestamp())  # in a stream, the time of the batch, also when it is repeated
    rest = [c for c in rows.columns if c not in ("url", "seq")]
    last = F.max(F.struct("order_at", "seq", "earlier", *rest)).alias("last")
    newest = keyed.withColumn("earlier", -came).groupBy("url").agg(last)
    changed = newest.withColumn("earlier", -came).where("last.earlier = earlier")
    return changed.select(*("url" if c == "url" else F.col(f"last.{c}") for c in rows.columns))


# --- reviews that come after the article -----------------------------------------------------


def reviewed_claims(claims: DataFrame, reviews: DataFrame, wait: str, lateness: str, salts: int = CLAIM_SALTS) -> DataFrame:
    """Claims with the reviews of equal text that appear within ``wait`` of them, earlier or later.

    ``claims``: ``article_id, pos, claim, claimed_at``; ``reviews``: the columns of the review table and
    ``reviewed_at``. A claim without a review comes out once, with a null ``review``, after the watermark has
    passed the end of its wait. Rows behind the watermark by more than ``lateness`` are dropped, and
    Spark counts them (:func:`late_rows`). A claim's text may be that of a third of all claims: claims
    are salted, and each review, of which a text has few, is there once for each salt.
    """
    norm = text.normalised(F.col("claim"))
    salt = F.pmod(F.xxhash64("article_id", "pos"), F.lit(salts)).cast("int")
    left = claims.withWatermark("claimed_at", lateness).select("article_id", "pos", "claim", "claimed_at", norm.alias("norm"), salt.alias("salt"))
    review = F.struct("review_id", "textual_rating", "publisher", "publisher_site", "review_url", "review_date")
    right = reviews.withWatermark("reviewed_at", lateness).select(
        text.normalised(F.col("claim_text")).alias("review_norm"), review.alias("review"), "reviewed_at",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("review_salt"),
    )
    near = F.expr(f"reviewed_at >= claimed_at - interval {wait} AND reviewed_at <= claimed_at + interval {wait}")
    same = (F.col("norm") == F.col("review_norm")) & (F.col("salt") == F.col("review_salt")) & (F.col("norm") != "")
    return left.join(right, same & near, "leftOuter").select("article_id", "pos", "claim", "review")


def claim_results(log: DataFrame) -> DataFrame:
    """The rows of :func:`reviewed_claims` as result rows, one for each claim: the review of least id counts."""
    best = log.groupBy("article_id", "pos", "claim").agg(F.min_by("review", F.col("review.review_id")).alias("review"))
    r = F.col("review")
    fields = [r[f] for f in ("textual_rating", "publisher", "publisher_site", "review_url", "review_date")]
    result = factcheck.review_result(F.col("claim"), r.isNotNull(), *fields)
    return best.select("article_id", "pos", F.inline(F.array(result)))


# --- sessions --------------------------------------------------------------------------------


def session_rows(rows: DataFrame, topic: str, at: str, gap: str, lateness: str) -> DataFrame:
    """A session row for each run of rows of a ``topic`` in which none comes more than ``gap`` after the one before.

    ``started``, ``ended`` (the last row's time plus the gap) and the counts of ``stats.session_stats`` over
    ``fact_myth_status``. A session comes out when the watermark has passed its end; tasks merge their
    rows to sessions before the shuffle, so a topic with a third of all rows sends few.
    """
    window = F.session_window(at, gap)
    out = stats.session_stats(rows.withWatermark(at, lateness), topic, window)
    counts = [c for c in out.columns if c not in (topic, "session_window")]
    return out.select(topic, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), *counts)


# --- running ---------------------------------------------------------------------------------


def drained(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of final rows over all input there is, into Parquet files of ``out``, each row once."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drained_changes(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of changes over all input there is; a batch has its own folder, which a repeat replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/run=batch{batch_id:012d}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = writer.outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, over all batches of this run."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
