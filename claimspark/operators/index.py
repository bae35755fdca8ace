"""Stored indexes: posting blocks for ranked search, and trigrams for search by a pattern.

Both are folders of Parquet, built once and read by many searches. A search reads the rows of its own
tokens or trigrams only, and of these as few blocks as an exact result allows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import store
from .counted import row_terms
from .joins import is_small
from .retrieval import K1, B

BUCKETS = 64  # folders of an index, by a hash of the token or trigram
LENGTHS = 32  # classes of article lengths; articles of a block are of one class, so that its best part is near to all
BLOCK_DOCS = 256  # articles of a block, about
FIRST_BLOCKS = 4  # of a topic, of the highest bounds, that are read before the others are judged
ROWS_OF_A_LIST = 4096  # at most
CHARS_OF_A_LIST = 4_000_000  # of a column, about, that are taken apart at a time
ROWS_OF_A_FILE = 100_000  # articles of which one file of a bucket has the postings, about
_ROUNDING = 1e-6  # scores are rounded


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int").alias("bucket")


def _save(df: DataFrame, path: str) -> None:
    """Folders by bucket, and the schema beside them, which an empty index does not show."""
    df.write.partitionBy("bucket").parquet(path)
    df.sparkSession.range(1).select(F.lit(df.schema.json())).write.text(f"{path}.schema")


def _read(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}.schema").first()[0]))
    return spark.read.schema(schema).parquet(path)


# --- ranked search ---------------------------------------------------------------------------


def build_postings(articles: DataFrame, path: str, key: str = "article_id", content: str = "text", block_docs: int = BLOCK_DOCS) -> None:
    """Write an index of ``articles`` to ``path``.

    ``terms`` has the inverse frequency of each token; ``blocks`` has for each token and block of articles the
    postings, each with the part it adds to a BM25 score, and the largest of these parts. Every
    token of an article is in the same block, so the parts' maxima bound the score of any article of a block.
    """
    tokens = text.tokens(F.col(content))
    sized = articles.select(F.col(key).alias("key"), content, F.size(tokens).alias("len"))
    bounds = F.percentile_approx("len", [i / LENGTHS for i in range(1, LENGTHS)], 1000)
    n, mean, cuts = sized.agg(F.count(F.lit(1)), F.avg("len"), bounds).first()
    wide = max(1, -(-n // (LENGTHS * block_docs)))
    length = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts or [0])))), lambda c: c < F.col("len")))
    block = length.cast("long") * wide + F.pmod(F.xxhash64("key"), F.lit(wide))
    counts = row_terms(sized.withColumn("block", block), ["key", "len", "block"], tokens).withColumnRenamed("term", "token")
    spread = F.pmod("block", F.lit(max(1, n // ROWS_OF_A_FILE)))
    # Counts move once, to where their block is put together, sorted and written.
    dealt = counts.withColumns({"bucket": _bucket("token"), "spread": spread}).repartition("bucket", "spread")
    damped = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0))
    part = (F.col("tf") * (K1 + 1) / damped).alias("part")
    blocks = dealt.groupBy("bucket", "spread", "token", "block").agg(F.max(part).alias("top"), F.collect_list(F.struct("key", part)).alias("postings"))
    ordered = blocks.select("token", "block", "top", "postings", "bucket").sortWithinPartitions("bucket", "token", "block")
    _save(ordered, f"{path}/blocks")
    written = _read(articles.sparkSession, f"{path}/blocks")
    df = written.groupBy("bucket", "token").agg(F.sum(F.size("postings")).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    _save(df.select("token", idf.alias("idf"), "bucket").repartition("bucket"), f"{path}/terms")


def _with(large: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Join with a usually short table, broadcast after a count. Only the folders of its buckets, of which there are BUCKETS, are read."""
    if "bucket" in on:
        large = large.where(F.col("bucket").isin(*(r[0] for r in few.select("bucket").distinct().collect())))
    return large.join(F.broadcast(few), on) if is_small(few) else large.join(few, on)


def topic_bounds(topics: DataFrame, path: str, topic: str = "topic") -> tuple[DataFrame, DataFrame]:
    """The weights of the topics' tokens, and what an article of a block can score at most: ``topic, block, bound``."""
    spark = topics.sparkSession
    wanted = topics.select(F.col(topic).alias("topic"), F.explode(F.array_distinct(text.tokens(F.col(topic)))).alias("token")).distinct()
    wanted = wanted.withColumn("bucket", _bucket("token"))
    weights = _with(_read(spark, f"{path}/terms"), wanted, ["bucket", "token"])
    tops = _with(_read(spark, f"{path}/blocks").select("bucket", "token", "block", "top"), weights, ["bucket", "token"])
    return weights, tops.groupBy("topic", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))


def _scores(weights: DataFrame, chosen: DataFrame, path: str) -> DataFrame:
    """``topic, key, score`` of all articles of the chosen blocks (``topic, block``) that hold a token."""
    blocks = _read(weights.sparkSession, f"{path}/blocks").select("bucket", "token", "block", "postings")
    read = _with(_with(blocks, weights, ["bucket", "token"]), chosen, ["topic", "block"])
    parts = read.select("topic", "idf", F.inline("postings"))
    return parts.groupBy("topic", "key").agg(F.round(F.sum(F.col("idf") * F.col("part")), 6).alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "key")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_postings(topics: DataFrame, path: str, keep, k: int = 10, topic: str = "topic", key: str = "article_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``retrieval.search_topk`` from an index, and ``topic, blocks, scanned``.

    The blocks of the highest bounds are read first. The ``k``-th score among their articles is a floor: a block
    whose bound is below it cannot hold a better article and is not read. ``keep``, such as
    ``session.written``, stores the bounds and first scores, which several steps read.
    """
    weights, bounds = topic_bounds(topics, path, topic)
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("bound"), "block"))
    bounds = keep(bounds.withColumn("place", place))
    first = keep(_best(_scores(weights, bounds.where(F.col("place") <= FIRST_BLOCKS).select("topic", "block"), path), k))
    floors = first.groupBy("topic").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
    floors = floors.select("topic", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    judged = bounds.join(floors, "topic", "left").withColumn("read", (F.col("place") <= FIRST_BLOCKS) | (F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - _ROUNDING))
    more = _scores(weights, judged.where(F.col("read") & (F.col("place") > FIRST_BLOCKS)).select("topic", "block"), path)
    best = _best(first.drop("rank").unionByName(more), k).select(F.col("topic").alias(topic), "rank", F.col("key").alias(key), "score")
    return best, judged.groupBy("topic").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("read").alias("scanned"))


# --- search by a pattern ---------------------------------------------------------------------


def _codes(value: bytes) -> np.ndarray:
    """The runs of three characters of a text, each once, as numbers of 21 bits a character. Sorted."""
    points = np.frombuffer(value.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def _grams(codes: np.ndarray) -> list[str]:
    points = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
    letters = points.tobytes().decode("utf-32-le")
    return [letters[i : i + 3] for i in range(0, len(letters), 3)]


def _slices(values: list[bytes | None]) -> Iterator[slice]:
    """Runs of rows with at most ROWS_OF_A_LIST rows, and about CHARS_OF_A_LIST bytes if a row has no more."""
    sizes = np.array([len(v) if v is not None else 0 for v in values], np.int64)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= ROWS_OF_A_LIST or total + n > CHARS_OF_A_LIST):
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


def _gram_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by trigram and column, put together where the texts are: a row and trigram is an entry of a list, not a row of a shuffle."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for field in range(batch.num_columns - 1):
            values = batch.column(field + 1).to_pylist()
            for own in _slices(values):
                codes = [_codes(v) if v else np.empty(0, np.int64) for v in values[own]]
                row = np.repeat(ids[own], [len(c) for c in codes])
                codes = np.concatenate(codes)
                if not len(codes):
                    continue
                order = np.argsort(codes, kind="stable")
                codes = codes[order]
                starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(codes)], pa.int32()), pa.array(row[order], pa.int64()))
                n = len(starts)
                columns = [pa.array(_grams(codes[starts]), pa.string()), pa.array(np.full(n, field), pa.int32()), pa.array(np.full(n, row[0] // ROWS_OF_A_LIST), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "field", "part", "ids"])


def build_trigrams(current: DataFrame, path: str, columns: Sequence[str] = ("url", "title", "summary")) -> None:
    """Write the rows of ``current`` with ids, and for each trigram and column the rows that hold it, in lists of bounded length."""
    spark = current.sparkSession
    current.withColumn("_id", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    each = rows.select("_id", *(F.lower(c).cast("binary").alias(f"field{i}") for i, c in enumerate(columns)))
    lists = each.mapInArrow(_gram_lists, "gram string, field int, part long, ids array<long>").withColumn("bucket", _bucket("gram"))
    spread = F.pmod("part", F.lit(max(1, rows.count() // ROWS_OF_A_FILE)))
    ordered = lists.repartition("bucket", spread).sortWithinPartitions("bucket", "gram")
    _save(ordered, f"{path}/grams")


def pattern_trigrams(spark: SparkSession, topic: str) -> list[tuple[int, str]]:
    """Bucket and text of the trigrams that any match of ``%topic%`` has; none if no three letters stand together."""
    grams = {gram for run in re.split("[%_]", store.folded(spark, topic)) for gram in _grams(_codes(run.encode()))}
    if not grams:
        return []
    found = spark.createDataFrame([(g,) for g in sorted(grams)], "gram string")
    return [(r["bucket"], r["gram"]) for r in found.select(_bucket("gram"), "gram").collect()]


def pattern_candidates(spark: SparkSession, topic: str, path: str) -> DataFrame | None:
    """``_id`` of rows of which one column has all trigrams of the pattern; null if the pattern has none."""
    wanted = pattern_trigrams(spark, topic)
    if not wanted:
        return None
    lists = _read(spark, f"{path}/grams").where(F.col("bucket").isin(*{b for b, _ in wanted}) & F.col("gram").isin(*(g for _, g in wanted)))
    hits = lists.select("field", F.explode("ids").alias("_id")).groupBy("_id", "field").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(wanted)).select("_id").distinct()


def articles_by_topic(spark: SparkSession, topic: str, path: str) -> DataFrame:
    """The rows of ``store.articles_by_topic`` from an index.

    ``%`` and ``_`` are wildcards, a backslash is not special. Candidates have all trigrams of the parts between wildcards;
    the scan's condition then decides. Where no part has three letters, all rows are candidates.
    """
    rows = spark.read.parquet(f"{path}/rows")
    found = pattern_candidates(spark, topic, path)
    return store.articles_by_topic(rows if found is None else rows.join(found, "_id", "left_semi"), topic)
