"""Stored indexes give the rows of the searches that read everything."""

import random
import time

import pytest
from pyspark.sql import functions as F

from claimspark.operators import index, retrieval, store
from claimspark.session import written
from claimspark.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("k", [1, 7])
def test_postings_search_reads_few_blocks(spark, tmp_path, k):
    draw = random.Random(11)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(300)]
    texts = [" ".join(draw.choices(common, k=draw.randrange(1, 60)) + draw.choices(rare, k=3)) for _ in range(1500)] + [None, "", "c0", "c0"]
    articles = spark.createDataFrame(list(enumerate(texts)), "article_id long, text string")
    topics = spark.createDataFrame([("c0 r7",), ("R1 r2 r3",), ("c1",), ("unheard",), ("",), (None,)], "topic string")
    index.build_postings(articles, str(tmp_path / "i"), block_docs=20)
    found, report = index.search_postings(topics, str(tmp_path / "i"), written, k=k)
    assert rows(found) == rows(retrieval.search_topk(topics, articles, k=k))
    seen = {r["topic"]: (r["blocks"], r["scanned"]) for r in report.collect()}
    assert set(seen) == {"c0 r7", "R1 r2 r3", "c1"} and all(n <= m for m, n in seen.values())
    assert sum(n for _, n in seen.values()) < 0.7 * sum(m for m, _ in seen.values())


def test_postings_of_an_empty_table(spark, tmp_path):
    articles = spark.createDataFrame([(1, None)], "article_id long, text string")
    index.build_postings(articles, str(tmp_path / "i"))
    found, report = index.search_postings(spark.createDataFrame([("a",)], "topic string"), str(tmp_path / "i"), written)
    assert found.count() == 0 and report.count() == 0


def test_a_search_reads_the_folders_of_its_tokens(spark, small, tmp_path):
    index.build_postings(tables.articles(spark, small), str(tmp_path / "i"))
    topics = spark.createDataFrame([("license",)], "topic string")
    weights, bounds = index.topic_bounds(topics, str(tmp_path / "i"))
    assert weights.count() == 1 and bounds.count() > 0
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 and "postings:" not in plan


ODD = ["100% sure", "a\\b c", "Straße İstanbul ΑΣ", "ὈΔΥΣΣΕΎΣ", "😀😀😀 x", "abcabcabc", "ab", "", None, "a_b%c", "x" * 50_000 + "needle"]
PATTERNS = ["sure", "0% S", "a\\b", "\\", "straSSE", "straße", "stanbul", "ας", "ΑΣ", "σσε", "😀😀", "abca%bc", "b_a", "ab", "%", "", "a_b", "NEEDLE", "xneedle_", "qqq"]


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    table = [(f"u{i}", t, ODD[-1 - i], "c", "s") for i, t in enumerate(ODD)]
    current = spark.createDataFrame(table, "url string, title string, summary string, classification string, fact_myth_status string")
    current = current.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("seq", F.lit(1))
    index.build_trigrams(current, str(tmp_path / "t"))
    for p in PATTERNS:
        assert rows(index.articles_by_topic(spark, p, str(tmp_path / "t")).select("url")) == rows(store.articles_by_topic(current, p).select("url")), p
    assert index.pattern_candidates(spark, "needle", str(tmp_path / "t")).count() == 2
    assert index.pattern_candidates(spark, "a_%c", str(tmp_path / "t")) is None


def saved(monkeypatch):
    """The plans of what an index stores, which are also stored."""
    plans, save = [], index._save

    def spy(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        save(df, path)

    monkeypatch.setattr(index, "_save", spy)
    return plans


def test_postings_and_trigrams_are_dealt_out_once(spark, tmp_path, monkeypatch):
    plans = saved(monkeypatch)
    texts = [(1, "a b a"), (2, "b c"), (3, None)]
    articles = written(spark.createDataFrame(texts, "article_id long, text string"))
    index.build_postings(articles, str(tmp_path / "p"))
    index.build_trigrams(articles.withColumn("url", F.col("text")), str(tmp_path / "t"), ("url",))
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 2, 1]  # blocks, terms from them, trigrams


def test_rows_of_one_key_are_one_article_of_an_index(spark, tmp_path):
    rows_ = [(1, "a b"), (1, "b a"), (2, "a c d"), (None, "a b"), (None, "a x")]
    articles = spark.createDataFrame(rows_, "article_id long, text string")
    topics = spark.createDataFrame([("a",)], "topic string")
    index.build_postings(articles, str(tmp_path / "i"))
    assert rows(index.search_postings(topics, str(tmp_path / "i"), written)[0].select("article_id").fillna(-1)) == [(-1,), (1,), (2,)]


def test_trigram_lists_are_bounded_and_lose_none(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(index, "ROWS_OF_A_LIST", 3)
    monkeypatch.setattr(index, "CHARS_OF_A_LIST", 40)
    draw = random.Random(5)
    texts = [None if i % 9 == 4 else "".join(draw.choices("ab😀", k=draw.randrange(30))) for i in range(60)]
    ids = [i + (i // 20 << 33) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], ["_id", "field0"])
    found = [r for b in index._gram_lists([batch]) for r in b.to_pylist()]
    assert all(len(r["ids"]) <= 3 and r["ids"] == sorted(r["ids"]) for r in found)
    expected = sorted((t[j : j + 3], i) for i, t in zip(ids, texts) for j in range(len(t or "") - 2) if t.find(t[j : j + 3]) == j)
    assert sorted((r["gram"], i) for r in found for i in r["ids"]) == expected


def test_patterns_equal_ilike_and_take_linear_time(spark):
    patterns = [*PATTERNS, "h%lich%ung", "a%b_c%", "_", "__%a", "%%", "a%_%c", "\\E", "ab%ab", "q%\\Q%\\E"]
    texts = [*ODD, "lich h ung", "h lich ung", "H LICHung", "\\Q x \\E", "abab", "aab", "a\nb\nc", "q\\Q\\E"]
    table = [(str(i), t, None, "c", "s") for i, t in enumerate(texts)] + [(None, None, None, "c", "s")]
    schema = "url string, title string, summary string, classification string, fact_myth_status string"
    current = spark.createDataFrame(table, schema).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz")).cache()
    for p in patterns:
        like = "%" + p.replace("\\", "\\\\") + "%"
        scan = current.where(F.coalesce(F.col("url").ilike(like), F.lit(False)) | F.coalesce(F.col("title").ilike(like), F.lit(False)))
        assert rows(store.articles_by_topic(current, p).select("url")) == rows(scan.select("url")), p
    long = spark.range(1).select(F.lit("u").alias("url"), F.repeat(F.lit("h lich "), 30_000).alias("title"), F.lit("").alias("summary"))
    long = long.select("*", F.lit("").alias("classification"), F.lit("").alias("fact_myth_status"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    started = time.perf_counter()
    assert store.articles_by_topic(long, "h%lich%ung").count() == 0
    assert time.perf_counter() - started < 20  # going back to each place took minutes
