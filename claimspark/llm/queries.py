"""The queries of the operators over the given tables. `sql.py` holds SQL of the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import decontaminate as decontamination
from . import hmm, languages, linededup, merkle, minhash, pieces, quality, repeats, search, toxicity, urls
from . import shard as sharding
from .tables import ROW, benchmark, documents, labels, pages, prepared

PIECES_MODEL = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(prepared(spark), folder)

    REGISTRY[fn.__name__] = run
    return fn


def held_out(folds: int, fold: int):
    """Rows that nothing is learned from, by the id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    out = decontamination.decontaminate(docs, benchmark(spark, folder)).withColumn("n_hit", decontamination.n_hit())
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query
def op2_shard(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard(documents(spark, folder).select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, folder).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text").withColumn(ROW, F.monotonically_increasing_id())
    out = minhash.with_first(written(minhash.near_duplicates(docs)), "doc_id")
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), "in_class", (F.col("first")[ROW] == F.col(ROW)).alias("kept"))


def pieces_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES_MODEL)


@query
def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    out = pieces.encode(documents(spark, folder).select("doc_id", "text"), pieces_model())
    return out.select(
        "doc_id", pieces.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "library_agrees",
    )


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.judge(documents(spark, folder).select("doc_id", "text", "source"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept",
    )


@query
def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    out = repeats.remove_repeats(documents(spark, folder).select("doc_id", "text"))
    return out.select(
        "doc_id", "n_bytes", repeats.n_removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    model = toxicity.learn(docs, labels(spark, folder).where(~held_out(4, 2)))
    out = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", predicted)


@query
def op6_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    filters = languages.learn(docs.where(~held_out(3, 1)))
    out = languages.identify(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


@query
def op8_hmm(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    model = hmm.learn(docs.where(~held_out(7, 2)))
    return hmm.score(docs.withColumn("held_out", held_out(7, 2)), model)


@query
def op11_urls(spark: SparkSession, folder: str) -> DataFrame:
    model = urls.learn(urls.labelled_urls(spark))
    return urls.judge(pages(spark, folder).select("page_id", "url"), model).drop("url")


@query
def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(documents(spark, folder).select("doc_id", "text"), benchmark(spark, folder).select("item_id", "text"))


@query
def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    head = [merkle.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.digest(*head, merkle.field(lower)))
    return merkle.manifest(docs, merkle.digest(*head, merkle.field(F.col("text"))), tampered)
