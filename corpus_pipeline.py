"""The corpus pipeline: documents to token ids in five stages.

Each stage reads what the one before it kept, from Parquet. Stages take ``(spark, docs, sf_dir)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import decontaminate as decontamination
from claimspark.llm import linededup, minhash, pieces
from claimspark.llm import toxicity as toxic
from claimspark.llm.queries import held_out, pieces_model
from claimspark.llm.tables import ROW, benchmark, documents, labels, numbered, prepared
from claimspark.session import written

#: SQL cannot train trees, so there is no SQL of the rows; tests hold the stages against
#: brute force, encoding against the library, and toxicity against the scores of op5.
ORACLE_SQL = None


def carried(docs: DataFrame, *inputs: str) -> DataFrame:
    """``text``, the ``inputs`` of an operator, and all other columns as one, ``document``, so that no name can clash.

    Columns of ``docs`` other than these may have any name.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("document"), "text", *inputs)


def unpacked(out: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, with ``text`` and the ``changed`` ones as they are now."""
    changed = {"text": F.col("text")} | changed
    return out.select(*(changed[c].alias(c) if c in changed else F.col("document").getField(c).alias(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold.

    Null and empty texts are scored as texts without words, texts of any length whole; repeated rows and ties have equal scores and stay or go
    together. An empty table gives an empty one. Extra columns stay as they are, whatever their names.
    """
    prepared(spark)
    model = toxic.learn(docs, labels(spark, sf_dir).where(~held_out(4, 2)))
    scored = toxic.score(carried(docs).withColumn("whole_text", F.col("text")), model)
    return unpacked(scored.where(F.col("score") < toxic.THRESHOLD), docs, text=F.col("whole_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources share; ``n_chars`` follows the text.

    The first occurrence of a line by id stays, of equal ids that of the first row. Null texts stay null, empty ones empty; repeated
    rows are each a document of the same source; texts of any length are split whole. An empty table gives an empty one. Extra columns stay as they are.
    """
    out = linededup.dedup_lines(carried(docs, "doc_id", "source"))
    n_chars = F.col("document").getField("n_chars")
    changed = F.when(F.col("n_removed_lines") > 0, F.length("text")).otherwise(n_chars)
    return unpacked(out, docs, n_chars=changed.cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near duplicates, of equal ids the first row.

    Each null text is a class of its own, all texts without words are one; repeated rows are copies; texts of any
    length are compared whole. An empty table gives an empty one. Extra columns stay as they are.
    """
    rows = numbered(carried(docs, "doc_id"))
    classes = written(minhash.near_duplicates(rows.select(ROW, "doc_id", "text")))
    first = minhash.with_first(classes, "doc_id").where(F.col("first")[ROW] == F.col(ROW)).select(ROW)
    return unpacked(rows.join(first, ROW, "left_semi"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window.

    Null and empty texts have no words and stay; repeated rows are judged alike; texts of any length whole. An
    empty table gives an empty one, an empty benchmark keeps all. Extra columns stay as they are.
    """
    found = decontamination.decontaminate(carried(docs), benchmark(spark, sf_dir))
    return unpacked(found.where(~decontamination.contaminated(decontamination.n_hit(), F.col("n_words"))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as four little-endian bytes each, and digests of them and of the decoded text.

    Null and empty texts have only begin and end; repeated rows each have a row; texts of any length are encoded whole. An empty table gives
    an empty one. Extra columns are not returned.
    """
    out = pieces.encode(docs.select("doc_id", "text"), pieces_model())
    return out.select(
        "doc_id", pieces.n_tokens().alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written before the next one reads it."""
    docs = documents(prepared(spark), sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
