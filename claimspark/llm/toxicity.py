"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings much more frequent in toxic training texts. The
features are densities of the lexicon and its nearness to words of the second person, capitals,
punctuation and obfuscation rates. Trees and calibration are Spark ML, fitted on a bounded sample of
labelled rows; every text is scored in one pass.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import arrays
from .tables import plain, schema_with

SAMPLE_TOXIC, SAMPLE_OTHER = 8_000, 12_000  # rows, about: the bound of the training sample
LEXICON = 400
LEAST_RATIO = 8.0  # of document frequencies, toxic against other
STEMS = (4, 5, 6)  # bytes of word beginnings that count as entries of the lexicon
NEAR = 5  # words
THRESHOLD = 0.3
_STEM = np.uint64(0x8EBC6AF09C88C6E3)

# Words of the second person in English, German, French and Spanish.
SECOND_PERSON = """
you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros vuestro
""".split()
# Digits that stand for letters.
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}

FEATURES = [
    "log_words", "hits", "hit_density", "weight", "weight_density", "top_weight", "kinds", "second_density", "near_hits",
    "capitals", "loud_words", "exclaims", "punctuation", "digits_in_words", "hidden_hits", "word_length",
]


class Lexicon(NamedTuple):
    tokens: np.ndarray  # hashes, sorted
    weights: np.ndarray


def _word_keys(texts: arrays.Texts, found: arrays.Words, values: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Hashes of words and of their beginnings; those no longer than the beginning have 0."""
    runs = arrays.Runs(values[texts.data], arrays.BYTE_POWERS)
    stems = {}
    for n in STEMS:
        stop = np.minimum(found.start + n, found.stop)
        key = arrays.mixed(runs.get(found.start, stop) ^ _STEM)
        key[found.stop - found.start <= n] = 0
        stems[n] = key
    return runs.get(found.start, found.stop), stems


def _tokens(batches):
    """Distinct words and beginnings of each text, with its label."""
    for batch, texts in arrays.slices(batches, "text"):
        label = np.array(batch.column(batch.schema.get_field_index("label")).to_pylist(), np.int64)
        found = arrays.words(texts, arrays.ALNUM)
        whole, stems = _word_keys(texts, found, arrays.LOWER_VALUE)
        owner = np.repeat(np.arange(batch.num_rows), found.counts())
        keys = np.concatenate([whole, *stems.values()])
        owners = np.tile(owner, 1 + len(stems))
        pair = np.unique(np.stack([keys, owners.astype(np.uint64)]), axis=1)
        pair = pair[:, pair[0] != 0]
        key, inverse = np.unique(pair[0], return_inverse=True)
        positive = np.bincount(inverse, weights=label[pair[1].astype(np.int64)], minlength=len(key)).astype(np.int64)
        total = np.bincount(inverse, minlength=len(key))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(positive), pa.array(total - positive)], names=["token", "toxic", "other"])


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> Lexicon:
    """Tokens of ``sample`` (``text, label``) that are at least LEAST_RATIO times as frequent in toxic texts."""
    totals = sample.agg(F.sum("label"), F.count("*")).first()
    toxic, other = totals[0] or 0, (totals[1] or 0) - (totals[0] or 0)
    if not toxic or not other:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    least = max(3, toxic // 200)
    counts = sample.select("text", "label").mapInArrow(_tokens, "token long, toxic long, other long")
    counts = counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") >= least)
    ratio = (F.col("toxic") / toxic) / ((F.col("other") + 0.5) / other)
    weight = F.least(F.log(ratio), F.lit(8.0))
    rows = counts.withColumn("weight", weight).where(F.col("weight") >= math.log(LEAST_RATIO))
    rows = rows.orderBy(F.desc(F.col("toxic") * F.col("weight")), "token").limit(size).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return Lexicon(tokens[order], np.array([r["weight"] for r in rows])[order])


def _weights(lexicon: Lexicon, whole: np.ndarray, stems: dict[int, np.ndarray]) -> np.ndarray:
    """For each word the largest weight of its entries, or 0."""
    out = np.zeros(len(whole))
    if len(lexicon.tokens):
        for keys in (whole, *stems.values()):
            place = np.minimum(np.searchsorted(lexicon.tokens, keys), len(lexicon.tokens) - 1)
            np.maximum(out, np.where(lexicon.tokens[place] == keys, lexicon.weights[place], 0.0), out=out)
    return out


def _table(chars) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER, _LOW = _table(map(chr, range(65, 91))), _table(map(chr, range(97, 123)))
_DIGIT, _EXCLAIM = _table("0123456789"), _table("!?")
_PUNCTUATION = _table("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN = arrays.LOWER.copy()
for _digit, _letter in DIGIT_LETTERS.items():
    _PLAIN[ord(_digit)] = ord(_letter)
_PLAIN_VALUE = arrays.BYTE_VALUE[_PLAIN]


def _hashes_of(texts: list[str]) -> np.ndarray:
    view = arrays.views(pa.array(texts))
    return np.unique(arrays.word_hashes(view, arrays.words(view, arrays.ALNUM)))


_SECOND = _hashes_of(SECOND_PERSON)


def features_of(texts: arrays.Texts, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    n_docs = len(texts.offsets) - 1
    found = arrays.words(texts, arrays.ALNUM)
    whole, stems = _word_keys(texts, found, arrays.LOWER_VALUE)
    weight = _weights(lexicon, whole, stems)
    n_words, n_bytes = found.counts().astype(float), np.diff(texts.offsets).astype(float)
    owner = np.repeat(np.arange(n_docs), found.counts())
    per_doc = lambda x: np.bincount(owner, weights=x, minlength=n_docs)

    def sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[first[1:]] - total[first[:-1]]).astype(float)

    hit = weight > 0
    second = np.isin(whole, _SECOND)
    near = np.zeros(len(whole))
    mark = np.flatnonzero(second)
    edge = np.zeros(len(whole) + 1, np.int64)
    np.add.at(edge, np.maximum(mark - NEAR, found.first[owner[mark]]), 1)
    np.add.at(edge, np.minimum(mark + NEAR + 1, found.first[owner[mark] + 1]), -1)
    near = (np.cumsum(edge[:-1]) > 0) & hit
    top = np.zeros(n_docs)
    np.maximum.at(top, owner[hit], weight[hit])
    kinds = np.bincount(np.unique(np.stack([owner[hit].astype(np.uint64), whole[hit]]), axis=1)[0].astype(np.int64), minlength=n_docs)

    upper, low, digit = _UPPER[texts.data], _LOW[texts.data], _DIGIT[texts.data]
    run = lambda flags: (lambda t: t[found.stop] - t[found.start])(np.concatenate([[0], np.cumsum(flags)]))
    uppers, digits, length = run(upper), run(digit), found.stop - found.start
    mixed_word = (digits > 0) & (digits < length)
    hidden = np.zeros(len(whole), bool)
    if mixed_word.any():
        at = np.flatnonzero(mixed_word)
        some = arrays.Words(found.start[at], found.stop[at], found.first)
        hidden[at] = (_weights(lexicon, *_word_keys(texts, some, _PLAIN_VALUE)) > 0) & ~hit[at]
    words, size = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    letters = np.maximum(sums(upper, texts.offsets) + sums(low, texts.offsets), 1)
    columns = [
        np.log1p(n_words), per_doc(hit), per_doc(hit) / words, per_doc(weight), per_doc(weight) / words, top, kinds,
        per_doc(second) / words, per_doc(near), sums(upper, texts.offsets) / letters,
        per_doc((uppers == length) & (length > 1)) / words, sums(_EXCLAIM[texts.data], texts.offsets) / size,
        sums(_PUNCTUATION[texts.data], texts.offsets) / size, per_doc(mixed_word) / words, per_doc(hidden), per_doc(length) / words,
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def _featured(shared):
    def run(batches):
        for batch, texts in arrays.slices(batches, "_text"):
            rows = features_of(texts, shared.value)
            columns = {name: pa.array(rows[:, k]) for k, name in enumerate(_columns())}
            yield arrays.replaced(batch.drop_columns(["_text"]), columns)

    return run


def _columns() -> list[str]:
    return [f"_f_{name}" for name in FEATURES]


def featured(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` less the text, with a column for each feature. Null and empty texts have zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    slim = docs.withColumn("_text", F.col(text)).drop(text)
    schema = schema_with(slim.drop("_text"), **{name: T.DoubleType() for name in _columns()})
    return slim.mapInArrow(_featured(shared), schema)


class Model(NamedTuple):
    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    base: float  # the score where there are no trees


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """A model from about SAMPLE_TOXIC + SAMPLE_OTHER labelled rows, chosen by a hash of ``key``.

    A key with several labels counts by the largest; rows without a label, key or text do not count.
    Of equal texts with the same label one is used, so exact copies do not weigh; texts that differ
    anywhere all count. One fifth of the sample calibrates.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    empty = Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), None, None, float(base))
    if len(sizes) < 2:
        return empty
    share = F.when(F.col("label") == 1, F.lit(SAMPLE_TOXIC / sizes[1])).otherwise(F.lit(SAMPLE_OTHER / sizes[0]))
    chosen = known.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < share * (1 << 20))
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    sample = sample.join(F.broadcast(chosen), "_key")  # the sample's bound in rows
    sample = written(_without_copies(sample))
    lexicon = learn_lexicon(sample)
    rows = featured(sample, lexicon)
    assembled = written(VectorAssembler(inputCols=_columns(), outputCol="_features").transform(rows).select("_key", "label", "_features"))
    part = F.pmod(F.xxhash64("_key", F.lit(5)), F.lit(5))
    fitting, rest = assembled.where(part != 0), assembled.where(part == 0)
    if fitting.select("label").distinct().count() < 2 or rest.select("label").distinct().count() < 2:
        fitting = rest = assembled
    if fitting.select("label").distinct().count() < 2:
        return empty._replace(lexicon=lexicon)
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxDepth=3, maxIter=15, stepSize=0.3, seed=7).fit(fitting)
    # The sample's classes are weighed back to their shares among the labels.
    scale = {k: sizes[k] / max(1, n) for k, n in ((r["label"], r["count"]) for r in rest.groupBy("label").count().collect())}
    weight = F.when(F.col("label") == 1, scale.get(1, 1.0)).otherwise(scale.get(0, 1.0))
    margins = _margins(trees, rest).select("_margin", F.col("label").cast("double").alias("label"), weight.alias("weight"))
    calibration = IsotonicRegression(featuresCol="_margin", labelCol="label", weightCol="weight", predictionCol="_score").fit(margins)
    return Model(lexicon, trees, calibration, float(base))


def _without_copies(sample: DataFrame) -> DataFrame:
    """The row of least ``_key`` for each whole text and label."""
    from pyspark.sql import Window

    same = Window.partitionBy(F.sha2("text", 256), "label").orderBy("_key")
    return sample.withColumn("_n", F.row_number().over(same)).where("_n = 1").select("_key", "text", "label")


def _margins(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("_margin", vector_to_array("rawPrediction")[1])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` less the text, with ``score`` between 0 and 1 for every row.

    Null and empty texts are scored as texts without words. Without labels of both kinds, every score
    is the share of toxic labels. Repeated rows have equal scores.
    """
    docs = plain(docs, "score")
    if model.trees is None:
        return docs.drop(text).withColumn("score", F.lit(model.base))
    rows = VectorAssembler(inputCols=_columns(), outputCol="_features").transform(featured(docs, model.lexicon, text))
    keep = [c for c in docs.columns if c != text]
    # Other columns travel as one, as the names of those that the models add are fixed.
    rows = rows.select(F.struct(*keep, F.lit(0).alias("_")).alias("_rest"), "_features")
    scored = model.calibration.transform(_margins(model.trees, rows).select("_rest", "_margin"))
    return scored.select(*(F.col("_rest")[c].alias(c) for c in keep), F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)).alias("score"))
