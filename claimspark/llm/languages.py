"""Language identification by bit-sliced Bloom filters of n-grams.

One filter for each language, all of the same hashes, are stored as slices of one table: entry ``i``
holds bit ``i`` of every filter as a mask of languages. A few look-ups and ANDs give all languages
that contain an n-gram. A text's score for a language is the share of its n-grams found there, less
what the filter reports by chance (its fill to the power of the number of hashes).

A language contains an n-gram that is not much rarer there than in the language where it is most frequent.
Texts with passages of another language bring its n-grams in: with every n-gram of the training texts the
filters grow alike as the corpus grows, and decide less and less. There is no cap on the number of n-grams;
the table is sized by the language with the most of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .tables import plain, schema_with

GRAM = 4  # bytes
SAMPLE_DOCS = 4_000  # of a language, about: the bound of the training sample
LEAST_SHARE = 0.3  # of the n-gram's rate in the language where it is most frequent
ENTRIES_PER_GRAM = 8  # at least, of the language with the most n-grams; the fill is then at most about 0.31
HASHES = 3
UNKNOWN = "und"


def _codes(texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of lower-cased bytes within texts, as integers, and how many each text has."""
    data = arrays.LOWER[texts.data].astype(np.uint64)
    data[~arrays.NOT_SPACE[texts.data]] = 32
    counts = np.maximum(np.diff(texts.offsets) - GRAM + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    code = data[: len(data) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code |= data[k : len(data) - GRAM + 1 + k] << np.uint64(8 * k)
    inside = np.zeros(len(code) + 1, np.int8)
    full = counts > 0
    np.add.at(inside, texts.offsets[:-1][full], 1)
    np.add.at(inside, (texts.offsets[:-1] + counts)[full], -1)
    return code[np.cumsum(inside[:-1]) > 0], counts


def _counted(batches):
    for batch, texts in arrays.slices(batches, "text"):
        lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        codes, counts = _codes(texts)
        ends = np.cumsum(counts)
        out = {"lang": [], "code": [], "n": []}
        for name in set(lang):
            own = [codes[ends[i] - counts[i] : ends[i]] for i in range(len(lang)) if lang[i] == name]
            code, n = np.unique(np.concatenate(own), return_counts=True)
            out["lang"].extend([name] * len(code))
            out["code"].append(code.view(np.int64))
            out["n"].append(n)
        columns = [pa.array(out["lang"], pa.string()), *(pa.array(np.concatenate(out[k] or [np.zeros(0, np.int64)])) for k in ("code", "n"))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "code", "n"])


class Filters:
    """Bit-sliced filters: a table of language masks."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]):
        self.languages = languages
        self.tables = []
        most = max((len(g) for g in grams.values()), default=0)
        self.entries = 1 << max(6, (ENTRIES_PER_GRAM * most - 1).bit_length())
        for at in range(0, len(languages), 64):
            table = np.zeros(self.entries, np.uint64)
            for k, name in enumerate(languages[at : at + 64]):
                for place in _places(grams.get(name, np.zeros(0, np.uint64)), self.entries):
                    table[place] |= np.uint64(1) << np.uint64(k)
            self.tables.append(table)
        fill = [((t >> np.uint64(k)) & np.uint64(1)).mean() for at, t in enumerate(self.tables) for k in range(len(languages[64 * at : 64 * at + 64]))]
        self.chance = np.array(fill) ** HASHES

    def shares(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each text and language, the share of n-grams contained, corrected for chance."""
        hits = np.zeros((len(counts), len(self.languages)))
        full = np.flatnonzero(counts)
        begin = np.cumsum(counts)[full] - counts[full]
        if len(full):
            places = _places(codes, self.entries)
            for at, table in enumerate(self.tables):
                mask = table[places[0]]
                for place in places[1:]:
                    mask &= table[place]
                for k in range(len(self.languages[64 * at : 64 * at + 64])):
                    bit = ((mask >> np.uint64(k)) & np.uint64(1)).astype(np.int64)
                    hits[full, 64 * at + k] = np.add.reduceat(bit, begin)
        rate = hits / np.maximum(counts, 1)[:, None]
        return np.clip((rate - self.chance) / np.maximum(1e-9, 1 - self.chance), 0, 1) * (counts > 0)[:, None]


def _places(codes: np.ndarray, entries: int) -> list[np.ndarray]:
    """The places of each code for each hash: steps of a second hash from a first, ``entries`` being a power of two."""
    h = arrays.mixed(codes + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(entries - 1)).astype(np.int64) for k in range(HASHES)]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters from a sample of about ``sample_docs`` rows of each language, chosen by a hash of ``key``.

    Rows without a language or text do not count.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("h")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda name: (-sizes[name], name))
    if not languages:
        return Filters([], {})
    share = docs.sparkSession.createDataFrame([(name, min(1.0, sample_docs / sizes[name])) for name in languages], "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    counts = sample.select("text", "lang").mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    rated = counts.withColumn("rate", rate).withColumn("most", F.max("rate").over(Window.partitionBy("code")))
    # The sample bounds what is collected: its distinct n-grams of four bytes.
    grams = rated.where(F.col("rate") >= LEAST_SHARE * F.col("most")).select("lang", "code").toArrow()
    names = np.array(grams.column("lang").to_pylist(), object)
    codes = grams.column("code").to_numpy().view(np.uint64)
    return Filters(languages, {name: codes[names == name] for name in languages})


def _predict(shared):
    def run(batches):
        filters: Filters = shared.value
        for batch, texts in arrays.slices(batches, "_text"):
            codes, counts = _codes(texts)
            shares = filters.shares(codes, counts)
            letters = batch.column(batch.schema.get_field_index("_letters")).to_pylist()
            best = shares.argmax(axis=1) if filters.languages else np.zeros(len(counts), int)
            total = shares.sum(axis=1)
            known = [bool(x) and bool(filters.languages) for x in letters]
            names = [filters.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known, strict=True)]
            score = [float(shares[i, best[i]] / total[i]) if ok and total[i] > 0 else 0.0 for i, ok in enumerate(known)]
            yield arrays.replaced(batch, {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    return run


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    A null text and one without letters are ``und`` with score 0, as is every text if no language was
    learned. A text too short for an n-gram, and one with none that is known, gets the language most
    frequent in training with score 0; so do ties the more frequent one. Columns of ``docs`` stay, but
    those named like a new one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # at most 128 bytes an n-gram of the largest language, for each 64 languages
    rows = plain(docs, "lang_pred", "score").withColumns({"_text": F.col(text), "_letters": F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))})
    out = rows.mapInArrow(_predict(shared), schema_with(rows, lang_pred=T.StringType(), score=T.DoubleType()))
    return out.drop("_text", "_letters")
