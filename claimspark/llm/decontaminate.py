"""Benchmark decontamination: a prefix-filtered containment join.

Each benchmark item is cut into windows of ``window`` words (an item of fewer words is one window)
and each window into shingles. A document contains a window only if it contains all of its
shingles, so one of them, the prefix, is enough to find candidates: the shingle that is rarest in
the documents. A candidate must leave room for the whole window around the shingle (positional and
length bounds) and is then checked word by word.

The documents are never shuffled. The windows are dealt into blocks of at most ``block_windows``
rows; one block at a time is broadcast and joined with every document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import arrays
from .tables import plain, schema_with

WINDOW = 13
SHINGLE = 3
BLOCK_WINDOWS = 500_000

_WINDOWS = "item string, words binary, n int"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
ITEMS = T.ArrayType(T.StringType())


class Block(NamedTuple):
    """Distinct windows with their items, ordered by prefix."""

    windows: list[bytes]
    items: list[list[str]]
    n: np.ndarray  # words
    size: np.ndarray  # words of a shingle
    whole: np.ndarray  # hash of all words
    prefix: np.ndarray  # hash of the chosen shingle
    place: np.ndarray  # where that shingle begins


def _window_rows(size: int):
    def run(batches):
        for batch, texts in arrays.slices(batches, "text"):
            found = arrays.words(texts, arrays.ALNUM)
            lower = arrays.LOWER[texts.data]
            item, text, n = [], [], []
            for i, name in enumerate(batch.column(0).to_pylist()):
                at = range(found.first[i], found.first[i + 1])
                own = [lower[found.start[w] : found.stop[w]].tobytes() for w in at]
                for k in range(max(1, len(own) - size + 1) if own else 0):
                    item.append(name)
                    text.append(b" ".join(own[k : k + size]))
                    n.append(min(size, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(text, pa.binary()), pa.array(n, pa.int32())], names=["item", "words", "n"])

    return run


def windows(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """The distinct windows of each item: ``item, words, n``. Items without an id are named ''."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(_window_rows(window), _WINDOWS).distinct()


def _hash_words(texts: list[bytes]) -> tuple[np.ndarray, arrays.Words]:
    view = arrays.views(pa.array(texts, pa.binary()))
    found = arrays.words(view, arrays.ALNUM)
    return arrays.word_hashes(view, found), found


def _candidates(rows: list, shingle: int) -> tuple[list[bytes], list[list[str]], np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct windows: text, items, words, hashes of their shingles, hash of the whole."""
    by_text: dict[bytes, list[str]] = {}
    for r in rows:
        by_text.setdefault(bytes(r["words"]), []).append(r["item"])
    texts = sorted(by_text)
    hashes, found = _hash_words(texts)
    runs, n = arrays.Runs(hashes, arrays.WORD_POWERS), found.counts()
    own = []
    for i, count in enumerate(n):
        size = min(shingle, int(count))
        at = np.arange(found.first[i], found.first[i + 1] - size + 1)
        own.append(runs.get(at, at + size))
    return texts, [by_text[t] for t in texts], n, own, runs.get(found.first[:-1], found.first[1:])


def _lookup(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the sorted keys, and the first place of each there."""
    place = np.searchsorted(keys, hashes)
    hit = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == hashes) if len(keys) else np.zeros(0, np.int64)
    return hit, place[hit]


def _frequency(keys_by_size):
    """Occurrences of each of the block's shingles in a partition of documents."""

    def run(batches):
        keys = keys_by_size.value
        counts = {size: np.zeros(len(k), np.int64) for size, k in keys.items()}
        for _, texts in arrays.slices(batches, "text"):
            found = arrays.words(texts, arrays.ALNUM)
            hashes = arrays.word_hashes(texts, found)
            for size, k in keys.items():
                own, _ = arrays.shingles(hashes, found, size)
                _, place = _lookup(k, own)
                counts[size] += np.bincount(place, minlength=len(k))
        for size, k in keys.items():
            seen = np.flatnonzero(counts[size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), size), pa.int32()), pa.array(k[seen].view(np.int64)), pa.array(counts[size][seen])],
                names=["size", "shingle", "n"],
            )

    return run


def _block(docs: DataFrame, text: str, rows: list, shingle: int) -> Block:
    """Choose the rarest shingle of each window; ties go to the first in the window."""
    texts, items, n, own, whole = _candidates(rows, shingle)
    sizes = np.minimum(n, shingle)
    keys = {int(s): np.unique(np.concatenate([own[i] for i in np.flatnonzero(sizes == s)])) for s in np.unique(sizes)}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(keys)
    seen = (
        docs.select(F.col(text).alias("text"))
        .mapInArrow(_frequency(shared), "size int, shingle long, n long")
        .groupBy("size", "shingle")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most one row for each shingle of the block
    )
    count = {(r["size"], r["shingle"] & ((1 << 64) - 1)): r["n"] for r in seen}
    place = np.array([int(np.argmin([count.get((s, int(h)), 0) for h in hs])) for s, hs in zip(sizes.tolist(), own, strict=True)], np.int64)
    prefix = np.array([int(hs[p]) for hs, p in zip(own, place, strict=True)], np.uint64)
    order = np.argsort(prefix, kind="stable")
    return Block([texts[i] for i in order], [items[i] for i in order], n[order], sizes[order], whole[order], prefix[order], place[order])


def _matches(block: Block, texts: arrays.Texts, found: arrays.Words) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of the block begin in the texts: word number, window number."""
    hashes = arrays.word_hashes(texts, found)
    runs = arrays.Runs(hashes, arrays.WORD_POWERS)
    owner = np.repeat(np.arange(len(found.first) - 1), found.counts())
    lower = None
    starts, which = [], []
    for size in np.unique(block.size):
        index = np.flatnonzero(block.size == size)
        keys = block.prefix[index]
        own, at = arrays.shingles(hashes, found, int(size))
        hit, low = _lookup(keys, own)
        if not len(hit):
            continue
        times = np.searchsorted(keys, own[hit], "right") - low
        ends = np.cumsum(times)
        w = index[np.repeat(low - (ends - times), times) + np.arange(ends[-1])]
        start = np.repeat(at[hit], times) - block.place[w]
        doc = np.repeat(owner[at[hit]], times)
        fits = (start >= found.first[doc]) & (start + block.n[w] <= found.first[doc + 1])
        w, start = w[fits], start[fits]
        same = runs.get(start, start + block.n[w]) == block.whole[w]
        for s, k in zip(start[same].tolist(), w[same].tolist(), strict=True):
            lower = arrays.LOWER[texts.data] if lower is None else lower
            span = range(s, s + int(block.n[k]))
            if b" ".join(lower[found.start[i] : found.stop[i]].tobytes() for i in span) == block.windows[k]:
                starts.append(s)
                which.append(k)
    return np.array(starts, np.int64), np.array(which, np.int64)


def _annotate(shared, first: bool):
    def run(batches):
        block = shared.value
        for batch, texts in arrays.slices(batches, "_text"):
            found = arrays.words(texts, arrays.ALNUM)
            n_docs, total = len(texts.offsets) - 1, int(found.first[-1])
            start, which = _matches(block, texts, found)
            edge = np.zeros(total + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + block.n[which], -1)
            covered = np.cumsum(edge[:-1]) > 0
            docs = np.searchsorted(found.first, start, "right") - 1
            items: list[set[str]] = [set() for _ in range(n_docs)]
            for d, k in zip(docs.tolist(), which.tolist(), strict=True):
                items[d].update(block.items[k])
            if not first:
                before = batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
                for d, spans in enumerate(before):
                    for s in spans:
                        covered[found.first[d] + s["start"] : found.first[d] + s["stop"]] = True
                for d, names in enumerate(batch.column(batch.schema.get_field_index("items")).to_pylist()):
                    items[d].update(names)
            hits = arrays.Texts(covered.view(np.uint8), found.first)
            spans = arrays.words(hits, np.arange(256) > 0)
            base = np.repeat(found.first[:-1], spans.counts())
            pairs = pa.StructArray.from_arrays([pa.array(spans.start - base, pa.int32()), pa.array(spans.stop - base, pa.int32())], names=["start", "stop"])
            names = [sorted(x) for x in items]
            yield arrays.replaced(
                batch,
                {
                    "n_words": pa.array(found.counts(), pa.int64()),
                    "hit_spans": arrays.lists(spans.counts(), pairs),
                    "items": pa.array(names, pa.list_(pa.string())),
                },
            )

    return run


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges) and ``items`` (ids as strings, sorted).

    Words are runs of letters, digits and non-ASCII characters; A-Z equal a-z. Null and empty texts
    have no words, so no hits; items without words have no windows. Repeated rows are judged each
    for itself. Columns of ``docs`` stay, but those named like a new one are replaced. No items:
    every document has empty lists.
    """
    docs = plain(docs, "n_words", "hit_spans", "items")
    found = written(windows(items, item_id, item_text, window))
    total = found.count()
    blocks = max(1, -(-total // block_windows))
    # Blocks of bounded size whatever the windows are: by rank of the hash, not by its value.
    if blocks > 1:
        found = written(found.withColumn("_part", F.pmod(F.xxhash64("words", "item"), F.lit(2 * blocks))))
    parts = [found] if blocks == 1 else [found.where(F.col("_part") == k) for k in range(2 * blocks)]
    new = {"n_words": T.LongType(), "hit_spans": SPANS, "items": ITEMS}
    out = docs.withColumn("_text", F.col(text))
    for k, part in enumerate(parts):
        rows = part.select("item", "words").collect()  # one block: about block_windows rows
        shared = docs.sparkSession.sparkContext.broadcast(_block(docs, text, rows, shingle))
        out = out.mapInArrow(_annotate(shared, k == 0), schema_with(out, **new))
        if k + 1 < len(parts):
            out = written(out)
    return out.drop("_text")


def contaminated(n_hit, n_words):
    """The rule: at least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def n_hit(spans: str = "hit_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
