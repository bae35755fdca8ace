"""Near-duplicate classes by DartMinHash and banded joining.

Each element of a weighted set is a strip as wide as its weight. Darts fall on a strip as a Poisson
process over an endless rank axis, decided by the element's hash alone, so equal regions of two
sets hold the same darts. A dart names one of ``k`` coordinates; each coordinate keeps its earliest
dart. Darts are thrown up to a rank at which a set expects ``k ln k + 2 k`` of them, so the work is
about linear in the elements plus ``k log k``; the rank doubles for sets whose coordinates are not all
hit. Two sets agree on a coordinate with the probability of their weighted Jaccard similarity.

Equal word sequences are one node. Nodes that share a band are not paired with each other: they are
compared with one pivot of the band, the node that collides most. Where members of a band are then
still in different classes, an exact prefix-filtered join over them finds the links that no pivot
showed. Links are verified on whole shingle sets. No step gathers a group in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import counted_join
from ..session import written
from . import arrays
from .components import components
from .tables import ROW, plain

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5  # at similarity 0.8 a pair shares no band with probability 3e-6
RARITY_CELLS = 1 << 18
_DART, _SLOT, _WIDTH, _CELL, _BAND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_BLOCK = 8  # further darts of a strip are thrown so many at once


def _strips(element: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strips of width at most 1: element number, key, width."""
    if weight is None:
        return np.arange(len(element)), element, np.ones(len(element))
    pieces = np.ceil(weight).astype(np.int64)
    owner = np.repeat(np.arange(len(element)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    key = np.where(nth == 0, element[owner], arrays.mixed(element[owner] + nth.astype(np.uint64) * _CELL))
    return owner, key, np.minimum(1.0, weight[owner] - nth)


def _throw(key: np.ndarray, width: np.ndarray, owner: np.ndarray, limit: np.ndarray, k: int):
    """Darts below the rank limit of their set: slot (set and coordinate), rank, identity."""
    slots, ranks, ids = [], [], []
    at, rank, nth = np.arange(len(key)), np.zeros(len(key)), 0
    while len(at):
        block = 1 if nth == 0 else _BLOCK
        dart = arrays.mixed(key[at][:, None] + np.arange(nth + 1, nth + block + 1, dtype=np.uint64) * _DART)
        times = rank[at][:, None] - np.cumsum(np.log(arrays.uniform(dart)), axis=1)
        inside = times < limit[owner[at]][:, None]
        if not (width == 1).all():
            inside_strip = inside & (arrays.uniform(arrays.mixed(dart ^ _WIDTH)) < width[at][:, None])
        else:
            inside_strip = inside
        r, c = np.nonzero(inside_strip)
        hit = dart[r, c]
        slots.append(owner[at[r]] * k + (arrays.mixed(hit ^ _SLOT) % np.uint64(k)).astype(np.int64))
        ranks.append(times[r, c])
        ids.append(hit)
        rank[at] = times[:, -1]
        at = at[inside[:, -1]]
        nth += block
    return np.concatenate(slots), np.concatenate(ranks), np.concatenate(ids)


def signatures(element: np.ndarray, owner: np.ndarray, n_sets: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """One row of ``k`` dart identities for each set; sets without elements have zeros.

    Without weights every element counts 1, however often it is given.
    """
    of, key, width = _strips(element, weight)
    owner = owner[of]
    total = np.bincount(owner, weights=width, minlength=n_sets)
    out = np.zeros(n_sets * k, np.uint64)
    limit = np.full(n_sets, k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    left = total > 0
    while left.any():
        mine = left[owner]
        slot, rank, dart = _throw(key[mine], width[mine], owner[mine], limit, k)
        best = np.full(n_sets * k, np.inf)
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        filled = np.isfinite(best).reshape(n_sets, k).all(axis=1) & left
        first &= filled[slot // k]
        out[slot[first]] = dart[first]
        left &= ~filled
        limit[left] *= 2
    return out.reshape(n_sets, k)


def _elements(texts: arrays.Texts, size: int) -> tuple[np.ndarray, np.ndarray, arrays.Words, np.ndarray]:
    """Shingles of each text (fewer words than ``size``: all of them as one) and their text."""
    found = arrays.words(texts, arrays.ALNUM)
    hashes = arrays.word_hashes(texts, found)
    element, at = arrays.shingles(hashes, found, size)
    owner = np.searchsorted(found.first, at, "right") - 1
    short = np.flatnonzero((found.counts() > 0) & (found.counts() < size))
    if len(short):
        whole = arrays.Runs(hashes, arrays.WORD_POWERS).get(found.first[short], found.first[short + 1])
        element, owner = np.concatenate([element, whole]), np.concatenate([owner, short])
    return element, owner, found, hashes


_SECOND = arrays.Powers(0x94D049BB133111EB | 1)


def _digests(found: arrays.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's word sequence."""
    a = arrays.Runs(hashes, arrays.WORD_POWERS).get(found.first[:-1], found.first[1:])
    b = arrays.Runs(arrays.mixed(hashes + _BAND), _SECOND).get(found.first[:-1], found.first[1:])
    return a.view(np.int64), b.view(np.int64)


def _signed(size: int, bands: int, rows: int):
    def run(batches):
        for batch, texts in arrays.slices(batches, "_text", arrays.WIDE_BYTES):
            element, owner, found, hashes = _elements(texts, size)
            n = batch.num_rows
            a, b = _digests(found, hashes)
            sig = signatures(element, owner, n, bands * rows).reshape(n, bands, rows)
            band = np.zeros((n, bands), np.uint64)
            for k in range(rows):
                band = arrays.mixed(band * _BAND + sig[:, :, k])
            band = arrays.mixed(band + np.arange(bands, dtype=np.uint64) * _DART)
            counts = np.where(found.counts() > 0, bands, 0)
            kept = band[found.counts() > 0].reshape(-1).view(np.int64)
            slim = batch.drop_columns(["_text"])
            null = batch.column(batch.schema.get_field_index("_text")).is_null()
            yield arrays.replaced(
                slim, {"_a": pa.array(a), "_b": pa.array(b), "_null": null, "_bands": arrays.lists(counts, pa.array(kept))}
            )

    return run


def _keyed_texts(batches):
    for batch, texts in arrays.slices(batches, "text"):
        found = arrays.words(texts, arrays.ALNUM)
        a, b = _digests(found, arrays.word_hashes(texts, found))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column(0)], names=["a", "b", "text"])


def _sets(texts: arrays.Texts, size: int) -> list[np.ndarray]:
    element, owner, _, _ = _elements(texts, size)
    order = np.lexsort((element, owner))
    element, owner = element[order], owner[order]
    keep = np.ones(len(element), bool)
    keep[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
    element, owner = element[keep], owner[keep]
    return np.split(element, np.searchsorted(owner, np.arange(1, len(texts.offsets) - 1)))


def _similar(size: int, least: float):
    def run(batches):
        for batch, left in arrays.slices(batches, "x"):
            u, v, links = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            own, known = _sets(left, size), {}
            column = batch.column(batch.schema.get_field_index("y"))
            for i, key in enumerate(v):
                if key not in known:
                    if len(known) > 64:
                        known.clear()
                    known[key] = _sets(arrays.views(column.slice(i, 1)), size)[0]
                other = known[key]
                common = len(np.intersect1d(own[i], other, assume_unique=True))
                links.append(common >= least * (len(own[i]) + len(other) - common) - 1e-9)
            keep = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(u, np.int64)[keep]), pa.array(np.array(v, np.int64)[keep])], names=["u", "v"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs ``u, v`` of nodes whose shingle sets have Jaccard similarity of at least ``least``."""
    left = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u")
    both = left.join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(_similar(size, least), "u long, v long")


def _rarity(size: int):
    def run(batches):
        cells = np.zeros(RARITY_CELLS, np.int64)
        for _, texts in arrays.slices(batches, "text"):
            element, *_ = _elements(texts, size)
            cells += np.bincount((element % np.uint64(RARITY_CELLS)).astype(np.int64), minlength=RARITY_CELLS)
        seen = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(cells[seen])], names=["cell", "n"])

    return run


def _prefixes(size: int, least: float, shared):
    def run(batches):
        counts = shared.value
        for batch, texts in arrays.slices(batches, "text"):
            node, token, place, total = [], [], [], []
            for name, own in zip(batch.column(0).to_pylist(), _sets(texts, size), strict=True):
                rank = counts[(own % np.uint64(RARITY_CELLS)).astype(np.int64)]
                n = len(own)
                prefix = own[np.lexsort((own, rank))][: n - math.ceil(least * n - 1e-9) + 1]
                node.append(np.full(len(prefix), name, np.int64))
                token.append(prefix.view(np.int64))
                place.append(np.arange(len(prefix)))
                total.append(np.full(len(prefix), n))
            columns = [np.concatenate(x) for x in (node, token, place, total)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["node", "token", "place", "n"])

    return run


def _rest(texts: DataFrame, comp: DataFrame, size: int, least: float) -> DataFrame:
    """Pairs of different classes that share a prefix shingle and may reach ``least``.

    Shingles are ordered by how often they occur, as counted in a table of fixed size; any order
    that is the same for all sets gives the same links. Of each token only the members outside its
    largest class are paired, with those of other classes.
    """
    spark = texts.sparkSession
    cells = np.zeros(RARITY_CELLS, np.int64)
    for r in texts.select("text").mapInArrow(_rarity(size), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        cells[r["cell"]] = r["n"]
    shared = spark.sparkContext.broadcast(cells)
    tokens = texts.select("node", "text").mapInArrow(_prefixes(size, least, shared), "node long, token long, place int, n int")
    tokens = written(tokens)
    common = written(tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"))
    tokens = written(counted_join(tokens, common, "token", "node", "m").drop("m").join(comp, "node"))
    sizes = tokens.groupBy("token", "label").agg(F.count("*").alias("m"))
    main = sizes.groupBy("token").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels"), F.sum("m").alias("rows"))
    main = written(main.where("labels > 1").select("token", F.col("top.label").alias("main"), "rows"))
    open_tokens = written(counted_join(tokens, main, "token", "node", "rows").drop("rows"))
    # Sets within ``least`` of each other's size are of the same band of sizes or of neighbouring ones.
    band = F.floor(F.log("n") / (max(-math.log(least), 1e-6) * (1 + 1e-6)))
    near = F.explode(F.array(*(band + k for k in (-1, 0, 1)))).alias("band")
    outside = open_tokens.where("label != main").select("token", near, *(F.col(c).alias(f"{c}_o") for c in ("node", "label", "place", "n", "main")))
    inside = open_tokens.drop("main").withColumn("band", band)
    pairs = inside.join(outside, ["token", "band"]).where("label != label_o and (label = main_o or node < node_o)")
    low, high = F.least("n", "n_o"), F.greatest("n", "n_o")
    overlap = F.least(F.col("n") - F.col("place"), F.col("n_o") - F.col("place_o"))
    fits = (low + 1e-9 >= least * high) & (overlap + 1e-9 >= least / (1 + least) * (F.col("n") + F.col("n_o")))
    return pairs.where(fits).select(F.col("node_o").alias("u"), F.col("node").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``docs`` less the text, with ``class_row`` and ``in_class``; ``docs`` must have the id ``_row``.

    A class is a connected group of documents linked by a Jaccard similarity of at least
    ``similarity`` of their sets of ``shingle`` words in a row; fewer words are one shingle.
    ``class_row`` is the least row of the class. Texts without words are equal to each other; each
    null text is a class of its own. Repeated rows are copies. Other columns stay.
    """
    keep = [c for c in plain(docs, "class_row", "in_class").columns if c != text]
    slim = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    signed = written(slim.mapInArrow(_signed(shingle, bands, rows), f"{fields}, _a long, _b long, _null boolean, _bands array<long>"))
    digest = F.struct("_a", "_b", F.when(F.col("_null"), F.col(ROW)).alias("own")).alias("_digest")
    nodes = written(signed.groupBy(digest).agg(F.min(ROW).alias("node"), F.count("*").alias("m")))

    # Bands of one row of each node; only those that several nodes share.
    bands_of = signed.select(F.col(ROW).alias("node"), F.col("_bands").alias("bands")).join(nodes.select("node"), "node")
    keys = written(bands_of.select("node", F.explode("bands").alias("band")))
    shared = written(keys.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"))
    members = written(counted_join(keys, shared, "band", "node", "m"))
    weight = members.groupBy("node").agg(F.sum("m").alias("weight"))
    weighted = written(members.select("band", "node").join(weight, "node"))
    pivots = weighted.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("top"), F.count("*").alias("m"))
    pivots = written(pivots.select("band", (-F.col("top.node")).alias("v"), "m"))
    pairs = counted_join(weighted, pivots, "band", "node", "m").where("node != v").select(F.col("node").alias("u"), "v").distinct()

    # One text of each node that shares a band.
    involved = signed.select(F.col(ROW).alias("node"), F.col("_a").alias("a"), F.col("_b").alias("b")).join(weight.select("node"), "node")
    keyed = docs.select(F.col(text).alias("text")).where(F.col(text).isNotNull()).mapInArrow(_keyed_texts, "a long, b long, text string")
    keyed = keyed.groupBy("a", "b").agg(F.first("text").alias("text"))
    texts = written(keyed.join(involved, ["a", "b"]).select("node", "text"))

    links = written(verified(pairs, texts, shingle, similarity))
    comp = components(links)
    label = F.coalesce("label", "node").alias("label")
    labelled = written(weighted.select("band", "node").join(comp, "node", "left").select("band", "node", label))
    open_bands = labelled.groupBy("band").agg((F.min("label") != F.max("label")).alias("open"), F.count("*").alias("m"))
    open_bands = written(open_bands.where("open").select("band", "m"))
    open_nodes = written(counted_join(labelled, open_bands, "band", "node", "m").select("node", "label").distinct())
    if not open_nodes.isEmpty():
        rest = _rest(texts.join(open_nodes.select("node"), "node"), open_nodes, shingle, similarity)
        more = written(verified(rest, texts, shingle, similarity))
        if not more.isEmpty():
            comp = components(links.unionByName(more))

    # Sizes come from the nodes; the rows themselves meet their node once, a digest of many rows in slices.
    named = written(nodes.join(comp, "node", "left").select("_digest", "node", "m", F.coalesce("label", "node").alias("_label")))
    sizes = written(named.groupBy("_label").agg(F.sum("m").alias("_rows"), F.count("*").alias("_nodes")))
    named = written(counted_join(named, sizes, "_label", "node", "_nodes").select("_digest", F.col("m").alias("_m"), "_label", "_rows"))
    out = counted_join(signed.select(*keep, digest), named, "_digest", ROW, "_m")
    return out.select(*keep, F.col("_label").alias("class_row"), F.col("_rows").alias("in_class"))


def with_first(classes: DataFrame, *order: str) -> DataFrame:
    """Rows of ``near_duplicates`` with ``first``: the least ``order`` columns and ``_row`` of the class.

    Classes of any size: their rows are aggregated where they are and spread for the join. A column
    named ``first`` is replaced.
    """
    classes = classes.drop(*(c for c in classes.columns if c.lower() == "first" and c not in order))
    least = written(classes.groupBy("class_row").agg(F.min(F.struct(*order, ROW)).alias("first"), F.count("*").alias("_rows")))
    return counted_join(classes, least, "class_row", ROW, "_rows").drop("_rows")
