"""Ranked lexical search of many queries at once, with shared sums computed once.

Items are queries; the score of a document is the sum of the parts of the item's terms. Term sets that
several items share are mined: terms are put in one order, and neighbouring symbols that stand
together in two items or more become a symbol of their own, over and over. What results is a graph in
which a node is the sum of two others, so a document's partial sum over a shared set is made once
and read by all items that hold it.

Items come in blocks of a bounded number of terms. For a block, texts are read once into counts of the
block's terms; document frequencies are an aggregation of them; scores are then sums of whole
numbers, for many documents side by side. A task sends on at most ``k`` rows of an item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import arrays
from .tables import ROW, numbered

K = 50
BLOCK_TERMS = 20_000  # terms of the items of a block, with repeats; a longer item is a block of its own
CELLS = 1 << 21  # sums of documents that are worked on side by side
SPREAD = 64  # parts of an item's candidates that are ranked first
MILLE, GIGA, LENGTH_SHARE = 1000, 1_000_000_000, 50


# --- queries that share sums -----------------------------------------------------------------


class Sums(NamedTuple):
    """Nodes 0 to ``n_terms - 1`` are terms; the others are sums of two nodes, by levels."""

    n_terms: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # node, left, right
    flat: np.ndarray  # nodes of all queries, one query after the other
    first: np.ndarray  # where each query begins

    @property
    def n_nodes(self) -> int:
        return self.n_terms + sum(len(x[0]) for x in self.levels)

    def additions(self) -> int:
        return self.n_nodes - self.n_terms + len(self.flat) - len(self.first)


def share(queries: list[list[int]], n_terms: int) -> Sums:
    """The graph of sums of queries, each a list of different terms that is not empty.

    Terms of more queries come first, those of the same queries next to each other. In each round
    the pairs of neighbours of two queries or more become nodes, the most frequent first, no symbol in
    two pairs. A round is linear in the queries.
    """
    holders: dict[int, list[int]] = {}
    for q, terms in enumerate(queries):
        for t in terms:
            holders.setdefault(t, []).append(q)
    place = {t: k for k, t in enumerate(sorted(holders, key=lambda t: (-len(holders[t]), holders[t], t)))}
    rows = [sorted(terms, key=place.__getitem__) for terms in queries]
    nodes: list[tuple[int, int, int]] = []
    depth: dict[int, int] = {}
    while True:
        counts = Counter(pair for row in rows for pair in zip(row, row[1:], strict=False))
        chosen: dict[int, tuple[int, int]] = {}
        taken: set[int] = set()
        for (a, b), n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if n < 2:
                break
            if a not in taken and b not in taken:
                taken |= {a, b}
                node = n_terms + len(nodes)
                chosen[a] = b, node
                depth[node] = 1 + max(depth.get(a, 0), depth.get(b, 0))
                nodes.append((node, a, b))
        if not chosen:
            break
        for q, row in enumerate(rows):
            out, i = [], 0
            while i < len(row):
                pair = chosen.get(row[i])
                if pair and i + 1 < len(row) and row[i + 1] == pair[0]:
                    out.append(pair[1])
                    i += 2
                else:
                    out.append(row[i])
                    i += 1
            rows[q] = out
    levels = []
    for level in range(1, max(depth.values(), default=0) + 1):
        levels.append(tuple(np.array(x, np.int64) for x in zip(*(n for n in nodes if depth[n[0]] == level), strict=True)))
    sizes = [len(row) for row in rows]
    return Sums(n_terms, levels, np.array([s for row in rows for s in row], np.int64), np.cumsum([0, *sizes[:-1]]).astype(np.int64))


def totals(sums: Sums, parts: np.ndarray) -> np.ndarray:
    """Totals of each query, from ``parts`` with a row for each term and a column for each document."""
    cells = np.zeros((sums.n_nodes, parts.shape[1]), np.int64)
    cells[: sums.n_terms] = parts
    for node, left, right in sums.levels:
        cells[node] = cells[left] + cells[right]
    return np.add.reduceat(cells[sums.flat], sums.first, axis=0)


# --- tasks -----------------------------------------------------------------------------------


def _item_terms(batches):
    """Different terms of each item, as hashes."""
    for batch, texts in arrays.slices(batches, "_text"):
        found = arrays.words(texts, arrays.ALNUM)
        each = np.split(arrays.word_hashes(texts, found), found.first[1:-1])
        terms = [np.unique(x) for x in each]
        flat = pa.array(np.concatenate([*terms, np.zeros(0, np.uint64)]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), arrays.lists(np.array([len(x) for x in terms]), flat)], names=[ROW, "terms"])


def _counted(shared):
    """Of each text with terms: their number, and the counts of the block's terms among them."""

    def run(batches):
        wanted = shared.value
        for batch, texts in arrays.slices(batches, "_text"):
            found = arrays.words(texts, arrays.ALNUM)
            hashes = arrays.word_hashes(texts, found)
            at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == hashes)
            owner = np.searchsorted(found.first, hit, "right") - 1
            code, n = np.unique(owner * len(wanted) + at[hit], return_counts=True)
            each = np.bincount(code // len(wanted), minlength=batch.num_rows)
            columns = [
                batch.column(0), pa.array(found.counts()),
                arrays.lists(each, pa.array((code % len(wanted)).astype(np.int32))), arrays.lists(each, pa.array(n.astype(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "n", "term", "tf"]).filter(pa.array(found.counts() > 0))

    return run


class _Best:
    """The ``k`` best rows of each query seen so far, by score and then by key; null keys come last."""

    def __init__(self, n: int, k: int, kind: pa.DataType):
        self.k, self.floor, self.most = k, np.ones(n, np.int64), 4 * n * k
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], kind)
        self.new: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def put(self, scores: np.ndarray, keys: pa.Array) -> None:
        """``scores``: queries by documents."""
        query, doc = np.nonzero(scores >= self.floor[:, None])
        self.new.append((query, scores[query, doc], keys.take(pa.array(doc))))
        self.size += len(query)
        if self.size > self.most:
            self.cut()

    def cut(self) -> None:
        query, score = (np.concatenate([x[i] for x in (self.rows, *self.new)]) for i in (0, 1))
        keys = pa.concat_arrays([x[2] for x in (self.rows, *self.new)])
        rank = np.empty(len(keys), np.int64)
        rank[pc.sort_indices(keys, null_placement="at_end").to_numpy()] = np.arange(len(keys))
        order = np.lexsort((rank, -score, query))
        query, score = query[order], score[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = nth == self.k - 1
        self.floor[query[last]] = score[last]
        keep = np.flatnonzero(nth < self.k)
        self.rows, self.new, self.size = (query[keep], score[keep], keys.take(pa.array(order[keep]))), [], 0


def _ranked(shared, k: int):
    """The ``k`` best rows of each query among the documents of a task."""

    def run(batches):
        sums, weights, names, n_docs, n_terms = shared.value
        width = max(1, CELLS // sums.n_nodes)
        best = None
        for batch in batches:
            keys = batch.column(0)
            best = best or _Best(len(sums.first), k, keys.type)
            n = batch.column(1).to_numpy().astype(np.int64)
            length = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms
            for low in range(0, batch.num_rows, width):
                high = min(low + width, batch.num_rows)
                term, tf = batch.column(2).slice(low, high - low), batch.column(3).slice(low, high - low)
                doc = np.repeat(np.arange(high - low), np.diff(term.offsets.to_numpy()))
                flat, tf = term.flatten().to_numpy(), tf.flatten().to_numpy()
                parts = np.zeros((sums.n_terms, high - low), np.int64)
                parts[flat, doc] = weights[flat] * ((GIGA * tf) // (MILLE * tf + 20 * length[low:high][doc]))
                best.put(totals(sums, parts), keys.slice(low, high - low))
        if best:
            best.cut()
            query, score, keys = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), keys, pa.array(score)], names=[ROW, "_key", "score"])
        arrays.hand_back()

    return run


# --- the operator ----------------------------------------------------------------------------


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list[int], list[list[int]]]]:
    """Row ids and term hashes of the items, ``most`` terms at a time."""
    rows, terms, n = [], [], 0
    for r in items.toLocalIterator():
        if rows and n + len(r["terms"]) > most:
            yield rows, terms
            rows, terms, n = [], [], 0
        rows.append(r[ROW])
        terms.append(r["terms"])
        n += len(r["terms"])
    if rows:
        yield rows, terms


def _block(docs: DataFrame, rows: list[int], terms: list[list[int]], k: int) -> DataFrame | None:
    """``_row`` of the item, ``_key`` of the document, ``score``: candidates, at most ``k`` of an item and task."""
    context = docs.sparkSession.sparkContext
    wanted = np.unique(np.concatenate([np.array(t, np.int64) for t in terms]).view(np.uint64))
    kind = docs.schema["_key"].dataType.simpleString()
    counted = docs.mapInArrow(_counted(context.broadcast(wanted)), f"_key {kind}, n long, term array<int>, tf array<long>")
    counted = written(counted)
    n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    frequency = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(wanted), np.int64)
    for r in frequency.select("term", weight.alias("w")).collect():  # one row for each term of the block
        weights[r["term"]] = r["w"]
    place = {t: i for i, t in enumerate(wanted.view(np.int64).tolist())}
    sums = share([[place[t] for t in own] for own in terms], len(wanted))
    shared = context.broadcast((sums, weights, np.array(rows, np.int64), n_docs, n_terms))
    return counted.mapInArrow(_ranked(shared, k), f"{ROW} long, _key {kind}, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", item: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """``item, rank, key, score``: the ``k`` documents of the highest score above 0 for each row of ``items``.

    Equal scores rank by ascending key, null keys last. Terms are runs of letters, digits and all
    beyond ASCII, with A-Z as a-z, told apart by 64 bits. Null and empty texts have no term: such
    documents are not counted and such items have no rows, nor has any item where no document has a
    term. Texts of any length are read whole. Repeated items are each ranked, repeated documents each
    listed. Other columns are not returned, so their names do not matter.
    """
    items = numbered(items.select(F.col(item).alias("_item"), F.col(text).alias("_text")))
    terms = items.select(ROW, "_text").mapInArrow(_item_terms, f"{ROW} long, terms array<long>").where("size(terms) > 0")
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = [x for x in (_block(docs, *block, k) for block in _blocks(terms, block_terms)) if x is not None]
    if not found:
        empty = T.StructType([T.StructField(item, items.schema["_item"].dataType), T.StructField("rank", T.IntegerType()), T.StructField(key, docs.schema["_key"].dataType), T.StructField("score", T.LongType())])
        return docs.sparkSession.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in empty))
    rows = reduce(DataFrame.unionByName, found).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    # Candidates grow with the number of tasks, so parts of an item are ranked first.
    order = F.desc("score"), F.asc_nulls_last("_key")
    first = Window.partitionBy(ROW, "_part").orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    rank = F.row_number().over(Window.partitionBy(ROW).orderBy(*order))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.join(items.select(ROW, "_item"), ROW).select(F.col("_item").alias(item), "rank", F.col("_key").alias(key), "score")
