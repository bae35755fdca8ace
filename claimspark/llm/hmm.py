"""Scoring by a hidden Markov language model.

A text is a sequence of tokens: its words in lower-case ASCII letters, then one end. A token belongs
to a class by its last bytes and length. A hidden chain of states emits classes, and a class emits its
tokens by their counts, add-one smoothed with room for one unknown token. Baum-Welch runs over all
training texts: each partition returns expected counts, which Spark sums, and the next round begins.
The likelihood of a text is exact, by the scaled forward recursion.

The recursion is a product of small matrices. Texts are cut into blocks whose products are computed
side by side; the blocks of a text are then chained. Token counts grow with the corpus: they are
aggregated and joined by Spark; only the most frequent ones, of bounded number, are broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import arrays
from .tables import ROW, plain

STATES = 4
CLASSES = 512
ROUNDS = 4
FREQUENT = 200_000  # tokens that are broadcast, at most
BLOCK = 64
_END = np.uint64(0x5851F42D4C957F2D)
_END_CLASS = CLASSES - 1


class Chain(NamedTuple):
    """State before the first token, transitions, emissions of classes."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_chain(shares: np.ndarray, states: int = STATES) -> Chain:
    """Slow transitions, and the classes' shares with a different fixed disturbance for each state."""
    key = arrays.mixed(np.arange(1, states * CLASSES + 1, dtype=np.uint64)).reshape(states, CLASSES)
    emit = (shares + 1e-6) * (0.4 + 1.2 * arrays.uniform(key))
    move = np.full((states, states), 0.08 / max(1, states - 1))
    np.fill_diagonal(move, 0.92 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


def tokens(texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token, and where each text's tokens begin (n + 1)."""
    found = arrays.words(texts, arrays.NOT_SPACE)
    hashes = arrays.word_hashes(texts, found)
    length = found.stop - found.start
    low = arrays.LOWER[texts.data]
    last = low[found.stop - 1].astype(np.uint64)
    other = np.where(length > 1, low[np.maximum(found.stop - 2, 0)], 0).astype(np.uint64)
    code = last | (other << np.uint64(8)) | (np.minimum(length, 12) // 3).astype(np.uint64) << np.uint64(16)
    kind = (arrays.mixed(code + np.uint64(1)) % np.uint64(CLASSES - 1)).astype(np.int64)
    at = found.first[1:]
    first = found.first + np.arange(len(found.first))
    return np.insert(hashes, at, _END), np.insert(kind, at, _END_CLASS), first


class Blocks(NamedTuple):
    """Blocks of at most BLOCK tokens. Their rows are in order of length, so that live ones come first."""

    classes: np.ndarray  # (BLOCK, rows)
    live: np.ndarray  # rows that have a token at each place
    first: np.ndarray  # first block of each text, n + 1
    row: np.ndarray  # of each block


def blocks_of(kinds: np.ndarray, first: np.ndarray) -> Blocks:
    lengths = np.diff(first)
    count = -(-lengths // BLOCK)
    begin = np.concatenate([[0], np.cumsum(count)])
    size = np.full(int(begin[-1]), BLOCK)
    full = count > 0
    size[begin[1:][full] - 1] = (lengths - (count - 1) * BLOCK)[full]
    order = np.argsort(-size, kind="stable")
    row = np.empty(len(order), np.int64)
    row[order] = np.arange(len(order))
    out = np.zeros((BLOCK, len(order)), np.int64)
    owner = np.repeat(np.arange(len(count)), lengths)
    at = np.arange(len(kinds)) - first[owner]
    out[at % BLOCK, row[begin[owner] + at // BLOCK]] = kinds
    return Blocks(out, np.bincount(size, minlength=BLOCK + 1)[::-1].cumsum()[::-1][1:], begin, row)


def _products(chain: Chain, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """The product of each row's matrices, scaled, and the logarithm of the scale."""
    n, states = len(blocks.row), len(chain.start)
    emit = np.ascontiguousarray(chain.emit.T)
    out, log = np.broadcast_to(np.eye(states), (n, states, states)).copy(), np.zeros(n)
    for t, m in enumerate(blocks.live.tolist()):
        if not m:
            break
        step = (out[:m].reshape(-1, states) @ chain.move).reshape(m, states, states)
        step *= emit[blocks.classes[t, :m]][:, None, :]
        out[:m] = step
        if t % 8 == 7:
            scale = step.sum(axis=(1, 2))
            out[:m] /= scale[:, None, None]
            log[:m] += np.log(scale)
    scale = out.sum(axis=(1, 2))
    return out / scale[:, None, None], log + np.log(scale)


def _chained(chain: Chain, blocks: Blocks, product: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before each row, and the log likelihood of each text."""
    first, count = blocks.first[:-1], np.diff(blocks.first)
    before = np.zeros((len(product), len(chain.start)))
    now = np.tile(chain.start, (len(count), 1))
    total = np.zeros(len(count))
    for k in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > k)
        b = blocks.row[first[live] + k]
        before[b] = now[live]
        after = (now[live][:, None, :] @ product[b])[:, 0, :]
        scale = after.sum(axis=1)
        now[live] = after / scale[:, None]
        total[live] += np.log(scale) + log[b]
    return before, total


def log_likelihood(chain: Chain, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each text's classes."""
    blocks = blocks_of(kinds, first)
    return _chained(chain, blocks, *_products(chain, blocks))[1]


def expected(chain: Chain, kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of start states, transitions and emissions."""
    blocks = blocks_of(kinds, first)
    product, log = _products(chain, blocks)
    before, _ = _chained(chain, blocks, product, log)
    states, n = len(chain.start), len(product)
    begin, count = blocks.first[:-1], np.diff(blocks.first)
    after = np.ones((n, states))  # chance of what follows a block, up to scale
    for k in range(int(count.max(initial=0)) - 1, 0, -1):
        b = begin[count > k] + k
        here, ahead_of = blocks.row[b], blocks.row[b - 1]
        back = (product[here] @ after[here][:, :, None])[:, :, 0]
        after[ahead_of] = back / back.sum(axis=1, keepdims=True)
    emit = np.ascontiguousarray(chain.emit.T)
    moved = np.empty((BLOCK, n, states))  # states after each transition, before its token
    ahead = np.empty((BLOCK, n, states))
    now = before.copy()
    for t, m in enumerate(blocks.live.tolist()):
        ahead[t, :m] = now[:m]
        np.matmul(now[:m], chain.move, out=moved[t, :m])
        step = moved[t, :m] * emit[blocks.classes[t, :m]]
        now[:m] = step / step.sum(axis=1, keepdims=True)
    move, seen = np.zeros((states, states)), np.zeros((states, CLASSES))
    occupied = np.zeros((BLOCK, n, states))
    for t in range(BLOCK - 1, -1, -1):
        m = int(blocks.live[t])
        if not m:
            continue
        value = emit[blocks.classes[t, :m]] * after[:m]
        joint = moved[t, :m] * value
        scale = joint.sum(axis=1, keepdims=True)
        occupied[t, :m] = joint / scale
        move += chain.move * ((ahead[t, :m] / scale).T @ value)
        back = value @ chain.move.T
        after[:m] = back / back.sum(axis=1, keepdims=True)
    flat = blocks.classes.reshape(-1)
    for s in range(states):  # places without a token add nothing
        seen[s] = np.bincount(flat, weights=occupied[:, :, s].reshape(-1), minlength=CLASSES)
    opened = blocks.row[begin[count > 0]]
    start = before[opened] * after[opened]
    return (start / start.sum(axis=1, keepdims=True)).sum(axis=0), move, seen


def _counted(batches):
    for _, texts in arrays.slices(batches, "text", arrays.WIDE_BYTES):
        hashes, kinds, _ = tokens(texts)
        token, at, n = np.unique(hashes, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(kinds[at], pa.int32()), pa.array(n)], names=["token", "kind", "n"])


def _classed(batches):
    for _, texts in arrays.slices(batches, "text", arrays.WIDE_BYTES):
        _, kinds, first = tokens(texts)
        raw = kinds.astype("<u2").tobytes()
        parts = [raw[2 * a : 2 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["kinds"])


def _expectation(chain: Chain):
    def run(batches):
        sums = None
        for _, texts in arrays.slices(batches, "kinds", arrays.WIDE_BYTES):
            kinds = texts.data.view("<u2").astype(np.int64) if len(texts.data) else np.zeros(0, np.int64)
            start, move, seen = expected(chain, kinds, texts.offsets // 2)
            flat = np.concatenate([start, move.ravel(), seen.ravel()])
            sums = flat if sums is None else sums + flat
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["cell", "value"])

    return run


def train(kinds: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch over all rows of ``kinds`` (class ids, two bytes each)."""
    chain = first_chain(shares, states)
    for _ in range(rounds):
        sums = kinds.mapInArrow(_expectation(chain), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        cells = np.zeros(states + states * states + states * CLASSES)
        for r in sums.collect():  # one row for each parameter
            cells[r["cell"]] = r["value"]
        if not cells.any():
            break
        start, rest = cells[:states] + 1e-3, cells[states:]
        move = rest[: states * states].reshape(states, states) + 1e-3
        emit = rest[states * states :].reshape(states, CLASSES) + 1e-3 * (shares + 1e-6) * CLASSES
        chain = Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return chain


class Model(NamedTuple):
    chain: Chain
    total: int  # training tokens
    distinct: int
    of_class: np.ndarray  # training tokens of each class
    kinds_of_class: np.ndarray  # distinct ones
    frequent: np.ndarray  # hashes, sorted
    counts: np.ndarray
    table: DataFrame | None  # token, n: all other tokens


def learn(docs: DataFrame, text: str = "text", states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT) -> Model:
    """A model of all rows of ``docs``. A null text is an empty one, which has one token, its end."""
    rows = docs.select(F.col(text).alias("text"))
    counts = rows.mapInArrow(_counted, "token long, kind int, n long").groupBy("token").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))
    counts = written(counts)
    of_class, kinds_of_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        of_class[r["kind"]], kinds_of_class[r["kind"]] = r["n"], r["v"]
    # The least count at which no more than ``frequent`` tokens are left.
    least, seen = 1 << 62, 0
    for r in counts.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("v")).orderBy(F.desc("size")).collect():
        seen += r["v"]
        if seen > frequent:
            break
        least = 1 << r["size"]
    top = counts.where(F.col("n") >= least).select("token", "n").collect()
    token = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(token)
    shares = of_class / max(1.0, of_class.sum())
    chain = train(written(rows.mapInArrow(_classed, "kinds binary")), shares, states, rounds)
    return Model(
        chain, int(of_class.sum()), int(kinds_of_class.sum()), of_class, kinds_of_class, token[order],
        np.array([r["n"] for r in top], np.int64)[order], counts.where(F.col("n") < least).select("token", "n"),
    )


def _scored(shared):
    def run(batches):
        model: Model = shared.value
        # Of one token given its class, without its count.
        share = np.log10(model.of_class + model.kinds_of_class + 1)
        for batch, texts in arrays.slices(batches, "_text", arrays.WIDE_BYTES):
            hashes, kinds, first = tokens(texts)
            n_tokens = np.diff(first)
            owner = np.repeat(np.arange(len(n_tokens)), n_tokens)
            place = np.minimum(np.searchsorted(model.frequent, hashes), max(0, len(model.frequent) - 1))
            known = model.frequent[place] == hashes if len(model.frequent) else np.zeros(len(hashes), bool)
            per_doc = lambda x: np.bincount(owner, weights=x, minlength=len(n_tokens))  # noqa: E731,B023
            value = np.zeros(len(hashes))
            value[known] = np.log10(model.counts[place[known]] + 1.0)
            chain = log_likelihood(model.chain, kinds, first) / np.log(10) - per_doc(share[kinds])
            rest = hashes[~known].view(np.int64)
            yield arrays.replaced(
                batch.drop_columns(["_text"]),
                {
                    "n_tokens": pa.array(n_tokens, pa.int64()),
                    "_known": pa.array(per_doc(known).astype(np.int64)),
                    "_value": pa.array(per_doc(value)),
                    "_chain": pa.array(chain),
                    "_rest": arrays.lists(np.bincount(owner[~known], minlength=len(n_tokens)), pa.array(rest)),
                },
            )

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` less the text, with ``n_tokens, n_known, train_tokens, base_score, score``.

    ``score`` is the model's log10 probability of the whole text, ``base_score`` that of an add-one
    unigram model. A null text is an empty one. Repeated rows have equal scores. Other columns stay,
    but those named like a new one are replaced.
    """
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in plain(docs, *new, ROW).columns if c != text]
    slim = docs.select(*keep, F.monotonically_increasing_id().alias(ROW), F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.drop("_text").schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model._replace(table=None))
    parts = f"{fields}, n_tokens long, _known long, _value double, _chain double, _rest array<long>"
    rows = written(slim.mapInArrow(_scored(shared), parts))
    rare = rows.select(ROW, F.explode("_rest").alias("token"))
    # Tokens of this side are rare by count, so no key is hot.
    found = rare.join(model.table, "token").groupBy(ROW).agg(F.sum(F.log10(F.col("n") + 1)).alias("_more"), F.count("*").alias("_found"))
    out = rows.drop("_rest").join(found, ROW, "left")
    value = F.col("_value") + F.coalesce("_more", F.lit(0.0))
    return out.select(
        *keep,
        "n_tokens",
        (F.col("_known") + F.coalesce("_found", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (value - F.col("n_tokens") * F.log10(F.lit(float(model.total + model.distinct + 1)))).alias("base_score"),
        (value + F.col("_chain")).alias("score"),
    )
