"""Exact removal of repeated substrings: suffixes sorted through a sampled cover, on Spark.

A byte goes if a string of ``length`` bytes over it also starts elsewhere. As in a difference-cover
construction, only a sample of the positions is sorted, chosen so that two equal strings always meet
a sampled position at the same distance from their starts; all other suffixes are then placed by the
bytes up to that position and its rank. The sample here follows content: of the grams within each
string of ``length`` bytes, the one of least hash is its anchor (about one position in 85).

1. Anchors whose gram occurs once cannot lie in a repeat and go. A filter of fixed size keeps them out
   of the shuffles.
2. An anchor's context is all strings that have it as their anchor. Equal contexts are repeats
   whole. One of each, of grams with several contexts, stays in the sort.
3. Sampled suffixes are sorted, to the right and, reversed, to the left of the anchor, and each is
   compared with its neighbours. The longest common prefixes bound which starts can repeat, and what
   the left neighbour also shares to the right repeats for certain.
4. The starts between, usually none or a few of a context, are merged by their bytes up to the
   anchor and from it on, and equal neighbours are repeats.

Bytes are compared by 64-bit and 128-bit hashes, except in the sort, which has the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import written
from . import arrays
from .bloom import Filter, filter_of
from .tables import ROW, plain

LENGTH = 200
GRAM = 32
MOST_PARTS = 5_000  # of the sorts: the driver compares two rows of each
_SECOND = arrays.Powers(0x94D049BB133111EB | 1)
_OTHER = arrays.mixed(arrays.BYTE_VALUE + np.uint64(0x632BE59BD9B4E019))


def _anchors(texts: arrays.Texts, length: int, gram: int):
    """Anchor, first and last start of each context, the grams' hashes and the hashes of any run."""
    data, offsets = texts
    runs = arrays.Runs(arrays.BYTE_VALUE[data], arrays.BYTE_POWERS)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), runs
    at = np.arange(len(data) - gram + 1)
    hashes = runs.get(at, at + gram)
    bits = max(20, int(len(data)).bit_length())
    low = np.uint64((1 << bits) - 1)
    least = (hashes & ~low) | at.astype(np.uint64)  # ties: the leftmost
    window, span = length - gram + 1, 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = window - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    anchor = (least & low).astype(np.int64)
    fits = np.zeros(len(anchor), bool)
    for low_end, high_end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        fits[low_end : max(low_end, high_end - length + 1)] = True
    start = np.flatnonzero(fits)
    if not len(start):
        return none, none, none, none.astype(np.uint64), runs
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    low_start, high_start = start[first], start[np.append(first[1:], len(start)) - 1]
    anchor = anchor[first]
    return anchor, low_start, high_start, hashes[anchor], runs


def digests(texts: arrays.Texts, runs: arrays.Runs | None = None) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's bytes."""
    runs = runs or arrays.Runs(arrays.BYTE_VALUE[texts.data], arrays.BYTE_POWERS)
    other = arrays.Runs(_OTHER[texts.data], _SECOND)
    begin, end = texts.offsets[:-1], texts.offsets[1:]
    length = (end - begin).astype(np.uint64)
    return arrays.mixed(runs.get(begin, end) + length).view(np.int64), other.get(begin, end).view(np.int64)


def _batch(**columns) -> pa.RecordBatch:
    values = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(values, names=list(columns))


def _grams(length: int, gram: int):
    def run(batches):
        for _, texts in arrays.slices(batches, "text"):
            yield _batch(gram=_anchors(texts, length, gram)[3].view(np.int64))

    return run


def _contexts(length: int, gram: int, shared):
    def run(batches):
        known: Filter = shared.value
        for _, texts in arrays.slices(batches, "text"):
            anchor, low, high, hashes, runs = _anchors(texts, length, gram)
            keep = known.has(hashes)
            anchor, low, high, hashes = anchor[keep], low[keep], high[keep], hashes[keep]
            a, b = digests(texts, runs)
            doc = np.searchsorted(texts.offsets, low, "right") - 1
            base = texts.offsets[doc]
            context = _context_keys(runs, anchor, low, high, length)
            yield _batch(
                gram=hashes.view(np.int64), context=context.view(np.int64), a=a[doc], b=b[doc],
                anchor=(anchor - base).astype(np.int32), low=(low - base).astype(np.int32), high=(high - base).astype(np.int32),
            )

    return run


def _pick(context: np.ndarray, a: np.ndarray) -> np.ndarray:
    return arrays.mixed(context + arrays.mixed(a))


def _picks(batches):
    for batch in batches:
        yield _batch(pick=_pick(*(c.to_numpy().view(np.uint64) for c in batch.columns)).view(np.int64))


def _sides(length: int, gram: int, shared):
    """The bytes of contexts that the filter knows: to the right of the anchor, and to its left, nearest first.

    Copies of a text give the same rows.
    """

    def run(batches):
        known: Filter = shared.value
        for _, texts in arrays.slices(batches, "text"):
            anchor, low, high, hashes, runs = _anchors(texts, length, gram)
            context = _context_keys(runs, anchor, low, high, length)
            doc = np.searchsorted(texts.offsets, low, "right") - 1
            keep = np.flatnonzero(known.has(_pick(context, digests(texts, runs)[0].view(np.uint64)[doc])))
            data = texts.data.tobytes()
            places = list(zip(anchor[keep].tolist(), low[keep].tolist(), high[keep].tolist(), strict=True))
            yield _batch(
                id=context[keep].view(np.int64), gram=hashes[keep].view(np.int64),
                left=pa.array([data[b:a][::-1] for a, b, _ in places], pa.binary()),
                right=pa.array([data[a : c + length] for a, _, c in places], pa.binary()),
            )

    return run


def _context_keys(runs: arrays.Runs, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    return arrays.mixed(runs.get(low, high + length) ^ arrays.mixed((anchor - low).astype(np.uint64) + np.uint64(1)))


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while low < high:  # the first difference
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x[:middle] == y[:middle] else (low, middle - 1)
    return low


_NEIGHBOUR = "id long, gram long, text binary, other binary, reach int, beside int, edge boolean"


def _compared(x: list, y: list) -> None:
    """Enter in both rows how far they agree; beside: how far also on the other side, at that reach."""
    if x[1] == y[1]:
        reach, beside = _common(x[2], y[2]), _common(x[3], y[3])
        for row in (x, y):
            if (reach, beside) > (row[4], row[5]):
                row[4:6] = reach, beside


def _neighbours(batches):
    """Rows of the sorted partition compared with their neighbours of the same gram.

    Rows of the same id are one. The partition's first and last row keep their bytes and are marked;
    they are compared across partitions later.
    """
    held, first, out = None, True, []
    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = [*values, 0, 0]
            if held is not None:
                if held[0] == row[0]:
                    continue
                _compared(held, row)
                out.append(_plain(held, first))
                first = False
            held = row
        yield _neighbour_batch(out)
        out = []
    if held is not None:
        yield _neighbour_batch([_plain(held, True)])


def _plain(row: list, edge: bool) -> list:
    return [*row, edge] if edge else [row[0], row[1], None, None, row[4], row[5], False]


def _neighbour_batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
    names = [x.split()[0] for x in _NEIGHBOUR.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def longest_common(sides: DataFrame, side: str, other) -> DataFrame:
    """``id, gram, reach, beside``: how far each suffix agrees with another of its gram, by a global sort."""
    spark = sides.sparkSession
    rows = sides.select("id", "gram", F.col(side).alias("text"), other.alias("other"))
    keys = ("gram", "text", "other", "id")
    parts = max(1, min(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_neighbours, _NEIGHBOUR))
    # Two rows of each partition at most.
    names = ("id", "gram", "text", "other", "reach", "beside")
    edges = sorted(([r[n] if n not in ("text", "other") else bytes(r[n]) for n in names] for r in found.where("edge").collect()), key=lambda e: (*e[1:4], e[0]))
    for x, y in zip(edges, edges[1:], strict=False):
        _compared(x, y)
    ends = spark.createDataFrame([(e[0], e[1], e[4], e[5]) for e in edges], "id long, gram long, reach int, beside int")
    return found.where("not edge").select("id", "gram", "reach", "beside").unionByName(ends)


def _starts(length: int):
    """Hashes of the strings that begin ``low`` to ``high`` bytes before the anchor."""

    def run(batches):
        for batch in batches:
            x = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            lefts, rights = arrays.views(x["left"]), arrays.views(x["right"])
            low, high = x["low"].to_numpy(), x["high"].to_numpy()
            ids, at, a, b = [], [], [], []
            for i in range(batch.num_rows):
                left = lefts.text(i)[::-1]
                text = np.frombuffer(left + rights.text(i), np.uint8)
                back = np.arange(low[i], high[i] + 1)
                begin = len(left) - back
                a.append(arrays.Runs(arrays.BYTE_VALUE[text], arrays.BYTE_POWERS).get(begin, begin + length))
                b.append(arrays.Runs(_OTHER[text], _SECOND).get(begin, begin + length))
                ids.append(np.full(len(back), x["id"][i].as_py()))
                at.append(back)
            if ids:
                yield _batch(
                    id=np.concatenate(ids).astype(np.int64), back=np.concatenate(at).astype(np.int32),
                    sa=np.concatenate(a).view(np.int64), sb=np.concatenate(b).view(np.int64),
                )

    return run


def _of_known_grams(shared):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column(1).to_numpy().view(np.uint64))))

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``a, b, start, stop``: byte spans, which may overlap, of repeats in the text of each digest.

    ``texts`` has the one column ``text``. Null and short texts have no spans.
    """
    spark = texts.sparkSession
    texts = texts.where(F.octet_length("text") >= length)
    counts = texts.mapInArrow(_grams(length, gram), "gram long").groupBy("gram").agg(F.count("*").alias("n"))
    repeated = written(counts.where("n > 1").select("gram"))
    shared = spark.sparkContext.broadcast(filter_of(repeated, "gram"))
    fields = "gram long, context long, a long, b long, anchor int, low int, high int"
    anchors = written(texts.mapInArrow(_contexts(length, gram, shared), fields))

    place = F.struct("a", "b", "anchor", "low", "high")
    contexts = anchors.groupBy("context").agg(F.count("*").alias("n"), F.first("gram").alias("gram"), F.min(place).alias("at"))
    contexts = written(contexts)
    whole = contexts.where("n > 1").select("context")
    spans = salted_join(anchors.select("context", "a", "b", "low", "high"), whole, "context", "a")
    spans = spans.select("a", "b", F.col("low").alias("start"), (F.col("high") + length).alias("stop"))

    several = contexts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    sampled = written(contexts.join(several, "gram").select(F.col("context").alias("id"), (F.col("n") == 1).alias("single"), "at.*"))
    picks = written(sampled.select("id", "a").mapInArrow(_picks, "pick long"))
    shared = spark.sparkContext.broadcast(filter_of(picks, "pick"))
    sides = written(texts.mapInArrow(_sides(length, gram, shared), "id long, gram long, left binary, right binary"))
    to_left = longest_common(sides, "left", F.col("right")).select("id", "gram", F.col("reach").alias("to_left"), F.col("beside").alias("sure"))
    to_right = longest_common(sides, "right", F.lit(b"")).select("id", F.col("reach").alias("to_right"))
    bounds = written(to_left.join(to_right, "id").where(F.col("to_left") + F.col("to_right") >= length))
    owners = sampled.where("single").select("id", "a", "b", "anchor")
    anchor = F.col("anchor")
    certain = bounds.where(F.col("to_left") + F.col("sure") >= length).join(owners, "id")
    certain = certain.select("a", "b", (anchor - F.col("to_left")).alias("start"), (anchor + F.col("sure")).alias("stop"))

    # Starts that may repeat but not with that neighbour. All contexts of the gram bring theirs.
    low, high = F.lit(length) - F.col("to_right"), F.least("to_left", F.lit(length) - 1 - F.col("sure"))
    unsure = bounds.select("gram", low.alias("low"), high.alias("high")).where("low <= high")
    unsure = written(unsure.groupBy("gram").agg(F.min("low").alias("gram_low"), F.max("high").alias("gram_high")))
    shared = spark.sparkContext.broadcast(filter_of(unsure, "gram"))
    some = sides.mapInArrow(_of_known_grams(shared), "id long, gram long, left binary, right binary").dropDuplicates(["id"])
    limits = bounds.join(unsure, "gram").select(
        "id", F.greatest("gram_low", F.lit(length) - F.col("to_right"), F.lit(0)).alias("low"), F.least("gram_high", "to_left").alias("high")
    )
    asked = some.join(limits.where("low <= high"), "id").select("id", "left", "right", "low", "high")
    starts = written(asked.mapInArrow(_starts(length), "id long, back int, sa long, sb long"))
    starts = starts.select("id", "back", F.struct("sa", "sb").alias("string"))
    twice = starts.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    hits = salted_join(starts, twice, "string", "id").join(owners, "id")
    edges = hits.select("a", "b", (anchor - F.col("back")).alias("start"), (anchor - F.col("back") + length).alias("stop"))
    return spans.unionByName(certain).unionByName(edges)


def _merged(spans) -> tuple[np.ndarray, np.ndarray]:
    """Spans sorted by start, joined where they touch."""
    start = np.array([s["start"] for s in spans], np.int64)
    stop = np.array([s["stop"] for s in spans], np.int64)
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _joined_spans(batches):
    """Each text's spans, merged."""
    for batch in batches:
        merged = [_merged(s) for s in batch.column(2).to_pylist()]
        pairs = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([m[k] for m in merged]) if merged else [], pa.int32()) for k in (0, 1)], names=["start", "stop"]
        )
        yield _batch(a=batch.column(0), b=batch.column(1), spans=arrays.lists(np.array([len(m[0]) for m in merged], np.int64), pairs))


def _cut(batches):
    for batch, texts in arrays.slices(batches, "_text"):
        spans = batch.column(batch.schema.get_field_index("spans"))
        kept = []
        for i, own in enumerate(spans.to_pylist()):
            text, at, parts = texts.text(i), 0, []
            for s in own or []:
                parts.append(text[at : s["start"]])
                at = s["stop"]
            kept.append(b"".join([*parts, text[at:]]))
        yield arrays.replaced(batch.drop_columns(["_text"]), {"kept": pa.array(kept, pa.binary())})


def _split(shared, inside: bool):
    """Rows whose text the filter knows, with digests; or the others, whose text stays whole."""

    def run(batches):
        known: Filter = shared.value
        for batch, texts in arrays.slices(batches, "_text"):
            a, b = digests(texts)
            has = known.has(a.view(np.uint64))
            if inside:
                yield arrays.replaced(batch, {"_a": pa.array(a), "_b": pa.array(b)}).filter(pa.array(has))
            else:
                whole = batch.column(batch.schema.get_field_index("_text")).fill_null("")
                kept = whole.cast(pa.large_binary() if pa.types.is_large_string(whole.type) else pa.binary()).cast(pa.binary())
                yield arrays.replaced(batch.drop_columns(["_text"]), {"kept": kept}).filter(pa.array(~has))

    return run


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` less the text, with ``n_bytes``, ``spans`` (removed byte ranges) and ``kept`` (binary).

    Texts are UTF-8 bytes, and a cut may fall inside a character. A null text is empty; texts
    shorter than ``length`` stay whole. Copies lose all bytes, each of them. Repeated rows are copies. Other columns
    stay, but those named like a new one are replaced.
    """
    keep = [c for c in plain(docs, "n_bytes", "spans", "kept", ROW).columns if c != text]
    found = repeated_spans(docs.select(F.col(text).alias("text")), length, gram)
    # A set, so that copies of a text add nothing.
    listed = found.groupBy("a", "b").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    kind = "array<struct<start:int,stop:int>>"
    spans = written(listed.mapInArrow(_joined_spans, f"a long, b long, spans {kind}"))
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(spans, "a"))
    slim = docs.select(*keep, F.col(text).alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.drop("_text").schema.fields)
    others = slim.mapInArrow(_split(shared, False), f"{names}, kept binary").withColumn("spans", F.array().cast(kind))
    inside = slim.mapInArrow(_split(shared, True), f"{_with_text(slim)}, _a long, _b long")
    key = F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))
    inside = inside.withColumn("_key", key).drop("_a", "_b")
    joined = inside.join(spans.select(F.struct("a", "b").alias("_key"), "spans"), "_key", "left").drop("_key")
    joined = joined.withColumn("spans", F.coalesce("spans", F.array().cast(kind)))
    cut = joined.mapInArrow(_cut, f"{names}, spans {kind}, kept binary")
    return others.select(*keep, "n_bytes", "spans", "kept").unionByName(cut.select(*keep, "n_bytes", "spans", "kept"))


def _with_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def n_removed(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
