"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one for each character, spaces as U+2581 with one more in front. The
agenda holds the adjacent pairs that form a piece; the pair of the best score, the leftmost among
equals, is merged, and its new neighbours enter the agenda, until none is left. Characters that
are in no piece become byte pieces.

No piece crosses from another character to a space, nor holds a line end, so a text falls into
chunks that merge on their own; equal chunks are encoded once. Chunks that are new are merged side
by side as arrays, each with its own agenda of ranks; long ones use a heap. The library encodes and decodes
every whole text too, equal texts of a slice once; a row is replaced by its result only where that differs.
"""

from __future__ import annotations

import re
import sys
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .tables import plain, schema_with

SPACE = "▁"
LONG = 48  # symbols of a chunk from which it gets a heap of its own
CACHE_CHUNKS = 200_000  # of each of two generations
TABLE_BITS = 20  # of the table of pairs; a vocabulary has some hundred thousand
_NONE = np.int32(2**31 - 1)
_TURNS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class Vocabulary:
    """Pieces, merges and bytes of a model, as tables."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        ids = {name: i for i, name in enumerate(names) if not special[i]}
        chars = sorted({c for name in ids for c in name} - set(ids))
        ids |= {c: n + k for k, c in enumerate(chars)}  # characters that occur only within pieces
        self.stranger = n + len(chars)  # all other characters
        self.char = np.full(0x110000, self.stranger, np.int32)
        for name, i in ids.items():
            if len(name) == 1:
                self.char[ord(name)] = i
        ranked = sorted((i for i in ids.values() if i < n and len(names[i]) > 1), key=lambda i: (-lib.get_score(i), i))
        place = {score: k for k, score in enumerate(dict.fromkeys(lib.get_score(i) for i in ranked))}
        self.base = self.stranger + 1
        pairs = {}
        for i in ranked:
            name = names[i]
            for cut in range(1, len(name)):
                a, b = ids.get(name[:cut]), ids.get(name[cut:])
                if a is not None and b is not None:
                    # Equal scores share a rank, so that the place decides between them.
                    pairs[a * self.base + b] = place[lib.get_score(i)], i
        self.pairs = pairs
        self.keys = np.array([*pairs, -1], np.int64)  # the last one is no pair
        self.ranks = np.array([*(p[0] for p in pairs.values()), _NONE], np.int32)
        self.merged = np.array([*(p[1] for p in pairs.values()), 0], np.int32)
        self.table = self._table()
        joined = [name for name in ids if len(name) > 1]
        splits = not any(re.search(rf"[^{SPACE}]{SPACE}|\n", name) for name in joined)
        self.chunk = re.compile(r" *[^ \n]+|\n| +" if splits else r"(?s).+")
        self.bytes_of = [b"" if lib.is_control(i) else bytes([int(name[3:5], 16)]) if lib.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]
        self.n_bytes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.forget()

    def _slots(self, code: np.ndarray, turn: int) -> np.ndarray:
        return (code.astype(np.uint64) * _TURNS[turn]) >> np.uint64(64 - TABLE_BITS)

    def _table(self) -> np.ndarray:
        """Where a pair is in ``keys``, at one of two slots that its code gives."""
        none = len(self.keys) - 1
        table = np.full(1 << TABLE_BITS, none, np.int32)
        slots = [self._slots(self.keys[:-1], turn).tolist() for turn in (0, 1)]
        held: dict[int, int] = {}
        for i in range(none):
            turn, tries = 0, 0
            while (slot := slots[turn][i]) in held and tries < 500:
                i, held[slot] = held[slot], i
                turn, tries = int(slots[0][i] == slot), tries + 1
            if slot in held:
                raise ValueError("the vocabulary has too many pairs for the table")
            held[slot] = i
        table[np.fromiter(held.keys(), np.int64, len(held))] = np.fromiter(held.values(), np.int32, len(held))
        return table

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in ``keys``; the last place for those that are none."""
        code = self._code(left, right)
        at = self.table[self._slots(code, 0)]
        miss = np.flatnonzero(self.keys[at] != code)
        second = self.table[self._slots(code[miss], 1)]
        at[miss] = np.where(self.keys[second] == code[miss], second, len(self.keys) - 1)
        return at

    def _code(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) * self.base + right

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.ranks[self._find(left, right)]

    def _fallback(self, symbols, chars: str) -> list[int]:
        """Ids of final symbols, where ``chars`` has the character of each that is no piece."""
        out = []
        for s, c in zip(symbols, chars, strict=True):
            if s < self.size:
                out.append(s)
            else:
                out.extend((self.byte[b] for b in c.encode()) if self.byte else [self.unknown])
        return out

    def merge_heap(self, chunk: str) -> list[int]:
        """One chunk by a heap of (rank, place of the left symbol)."""
        symbols = self.char[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, base, alive = self.pairs, self.base, [True] * n
        agenda = [(*p, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (p := pairs.get(symbols[i] * base + symbols[i + 1]))]
        agenda = [(rank, i, left, right, new) for rank, new, i, left, right in agenda]
        heapify(agenda)
        while agenda:
            _, i, left, right, new = heappop(agenda)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := pairs.get(symbols[a] * base + symbols[b])):
                    heappush(agenda, (p[0], a, symbols[a], symbols[b], p[1]))
        kept = [i for i in range(n) if alive[i]]
        return self._fallback([symbols[i] for i in kept], [chunk[i] for i in kept])

    def merge_many(self, chunks: list[str]) -> list[bytes]:
        """Many short chunks at once, with their spaces: in each round the best pair of every chunk is merged."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = "".join(chunks).replace(" ", SPACE)
        symbols = self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        place = np.arange(len(symbols))
        owner = np.repeat(np.arange(len(chunks)), lengths)
        ranks = np.full(len(symbols), _NONE, np.int32)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[same] = self.rank(symbols[same], symbols[same + 1])
        done = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(ranks, first)
            sizes = np.diff(np.append(first, len(symbols)))
            if not (best < _NONE).all():
                over = np.repeat(best == _NONE, sizes)
                done.append((owner[over], place[over], symbols[over]))
                keep = ~over
                owner, place, symbols, ranks = owner[keep], place[keep], symbols[keep], ranks[keep]
                sizes, best = sizes[best < _NONE], best[best < _NONE]
                if not len(symbols):
                    break
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            symbols[hits] = self.merged[self._find(symbols[hits], symbols[hits + 1])]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            owner, place, symbols, ranks = owner[keep], place[keep], symbols[keep], ranks[keep]
            hits -= np.arange(len(hits))
            ranks[hits] = _NONE
            for left in (hits, hits[hits > 0] - 1):
                left = left[left + 1 < len(symbols)]
                left = left[owner[left] == owner[left + 1]]
                ranks[left] = self.rank(symbols[left], symbols[left + 1])
        owner, place, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((place, owner))
        owner, place, symbols = owner[order], place[order], symbols[order]
        bounds = np.searchsorted(owner, np.arange(len(chunks) + 1))
        flat = symbols.astype("<u4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in np.unique(owner[symbols >= self.size]).tolist():
            a, b = bounds[k], bounds[k + 1]
            ids = self._fallback(symbols[a:b].tolist(), [text[p] for p in place[a:b].tolist()])
            out[k] = np.array(ids, "<u4").tobytes()
        return out

    def _learn(self, split: list[list[str]]) -> list[str]:
        """Encode the chunks that are not in the cache; the long ones among them."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        new = set().union(*split).difference(cache)
        if older:
            again = [c for c in new if c in older]
            cache.update(zip(again, map(older.__getitem__, again), strict=True))
            new.difference_update(again)
        long = [c for c in new if len(c) >= LONG]
        short = list(new.difference(long))
        chunks = short + long
        made = self.merge_many(short) if short else []
        made += [_packed(self.merge_heap(c.replace(" ", SPACE))) for c in long]
        cache.update(zip(chunks, made, strict=True))
        self.odd.update(self._odd(chunks, made))
        return long

    def _odd(self, chunks: list[str], made: list[bytes]) -> dict[str, bytes]:
        """Chunks whose ids do not spell them, and what they spell. All are spelled in one go, and one by one only if that differs."""
        ids, piece = _unpacked(b"".join(made)), self.bytes_of.__getitem__
        spelled, text = b"".join(map(piece, ids)), "".join(chunks).encode()
        if spelled == text:
            places = np.cumsum(self.n_bytes[np.asarray(ids, np.int64)])
            last = np.cumsum(np.fromiter(map(len, made), np.int64, len(made))) // 4 - 1
            sizes = map(len, chunks) if len(text) == sum(map(len, chunks)) else map(len, map(str.encode, chunks))
            if (places[last] == np.cumsum(np.fromiter(sizes, np.int64, len(chunks)))).all():
                return {}
        each = ((c, b"".join(map(piece, _unpacked(x)))) for c, x in zip(chunks, made, strict=True))
        return {c: back for c, back in each if back != c.encode()}

    def run(self, texts: list[str]) -> tuple[list[bytes], list[str], list[bool]]:
        """Ids of each text with those of begin and end, four little-endian bytes each; the decoded text; whether the library agrees.

        The ids are the agenda's and the text is that of their chunks. The library encodes and decodes each whole
        text too, so that the cut into chunks is checked as well; only where it differs its result is taken.
        """
        each = list(dict.fromkeys(texts))
        split = [self.chunk.findall(" " + t.replace(SPACE, " ")) if t else [] for t in each]
        long = self._learn(split)
        begin, end, known = _packed([self.begin]), _packed([self.end]), self.cache.__getitem__
        checked = self.library.encode(each, add_bos=True, add_eos=True, num_threads=1, return_type="numpy")
        back = self.library.decode(checked, num_threads=1)
        out = {}
        for text, own, other, decoded in zip(each, split, checked, back, strict=True):
            ids, packed = b"".join([begin, *map(known, own), end]), other.astype("<u4", copy=False).tobytes()
            agrees = ids == packed and self._decoded(own) == decoded
            out[text] = (ids, decoded, True) if agrees else (packed, decoded, False)
        for c in long:  # long chunks are rare and seldom come again
            del self.cache[c]
            self.odd.pop(c, None)
        ids, decoded, agrees = zip(*map(out.__getitem__, texts), strict=True) if texts else ((), (), ())
        return list(ids), list(decoded), list(agrees)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        ids, _, agrees = self.run(texts)
        return ids, agrees

    def _decoded(self, chunks: list[str]) -> str | None:
        """The text of chunks; null if their bytes are no UTF-8."""
        if not self.odd or self.odd.keys().isdisjoint(chunks):
            return "".join(chunks)[1:]
        parts = b"".join(self.odd[c] if c in self.odd else c.encode() for c in chunks)
        try:
            return parts.removeprefix(b" ").decode()
        except UnicodeDecodeError:
            return None

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}  # chunks that do not decode to themselves

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text; bytes that are no UTF-8 become U+FFFD."""
        parts = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        parts = parts[1:] if parts[:1] == b" " else parts
        try:
            parts.decode()
        except UnicodeDecodeError:
            return self.library.decode(np.frombuffer(ids, "<u4").tolist()).encode()
        return parts


def _unpacked(ids: bytes):
    return array("I", ids) if _LITTLE else np.frombuffer(ids, "<u4").tolist()


def _packed(ids) -> bytes:
    return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()


_LOADED: dict[bytes, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Vocabulary(model)
    return _LOADED[model]


def _run(shared):
    def run(batches):
        vocabulary = _vocabulary(shared.value)
        vocabulary.forget()  # what an earlier task left
        for batch, texts in arrays.slices(batches, "_text", 2 * arrays.WIDE_BYTES):
            ids, decoded, agrees = vocabulary.run([texts.text(i).decode() for i in range(batch.num_rows)])
            yield arrays.replaced(
                batch,
                {
                    "ids": pa.array(ids, pa.binary()),
                    "decoded": pa.array(decoded, pa.string()),
                    "library_agrees": pa.array(agrees, pa.bool_()),
                },
            )
        vocabulary.forget()
        arrays.hand_back()

    return run


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers), ``decoded`` and ``library_agrees``.

    Begin and end ids are included; a null or empty text has only these and decodes to ''. The
    sentencepiece library encodes and decodes each whole text too; where it differs, the row gets its result
    and ``library_agrees`` is false. Whole texts of any length are encoded; repeated rows have equal
    results; an empty table gives an empty one. Equal scores merge leftmost first. Columns of ``docs`` stay, but those named like a
    new one are replaced and names that begin with an underscore go.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # of the vocabulary's size
    new = {"ids": T.BinaryType(), "decoded": T.StringType(), "library_agrees": T.BooleanType()}
    rows = plain(docs, *new).withColumn("_text", F.col(text))
    return rows.mapInArrow(_run(shared), schema_with(rows, **new)).drop("_text")


def n_tokens(ids: str = "ids"):
    return F.floor(F.octet_length(ids) / 4).cast("long")
