"""A Bloom filter of bounded size, built on the executors.

For keeping rows out of a shuffle that cannot match. When there are more keys than it is made for it
lets more rows through; results do not depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mixed

BITS_PER_KEY = 16
MOST_BITS = 1 << 27  # 16 MB
BLOCK_BITS = 1 << 16
_PROBES = 3


def _places(keys: np.ndarray) -> list[np.ndarray]:
    """Places within a key's block."""
    h = mixed(keys ^ np.uint64(0xE7037ED1A0B428DB))
    return [((h >> np.uint64(20 * k)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for k in range(_PROBES)]


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(blocks)).astype(np.int64)


class Filter:
    def __init__(self, blocks: dict[int, bytes], count: int):
        self.count = count
        empty = bytes(BLOCK_BITS // 8)
        self.bits = np.frombuffer(b"".join(blocks.get(k, empty) for k in range(count)), np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        base = _block(keys, self.count) * BLOCK_BITS
        out = np.ones(len(keys), bool)
        for place in _places(keys):
            at = base + place
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _blocks_of(batches):
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        block = batch.column(0).to_numpy()
        for place in _places(batch.column(1).to_numpy().view(np.uint64)):
            for k in np.unique(block).tolist():
                bits = blocks.setdefault(k, np.zeros(BLOCK_BITS, np.uint8))
                bits[place[block == k]] = 1
    for k, bits in blocks.items():
        packed = np.packbits(bits, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([packed], pa.binary())], names=["block", "bits"])


def _number(blocks: int):
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_block(keys, blocks)), batch.column(0)], names=["block", "key"])

    return run


def filter_of(df: DataFrame, key: str) -> Filter:
    """The filter of a column of long integers; ``df`` should be cheap to read twice."""
    blocks = max(1, min(MOST_BITS, df.count() * BITS_PER_KEY) // BLOCK_BITS)
    keyed = df.select(F.col(key).alias("key")).mapInArrow(_number(blocks), "block long, key long")
    parts = max(1, min(blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = keyed.repartition(parts, "block").mapInArrow(_blocks_of, "block long, bits binary").collect()
    return Filter({r["block"]: bytes(r["bits"]) for r in rows}, blocks)
