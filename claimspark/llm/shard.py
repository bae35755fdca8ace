"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal rows are sorted by size and each goes into the open bin with the least room that
still holds it; the rooms are kept in order, so a bin is found by binary search. Packing has two
levels, so that no task sees all groups: tasks pack their own groups into cartons, a small fraction
of a shard each, and the cartons, whose number has a bound, are packed into the shards at the least
capacity that needs no further shard.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tables import ROW, numbered, plain

SHARDS = 40
CARTONS = 64, 4096  # of a shard, on small and on large inputs
PART_ROWS = 50_000  # that one task packs, about
OVERHEAD = 16  # bytes of a row besides its text
SLOT_ROWS = 20_000  # rows that one task numbers, about


class Bins:
    """Open bins, ordered by the room left; ties by the bin's number."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.rooms = capacity, 0, []

    def put(self, size: int, most: int | None = None) -> int | None:
        """The bin that gets ``size``: the tightest that holds it, else a new one unless there are ``most``."""
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        elif most is not None and self.count >= most or size > self.capacity:
            return None
        else:
            room, number, self.count = self.capacity, self.count, self.count + 1
        insort(self.rooms, (room - size, number))
        return number


def _packed(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    bins = Bins(capacity)
    out = []
    for size in sizes:
        number = bins.put(size, shards)
        if number is None:
            return None
        out.append(number)
    return out


def best_fit(sizes: list[int], shards: int) -> list[int]:
    """Best-fit decreasing of sizes in descending order, at the least capacity that fits ``shards`` bins."""
    low = max(math.ceil(sum(sizes) / shards), max(sizes, default=1), 1)
    high = 2 * low  # enough: were no bin to hold a size, all would be filled by more than the mean
    best = _packed(sizes, shards, high)
    while low < high:
        middle = (low + high) // 2
        found = _packed(sizes, shards, middle)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best


def _cartons(capacity: int):
    def run(batches):
        bins: Bins | None = None
        for batch in batches:
            part = batch.column(0).to_pylist()
            key = batch.column(1)
            out = []
            bins = bins or Bins(capacity)
            for size in batch.column(2).to_pylist():
                out.append(bins.put(size))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), key, batch.column(2), pa.array(out, pa.int32())], names=["part", "key", "bytes", "bin"])

    return run


def shard(
    docs: DataFrame, text: str = "text", shards: int = SHARDS, cartons: tuple[int, int] = CARTONS, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """``docs`` less the text, with ``size, text_crc32, shard, slot``: shards of nearly equal bytes.

    Rows of equal text are one group and stay together; all null texts are a group, as are all
    empty ones. A group larger than a carton is packed on the second level; one larger than a
    shard's fair share cannot be whole in shards of equal size and is dealt by row in pieces of
    carton size. Slots count from 0 without gaps in each shard; their order has no meaning.
    Repeated rows are each placed. An empty table gives an empty table. The text is
    read once and does not move. Other columns stay, but those named like a new one are replaced.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    docs = plain(docs, "size", "text_crc32", "shard", "slot")
    rows = numbered(docs.withColumns({"size": size, "text_crc32": F.crc32(F.coalesce(text, F.lit(""))), "_key": F.coalesce(F.sha2(text, 256), F.lit("null"))}).drop(text))
    groups = written(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total, n = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    share = max(1, math.ceil((total or 0) / shards))
    # A part fills some sixteen cartons; more rows make more parts, so more cartons, up to a bound.
    wanted = math.ceil((n or 0) / PART_ROWS)
    each = min(max(cartons[0], 16 * wanted // shards), cartons[1])
    carton = max(1, share // each)
    parts = max(1, min(shards * each // 16, wanted))
    small = (
        groups.where(F.col("bytes") <= carton)
        .select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "bytes")
        .repartition(parts, "part")
        .sortWithinPartitions("part", F.desc("bytes"), "key")
    )
    # First level. A partition may get several parts or none, so bins are named by the partition.
    packed = written(small.mapInArrow(_cartons(carton), "part int, key string, bytes long, bin int").withColumn("task", F.spark_partition_id()))
    packed = packed.withColumn("_unit", F.concat_ws("/", F.lit("c"), "task", "bin"))

    # Second level: cartons, large groups, and pieces of groups above a fair share. Their number
    # has a bound: about twice the cartons, and one for each part.
    large = groups.where(F.col("bytes") > carton)
    pieces = F.when(F.col("bytes") > share, F.ceil(F.col("bytes") / carton)).otherwise(F.lit(1)).cast("int")
    large = large.select("key", "bytes", "rows", pieces.alias("pieces"))
    units = [(r["_unit"], r["bytes"]) for r in packed.groupBy("_unit").agg(F.sum("bytes").alias("bytes")).collect()]
    big = large.collect()
    for r in big:
        row_bytes = r["bytes"] // r["rows"]
        for k in range(r["pieces"]):
            count = r["rows"] // r["pieces"] + (k < r["rows"] % r["pieces"])
            units.append((f"g/{r['key']}/{k}", count * row_bytes))
    units.sort(key=lambda u: (-u[1], u[0]))
    placed = list(zip((u for u, _ in units), best_fit([s for _, s in units], shards), strict=True))
    spark = docs.sparkSession
    place = spark.createDataFrame(placed or [("", 0)], "_unit string, shard int")

    # Rows of large groups: few keys, so they are broadcast; the others have few rows each.
    whole = spark.createDataFrame([(r["key"], r["pieces"]) for r in big], "_key string, _pieces int")
    keyed = rows.join(F.broadcast(whole), "_key", "left")
    of_large = _dealt(keyed.where("_pieces > 1"), slot_rows).select(
        *rows.columns, F.concat_ws("/", F.lit("g"), "_key", F.pmod("_nth", F.col("_pieces")).cast("string")).alias("_unit")
    )
    of_whole = keyed.where("_pieces = 1").select(*rows.columns, F.concat_ws("/", F.lit("g"), "_key", F.lit("0")).alias("_unit"))
    of_small = keyed.where("_pieces is null").select(*rows.columns).join(packed.select(F.col("key").alias("_key"), "_unit"), "_key").select(*rows.columns, "_unit")
    out = written(of_large.unionByName(of_whole).unionByName(of_small).join(F.broadcast(place), "_unit").drop("_unit", "_key"))
    return _nth(out, ["shard"], "slot", slot_rows).drop(ROW)


def _nth(df: DataFrame, keys: list[str], name: str, slot_rows: int) -> DataFrame:
    """A number for each row of a key, from 0 without gaps, where a key may hold any share of the rows.

    Slices of a key, by the row id, are counted; a slice begins where those before it end, and rows
    are numbered within their slice.
    """
    slices = max(1, math.ceil(df.count() / slot_rows))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(ROW), F.lit(slices)).cast("int"))
    sizes = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    within = Window.partitionBy(*keys, "_slice").orderBy(ROW)
    numbered_rows = cut.withColumn("_at", F.row_number().over(within) - 1)
    return numbered_rows.join(begin, [*keys, "_slice"]).withColumn(name, F.col("_begin") + F.col("_at")).drop("_slice", "_begin", "_at")


def _dealt(df: DataFrame, slot_rows: int) -> DataFrame:
    return _nth(df, ["_key"], "_nth", slot_rows)
