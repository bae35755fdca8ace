"""Merkle manifest of a table: a proof for every row, without a pass back down the tree.

Leaves stand in order within their group; every FANOUT neighbours make a node, and what remains of a
group is its subroot. Leaves are dealt into aligned blocks of FANOUT**LOCAL, whose lower levels
are hashed where they lie. Above, a butterfly exchange: in each round the blocks that stand at the
same place of FANOUT neighbouring subtrees swap the roots of these, and each of them hashes the
common ancestor for itself. So after the last round every block holds all upper siblings. A round
shuffles one root a block and neighbour. The subroots, in order of their groups, are the leaves of one
more such tree.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tables import ROW

FANOUT = 16
LOCAL = 3  # levels of a block
ROWS_OF_A_TASK = 100_000  # of the sort, about
_PATH = "array<struct<at int, before string, after string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _h(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


# --- order -----------------------------------------------------------------------------------


def ranked(df: DataFrame, group: list[str], order: list[str], rows_of_a_task: int = ROWS_OF_A_TASK) -> DataFrame:
    """``df`` with ``_pos``, the place of each row in its group from 0, and ``_n``, the size of the group.

    Rows are sorted across tasks by ranges of group and order, which must tell all rows apart, so a group may hold any
    share of them. Only counts of a task and group are numbered together.
    """
    parts = max(1, -(-df.count() // rows_of_a_task), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*group, *order]
    in_task = (F.monotonically_increasing_id() % (1 << 33)).alias("_at")
    cut = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    cut = written(cut.select("*", F.spark_partition_id().alias("_task"), in_task))
    counts = cut.groupBy("_task", *group).agg(F.count("*").alias("_m"), F.min("_at").alias("_low"))
    before = Window.partitionBy(*group).orderBy("_task")
    begin = counts.select(
        "_task", *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)),
        (F.sum("_m").over(before) - F.col("_m") - F.col("_low")).alias("_shift"),
        F.sum("_m").over(Window.partitionBy(*group)).alias("_n"),
    )
    same = [cut[g].eqNullSafe(begin[f"_g{i}"]) for i, g in enumerate(group)]
    joined = cut.join(begin, [cut["_task"] == begin["_task"], *same])
    return joined.select(*(cut[c] for c in df.columns), (cut["_at"] + begin["_shift"]).alias("_pos"), begin["_n"])


# --- blocks ----------------------------------------------------------------------------------


def block_levels(hashes: list[str], whole: bool, local: int = LOCAL) -> list[list[str]]:
    """Levels of a block, leaves first. A block that is a whole group ends with its one node."""
    levels = [hashes]
    while len(levels[-1]) > 1 if whole else len(levels) <= local:
        low = levels[-1]
        levels.append([_h("".join(low[i : i + FANOUT])) for i in range(0, len(low), FANOUT)])
    return levels


def _blocks(rows: DataFrame, group: list[str], payload: list[str], local: int) -> DataFrame:
    """One row for each block, of at most FANOUT**local leaves: ``_block``, ``_blocks`` of its group, ``_leaves`` in order."""
    size = FANOUT**local
    block = F.floor(F.col("_pos") / size).cast("long")
    rows = rows.withColumn("_block", block).withColumn("_blocks", F.ceil(F.col("_n") / size).cast("long"))
    leaves = F.sort_array(F.collect_list(F.struct("_pos", "_hash", *payload))).alias("_leaves")
    return written(rows.groupBy(*group, "_block", "_blocks").agg(leaves))


def _roots(blocks: DataFrame, group: list[str], local: int) -> DataFrame:
    """``group, _block, _blocks, _root``."""

    def run(batches):
        for batch in batches:
            roots = []
            for leaves, count in zip(batch.column("_leaves"), batch.column("_blocks").to_pylist(), strict=True):
                roots.append(block_levels(leaves.values.field("_hash").to_pylist(), count == 1, local)[-1][0])
            kept = [*group, "_block", "_blocks"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(roots, pa.string())], names=[*kept, "_root"])

    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in (*group, "_block", "_blocks"))
    return blocks.mapInArrow(run, f"{kinds}, _root string")


def _steps(siblings: Column, own: Column) -> Column:
    """Siblings (an array of (place, hash) in order) as what stands before and after one's own place."""

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter(siblings, keep), lambda x: x["_hash"]), "")

    return F.struct(own.cast("int").alias("at"), joined(lambda x: x["_digit"] < own).alias("before"), joined(lambda x: x["_digit"] > own).alias("after"))


def butterfly(blocks: DataFrame, group: list[str]) -> DataFrame:
    """``group, _block, _top, _path``: the root of the group and the steps from the block's root to it.

    ``blocks`` has ``group, _block, _blocks, _root``. In round ``r`` a block belongs to the node
    ``_block / FANOUT**r`` and stands at the place (lane) ``_block % FANOUT**r`` in it. Nodes under one parent swap
    roots lane by lane. Only the last node of a level may be short; its blocks take the lanes that it lacks.
    """
    most = blocks.agg(F.max("_blocks")).first()[0] or 1
    nodes = blocks.select(*group, "_block", "_blocks", F.col("_root").alias("_hash"), F.array().cast(_PATH).alias("_path"))
    span = 1  # blocks of a full node
    while span < most:
        node = F.floor(F.col("_block") / span)
        members = F.least(F.lit(span), F.col("_blocks") - node * span)
        parent = F.floor(node / FANOUT)
        lanes = F.least(F.lit(span), F.col("_blocks") - parent * span * FANOUT)
        lane = F.col("_block") % span
        placed = nodes.withColumns({"_parent": parent, "_digit": (node % FANOUT).cast("int"), "_own": lane, "_to": F.sequence(lane, lanes - 1, members)})
        sent = placed.select(*group, "_parent", F.explode("_to").alias("_lane"), "_digit", "_hash", "_own", "_block", "_blocks", "_path")
        own = F.when(F.col("_lane") == F.col("_own"), F.struct("_block", "_blocks", "_digit", "_hash", "_path"))
        met = sent.groupBy(*group, "_parent", "_lane").agg(
            F.sort_array(F.collect_list(F.struct("_digit", "_hash"))).alias("_all"), F.collect_list(own).alias("_mine")
        )
        here = met.select(*group, "_all", F.explode("_mine").alias("_b"))
        done = F.col("_b._blocks") <= span  # one node is left: nothing above it
        ancestor = F.sha2(F.array_join(F.transform("_all", lambda x: x["_hash"]), "").cast("binary"), 256)
        step = F.array(_steps(F.col("_all"), F.col("_b._digit"))).cast(_PATH)
        nodes = here.select(
            *group, "_b._block", "_b._blocks", F.when(done, F.col("_b._hash")).otherwise(ancestor).alias("_hash"),
            F.when(done, F.col("_b._path")).otherwise(F.concat("_b._path", step)).alias("_path"),
        )
        span *= FANOUT
    return nodes.select(*group, "_block", F.col("_hash").alias("_top"), "_path")


# --- proofs ----------------------------------------------------------------------------------


def _local_steps(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        low = at - at % FANOUT
        out.append(("".join(level[low:at]), "".join(level[at + 1 : low + FANOUT])))
        at //= FANOUT
    return out


def fold(leaf: str, steps) -> str:
    for before, after in steps:
        leaf = _h(before + leaf + after)
    return leaf


def _paths(local: int):
    """The steps from each leaf of a block to the root of its group."""

    def run(batches):
        for batch in batches:
            out, keys = [], []
            for leaves, count, upper in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                levels = block_levels(leaves.values.field("_hash").to_pylist(), count == 1, local)
                rest = [(s["before"], s["after"]) for s in upper]
                for at, name in enumerate(leaves.values.field("_key").to_pylist()):
                    keys.append(name)
                    out.append([{"at": k, "before": b, "after": a} for k, (b, a) in enumerate(_local_steps(levels, at) + rest)])
            kind = pa.list_(pa.struct([("at", pa.int32()), ("before", pa.string()), ("after", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, kind)], names=["_key", "_path"])

    return run


def _proved(local: int):
    """A row for each leaf of a block, with the digest of its proof and the root from its tampered form."""

    def run(batches):
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            upper, above = column["_path"].to_pylist(), column["_above"].to_pylist()
            for i, (leaves, count) in enumerate(zip(column["_leaves"], column["_blocks"].to_pylist(), strict=True)):
                rows = leaves.values
                hashes, tampered = rows.field("_hash").to_pylist(), rows.field("_tampered").to_pylist()
                levels = block_levels(hashes, count == 1, local)
                rest = [(s["before"], s["after"]) for s in upper[i] + above[i]]
                tail = "".join(b + a for b, a in rest)
                proofs, folded = [], []
                for at, (leaf, other) in enumerate(zip(hashes, tampered, strict=True)):
                    own = _local_steps(levels, at)
                    proofs.append(_h("".join(b + a for b, a in own) + tail))
                    folded.append(fold(other or leaf, own + rest))
                n = len(hashes)
                subroot, root = column["_top"][i].as_py(), column["_final"][i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.field("_of"), pa.array(hashes), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded),
                        pa.array([x == root for x in folded]),
                    ],
                    names=["_of", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return run


def manifest(docs: DataFrame, leaf: Column, tampered: Column, group: str = "source", key: str = "doc_id", rows_of_a_task: int = ROWS_OF_A_TASK, local: int = LOCAL) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    ``leaf`` is the digest of a row, ``tampered`` the digest that a check finds instead, or null where the
    row is as it was. A proof is the digests of all siblings, level by level, left to right;
    ``folded_root`` is the root that they give with the tampered leaf. Null groups are a group of
    their own, before all others; null keys come first in theirs; equal keys are in the order of their leaves. Repeated
    rows are leaves each. Texts of any length are hashed where they lie and do not move. An
    empty table has no rows. Other columns are read only where ``leaf`` reads them and are not returned.
    """
    rows = written(docs.select(F.col(key).alias("_of"), F.col(group).alias("_group"), leaf.alias("_hash"), tampered.alias("_tampered"), F.monotonically_increasing_id().alias(ROW)))
    placed = ranked(rows, ["_group"], ["_of", "_hash", ROW], rows_of_a_task)
    blocks = _blocks(placed, ["_group"], ["_tampered", "_of"], local)
    upper = written(butterfly(written(_roots(blocks, ["_group"], local)), ["_group"]))

    # Subroots are the leaves of the last tree.
    tops = upper.where("_block = 0").select("_group", F.col("_top").alias("_hash"))
    last = written(ranked(written(tops.withColumn("_key", F.monotonically_increasing_id())), [], ["_group", "_key"], rows_of_a_task))
    groups = _blocks(last, [], ["_key"], local)
    ends = written(butterfly(written(_roots(groups, [], local)), []))
    top = ends.select("_top").first()
    steps = groups.join(ends, "_block").select("_leaves", "_blocks", "_path").mapInArrow(_paths(local), f"_key long, _path {_PATH}")
    above = written(last.select(F.col("_group").alias("_g"), "_key").join(steps, "_key").select("_g", F.col("_path").alias("_above")))

    own = upper.select(F.col("_group").alias("_g"), F.col("_block").alias("_b"), "_top", "_path")
    whole = blocks.join(own, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b"))).drop("_g", "_b")
    whole = whole.join(above, F.col("_group").eqNullSafe(F.col("_g")))
    fields = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = whole.select("_leaves", "_blocks", "_path", "_above", "_top", F.lit(top and top[0]).cast("string").alias("_final"))
    return out.mapInArrow(_proved(local), f"_of {rows.schema['_of'].dataType.simpleString()}, {fields}").withColumnRenamed("_of", key)
