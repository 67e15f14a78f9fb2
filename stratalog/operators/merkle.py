"""Merkle trees over the log: twigs of 2048 rows, shard roots and the root of all shards.

A twig's rows meet once, by (shard, twig); its eleven levels and the three levels over its bitmap of active rows are then a
projection. Levels above twigs are computed shard by shard, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import entry_hex, hash_pair, leaf_hash, read_le
from ..functions.keys import SHARDS, TWIG_SHIFT, TWIG_SIZE, leaf_of, little_endian, twig_of
from ..functions.nulltree import FIRST_LEVEL_ABOVE_TWIG, NULL_BITS, NULL_LEAF, NULL_TWIG, NULL_UPPER
from .versions import with_active

#: Types of the rows that :func:`upper_nodes` gives.
_UPPER = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32())


def leaf_bytes(log: DataFrame) -> DataFrame:
    """Add ``entry`` (hex of the canonical bytes)."""
    return log.withColumn("entry", entry_hex(*(F.col(c) for c in ("key", "value", "next_key", "height", "last_height", "sn", "deactivated"))))


def leaf_hashes(log: DataFrame) -> DataFrame:
    """``(shard, sn, active, leaf)`` of every log row."""
    return leaf_bytes(with_active(log)).select("shard", "sn", "active", leaf_hash(F.col("entry")).alias("leaf"))


def _fold(level: int, nodes: Column) -> Column:
    half = F.sequence(F.lit(0), (F.size(nodes) / 2 - 1).cast("int"))
    return F.transform(half, lambda i: hash_pair(level, F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)))


def _bitmap(flags: Column) -> Column:
    """Hex of the bitmap, lowest bit of a byte first."""
    byte = lambda i: sum((F.get(flags, 8 * i + b) * (1 << b) for b in range(1, 8)), F.get(flags, 8 * i))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lower(F.lpad(F.hex(byte(i).cast("long")), 2, "0"))), "")


def twigs(leaves: DataFrame) -> DataFrame:
    """One row a twig: ``(shard, twig, levels, bitmap, bit_levels, left_root, twig_root)``.

    ``levels`` holds the hashes of level 0 to 10, ``bit_levels`` those over the eight chunks of the bitmap. The youngest
    twig exists even before its first row is written.
    """
    rows = leaves.select("shard", twig_of(F.col("sn")).alias("twig"), leaf_of(F.col("sn")).cast("int").alias("at"), "leaf", F.col("active").cast("int").alias("bit"))
    gathered = rows.groupBy("shard", "twig").agg(F.sort_array(F.collect_list(F.struct("at", "leaf", "bit"))).alias("rows"))
    opened = (
        leaves.groupBy("shard").agg((F.max("sn") + 1).alias("next"))
        .where(F.col("next") % TWIG_SIZE == 0)
        .select("shard", twig_of(F.col("next")).alias("twig"), F.array().cast(dict(gathered.dtypes)["rows"]).alias("rows"))
    )
    rest = F.lit(TWIG_SIZE) - F.size("rows")
    out = gathered.unionByName(opened).select(
        "shard", "twig",
        F.concat(F.transform("rows", lambda r: r["leaf"]), F.array_repeat(F.lit(NULL_LEAF.hex()), rest)).alias("l0"),
        F.concat(F.transform("rows", lambda r: r["bit"]), F.array_repeat(F.lit(0), rest)).alias("flags"),
    )
    for level in range(TWIG_SHIFT):
        out = out.withColumn(f"l{level + 1}", _fold(level, F.col(f"l{level}")))
    out = out.withColumn("bitmap", _bitmap(F.col("flags")))
    out = out.withColumn("b0", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr("bitmap", 64 * i + 1, F.lit(64))))
    for k, level in enumerate((8, 9, 10)):
        out = out.withColumn(f"b{k + 1}", _fold(level, F.col(f"b{k}")))
    return out.select(
        "shard", "twig",
        F.array(*(F.col(f"l{k}") for k in range(TWIG_SHIFT))).alias("levels"), "bitmap", F.array("b0", "b1", "b2", "b3").alias("bit_levels"),
        F.get(F.col(f"l{TWIG_SHIFT}"), F.lit(0)).alias("left_root"),
        hash_pair(11, F.get(F.col(f"l{TWIG_SHIFT}"), F.lit(0)), F.get(F.col("b3"), F.lit(0))).alias("twig_root"),
    )


def left_roots(leaves: DataFrame) -> DataFrame:
    """``(shard, twig, left_root)`` of the twigs that ``leaves`` of ``(shard, sn, leaf)`` fill from their first row on."""
    rows = leaves.select("shard", twig_of(F.col("sn")).alias("twig"), leaf_of(F.col("sn")).cast("int").alias("at"), "leaf")
    out = rows.groupBy("shard", "twig").agg(F.sort_array(F.collect_list(F.struct("at", "leaf"))).alias("rows"))
    out = out.withColumn("nodes", F.concat(F.transform("rows", lambda r: r["leaf"]), F.array_repeat(F.lit(NULL_LEAF.hex()), F.lit(TWIG_SIZE) - F.size("rows"))))
    for level in range(TWIG_SHIFT):
        out = out.withColumn("nodes", _fold(level, F.col("nodes")))
    return out.select("shard", "twig", F.get("nodes", F.lit(0)).alias("left_root"))


def bits_root(bitmap: Column) -> Column:
    """Root of the three levels over the eight chunks of a twig's bitmap (hex)."""
    nodes = [F.substring(bitmap, 64 * i + 1, 64) for i in range(8)]
    for level in (8, 9, 10):
        nodes = [hash_pair(level, a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=True)]
    return nodes[0]


def twig_root(left_root: Column, bitmap: Column) -> Column:
    return hash_pair(11, left_root, bits_root(bitmap))


def inactive_twig_root(left_root: Column) -> Column:
    """Root of a twig without active rows, as compaction leaves it."""
    return hash_pair(11, left_root, F.lit(NULL_BITS[-1].hex()))


def _upper(twigs: dict[int, str], given: dict[tuple[int, int], str]) -> Iterator[tuple[int, int, str | None, int]]:
    """``(level, nth, hash, top)`` of one shard's nodes (see :func:`upper_nodes`)."""
    top = max(twigs).bit_length() + 12 if max(twigs) else 13
    known = dict(twigs)
    for level in range(FIRST_LEVEL_ABOVE_TWIG - 1, top + 1):
        if level >= FIRST_LEVEL_ABOVE_TWIG:
            null = (NULL_TWIG if level == FIRST_LEVEL_ABOVE_TWIG else NULL_UPPER[level]).hex()
            byte, below, known = bytes([level - 1]), known, {}
            for nth in {n >> 1 for n in below}:
                left, right = below.get(2 * nth), below.get(2 * nth + 1) or null
                known[nth] = None if left is None else sha256(byte + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()
        for (at, nth), node in given.items():
            if at == level and known.get(nth) is None:
                known[nth] = node
        if given:
            known = {nth: node for nth, node in known.items() if node is not None}
        for nth, node in known.items():
            yield level, nth, node, top


def upper_nodes(trees: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(shard, level, nth, hash, top)`` from the twigs (level 12) to each shard's root, the node 0 of level ``top``.

    A missing right sibling above level 13 counts as the empty subtree of its parent's level, as the format has it. Where
    twigs were pruned, ``edges`` of ``(shard, level, nth, hash)`` hold the nodes that their parents are computed from; nodes
    left of them are not given. A shard's twigs (one row in 2,048 of the log) meet in one task.
    """
    rows = trees.select("shard", F.lit(False).alias("edge"), F.lit(12).alias("level"), F.col("twig").alias("nth"), F.col("twig_root").alias("hash"))
    if edges is not None:
        rows = rows.unionByName(edges.select("shard", F.lit(True).alias("edge"), "level", "nth", "hash"))

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found = [(shard, *node) for node in _upper(twigs, given)] if twigs else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(_UPPER)], names=["shard", "level", "nth", "hash", "top"])

        shard, twigs, given = None, {}, {}
        for batch in batches:
            for number, edge, level, nth, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != shard:
                    if shard is not None:
                        yield out()
                    shard, twigs, given = number, {}, {}
                if edge:
                    given[level, nth] = node
                else:
                    twigs[nth] = node
        if shard is not None:
            yield out()

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(climb, "shard int, level int, nth long, hash string, top int")


def edge_nodes(nodes: DataFrame, ends: DataFrame, sibling: bool = False) -> DataFrame:
    """``(shard, level, nth, hash)`` of the nodes to keep when the twigs before ``end`` of ``(shard, end)`` go.

    One node a level: the twig ``end`` itself, and above it the node at half of the one below, rounded down to a left child.
    With ``sibling`` the twig before an odd ``end`` is kept too; without it that root has to come from the twig's own record.
    """
    nth = F.expr("shiftright(end, level - 12)")
    twig = (F.col("nth") == nth) | (F.lit(sibling) & (nth % 2 == 1) & (F.col("nth") == nth - 1))
    wanted = nodes.join(ends, "shard").where(F.when(F.col("level") == 12, twig).otherwise(F.col("nth") == nth - nth % 2))
    return wanted.select("shard", "level", "nth", "hash")


def edge_hex(level: Column, nth: Column, node: Column) -> Column:
    """Serialised edge node: its packed position (level in the top byte), little-endian, and its hash."""
    return F.concat(little_endian(F.shiftleft(level.cast("long"), 56).bitwiseOR(nth), 8), node)


def parse_edges(text: Column) -> Column:
    """Array of ``(level, nth, hash)`` from serialised edge nodes; null where the length does not fit."""
    count = (F.length(text) / 80).cast("int")

    def at(i: Column) -> Column:
        place = read_le(F.substr(text, 80 * i + 1, F.lit(16)), F.lit(0), 8)
        node = F.substr(text, 80 * i + 17, F.lit(64))
        return F.struct(F.shiftrightunsigned(place, 56).cast("int").alias("level"), place.bitwiseAND((1 << 56) - 1).alias("nth"), node.alias("hash"))

    return F.when(F.length(text) % 80 == 0, F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<struct<level:int,nth:bigint,hash:string>>")))


def tree_diff(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of two trees (twigs or nodes) that differ: the columns ``on``, and ``side`` (left, right or both)."""
    values = [c for c in left.columns if c not in on]
    a = left.select(*on, F.struct(*values).alias("a"))
    b = right.select(*on, F.struct(*values).alias("b"))
    side = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both")
    return a.join(b, on, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*on, side.alias("side"))


def shard_roots(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("level") == F.col("top")) & (F.col("nth") == 0)).select("shard", F.col("hash").alias("root"))


def global_root(roots: DataFrame) -> DataFrame:
    """One row: the root over the eight shard roots, without level bytes."""
    row = roots.groupBy().pivot("shard", list(range(SHARDS))).agg(F.first("root"))
    level = [F.col(f"`{k}`") for k in range(SHARDS)]
    while len(level) > 1:
        level = [F.sha2(F.unhex(F.concat(a, b)), 256) for a, b in zip(level[::2], level[1::2], strict=True)]
    return row.select(level[0].alias("root_hash"))
