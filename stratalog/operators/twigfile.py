"""Positions of entries in a shard's file, and the records that keep a full twig's hashes.

An entry takes eight magic bytes, its canonical bytes and padding to a multiple of eight; its position is the sum of what
comes before. A twig's record has the position of its first entry and the nodes 1 to 255 and 2048 to 4095 of its tree (node
1 is the left root, node n has the children 2n and 2n + 1, leaves begin at 2048); the three levels between are computed
again from eight leaves when one of their nodes is asked for. The format's checksum is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import hash_pair
from ..functions.keys import TWIG_SHIFT, TWIG_SIZE, twig_of

KEPT_TOP = 255
FIRST_LEAF = 2048


def padded_size(entry: Column) -> Column:
    """Bytes that an entry (hex of its canonical bytes) takes in the file."""
    size = F.length(entry) / 2
    return (8 + F.ceil(size / 8) * 8).cast("long")


def entry_positions(entries: DataFrame) -> DataFrame:
    """``(shard, sn, pos, next_pos)`` of rows ``(shard, sn, entry)``: a prefix sum over twigs, then inside each."""
    rows = entries.select("shard", "sn", twig_of(F.col("sn")).alias("twig"), padded_size(F.col("entry")).alias("size"))
    sums = rows.groupBy("shard", "twig").agg(F.sum("size").alias("held"))
    before = sums.select("shard", "twig", (F.sum("held").over(Window.partitionBy("shard").orderBy("twig")) - F.col("held")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("shard", "twig").orderBy("sn"))
    placed = rows.withColumn("inside", inside).join(before, ["shard", "twig"]).withColumn("next_pos", F.col("before") + F.col("inside"))
    return placed.select("shard", "sn", (F.col("next_pos") - F.col("size")).alias("pos"), "next_pos")


def twig_records(trees: DataFrame, positions: DataFrame) -> DataFrame:
    """``(shard, twig, first_pos, top, leaves)`` of the full twigs: nodes 1 to 255 and the leaves, as arrays of hex."""
    firsts = positions.where(F.col("sn") % TWIG_SIZE == 0).select("shard", twig_of(F.col("sn")).alias("twig"), F.col("pos").alias("first_pos"))
    full = positions.where(F.col("sn") % TWIG_SIZE == TWIG_SIZE - 1).select("shard", twig_of(F.col("sn")).alias("twig"))
    level = lambda k: F.get("levels", F.lit(k))
    top = F.concat(F.array("left_root"), *(level(k) for k in range(TWIG_SHIFT - 1, 3, -1)))
    return trees.join(full, ["shard", "twig"], "left_semi").join(firsts, ["shard", "twig"]).select("shard", "twig", "first_pos", top.alias("top"), level(0).alias("leaves"))


def record_node(top: Column, leaves: Column, node: Column) -> Column:
    """Hash of node 1 to 4095 of a twig's record; null beyond."""
    leaf = lambda i: F.get(leaves, i.cast("int"))

    def cone(height: int) -> Column:
        """Root over the 2^height leaves below the node."""
        first = F.shiftleft(node, height) - FIRST_LEAF
        row = [leaf(first + i) for i in range(1 << height)]
        for level in range(height):
            row = [hash_pair(level, a, b) for a, b in zip(row[::2], row[1::2], strict=True)]
        return row[0]

    return (
        F.when((node >= 1) & (node <= KEPT_TOP), F.get(top, (node - 1).cast("int")))
        .when((node >= 256) & (node < 512), cone(3)).when((node >= 512) & (node < 1024), cone(2)).when((node >= 1024) & (node < 2048), cone(1))
        .when((node >= FIRST_LEAF) & (node < 2 * FIRST_LEAF), leaf(node - FIRST_LEAF))
    )


def record_hex(first_pos: Column, top: Column, leaves: Column) -> Column:
    """A record's bytes as hex, without the checksum."""
    from ..functions.keys import little_endian

    return F.concat(little_endian(first_pos, 8), F.array_join(top, ""), F.array_join(leaves, ""))
