"""Inclusion, activity and non-existence proofs.

A proof runs from a leaf through its twig's 11 levels, the 3 levels of the bitmap chunk that holds its bit, and the levels
above twigs to the shard's root. Sides follow from bits of the serial number, so a proof is a list of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import hash_pair
from ..functions.keys import TWIG_SHIFT, leaf_of, little_endian, twig_of
from ..functions.nulltree import NULL_TWIG, NULL_UPPER
from .ordered import RANGE, ranged

OTHER_HASHES = 17


def proof_paths(rows: DataFrame, trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """Proofs for ``rows`` of ``(shard, sn)``: ``(shard, sn, leaf, left, chunk, right, upper, root)``.

    ``left``, ``right`` and ``upper`` are arrays of sibling hashes, lowest level first. A row asked for twice is proven once.
    """
    leaf = leaf_of(F.col("sn")).cast("int")
    peer = lambda n: n.bitwiseXOR(F.lit(1))
    asked = rows.select("shard", "sn").withColumn("twig", twig_of(F.col("sn"))).withColumn("at", leaf)
    level = lambda name, k: F.get(F.col(name), F.lit(k))

    def path(r: Column) -> Column:
        at = r["at"]
        return F.struct(
            r["sn"].alias("sn"),
            F.get(level("levels", 0), at).alias("leaf"),
            F.array(*(F.get(level("levels", k), peer(F.shiftright(at, k))) for k in range(TWIG_SHIFT))).alias("left"),
            F.get(level("bit_levels", 0), F.shiftright(at, 8)).alias("chunk"),
            F.array(*(F.get(level("bit_levels", k), peer(F.shiftright(at, 8 + k))) for k in range(3))).alias("right"),
        )

    # a twig's hashes meet its asked rows once (2048 at most, each serial number once), not once a row
    by_twig = asked.distinct().groupBy("shard", "twig").agg(F.collect_list(F.struct("sn", "at")).alias("rows"))
    inside = by_twig.join(trees, ["shard", "twig"]).select("shard", "twig", F.explode(F.transform("rows", path)).alias("p")).select("shard", "twig", "p.*")
    tops = nodes.select("shard", "top").distinct()
    steps = inside.select("shard", "twig").distinct().join(tops, "shard").withColumn("level", F.explode(F.sequence(F.lit(12), F.col("top") - 1)))
    steps = steps.withColumn("nth", F.expr("shiftright(twig, level - 12)").bitwiseXOR(F.lit(1)))
    null = F.when(F.col("level") == 12, F.lit(NULL_TWIG.hex()))
    for level in range(13, 64):
        null = null.when(F.col("level") == level, F.lit(NULL_UPPER[level + 1].hex()) if level + 1 in NULL_UPPER else F.lit(None))
    upper = (
        steps.join(nodes.select("shard", "level", "nth", "hash"), ["shard", "level", "nth"], "left")
        .groupBy("shard", "twig")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("level", F.coalesce("hash", null).alias("hash")))), lambda x: x["hash"]).alias("upper"))
    )
    roots = nodes.where((F.col("level") == F.col("top")) & (F.col("nth") == 0)).select("shard", F.col("hash").alias("root"))
    return inside.join(upper, ["shard", "twig"]).join(roots, "shard").drop("twig")


def proof_hex(p: DataFrame) -> Column:
    """Serialised proof, as hex."""
    return F.concat(little_endian(F.col("sn"), 8), "leaf", F.array_join("left", ""), "chunk", F.array_join("right", ""), F.array_join("upper", ""), "root")


def parse_proof(text: Column) -> Column:
    """Struct of a serialised proof; null where the length doesn't fit."""
    n = F.length(text) - 16
    upper = (n / 64).cast("int") - OTHER_HASHES
    at = lambda k: F.substr(text, 17 + 64 * k, F.lit(64))
    many = lambda start, count: F.transform(F.sequence(F.lit(0), count - 1), lambda i: at(start + i))
    sn = F.conv(F.concat(*(F.substring(text, 2 * k + 1, 2) for k in range(7, -1, -1))), 16, -10).cast("long")
    parsed = F.struct(
        sn.alias("sn"), at(F.lit(0)).alias("leaf"), many(F.lit(1), F.lit(11)).alias("left"), at(F.lit(12)).alias("chunk"), many(F.lit(13), F.lit(3)).alias("right"),
        F.when(upper > 0, many(F.lit(16), upper)).otherwise(F.array().cast("array<string>")).alias("upper"), at(F.lit(16) + upper).alias("root"),
    )
    return F.when((n % 64 == 0) & (upper >= 0), parsed)


def folded_root(p: DataFrame) -> Column:
    """Root that a proof's hashes lead to."""

    def step(level: int, acc: Column, peer: Column, bit: int) -> Column:
        left = F.shiftright("sn", bit).bitwiseAND(F.lit(1)) == 1
        return F.when(left, hash_pair(level, peer, acc)).otherwise(hash_pair(level, acc, peer))

    acc = F.col("leaf")
    for k in range(TWIG_SHIFT):
        acc = step(k, acc, F.get("left", F.lit(k)), k)
    bits = F.col("chunk")
    for k in range(3):
        bits = step(8 + k, bits, F.get("right", F.lit(k)), 8 + k)
    return acc, bits


def verify(paths: DataFrame) -> DataFrame:
    """``(shard, sn, valid, is_active)``: the hashes lead to the root, and the row's bit is set."""

    acc, bits = folded_root(paths)
    staged = paths.withColumn("left_root", acc).withColumn("bits_root", bits).withColumn("twig_root", hash_pair(11, F.col("left_root"), F.col("bits_root")))
    numbered = F.transform("upper", lambda h, i: F.struct(h.alias("peer"), (i + 12).alias("level")))

    def up(current: Column, node: Column) -> Column:
        byte = F.lpad(F.hex(node["level"].cast("long")), 2, "0")
        left = F.call_function("shiftright", F.col("sn"), (node["level"] - 1)).bitwiseAND(F.lit(1)) == 1
        joined = F.when(left, F.concat(byte, node["peer"], current)).otherwise(F.concat(byte, current, node["peer"]))
        return F.sha2(F.unhex(joined), 256)

    root = F.aggregate(numbered, F.col("twig_root"), up)
    in_chunk = F.col("sn").bitwiseAND(F.lit(255))
    byte = F.conv(F.substr("chunk", (2 * F.shiftright(in_chunk, 3) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, in_chunk.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return staged.select("shard", "sn", (root == F.col("root")).alias("valid"), bit.alias("is_active"))


def absence_witness(live: DataFrame, keys: DataFrame, ranges: int | None = None) -> DataFrame:
    """For each key that is not live, the live row whose span (key, next key) covers it.

    Keys and rows are unioned and each key takes the last row before it, within ranges of keys; a range's opening row comes
    from the ranges before.
    """
    rows = live.select("key", F.struct("key", "next_key", "shard", "sn").alias("w"), F.lit(0).alias("side"))
    asked = keys.select("key").distinct().join(live.select("key"), "key", "left_anti")
    both = rows.unionByName(asked.select("key", F.lit(None).cast(dict(rows.dtypes)["w"]).alias("w"), F.lit(1).alias("side")))
    both = ranged(both, ranges=ranges)
    inner = Window.partitionBy(RANGE).orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    last = both.groupBy(RANGE).agg(F.max_by("w", F.when(F.col("side") == 0, F.col("key"))).alias("tail"))
    carried = last.select(RANGE, F.last("tail", ignorenulls=True).over(outer).alias("carried"))
    found = both.withColumn("w", F.last("w", ignorenulls=True).over(inner)).where("side = 1").join(carried, RANGE)
    return found.withColumn("w", F.coalesce("w", "carried")).select("key", F.col("w.key").alias("before"), F.col("w.next_key").alias("after"), F.col("w.shard").alias("shard"), F.col("w.sn").alias("sn"))
