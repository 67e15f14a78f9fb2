"""Canonical bytes of log entries, and their inverse, as JVM expressions over hex text.

``[n][u24 length][u32 position]*[ff ff ff ff][u32 |K|]K[u32 |V|]V[u32 |N|]N[height][last height][sn][deactivated sn]*``, all
little-endian. Where the eight magic bytes occur in the three strings they are zeroed and their positions are listed. The
escape runs inside a CASE branch, so only rows that need it pay for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import hexed, little_endian

MAGIC = "fffefdfcfcfdfeff"


def _sized(data: Column) -> Column:
    return F.concat(little_endian(F.octet_length(data), 4), hexed(data))


def _magic_positions(strings: Column) -> Column:
    """Byte positions of magic occurrences, left to right without overlap.

    The scan stops once eight or fewer bytes are left, so an occurrence that ends the region is found only as the first.
    """
    n = (F.length(strings) / 2).cast("int")
    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("next"))

    def step(acc: Column, i: Column) -> Column:
        here = (i >= acc["next"]) & (acc["next"] + 8 < n) & (F.substr(strings, 2 * i + 1, F.lit(16)) == MAGIC)
        return F.struct(
            F.when(here, F.concat(acc["found"], F.array(i))).otherwise(acc["found"]).alias("found"),
            F.when(here, i + 8).otherwise(acc["next"]).alias("next"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 8, F.lit(0))), start, step)["found"]


def entry_hex(key: Column, value: Column, next_key: Column, height: Column, last_height: Column, sn: Column, deactivated: Column) -> Column:
    """Hex text of an entry's canonical bytes; ``deactivated`` is an array of serial numbers (null counts as empty)."""
    listed = F.coalesce(deactivated, F.array().cast("array<bigint>"))
    strings = F.concat(_sized(key), _sized(value), _sized(next_key))
    numbers = F.concat(little_endian(height, 8), little_endian(last_height, 8), little_endian(sn, 8))
    tail = F.array_join(F.transform(listed, lambda x: little_endian(x, 8)), "")
    count = little_endian(F.size(listed), 1)
    plain_length = (F.length(strings) + F.length(numbers)) / 2 + 4
    plain = F.concat(count, little_endian(plain_length, 3), F.lit("ffffffff"), strings, numbers, tail)
    found = _magic_positions(strings)
    zeroed = F.aggregate(found, strings, lambda acc, p: F.overlay(acc, F.lit("0" * 16), 2 * p + 1, F.lit(16)))
    positions = F.array_join(F.transform(found, lambda p: little_endian(p + 4 * F.size(found), 4)), "")
    escaped = F.concat(count, little_endian(plain_length + 4 * F.size(found), 3), positions, F.lit("ffffffff"), zeroed, numbers, tail)
    occurs = strings.rlike(f"^(?:..)*?{MAGIC}")
    return F.when(occurs, escaped).otherwise(plain)


def read_le(text: Column, byte: Column, size: int) -> Column:
    """Integer from ``size`` little-endian bytes of a hex text (signed for eight)."""
    at = lambda k: F.substr(text, 2 * (byte + k) + 1, F.lit(2))
    big = F.concat(*(at(k) for k in range(size - 1, -1, -1)))
    if size < 8:
        return F.conv(big, 16, 10).cast("long")
    return F.conv(big, 16, -10).cast("long")


def decode_entry(text: Column) -> Column:
    """Struct of an entry from its hex text; magic bytes are put back."""
    n = read_le(text, F.lit(0), 1)
    body = read_le(text, F.lit(1), 3)  # from byte 4 to the numbers' end
    stop = F.lit(4).cast("long") + body
    marks = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: read_le(text, 4 + 4 * k, 4))
    escapes = F.array_position(marks, F.lit(0xFFFFFFFF).cast("long")) - 1
    start = 4 + 4 * escapes + 4
    fixed = F.aggregate(
        F.slice(marks, F.lit(1), escapes.cast("int")), text, lambda acc, p: F.overlay(acc, F.lit(MAGIC), (2 * (p + 8) + 1).cast("int"), F.lit(16))
    )
    key_len = read_le(fixed, start, 4)
    value_at = start + 4 + key_len
    value_len = read_le(fixed, value_at, 4)
    next_at = value_at + 4 + value_len
    next_len = read_le(fixed, next_at, 4)
    cut = lambda at, size: F.unhex(F.substr(fixed, (2 * at + 1).cast("int"), (2 * size).cast("int")))
    return F.struct(
        cut(start + 4, key_len).alias("key"),
        cut(value_at + 4, value_len).alias("value"),
        cut(next_at + 4, next_len).alias("next_key"),
        read_le(fixed, stop - 24, 8).alias("height"),
        read_le(fixed, stop - 16, 8).alias("last_height"),
        read_le(fixed, stop - 8, 8).alias("sn"),
        F.when(n == 0, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: read_le(fixed, stop + 8 * k, 8)))
        .alias("deactivated"),
    )


def leaf_hash(entry: Column) -> Column:
    """Merkle leaf of an entry's hex text, as hex."""
    return F.sha2(F.unhex(entry), 256)


def hash_pair(level: int, left: Column, right: Column) -> Column:
    """Parent of two hex hashes; ``level`` is the children's."""
    return F.sha2(F.unhex(F.concat(F.lit(f"{level:02x}"), left, right)), 256)
