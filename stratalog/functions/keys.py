"""Key-space functions: hash-derived short keys, shards, index channels, buckets and byte packing as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 8
KEY_SIZE = 8
TWIG_SHIFT = 11
TWIG_SIZE = 1 << TWIG_SHIFT
START_GUARD = bytes(8)
END_GUARD = bytes([255] * 8)
MAX_HOPS = 100


def sha256(data: Column) -> Column:
    """Digest as binary."""
    return F.unhex(F.sha2(data.cast("binary"), 256))


def byte_at(data: Column, index: int) -> Column:
    """Unsigned value of one byte, counted from 0."""
    return F.conv(F.hex(F.substring(data, index + 1, 1)), 16, 10).cast("int")


def limit_range(byte: Column) -> Column:
    """Keep the first byte between the guards: b mod 128 + 64."""
    return byte % 128 + 64


def limited(digest: Column) -> Column:
    """First eight bytes of a digest with the first byte limited."""
    first = F.unhex(F.lpad(F.hex(limit_range(byte_at(digest, 0)).cast("long")), 2, "0"))
    return F.concat(first, F.substring(digest, 2, KEY_SIZE - 1))


def short_key(key: Column, hop: int = 0) -> Column:
    """The key's address after ``hop`` collisions: each further hop hashes the whole digest again."""
    digest = sha256(key)
    for _ in range(hop):
        digest = sha256(digest)
    return limited(digest)


def shard_id(key: Column) -> Column:
    return F.when(F.octet_length(key) != KEY_SIZE, F.lit(0)).otherwise(F.floor(byte_at(key, 7) / (256 // SHARDS)).cast("int"))


def index_channel(byte: Column) -> Column:
    return F.when(byte < 64, F.lit(0)).when(byte >= 192, F.lit(9)).otherwise(1 + F.floor((byte - 64) / 16).cast("int"))


def order_bucket(key: Column) -> Column:
    """One of 64 buckets that keep the order of keys."""
    return F.shiftright(byte_at(key, 0), 2)


def twig_of(sn: Column) -> Column:
    return F.shiftright(sn, TWIG_SHIFT)


def leaf_of(sn: Column) -> Column:
    return sn.bitwiseAND(TWIG_SIZE - 1)


def hexed(data: Column) -> Column:
    return F.lower(F.hex(data))


def little_endian(value: Column, size: int) -> Column:
    """Hex text of an integer's low ``size`` bytes, lowest first."""
    text = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.lower(F.concat(*(F.substring(text, 15 - 2 * k, 2) for k in range(size))))
