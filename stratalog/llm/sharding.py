"""Proportional stratified interleaving into shards (DataFrame operations only).

Rows of a source are ranked in a seeded shuffle; rank r of n stands at the fraction (r - 1 + u) / n, where u, in [0, 1), is
a seeded draw of the source. In the order of these fractions every stretch holds the sources in the proportions of the
whole, so cutting it into equal runs gives shards that each match the mixture, with row counts at most one apart. The draw
lets sources of a few rows, which have no more than a few fractions, fall evenly over all shards.

No source is ranked by one task: a rank is the number of rows in the source's earlier hash buckets plus the place in its
own bucket, and the global place is found alike over buckets of the fraction, which the sources fill evenly. Buckets and
their rows both grow with the square root of the number of rows, so neither a bucket nor the list of buckets gets large.

Defined results: a null text has no bytes; a null source is a source of its own; a null id is hashed as empty; rows equal
in id and text are interchangeable; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, utf8_crc32
from .mixing import BITS, source_key, uniform_hash

#: Fewest rows that one window partition sorts, on average.
BUCKET_ROWS = 1000


def document_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def source_draw(skey: Column, seed: str) -> Column:
    """The source's seeded draw in [0, 1), a multiple of 2^-20."""
    return F.shiftright(uniform_hash(skey, seed + ":source"), BITS - 20) / F.lit(float(1 << 20))


def interleave(docs: DataFrame, *, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "shard", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(id, source, size, text_crc32, shard, slot)`` for every row; slots of a shard run from 0 without gaps."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        source_key(F.col(source_col)).alias("skey"),
        document_size(F.col(text_col)).alias("size"),
        utf8_crc32(F.col(text_col)).alias("crc"),
        uniform_hash(F.col(id_col), seed).alias("h"),
    )
    total, most = (
        rows.groupBy("skey").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    )
    bucket_rows = max(bucket_rows, isqrt(total))
    bits = max(0, (most // bucket_rows).bit_length())
    spread = max(1, total // bucket_rows)
    rows = rows.withColumn("b", F.shiftright("h", BITS - bits))
    upto = F.sum("n").over(Window.partitionBy("skey").orderBy("b"))
    offsets = (
        rows.groupBy("skey", "b")
        .agg(F.count("*").alias("n"))
        .select("skey", "b", (upto - F.col("n")).alias("earlier"), F.sum("n").over(Window.partitionBy("skey")).alias("of"))
    )
    place = F.row_number().over(Window.partitionBy("skey", "b").orderBy("h", "id", "crc", "size"))
    ranked = (
        rows.withColumn("place", place)
        .join(offsets, ["skey", "b"])
        .withColumn("fraction", (F.col("earlier") + F.col("place") - 1 + source_draw(F.col("skey"), seed)) / F.col("of"))
        .select("id", "source", "skey", "size", "crc", "h", "fraction", F.floor(F.col("fraction") * spread).alias("g"))
    )
    ranked = checkpointed(ranked)
    starts = ranked.groupBy("g").agg(F.count("*").alias("n")).select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("g").orderBy("fraction", "skey", "h", "id", "crc", "size"))
    at = ranked.withColumn("inside", inside).join(starts, "g").withColumn("at", F.col("start") + F.col("inside") - 1)
    rows_all = max(1, total)
    return at.withColumn("shard", F.expr(f"cast(at * {shards}L div {rows_all}L as int)")).select(
        "id", "source", "size", F.col("crc").alias("text_crc32"), "shard",
        F.expr(f"at - (shard * {rows_all}L + {shards - 1}L) div {shards}L").alias("slot"),
    )
