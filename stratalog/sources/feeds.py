"""Change feeds: tables turned into block-ordered operations on keys.

An operation is ``(height, seq, key, op, value)``: op ``S`` sets and ``D`` deletes a logical key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import short_key

OPS = "height long, seq long, key string, op string, value string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last events by day; an error deletes the user."""
    return table(spark, sf_dir, "events").select(
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("height"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user:"), F.col("user_id")).alias("key"),
        F.when(F.col("event_type") == "error", F.lit("D")).otherwise(F.lit("S")).alias("op"),
        F.concat("event_type", F.lit(":"), F.col("event_id")).alias("value"),
    )


def order_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order once, in one bulk block."""
    return table(spark, sf_dir, "orders").select(
        F.lit(0).cast("long").alias("height"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("order:"), F.col("o_orderkey")).alias("key"),
        F.lit("S").alias("op"),
        F.concat("o_orderstatus", F.lit(":"), F.col("o_custkey")).alias("value"),
    )


def customer_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders by month since January 1995."""
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        ((F.year(day) - 1995) * 12 + F.month(day) - 1).cast("long").alias("height"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("cust:"), F.col("o_custkey")).alias("key"),
        F.lit("S").alias("op"),
        F.concat(F.lit("order:"), F.col("o_orderkey")).alias("value"),
    )


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four blocks over the orders: all set, the finished ones set again, the pending ones deleted, the urgent ones set again."""
    key, status, urgent = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    step = lambda h, op, value: F.struct(F.lit(h).cast("long").alias("height"), F.lit(op).alias("op"), value.alias("value"))
    steps = F.array(
        step(0, "S", F.concat(status, F.lit(":"), key)),
        F.when(status == "F", step(1, "S", F.concat(F.lit("late:"), key))),
        F.when(status == "P", step(2, "D", F.lit(""))),
        F.when(urgent, step(3, "S", F.concat(F.lit("urgent:"), key))),
    )
    rows = table(spark, sf_dir, "orders").select(key.alias("seq"), F.concat(F.lit("order:"), key).alias("key"), F.explode(F.array_compact(steps)).alias("x"))
    return rows.select("x.height", "seq", "key", "x.op", "x.value")


def engine_key(logical: Column) -> Column:
    """Eight-byte key under which the engine stores a logical key."""
    return short_key(logical)


def to_engine(ops: DataFrame) -> DataFrame:
    """Operations on eight-byte keys and binary values."""
    return ops.select("height", "seq", engine_key(F.col("key")).alias("key"), "op", F.col("value").cast("binary").alias("value"))
