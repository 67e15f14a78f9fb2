"""Overlay reads and write-back: a block's or transaction's changes over a base state.

An overlay is ``(key, op, value)``, one row a key. In a buffered overlay an empty value means deletion; the engine itself
keeps keys with empty values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def buffered(changes: DataFrame) -> DataFrame:
    """Changes as a buffer holds them: setting an empty or null value deletes."""
    deleted = (F.col("op") == "D") | F.col("value").isNull() | (F.length("value") == 0)
    return changes.select("key", F.when(deleted, F.lit("D")).otherwise(F.lit("S")).alias("op"), F.when(~deleted, F.col("value")).alias("value"))


def overlay_get(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Merged state: overlay rows win, deletions hide base rows."""
    top = overlay.select("key", F.col("op").alias("__op"), F.col("value").alias("__value"))
    merged = base.select("key", "value").join(top, "key", "full_outer")
    return merged.where(F.coalesce(F.col("__op"), F.lit("S")) == "S").select("key", F.when(F.col("__op") == "S", F.col("__value")).otherwise(F.col("value")).alias("value"))


def overlay_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys whose values differ between two states: ``(key, left_value, right_value)``."""
    a = left.select("key", F.col("value").alias("left_value"))
    b = right.select("key", F.col("value").alias("right_value"))
    return a.join(b, "key", "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def to_block(overlay: DataFrame, height: int) -> DataFrame:
    """An overlay as one block of operations."""
    return overlay.select(F.lit(height).cast("long").alias("height"), F.lit(0).cast("long").alias("seq"), "key", "op", "value")


def conflicts(touches: DataFrame) -> DataFrame:
    """Keys touched by more than one worker: ``(key, workers)`` from ``(worker, key)``."""
    return touches.distinct().groupBy("key").agg(F.count("*").alias("workers")).where("workers > 1")
