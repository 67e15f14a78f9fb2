"""Current and historical state of a change feed: point, range, as-of and neighbour queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_writer(ops: DataFrame) -> DataFrame:
    """One operation a key and block: the last by sequence number. Combined map-side; no window over a hot key."""
    return ops.groupBy("height", "key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("w")).select("height", "key", "w.*")


def latest(ops: DataFrame, height: int | None = None) -> DataFrame:
    """Latest operation of each key, up to a height; deletions included."""
    rows = ops if height is None else ops.where(F.col("height") <= height)
    newest = F.max_by(F.struct("height", "op", "value", "seq"), F.struct("height", "seq"))
    return rows.groupBy("key").agg(newest.alias("w")).select("key", "w.*")


def current_state(ops: DataFrame, height: int | None = None) -> DataFrame:
    """Live keys with their values as of a height (the latest if none)."""
    return latest(ops, height).where("op = 'S'").select("key", "value", "height", "seq")


def get_batch(ops: DataFrame, keys: DataFrame, height: int | None = None) -> DataFrame:
    """Values of ``keys`` (null where absent). The feed is reduced to the wanted keys before it is aggregated."""
    wanted = keys.select("key").distinct()
    found = current_state(ops.join(wanted, "key", "left_semi"), height)
    return keys.join(found.select("key", "value", F.col("height").alias("found_height")), "key", "left")


def has(ops: DataFrame, keys: DataFrame, height: int | None = None) -> DataFrame:
    return keys.join(current_state(ops, height), "key", "left_semi")


def missing(ops: DataFrame, keys: DataFrame, height: int | None = None) -> DataFrame:
    return keys.join(current_state(ops, height), "key", "left_anti")


def active_count_by_height(ops: DataFrame) -> DataFrame:
    """Live keys after each block: the running sum of births less deaths."""
    w = Window.partitionBy("key").orderBy("height")
    last = last_writer(ops).withColumn("was", F.coalesce(F.lag("op").over(w), F.lit("D")))
    change = F.when((F.col("op") == "S") & (F.col("was") == "D"), 1).when((F.col("op") == "D") & (F.col("was") == "S"), -1).otherwise(0)
    by_block = last.groupBy("height").agg(F.sum(change).alias("delta"))
    return by_block.select("height", F.sum("delta").over(Window.orderBy("height")).alias("active"))  # one row a block


def asof_join(probes: DataFrame, ops: DataFrame) -> DataFrame:
    """For each probe ``(key, at)`` the newest version at or before ``at``; null where absent or deleted.

    Probes and versions are unioned and each probe takes the last version before it in its key's order: one shuffle by key,
    and no inequality join. Deletions are versions too and hide what they delete.
    """
    versions = last_writer(ops).select("key", F.col("height").alias("at"), F.lit(0).alias("side"), F.struct("op", "value", "height").alias("v"))
    asked = probes.select("key", "at", F.lit(1).alias("side"), F.lit(None).cast(dict(versions.dtypes)["v"]).alias("v"))
    w = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = versions.unionByName(asked).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1")
    live = F.col("v.op") == "S"
    return seen.select("key", "at", F.when(live, F.col("v.value")).alias("value"), F.when(live, F.col("v.height")).alias("version_height"))


def history(ops: DataFrame) -> DataFrame:
    """Versions of each key with the span of heights for which each holds (``until`` null: still)."""
    w = Window.partitionBy("key").orderBy("height")
    return last_writer(ops).select("key", "height", F.lead("height").over(w).alias("until"), "op", "value")


def tombstones(ops: DataFrame) -> DataFrame:
    """Blocks in which a live key was deleted."""
    w = Window.partitionBy("key").orderBy("height")
    return last_writer(ops).withColumn("was", F.lag("op").over(w)).where("op = 'D' and was = 'S'").select("key", "height")


def put_and_get_old(ops: DataFrame) -> DataFrame:
    """Each write with the value it replaced."""
    w = Window.partitionBy("key").orderBy("height")
    return last_writer(ops).select("key", "height", "value", F.lag("value").over(w).alias("old_value"))


def range_scan(state: DataFrame, start, end, reverse: bool = False) -> DataFrame:
    """Keys in ``[start, end)`` in order; the predicate reaches the scan of a table that holds the keys."""
    rows = state.where((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end)))
    return rows.orderBy(F.col("key").desc() if reverse else F.col("key"))


def touched_in_range(ops: DataFrame, keys: DataFrame, start: int, end: int) -> DataFrame:
    """Which of ``keys`` changed in blocks ``start`` to ``end`` (both inclusive)."""
    changed = ops.where(F.col("height").between(start, end)).select("key").distinct().withColumn("touched", F.lit(True))
    return keys.join(changed, "key", "left").select("key", F.coalesce("touched", F.lit(False)).alias("touched"))


def first_change_before(ops: DataFrame, height: int) -> DataFrame:
    """Last block before ``height`` in which each key changed."""
    return ops.where(F.col("height") < height).groupBy("key").agg(F.max("height").alias("changed_at"))
