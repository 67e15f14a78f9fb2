"""Neighbours and ranks in key order without a global sort in one task.

Rows are dealt into ranges of keys by sampled bounds, so ranges hold like numbers of rows whatever the keys look like. A
window looks inside each range, and one row a range carries what crosses its edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import shared

RANGE = "__range"


def ranged(df: DataFrame, key: str = "key", ranges: int | None = None) -> DataFrame:
    """Rows with the number of their key range; ranges are in key order and equal keys share one.

    There are as many ranges as the session has shuffle partitions, unless given. The rows are written once, since bounds
    that are sampled again need not be the same.
    """
    dealt = df.repartitionByRange(ranges, key) if ranges else df.repartitionByRange(key)
    return shared(dealt.withColumn(RANGE, F.spark_partition_id()))


def with_next(df: DataFrame, name: str, key: str = "key", ranges: int | None = None) -> DataFrame:
    """Add the following key (null for the last)."""
    rows = ranged(df, key, ranges)
    edge = rows.groupBy(RANGE).agg(F.min(key).alias("__edge"))
    return _across(rows, edge.withColumn("__beyond", F.lead("__edge").over(Window.orderBy(RANGE))), F.lead(key).over(_inside(key)), name)


def with_previous(df: DataFrame, name: str, key: str = "key", ranges: int | None = None) -> DataFrame:
    """Add the preceding key (null for the first)."""
    rows = ranged(df, key, ranges)
    edge = rows.groupBy(RANGE).agg(F.max(key).alias("__edge"))
    return _across(rows, edge.withColumn("__beyond", F.lag("__edge").over(Window.orderBy(RANGE))), F.lag(key).over(_inside(key)), name)


def _inside(key: str) -> Window:
    return Window.partitionBy(RANGE).orderBy(key)


def _across(rows: DataFrame, edges: DataFrame, here, name: str) -> DataFrame:
    joined = rows.withColumn("__here", here).join(edges.drop("__edge"), RANGE)
    return joined.withColumn(name, F.coalesce("__here", "__beyond")).drop("__here", "__beyond", RANGE)


def with_rank(df: DataFrame, name: str, key: str = "key", ranges: int | None = None) -> DataFrame:
    """Add the rank (from 1) in key order."""
    rows = ranged(df, key, ranges)
    sizes = rows.groupBy(RANGE).agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy(RANGE)) - F.col("__n")).drop("__n")
    ranked = rows.withColumn("__place", F.row_number().over(_inside(key))).join(sizes, RANGE)
    return ranked.withColumn(name, F.col("__before") + F.col("__place")).drop("__place", "__before", RANGE)
