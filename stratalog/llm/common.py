"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import re
import sys
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition used throughout: a word is a maximal run of anything else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names. A private one is made in local mode only (tests); a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="stratalog-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage now: shuffle files, and checkpoints where the session has them cleaned, are deleted
    once the driver has collected what refers to them, which may else be long after the last plan that reads them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_arrow_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Bound what one Arrow batch brings into a Python worker, whatever the texts' lengths.

    The limits hold for the session, since Spark reads them when a plan runs. They are only ever lowered, so the order in
    which plans are built does not matter and a session's own smaller limits stay.
    """
    now_rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now_rows <= 0 or now_rows > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    now_bytes = _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if now_bytes <= 0 or now_bytes > megabytes << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def _bytes(text: str) -> int:
    """Bytes that a size such as ``48m`` names."""
    digits, unit = re.match(r"\s*(-?\d+)\s*([a-z]*)", text.lower()).groups()
    return int(digits) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(unit[:1], 0)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star contraction.

    Returns ``(node, component)`` for every node that has an edge to another node; ``component`` is the
    smallest node of its component. Nulls and self-loops are ignored, repeated edges are harmless, and an
    empty edge table gives an empty result. A round costs two aggregations (combined map-side, so a node
    with a third of all edges sends one row a task) and two equi-joins that adaptive execution may split;
    no adjacency list is ever gathered. Rounds grow with the logarithm of the longest chain, and each
    ends in the shared checkpoint folder.
    """
    u, v = F.col(a), F.col(b)
    stars = checkpointed(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo"))
        .distinct()
    )
    state = _digest(stars)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        )
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(roots, "hi").where(F.col("lo") > F.col("m"))
        after = checkpointed(
            roots.select("hi", F.col("m").alias("lo"))
            .unionByName(moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            .distinct()
        )
        before, state = state, _digest(after)
        stars = after
        del both, least, large, roots, moved, after
        release(stars.sparkSession)  # the last round's files
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


#: Rows of two or three numbers or short strings that may be broadcast (about 50 MB).
BROADCAST_ROWS = 500_000


def sized(table: DataFrame) -> DataFrame:
    """A narrow table, to be broadcast if it has at most :data:`BROADCAST_ROWS` rows (they are counted), else joined by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join in which a key's rows of ``left`` meet ``salts`` copies of its rows of ``right``.

    For a large left side with hot keys and a small right one: a key that holds a third of all left rows is dealt over
    ``salts`` tasks by the hash of ``spread``.
    """
    salt = F.pmod(F.xxhash64(spread, F.lit("salt")), F.lit(salts)).cast("int")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", salt).join(copies, [*on, "__salt"], how).drop("__salt")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def process_cache() -> dict:
    """Per-process store for tables that workers build once (functions travel by value, their globals don't last)."""
    return sys.__dict__.setdefault("_stratalog_process_cache", {})
