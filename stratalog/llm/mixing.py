"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

Targets share the whole size by weight; none exceeds ``repeats`` times its source, and what is cut off is shared again by
weight. A target of k whole passes and a rest takes every row k times, and the rest from the rows whose hash lies under
the source's threshold. The threshold comes from sums of size by source and hash bucket: the bucket where the running sum
crosses the budget is the boundary, and only its rows are summed again, by the next bits of the hash, until it holds one
hash. No row is sorted; each level sends at most ``2^13`` sums a source and task. A smaller budget keeps a subset of a
larger one's rows.

Defined results: a null text has size 0; a null source is a source of its own, the last; equal ids share their hash, so
repeated rows are taken or left together; a source of size 0 takes nothing; an empty table gives an empty result; extra
columns are not read. What a source takes misses its target by half of its boundary row (all rows of one id) at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh_name, word_count

#: Bits of each refinement level; together the 60 bits of the hash.
LEVELS = (12, 12, 12, 12, 12)
BITS = sum(LEVELS)
#: A table of one row a source is broadcast up to this many rows (checked), else joined by shuffle.
BROADCAST_SOURCES = 20_000


def source_key(source: Column) -> Column:
    """A key without null that sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def uniform_hash(value: Column, seed: str) -> Column:
    """60 uniform bits of an id (null counts as empty), the same in every run and engine."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, repeats: int = 3, cycle: int = 3) -> DataFrame:
    """``(skey, source_size, target)`` from ``(skey, source_size)``: one row a source, so a single window suffices.

    With weights w and caps c the shares are ``least(c, level * w)``. Sources are capped in the order of c / w; the level
    is what the others' weights share of the rest.
    """
    w = ((F.row_number().over(Window.orderBy("skey")) - 1) % cycle + 1).cast("long")
    ranked = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * repeats)
    whole = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("w")), "skey").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    before_cap, before_w = F.coalesce(F.sum("cap").over(order), F.lit(0)), F.coalesce(F.sum("w").over(order), F.lit(0))
    ranked = ranked.withColumn("level", (F.col("total") - before_cap) / (F.col("all_w") - before_w))
    # the first source (by cap / w) whose level doesn't exceed its cap / w sets the level of itself and all later ones
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("skey"), F.col("level").alias("level")))
    found = F.min(fits).over(whole)
    share = F.least(F.col("cap").cast("double"), found["level"] * F.col("w"))
    return ranked.select("skey", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_SOURCES else table


def take_by_threshold(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Thresholds ``(skey, source_size, target, passes, cut, whole)`` for ``rows`` of ``(skey, h, size)``.

    A row is in the rest of its source if its hash is under ``cut``, or equals it and ``whole`` says so.
    """
    state = targets.withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    state = checkpointed(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long")))
    sources = state.count()
    unsettled, settled, left = state.where("budget > 0"), [], BITS
    for width in LEVELS:
        shift = left - width
        inside = rows.join(_small(unsettled.select("skey", "prefix"), sources), "skey").where(
            F.shiftright("h", left) == F.col("prefix")
        )
        sums = inside.groupBy("skey", F.shiftright("h", shift).alias("q")).agg(
            F.sum("size").alias("mass"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        running = F.sum("mass").over(Window.partitionBy("skey").orderBy("q"))
        crossed = (
            sums.withColumn("upto", running)
            .join(_small(unsettled.select("skey", "budget", "before"), sources), "skey")
            .where(F.col("before") + F.col("upto") > F.col("budget"))
            .groupBy("skey")
            .agg(F.min(F.struct("q", "mass", "low", "high", "upto")).alias("x"))
        )
        placed = checkpointed(
            unsettled.drop("prefix")
            .join(crossed, "skey")
            .select(
                "skey", "source_size", "target", "passes", "budget",
                F.col("x.q").alias("prefix"),
                (F.col("before") + F.col("x.upto") - F.col("x.mass")).alias("before"),
                F.col("x.mass").alias("mass"), F.col("x.low").alias("low"), (F.col("x.low") == F.col("x.high")).alias("single"),
            )
        )
        settled.append(placed.where("single"))
        unsettled = placed.where("not single").select("skey", "source_size", "target", "passes", "budget", "prefix", "before")
        left = shift
        if unsettled.isEmpty():
            break
    cuts = settled[0]
    for more in settled[1:]:
        cuts = cuts.unionByName(more)
    nearer = (F.col("before") + F.col("mass") - F.col("budget")) <= (F.col("budget") - F.col("before"))
    cuts = cuts.select("skey", F.col("low").alias("cut"), nearer.alias("whole"))
    return checkpointed(state.select("skey", "source_size", "target", "passes").join(cuts, "skey", "left"))


def mix(docs: DataFrame, *, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = 3, cycle: int = 3, seed: str = "mix") -> DataFrame:
    """``(id, size, source_size, target, times)`` for every row; ``times`` is how often the mix takes it."""
    size = word_count(F.col(text_col)) if size is None else size
    rows = checkpointed(
        docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("skey"), size.alias("size"))
    ).withColumn("h", uniform_hash(F.col("id"), seed))
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    plan = take_by_threshold(rows.select("skey", "h", "size"), source_targets(sizes, repeats, cycle))
    taken = F.coalesce((F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("whole")), F.lit(False))
    return rows.join(_small(plan, plan.count()), "skey").select(
        "id", "size", "source_size", "target", (F.col("passes") + taken.cast("long")).alias("times")
    )


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The rows of the mix, each as often as it is taken; the columns are those of ``docs``.

    The thresholds are the same for all rows of a source, so the filter is a projection over the source's plan and the
    texts are never shuffled.
    """
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("skey"), word_count(F.col(text_col)).alias("size")))
    rows = rows.withColumn("h", uniform_hash(F.col("id"), seed))
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    plan = take_by_threshold(rows.select("skey", "h", "size"), source_targets(sizes))
    key, own, copy = (fresh_name(docs, n) for n in ("mix_key", "mix_plan", "mix_copy"))
    slim = plan.select(F.col("skey").alias(key), F.struct("passes", "cut", "whole").alias(own))
    joined = docs.join(_small(slim, slim.count()), source_key(docs[source_col]) == F.col(key))
    h, plan_of = uniform_hash(F.col(id_col), seed), F.col(own)
    taken = F.coalesce((h < plan_of["cut"]) | ((h == plan_of["cut"]) & plan_of["whole"]), F.lit(False))
    times = (plan_of["passes"] + taken.cast("long")).cast("int")
    return (
        joined.where(times > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (SELECT *, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - COALESCE(sum(cap) OVER (ORDER BY cap::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(w) OVER () - COALESCE(sum(w) OVER (ORDER BY cap::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w),
f AS (SELECT arg_min(level, (cap::DOUBLE / w, skey)) AS level FROM l WHERE level * w <= cap),
t AS (SELECT skey, source_size, COALESCE(LEAST(cap::DOUBLE, f.level * w), cap::DOUBLE) AS target FROM w LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t),
r AS (SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget,
             sum(size) OVER (PARTITION BY skey ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY skey, h) AS mass
      FROM d JOIN p USING (skey))
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN budget > 0 AND (upto <= budget OR (upto - mass <= budget AND upto - budget <= budget - (upto - mass))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
