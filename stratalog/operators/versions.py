"""The append-only version log of a block-ordered change feed.

A row is appended for a key in a block if the key is set there or its successor in key order changed; it carries the
successor, the block of the row it replaces, and a serial number of its shard. Replaced rows are deactivated: their serial
numbers are listed by the next append of the shard, or by filler rows once 65 have gathered or the block ends.

The work grows with the changes, not with keys times blocks. Keys are dealt into ranges; each range walks its own
operations in block order over a sorted list of its live keys and gives a row where a key is written, deleted or followed by
another key than before (:func:`sweep`). What crosses ranges is settled by a second walk over the first and last live key
of each range, one row for each change of them (:func:`spine`). Serial numbers are prefix sums over (shard, block, range).
Rows that several branches read are written to the shared checkpoint folder once. :mod:`..engine` commits block by block.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import END_GUARD, SHARDS, START_GUARD, TWIG_SIZE, shard_id
from ..lineage import shared
from .ordered import with_next
from .state import last_writer

#: Deactivations that a filler row takes.
FLUSH_AT = 65

LOG = "block long, shard int, sn long, key binary, value binary, next_key binary, height long, last_height long, is_dummy boolean, deactivated array<bigint>"

#: Operations that a key range holds about (a range is walked by one Python worker, which holds them all).
RANGE_ROWS = 50_000

#: Rows of a sweep: kind 0 is a change of ``key`` (``wrote`` is S, D, or T where only the successor changed; ``next_key`` is
#: null where the successor lies beyond the range), kind 1 the range's first and last live key (``low``, ``key``) after a block.
SWEPT = "kind int, range int, block long, key binary, wrote string, value binary, existed boolean, next_key binary, low binary"
_SWEPT = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), ("key", pa.binary()), ("wrote", pa.string()), ("value", pa.binary()), ("existed", pa.bool_()), ("next_key", pa.binary()), ("low", pa.binary())])
_FLUSH = 50_000


class Sweep:
    """Live keys of one range in order, with the successor that each was last written with."""

    def __init__(self, number: int) -> None:
        self.number, self.live, self.nexts, self.edge = number, [], {}, (None, None)

    def block(self, height: int, ops: list[tuple[bytes, str, bytes | None]]) -> list[tuple]:
        """Rows of one block; ``ops`` has one operation a key."""
        sets = {k: v for k, op, v in ops if op == "S"}
        born = [k for k in sets if k not in self.nexts]
        dead = [k for k, op, _ in ops if op == "D" and k in self.nexts]
        if len(born) + len(dead) > 32:
            gone = set(dead)
            self.live = sorted([k for k in self.live if k not in gone] + born)
        else:
            for k in dead:
                del self.live[bisect_left(self.live, k)]
            for k in born:
                insort(self.live, k)
        live = self.live
        rows = [(0, self.number, height, k, "D", None, True, None, None) for k in dead]
        for k in dead:
            del self.nexts[k]
        touched = set()
        for k in (*born, *dead):
            at = bisect_left(live, k)
            if at and live[at - 1] not in sets:
                touched.add(live[at - 1])
        for k in (*sets, *touched):
            at = bisect_right(live, k)
            after = live[at] if at < len(live) else None
            existed = k in self.nexts
            if k in sets or after != self.nexts[k]:
                rows.append((0, self.number, height, k, "S" if k in sets else "T", sets.get(k), existed, after, None))
            self.nexts[k] = after
        edge = (live[0], live[-1]) if live else (None, None)
        if edge != self.edge:
            self.edge = edge
            rows.append((1, self.number, height, edge[1], None, None, None, None, edge[0]))
        return rows


class Spine:
    """First and last live key of every range that has any, and the successors across ranges."""

    def __init__(self) -> None:
        self.ranges, self.edges, self.links = [], {}, {}

    def block(self, changes: list[tuple[int, bytes | None, bytes | None]]) -> list[tuple[bytes, bytes | None]]:
        """Pairs of a range's last key and its successor that changed; ``changes`` are ``(range, low, high)``."""
        near = set()
        for number, low, high in changes:
            if low is None:
                if number in self.edges:
                    del self.ranges[bisect_left(self.ranges, number)]
                    del self.edges[number]
                    self.links.pop(number, None)
                continue
            if number not in self.edges:
                insort(self.ranges, number)
            self.edges[number] = low, high
        for number, *_ in changes:
            at = bisect_left(self.ranges, number)
            near.update(self.ranges[max(0, at - 1) : at + 1])
        out = []
        for number in sorted(near):
            at = bisect_right(self.ranges, number)
            after = self.edges[self.ranges[at]][0] if at < len(self.ranges) else None
            link = self.edges[number][1], after
            if self.links.get(number) != link:
                self.links[number] = link
                out.append(link)
        return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each block, block by block, from batches sorted by their first column."""
    height, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != height:
                if rows:
                    yield height, rows
                height, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield height, rows


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows :data:`SWEPT` of one key range from ``(block, key, op, value)`` in block order."""
    state, held = Sweep(TaskContext.get().partitionId()), []
    for height, ops in _by_block(batches):
        held += state.block(height, ops)
        if len(held) >= _FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SWEPT, strict=True)], schema=_SWEPT)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SWEPT, strict=True)], schema=_SWEPT)


def spine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(block, key, next_key)`` of the last key of a range whenever its successor in later ranges changes."""
    state, held = Spine(), []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "key", "next_key"])

    for height, changes in _by_block(batches):
        held += [(height, *link) for link in state.block(changes)]
        if len(held) >= _FLUSH:
            yield out()
            held = []
    if held:
        yield out()


def key_changes(ops: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(block, key, range, at, value, existed, appends, next_key, height, last_height)`` of the keys that a block writes, deletes or
    gives another successor."""
    spark = ops.sparkSession
    guards = spark.createDataFrame([(-1, bytearray(k), "S", bytearray()) for k in (START_GUARD, END_GUARD)], "height long, key binary, op string, value binary")
    written = shared(last_writer(ops).select("height", "key", "op", "value").unionByName(guards).select(F.col("height").alias("block"), "key", "op", "value"))
    # as many ranges as the rows ask for: what a worker holds does not grow with the feed, and adaptive execution does not put ranges together
    dealt = written.repartitionByRange(ranges or -(-written.count() // RANGE_ROWS), "key")
    swept = shared(dealt.sortWithinPartitions("block", "key").mapInArrow(sweep, SWEPT))
    edges = swept.where("kind = 1").select("block", "range", "low", F.col("key").alias("high"))
    links = edges.repartition(1).sortWithinPartitions("block", "range").mapInArrow(spine, "block long, key binary, next_key binary")
    own = swept.where("kind = 0").select("block", "key", "range", "wrote", "value", "existed", "next_key", F.lit(None).cast("binary").alias("beyond"))
    across = links.select("block", "key", F.lit(None).cast("int").alias("range"), F.lit(None).cast("string").alias("wrote"), F.lit(None).cast("binary").alias("value"), F.lit(True).alias("existed"), F.lit(None).cast("binary").alias("next_key"), F.coalesce("next_key", "key").alias("beyond"))
    by_key = Window.partitionBy("key").orderBy("block")
    so_far = by_key.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # both rows of a block see each other
    here = Window.partitionBy("key", "block")
    rows = (
        own.unionByName(across)
        .withColumn("beyond", F.last("beyond", ignorenulls=True).over(so_far))
        .withColumn("range", F.last("range", ignorenulls=True).over(so_far))
        .withColumn("value", F.last("value", ignorenulls=True).over(so_far))
        .withColumn("twin", F.max(F.col("wrote").isNotNull()).over(here))
        .where("wrote is not null or not twin")
        .withColumn("next_key", F.coalesce("next_key", "beyond"))
        .withColumn("appends", F.coalesce(F.col("wrote") != "D", F.lit(True)))
    )
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    last_block = F.last(F.when(F.col("appends"), F.col("block")), ignorenulls=True).over(earlier)
    last_height = F.when(F.col("block") == -1, F.lit(-1)).when(~F.col("existed"), F.lit(0)).otherwise(last_block).cast("long")
    return rows.withColumn("last_height", last_height).select(
        "block", "key", "range", F.lit(0).cast("long").alias("at"), "value", "existed", "appends", "next_key", F.col("block").alias("height"), "last_height"
    )


def version_log(ops: DataFrame, *, base_sn: int = TWIG_SIZE, ranges: int | None = None) -> DataFrame:
    """Log rows of engine operations ``(height, seq, key, op, value)``, guards included.

    ``base_sn`` is the first serial number of each shard: 2048 after the genesis rows, 0 without them. ``ranges`` is the
    number of key ranges (one for each :data:`RANGE_ROWS` operations if not given).
    """
    changed = shared(key_changes(ops, ranges).withColumn("shard", shard_id(F.col("key"))))
    rows = shared(number_rows(expand_steps(changed), F.lit(base_sn)))
    replaced = F.last(F.when(F.col("kind") == 1, F.col("sn")), ignorenulls=True).over(
        Window.partitionBy("key").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, -1)
    )
    return list_deactivations(shared(rows.withColumn("replaced", F.when(F.col("kind") == 0, replaced))))


#: Range of the filler rows that end a block.
LAST_RANGE = (1 << 31) - 1


def expand_steps(changed: DataFrame) -> DataFrame:
    """Steps of each (shard, block): a deactivation (kind 0) and an append (1) a key, fillers where they are due (2 at the end).

    The order inside a range is that of ``(at, key)``. ``takes`` tells whether a step takes a serial number, ``run`` counts the appends before it and ``n`` the run's
    deactivations. Both are counted inside key ranges; one row a (shard, block, range) carries them from range to range.
    """
    none = F.array().cast("array<int>")
    kinds = F.concat(F.when(F.col("existed"), F.array(F.lit(0))).otherwise(none), F.when(F.col("appends"), F.array(F.lit(1))).otherwise(none))
    line = Window.partitionBy("shard", "block", "range").orderBy("at", "key", "kind")
    steps = changed.withColumn("kind", F.explode(kinds))
    steps = steps.withColumn("local", F.coalesce(F.sum("kind").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_run = Window.partitionBy("shard", "block", "range", "local").orderBy("at", "key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = shared(steps.withColumn("n", F.sum(1 - F.col("kind")).over(in_run)))
    by_range = Window.partitionBy("shard", "block").orderBy("range")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    # deactivations after a range's last append belong to the run that goes on in the next range
    tails = (
        steps.groupBy("shard", "block", "range", "local").agg(F.sum(F.col("kind")).alias("appends"), F.max("n").alias("n"))
        .groupBy("shard", "block", "range").agg(F.sum("appends").alias("appends"), F.max_by(F.when(F.col("appends") == 0, F.col("n")).otherwise(0), "local").alias("tail"))
        .withColumn("run0", F.coalesce(F.sum("appends").over(before), F.lit(0)))
        .withColumn("stretch", F.sum((F.col("appends") > 0).cast("int")).over(by_range))
        .withColumn("held", F.sum("tail").over(Window.partitionBy("shard", "block", "stretch").orderBy("range")))
        .withColumn("carry", F.coalesce(F.lag("held").over(by_range), F.lit(0)))
    )
    tails = shared(tails)
    steps = steps.join(tails.select("shard", "block", "range", "run0", "carry"), ["shard", "block", "range"])
    steps = steps.withColumn("n", F.when(F.col("local") == 0, F.col("n") + F.col("carry")).otherwise(F.col("n"))).withColumn("run", F.col("run0") + F.col("local"))
    steps = steps.withColumn("takes", F.when(F.col("kind") == 1, 1).otherwise((F.col("n") % FLUSH_AT == 0).cast("int"))).drop("local", "run0", "carry")
    ends = (
        tails.groupBy("shard", "block").agg(F.max_by("held", "range").alias("n"), F.sum("appends").alias("run"))
        .where(f"n % {FLUSH_AT} > 0")
        .select("shard", "block", F.lit(LAST_RANGE).alias("range"), "run", "n", F.lit(2).alias("kind"), F.lit(1).alias("takes"))
    )
    return steps.unionByName(ends, allowMissingColumns=True)


def number_rows(steps: DataFrame, first) -> DataFrame:
    """Add ``sn``; ``first`` is the first free serial number of the row's shard: a prefix sum over (block, range), then inside."""
    steps = shared(steps)
    sums = steps.groupBy("shard", "block", "range").agg(F.sum("takes").alias("taken"))
    before = sums.withColumn("before", F.sum("taken").over(Window.partitionBy("shard").orderBy("block", "range")) - F.col("taken")).drop("taken")
    inside = Window.partitionBy("shard", "block", "range").orderBy("at", "key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = steps.withColumn("inside", F.sum("takes").over(inside)).join(before, ["shard", "block", "range"])
    return numbered.withColumn("sn", (first + F.col("before") + F.col("inside") - 1).cast("long")).drop("inside", "before")


def list_deactivations(rows: DataFrame) -> DataFrame:
    """Log rows of numbered steps; ``replaced`` is the serial number that a deactivation turns off.

    Deactivations of a run go in stretches of 65: a full one is taken by the filler after it, the rest by the run's append
    or end.
    """
    lists = (
        rows.where("kind = 0")
        .groupBy("shard", "block", "run", F.floor((F.col("n") - 1) / FLUSH_AT).alias("stretch"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "replaced"))), lambda x: x["replaced"]).alias("listed"))
        .withColumn("stretch", F.when(F.size("listed") == FLUSH_AT, F.col("stretch")).otherwise(F.lit(-1)).cast("long"))
    )
    taken = F.when(F.col("kind") == 0, F.col("n") / FLUSH_AT - 1).otherwise(F.lit(-1)).cast("long")
    out = rows.where("takes = 1").withColumn("stretch", taken).join(lists, ["shard", "block", "run", "stretch"], "left")
    dummy = F.col("kind") != 1
    filler = F.lit("dummy").cast("binary")
    listed = F.coalesce("listed", F.array().cast("array<bigint>"))
    pick = lambda other, own_col: F.when(dummy, other).otherwise(own_col)
    return out.select(
        "block", "shard", "sn",
        pick(filler, F.col("key")).alias("key"), pick(filler, F.col("value")).alias("value"), pick(filler, F.col("next_key")).alias("next_key"),
        pick(F.lit(-2).cast("long"), F.col("height")).alias("height"), pick(F.lit(-2).cast("long"), F.col("last_height")).alias("last_height"),
        dummy.alias("is_dummy"), F.when(dummy, F.concat(listed, F.array("sn"))).otherwise(listed).alias("deactivated"),
    )


def genesis(spark, shards: int = SHARDS) -> DataFrame:
    """The 2048 filler rows that open each shard."""
    filler = F.lit("dummy").cast("binary")
    return spark.range(shards * TWIG_SIZE).select(
        F.lit(-1).cast("long").alias("block"), F.floor(F.col("id") / TWIG_SIZE).cast("int").alias("shard"), (F.col("id") % TWIG_SIZE).alias("sn"),
        filler.alias("key"), filler.alias("value"), filler.alias("next_key"), F.lit(-2).cast("long").alias("height"), F.lit(-2).cast("long").alias("last_height"),
        F.lit(True).alias("is_dummy"), F.array().cast("array<bigint>").alias("deactivated"),
    )


def with_active(log: DataFrame) -> DataFrame:
    """Add ``active``: appended, no filler, and listed by no later row of the shard."""
    off = log.select("shard", F.explode("deactivated").alias("sn")).distinct().withColumn("off", F.lit(True))
    return log.join(off, ["shard", "sn"], "left").withColumn("active", ~F.col("is_dummy") & F.col("off").isNull()).drop("off")


def consistency(log: DataFrame) -> DataFrame:
    """One row: live rows, and how many name another successor than the next live key."""
    live = with_active(log).where("active")
    chained = with_next(live.select("key", "next_key"), "expected")
    wrong = ~F.col("next_key").eqNullSafe(F.coalesce("expected", "key"))
    return chained.agg(F.count("*").alias("rows_checked"), F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("broken"))
