"""Version log and store against a model that takes every step one by one; compaction, pruning and recovery."""

import random

import pytest
from model import Model
from pyspark.sql import functions as F

from stratalog.engine import Store
from stratalog.functions.keys import END_GUARD, START_GUARD, short_key
from stratalog.operators import versions

OPS = "height long, seq long, key binary, op string, value binary"


def history(seed, blocks, names, writes, deletes):
    """Blocks of ``{key: value or None}``; keys of a few shards, runs of neighbours deleted together."""
    r = random.Random(seed)
    keys = sorted({bytes([r.choice([64, 90, 191]), r.randrange(4)]) + r.randbytes(5) + bytes([r.choice([0, 1, 2, 255])]) for _ in range(names)})
    out = []
    for h in range(blocks):
        ops = {k: f"{h}:{k.hex()[:6]}".encode() for k in (r.sample(keys, writes) if h else keys)}
        at = r.randrange(len(keys) // 3)
        ops |= {k: None for k in keys[at : at + r.randint(deletes // 2, deletes)] if h % 2}
        out.append(ops)
    return out


def frame(spark, blocks):
    rows = [(h, k, bytearray(key), "D" if v is None else "S", v and bytearray(v)) for h, ops in enumerate(blocks) for k, (key, v) in enumerate(ops.items())]
    return spark.createDataFrame(rows, OPS)


def log_rows(log):
    names = ("block", "shard", "sn", "key", "value", "next_key", "height", "last_height", "deactivated")
    out = [tuple(bytes(r[n]) if n in ("key", "value", "next_key") else list(r[n]) if n == "deactivated" else r[n] for n in names) for r in log.collect()]
    return sorted(out, key=lambda x: (x[1], x[2]))


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 7), (3, 23)])
def test_version_log_equals_the_model(spark, seed, ranges):
    blocks = history(seed, 7, 400, 60, 250)
    model = Model()
    for h, ops in enumerate(blocks):
        model.commit(h, ops)
    log = versions.version_log(frame(spark, blocks), ranges=ranges)
    assert log_rows(log) == sorted([(*r[:8], list(r[8])) for r in model.log], key=lambda x: (x[1], x[2]))
    assert any(len(r[8]) == 66 for r in model.log)


def test_a_key_written_in_every_block_and_an_emptied_range(spark):
    key = lambda k: bytes([k]) + b"abcdef" + bytes([7])
    blocks = [{key(k): b"1" for k in range(70, 90)}, {key(k): None for k in range(70, 89)}, {key(75): b"2"}, {key(75): b"3"}, {key(75): None, key(89): None}, {key(80): b"4"}]
    model = Model()
    for h, ops in enumerate(blocks):
        model.commit(h, ops)
    for ranges in (1, 5, 40):
        log = versions.version_log(frame(spark, blocks), ranges=ranges)
        assert log_rows(log) == sorted([(*r[:8], list(r[8])) for r in model.log], key=lambda x: (x[1], x[2]))


def live(store, height=None):
    return {bytes(r["key"]): bytes(r["value"]) for r in store.state(height).collect()}


def test_store_compacts_prunes_and_recovers(spark, tmp_path):
    r = random.Random(9)
    names = [bytes([64 + k % 128, k // 128]) + r.randbytes(5) + bytes([k % 2]) for k in range(2600)]
    blocks = [{k: b"0" for k in names}]
    blocks += [{k: f"{h}".encode() for k in r.sample(names[:2000], 1300)} for h in (1, 2)]
    blocks += [{k: (None if h == 4 and j < 90 else f"{h}".encode()) for j, k in enumerate(names[h * 20 : h * 20 + 400])} for h in (3, 4, 5)]
    path = str(tmp_path / "store")
    store = Store.create(spark, path, bits=4, compact_at=100, compact_ratio=1, min_kept=1)
    model, past = Model(min_kept=1, compact_at=100, ratio=1), []
    for h, ops in enumerate(blocks):
        store.commit_block(frame(spark, [ops]).drop("height"), h)
        model.commit(h, ops)
        past.append({k: v[0] for k, v in model.live.items() if k not in (START_GUARD, END_GUARD)})
    genesis = F.col("block") == -1
    assert log_rows(store.log().where(~genesis)) == sorted([(*x[:8], list(x[8])) for x in model.log if x[0] >= 0], key=lambda x: (x[1], x[2]))
    meta = store.meta()
    assert (list(meta.next_sn), list(meta.oldest), meta.active) == (model.next_sn, model.oldest, len(model.live))
    assert max(model.oldest) >= 4 and any(x[6] < x[0] and x[3] != b"dummy" for x in model.log)  # rows were appended again
    assert store.recover().isEmpty() and store.check_tree().isEmpty()
    for h in (0, 3):
        assert live(store, h) == past[h]

    assert store.prune_before(2).pruned[0] == 2  # up to an odd twig first
    assert store.recover().isEmpty()
    pruned = store.prune_before(3)
    assert max(pruned.pruned) >= 2 and pruned.edges is not None
    assert store.log().where("shard = 0").agg(F.min("sn")).first()[0] == (pruned.pruned[0] + 1) * 2048
    assert store.recover().isEmpty() and store.check_tree().isEmpty()
    assert live(store, 3) == {} and live(store, 4) == past[4] and live(store) == past[5]
    # a reopened store goes on as one that was never pruned
    again, plain = Store(spark, path, compact_at=100, compact_ratio=1, min_kept=1), {names[1]: b"x", names[2500]: None}
    again.commit_block(frame(spark, [plain]).drop("height"), 6)
    model.commit(6, plain)
    assert again.recover().isEmpty() and again.check_tree().isEmpty()
    assert live(again) == {k: v[0] for k, v in model.live.items() if k not in (START_GUARD, END_GUARD)} and live(again, 5) == past[5]
    assert list(again.meta().next_sn) == model.next_sn


def test_compaction_moves_rows_of_its_own_block(spark, tmp_path):
    """The oldest twig is filled up by the block that compacts it."""
    r = random.Random(4)
    names = [bytes([64 + k % 128, k // 128]) + r.randbytes(5) + bytes([k % 2]) for k in range(1500)]
    blocks = [{k: b"0" for k in names}, {k: b"1" for k in names[:700]} | {k: None for k in names[1400:]}]
    store, model = Store.create(spark, str(tmp_path / "store"), bits=4, compact_at=100, compact_ratio=1, min_kept=1), Model(min_kept=1, compact_at=100, ratio=1)
    for h, ops in enumerate(blocks):
        store.commit_block(frame(spark, [ops]).drop("height"), h)
        model.commit(h, ops)
    assert log_rows(store.log().where("block >= 0")) == sorted([(*x[:8], list(x[8])) for x in model.log if x[0] >= 0], key=lambda x: (x[1], x[2]))
    assert any(x[0] == 1 and x[6] == 1 and x[2] >= 4096 and x[3] in names[:700] for x in model.log)
    assert store.recover().isEmpty() and store.check_tree().isEmpty()
    assert live(store) == {k: v[0] for k, v in model.live.items() if k not in (START_GUARD, END_GUARD)}


def test_ranges_and_files_of_a_block_do_not_follow_its_buckets(spark, tmp_path, monkeypatch):
    """A store of two buckets sorts and writes its rows in many parts, with the same roots and links."""
    from pathlib import Path

    from stratalog import engine

    ops = spark.range(400).select(F.col("id").alias("seq"), short_key(F.col("id").cast("string")).alias("key"), F.lit("S").alias("op"), F.lit("v").cast("binary").alias("value"))
    seen = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for name, rows in (("one", 1 << 40), ("many", 25)):
        monkeypatch.setattr(engine, "RANGE_ROWS", rows, raising=False)
        monkeypatch.setattr(engine, "FILE_ROWS", rows, raising=False)
        store = engine.Store.create(spark, str(tmp_path / name), bits=1)
        store.commit_block(ops.where("seq < 300"), 0)
        meta = store.commit_block(ops.where("seq >= 280"), 1)
        seen.append((meta.roots, meta.next_sn, meta.active, meta.buckets, sorted(map(repr, store.state().collect()))))
        files = [len(list(b.glob("*.parquet"))) for b in Path(tmp_path / name / "state" / "block=1").glob("bucket=*")]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] == seen[1] and min(files) > 1
