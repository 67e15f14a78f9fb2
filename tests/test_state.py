"""As-of reads, scans, neighbours and overlays on small tables with known answers."""

from stratalog.operators import lifecycle, ordered, overlay, state

OPS = "height long, seq long, key string, op string, value string"


def feed(spark):
    rows = [("ABcd1234", "1"), ("ABcd1235", "2"), ("0bcd1234", "0"), ("ABed1234", "3"), ("BBed1234", "3"), ("FBed1234", "4")]
    ops = [(0, k, key, "S", v) for k, (key, v) in enumerate(rows)] + [(0, 9, "BBed1234", "D", None), (10, 10, "ABcd1234", "S", "111"), (10, 11, "1bcd1234", "S", "100")]
    return spark.createDataFrame(ops, OPS)


def test_as_of(spark):
    asked = {("ABcd1234", 0): "1", ("ABcd1234", 5): "1", ("ABcd1234", 10): "111", ("ABcd1234", 11): "111", ("1bcd1234", 10): "100", ("1bcd1234", 9): None,
             ("FFcd1234", 9): None, ("1bcd1234FFFFFF", 8): None, ("ABed1234", 9): "3", ("BBed1234", 9): None, ("ABcd1234", -1): None}
    probes = spark.createDataFrame(list(asked), "key string, at long")
    assert {(r["key"], r["at"]): r["value"] for r in state.asof_join(probes, feed(spark)).collect()} == asked


def test_scans_exclude_their_end(spark):
    now = state.current_state(feed(spark))
    take = lambda *a, **k: [(r["key"], r["value"]) for r in state.range_scan(now, *a, **k).collect()]
    assert take("0bcd1234", "ABcd1234") == [("0bcd1234", "0"), ("1bcd1234", "100")]
    assert take("ABcd1234", "0bcd1234") == []
    assert take("ABed1234", "FFcd1234", reverse=True) == [("FBed1234", "4"), ("ABed1234", "3")]
    assert take("ABed1234", "FBed1234", reverse=True) == [("ABed1234", "3")]


def test_neighbours_and_ranks_across_buckets(spark):
    keys = sorted({bytes([a, b]) for a in (0, 7, 7, 200, 255) for b in (1, 2, 90)})
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    for ranges in (None, 1, 5):
        after = {bytes(r["key"]): r["n"] and bytes(r["n"]) for r in ordered.with_next(df, "n", ranges=ranges).collect()}
        assert after == dict(zip(keys, [*keys[1:], None], strict=True))
        before = {bytes(r["key"]): r["n"] and bytes(r["n"]) for r in ordered.with_previous(df, "n", ranges=ranges).collect()}
        assert before == dict(zip(keys, [None, *keys[:-1]], strict=True))
        assert {bytes(r["key"]): r["n"] for r in ordered.with_rank(df, "n", ranges=ranges).collect()} == {k: i + 1 for i, k in enumerate(keys)}


def test_overlay_hides_and_replaces(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string")
    top = overlay.buffered(spark.createDataFrame([("a", "S", "9"), ("b", "D", None), ("c", "S", ""), ("d", "S", "4")], "key string, op string, value string"))
    assert {(r["key"], r["value"]) for r in overlay.overlay_get(base, top).collect()} == {("a", "9"), ("d", "4")}


def test_retention_keeps_the_newest_version_at_the_watermark(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 9), ("b", 2)], "key string, height long")
    assert {tuple(r) for r in lifecycle.retain_versions(rows, 5).collect()} == {("a", 3), ("a", 9), ("b", 2)}


def test_prune_ranges_need_more_than_the_least(spark):
    log = spark.createDataFrame([(0, 2048 * (t + 1) - 1, t) for t in range(8)], "shard int, sn long, block long")
    of = lambda name, v: spark.createDataFrame([(0, v)], f"shard int, {name} long")
    found = lambda h, oldest: [tuple(r) for r in lifecycle.prune_ranges(log, h, of("last_pruned_twig", -1), of("oldest_active_twig", oldest)).collect()]
    # twig t begins in block t - 1: the twigs 1 to 5 began below block 5
    assert found(5, 7) == [(0, 0, 5)]
    assert found(5, 4) == [(0, 0, 3)]
    assert found(5, 3) == [] and found(1, 7) == []


def test_empty_feed(spark):
    none = spark.createDataFrame([], OPS)
    assert state.current_state(none).count() == 0
    assert state.history(none).count() == 0
    assert state.active_count_by_height(none).count() == 0
