"""Two blocks on a small key space: every live row's successor, heights and serial number are known."""

import pytest
from pyspark.sql import functions as F

from stratalog.engine import Store
from stratalog.functions.keys import END_GUARD, START_GUARD
from stratalog.operators import versions

OPS = "height long, seq long, key binary, op string, value binary"
#: Suffix, successor's suffix, value, height, last height, serial number after both blocks.
GOLDEN = [
    ("00", "20", "00", 1, 0, 16), ("20", "44", "20", 1, 0, 17), ("44", "55", "444", 1, 0, 18), ("55", "60", "555", 1, 0, 19),
    ("60", "66", "60", 1, 0, 20), ("66", "77", "666", 1, 0, 21), ("77", "80", "777", 1, 0, 22), ("80", "88", "80", 1, 0, 23),
    ("88", "90", "888", 1, 0, 24), ("90", "a0", "90", 0, 0, 9), ("a0", "aa", "a0", 1, 0, 25), ("aa", "bb", "aaa", 1, 0, 0),
    ("bb", "c0", "bbb", 1, 0, 1), ("c0", "e0", "c0", 1, 0, 26), ("e0", "f0", "e0", 0, 0, 14), ("f0", None, "f0", 0, 0, 15),
]


def key(suffix):
    return bytearray(b"004321" + suffix.encode())


def expected():
    rows = {bytes(key(s)): (bytes(key(n)) if n else END_GUARD, v.encode(), h, lh, sn) for s, n, v, h, lh, sn in GOLDEN}
    rows[START_GUARD] = (bytes(key("00")), b"", 0, -1, 1)
    rows[END_GUARD] = (END_GUARD, b"", -1, -1, 0)
    return rows


@pytest.fixture(scope="module")
def ops(spark):
    first = [(0, k, key(f"{d}0"), "S", bytearray(f"{d}0".encode())) for k, d in enumerate("0123456789abcdef")]
    gone = [(1, k, key(s), "D", None) for k, s in enumerate(("10", "30", "40", "50", "70", "b0", "d0"))]
    more = [(1, 10 + k, key(d * 2), "S", bytearray((d * 3).encode())) for k, d in enumerate("45678ab")]
    return spark.createDataFrame(first + gone + more, OPS)


def found(rows):
    return {bytes(r["key"]): (bytes(r["next_key"]), bytes(r["value"]), r["height"], r["last_height"], r["sn"]) for r in rows.collect()}


def test_batch_log(ops):
    log = versions.version_log(ops, base_sn=0)
    assert found(versions.with_active(log).where("active")) == expected()
    assert versions.consistency(log).first().asDict() == {"rows_checked": 18, "broken": 0}


def test_store_commits_block_by_block(spark, ops, tmp_path):
    store = Store.create(spark, str(tmp_path / "store"), init_dummies=False)
    for height in (0, 1):
        store.commit_block(ops.where(F.col("height") == height).drop("height"), height)
    assert found(store.state(guards=True)) == expected()
    assert store.active_count() == 18
    assert [bytes(r["key"]) for r in store.scan(reverse=True).collect()] == sorted(set(expected()) - {START_GUARD, END_GUARD}, reverse=True)
    asked = spark.createDataFrame([(key("10"),), (key("44"),)], "key binary")
    values = lambda height=None: {bytes(r["key"])[-2:]: r["value"] and bytes(r["value"]) for r in store.get(asked, height).collect()}
    assert values() == {b"10": None, b"44": b"444"}
    assert values(0) == {b"10": b"10", b"44": None}
    # a block that is committed already changes nothing, an older one is refused
    assert store.commit_block(ops.where("height = 1").drop("height"), 1).height == 1
    with pytest.raises(ValueError):
        store.commit_block(ops.where("height = 0").drop("height"), 0)
    assert store.prune_before(0).prune_height == 0
    assert values(0) == {b"10": None, b"44": None}
