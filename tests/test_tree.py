"""Leaf bytes, null constants, roots and proofs against plain hashlib."""

import random
from hashlib import sha256

from pyspark.sql import functions as F

from stratalog.functions import codec, keys, nulltree
from stratalog.operators import merkle, proofs, versions

MAGIC = bytes.fromhex(codec.MAGIC)


def pair(level, a, b):
    return sha256(bytes([level]) + a + b).digest()


def entry(key, value, nxt, height, last, sn, off):
    strings = b"".join(len(x).to_bytes(4, "little") + x for x in (key, value, nxt))
    found, at = [], 0
    while at + 8 < len(strings) and (p := strings.find(MAGIC, at)) >= 0:
        found.append(p)
        at = p + 8
    for p in found:
        strings = strings[:p] + bytes(8) + strings[p + 8 :]
    le = lambda x: (x & (1 << 64) - 1).to_bytes(8, "little")
    body = b"".join((p + 4 * len(found)).to_bytes(4, "little") for p in found) + b"\xff" * 4 + strings + le(height) + le(last) + le(sn)
    return bytes([len(off)]) + len(body).to_bytes(3, "little") + body + b"".join(map(le, off))


def test_null_constants():
    assert nulltree.NULL_LEAF.hex() == "f0cf280bd5cc1273c8c3e7a977c9fc8066140b6bb938341db90c5da032a5f6c2"
    assert nulltree.NULL_TWIG.hex() == "899643f66d7f880c56f1921f5a6ecc2a2faced5d06419d5286b64fdb6221806c"
    assert nulltree.NULL_UPPER[13].hex() == "ed8790c6d129b164c55dd452440d1ba0653ff5944a59a3f8e23ba10ede1ca6a0"
    assert nulltree.NULL_UPPER[14].hex() == "67bc4f829af562daa931592fef65de3f33b95f5fa95a05bc80d0e097043bfc5f"


def test_entry_bytes_and_back(spark):
    r = random.Random(5)
    rows = []
    for k in range(40):
        junk = lambda: bytearray(b"".join(MAGIC if r.random() < 0.3 else r.randbytes(r.randint(0, 5)) for _ in range(r.randint(0, 4))))
        rows.append((junk(), junk(), junk(), r.randint(-2, 9), r.randint(-2, 9), k, [r.randint(0, 99) for _ in range(r.choice([0, 1, 66]))]))
    df = spark.createDataFrame(rows, "key binary, value binary, next_key binary, height long, last_height long, sn long, deactivated array<long>")
    text = codec.entry_hex(*(F.col(c) for c in df.columns))
    got = df.withColumn("e", text).withColumn("back", codec.decode_entry(F.col("e"))).orderBy("sn").collect()
    for row, (k, v, n, h, lh, sn, off) in zip(got, rows, strict=True):
        assert row["e"] == entry(bytes(k), bytes(v), bytes(n), h, lh, sn, off).hex()
        b = row["back"]
        assert (b["height"], b["last_height"], b["sn"], b["deactivated"]) == (h, lh, sn, off)
        if MAGIC not in bytes(n)[-8:]:
            assert (bytes(b["key"]), bytes(b["value"]), bytes(b["next_key"])) == (bytes(k), bytes(v), bytes(n))


def test_key_functions(spark):
    texts = [f"k{n}" for n in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", keys.short_key(F.col("t")).alias("a"), keys.short_key(F.col("t"), 2).alias("b"), keys.shard_id(keys.short_key(F.col("t"))).alias("s")).collect()
    for row in rows:
        d = sha256(row["t"].encode()).digest()
        d3 = sha256(sha256(d).digest()).digest()
        assert bytes(row["a"]) == bytes([d[0] % 128 + 64]) + d[1:8]
        assert bytes(row["b"]) == bytes([d3[0] % 128 + 64]) + d3[1:8]
        assert row["s"] == d[7] // 32


def brute_root(entries, active):
    """Root of one shard from its entries' bytes and bits."""
    youngest = len(entries) >> 11
    nodes = {}
    for twig in range(youngest + 1):
        level = [sha256(entries[n]).digest() if n < len(entries) else nulltree.NULL_LEAF for n in range(twig * 2048, twig * 2048 + 2048)]
        for k in range(11):
            level = [pair(k, level[i], level[i + 1]) for i in range(0, len(level), 2)]
        bits = bytearray(256)
        for n in range(2048):
            if twig * 2048 + n in active:
                bits[n >> 3] |= 1 << (n & 7)
        chunk = [bytes(bits[i : i + 32]) for i in range(0, 256, 32)]
        for k in (8, 9, 10):
            chunk = [pair(k, chunk[i], chunk[i + 1]) for i in range(0, len(chunk), 2)]
        nodes[twig] = pair(11, level[0], chunk[0])
    top = youngest.bit_length() + 12 if youngest else 13
    for k in range(13, top + 1):
        null = nulltree.NULL_TWIG if k == 13 else nulltree.NULL_UPPER[k]
        nodes = {n: pair(k - 1, nodes[2 * n], nodes.get(2 * n + 1, null)) for n in {m >> 1 for m in nodes}}
    return nodes[0]


def small_log(spark, n, off):
    lists = spark.createDataFrame([(n - 1, off)], "sn long, off array<long>")
    text = lambda s: F.lit(s).cast("binary")
    rows = spark.range(n).withColumnRenamed("id", "sn").join(F.broadcast(lists), "sn", "left")
    return rows.select(
        F.lit(0).cast("long").alias("block"), F.lit(0).alias("shard"), "sn", text("key").alias("key"), text("value").alias("value"), text("nextkey").alias("next_key"),
        F.lit(100).cast("long").alias("height"), F.lit(99).cast("long").alias("last_height"), F.lit(False).alias("is_dummy"),
        F.coalesce("off", F.array().cast("array<long>")).alias("deactivated"),
    )


def test_roots_and_proofs(spark):
    n, off = 8192 + 5, [101, 999, 1002, 5000, 8100]
    log = small_log(spark, n, off)
    trees = merkle.twigs(merkle.leaf_hashes(log)).checkpoint()
    nodes = merkle.upper_nodes(trees.select("shard", "twig", "twig_root")).checkpoint()
    root = merkle.shard_roots(nodes).first()["root"]
    entries = [entry(b"key", b"value", b"nextkey", 100, 99, s, off if s == n - 1 else []) for s in range(n)]
    assert root == brute_root(entries, set(range(n)) - set(off)).hex()

    asked = log.where((F.col("sn") % 37 == 0) | F.col("sn").isin(*off, n - 1)).select("shard", "sn")
    paths = proofs.proof_paths(asked, trees, nodes).checkpoint()
    checked = {r["sn"]: (r["valid"], r["is_active"]) for r in proofs.verify(paths).collect()}
    assert checked == {r["sn"]: (True, r["sn"] not in off) for r in asked.collect()}
    # what was serialised and parsed proves the same, and a changed hash proves nothing
    again = paths.select("shard", proofs.parse_proof(proofs.proof_hex(paths)).alias("p")).select("shard", "p.*")
    assert again.exceptAll(paths.select(*again.columns)).isEmpty()
    forged = paths.withColumn("leaf", F.sha2("leaf", 256))
    assert proofs.verify(forged).where("valid").isEmpty()


def test_levels_follow_the_youngest_twig(spark):
    fixed = {1: 13, 2: 14, 3: 14, 4: 15, 7: 15, 8: 16, 15: 16, 16: 17, 32: 18, 64: 19, 128: 20, 256: 21, 511: 21}
    rows = [(k, t, "00" * 32) for k, y in enumerate(fixed) for t in range(y + 1)]
    nodes = merkle.upper_nodes(spark.createDataFrame(rows, "shard int, twig long, twig_root string"))
    assert {r["shard"]: r["top"] for r in nodes.select("shard", "top").distinct().collect()} == dict(enumerate(fixed.values()))


def test_absence_witness_spans_the_key(spark):
    names = [bytes([64 + 9 * k]) + bytes(7) for k in range(8)]
    live = [(bytearray(a), bytearray(b), 0, k) for k, (a, b) in enumerate(zip([keys.START_GUARD, *names], [*names, keys.END_GUARD], strict=True))]
    df = spark.createDataFrame(live, "key binary, next_key binary, shard int, sn long")
    asked = [bytes([c]) + bytes(6) + b"x" for c in (1, 64, 100, 250)] + names[:1]
    got = proofs.absence_witness(df, spark.createDataFrame([(bytearray(k),) for k in asked], "key binary")).collect()
    assert {bytes(r["key"]) for r in got} == set(asked[:-1])
    assert all(bytes(r["before"]) < bytes(r["key"]) < bytes(r["after"]) for r in got)


def test_filler_rows_after_many_deletions(spark):
    """Seventy deletions in one shard: a filler takes 65 and itself, another the rest at the block's end."""
    name = lambda k: bytearray(b"k" + k.to_bytes(6, "big") + b"\x21")
    ops = [(0, k, name(k), "S", bytearray(b"v")) for k in range(70)] + [(1, k, name(k), "D", None) for k in range(70)]
    log = versions.version_log(spark.createDataFrame(ops, "height long, seq long, key binary, op string, value binary"), base_sn=0)
    fillers = log.where("is_dummy and block = 1").orderBy("sn").collect()
    assert [(r["shard"], len(r["deactivated"]), r["deactivated"][-1] == r["sn"]) for r in fillers if r["shard"] == 1] == [(1, 66, True), (1, 6, True)]


def test_ranges_of_a_log_follow_the_number_of_operations(spark, monkeypatch):
    """What one worker of the sweep holds is bounded, and the log does not depend on the ranges."""
    monkeypatch.setattr(versions, "RANGE_ROWS", 100, raising=False)
    ops = spark.range(3000).select(
        (F.col("id") % 2).alias("height"), F.col("id").alias("seq"), keys.short_key((F.col("id") % 2000).cast("string")).alias("key"), F.lit("S").alias("op"), F.lit("v").cast("binary").alias("value")
    )
    held = [r["n"] for r in versions.key_changes(ops).groupBy("range").agg(F.count("*").alias("n")).collect()]
    assert len(held) > 20 and max(held) < 600
    rows = lambda log: sorted(map(repr, log.collect()))
    assert rows(versions.version_log(ops)) == rows(versions.version_log(ops, ranges=1))
