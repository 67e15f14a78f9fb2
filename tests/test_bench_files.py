"""Accounts, 256-bit amounts, transactions and the files of the benches against plain Python integers and bytes."""

import json
import random
from hashlib import sha256

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalog.functions import accounts as A
from stratalog.operators import merkle, transfers, twigfile
from stratalog.sources import bench_files


def coin(k):
    return sha256(f"coin{k}".encode()).digest()[:8]


def coin_list(sn):
    h = sha256(f"listofcoins{sn}".encode()).digest()
    return [h[i + 1] % 100 for i in range(1 + h[0] % 8)]


def test_256_bit_sums_and_differences(spark):
    r = random.Random(1)
    pairs = [(r.getrandbits(256), r.getrandbits(r.choice([8, 64, 160, 256]))) for _ in range(200)]
    pairs += [(0, 0), (2**256 - 1, 1), (2**128, 1), (5, 5), (4, 5), (2**255, 2**255), (2**256 - 1, 0)]
    df = spark.createDataFrame([(f"{a:064x}", f"{b:064x}") for a, b in pairs], "a string, b string")
    rows = df.select(A.u256_add(F.col("a"), F.col("b")).alias("s"), A.u256_sub(F.col("a"), F.col("b")).alias("d")).collect()
    for (a, b), row in zip(pairs, rows, strict=True):
        assert row["s"] == (f"{a + b:064x}" if a + b < 2**256 else None)
        assert row["d"] == (f"{a - b:064x}" if a >= b else None)


def account(address, sequence, native, coins):
    return address + sequence.to_bytes(8, "little") + native.to_bytes(32, "big") + b"".join(i + x.to_bytes(32, "big") for i, x in sorted(coins))


def test_accounts_of_numbers(spark):
    rows = transfers.accounts_of(spark.range(40).withColumnRenamed("id", "sn"), amounts=False).collect()
    for row in rows:
        address = sha256(f"address{row['sn']}".encode()).digest()[:20]
        assert row["account"] == account(address, row["sn"] << 32, 0, [(coin(k), 0) for k in coin_list(row["sn"])]).hex()
    full = transfers.accounts_of(spark.range(40).withColumnRenamed("id", "sn"))
    parsed = full.select(A.parse_account(F.col("account")).alias("a")).collect()
    assert all(int(x["a"]["native"], 16) >> 128 << 128 == int(x["a"]["native"], 16) for x in parsed)
    zero = transfers.accounts_of(spark.range(1, 41).withColumnRenamed("id", "sn"), amounts=False)
    assert {(r["sn"], r["problem"]) for r in transfers.compare_accounts(full, zero).collect()} == {(0, "missing"), (40, "missing")}
    swapped = zero.withColumn("account", F.when(F.col("sn") == 7, F.regexp_replace("account", "0{64}$", "f" * 64)).when(F.col("sn") == 8, F.concat(F.lit("0" * 40), F.substring("account", 41, 9999))).otherwise(F.col("account")))
    assert {(r["sn"], r["problem"]) for r in transfers.compare_accounts(zero, swapped).collect()} == {(8, "address")}
    short = spark.createDataFrame([("00" * 59,), ("00" * 61,), ("00" * (60 + 9 * 40),)], "t string")
    assert short.where(A.parse_account(F.col("t")).isNotNull()).isEmpty()


def test_transactions_on_256_bit_accounts(spark):
    r = random.Random(2)
    ids = [coin(k) for k in range(4)]
    accounts = {}
    for k in range(30):
        held = r.sample(ids, r.randint(1, 3))
        accounts[bytes([k]) * 8] = [bytes([k]) * 20, k << 32, r.choice([3, 10, 1 << 150]), [(i, r.choice([0, 50, 7 << 128, 2**256 - 1])) for i in sorted(held)]]
    nums = sorted(accounts)
    tx = [(0, k, nums[2 * k % 30] if k % 9 else b"x" * 8, nums[(2 * k + 1) % 30] if k % 7 else b"y" * 8, r.choice([0, 49, 10**18, -20]), r.choice(ids)) for k in range(60)]
    want = {}
    for _, k, a, b, amount, i in tx:
        x, y, n = accounts.get(a), accounts.get(b), abs(amount)
        at = lambda acc: next((j for j, c in enumerate(acc[3]) if c[0] == i), -1)
        if x is None or y is None:
            want[k] = ("no from-account" if x is None else "no to-account", None, None)
        elif at(x) < 0 or at(y) < 0:
            want[k] = (f"coin not in {'from' if at(x) < 0 else 'to'}-account", None, None)
        elif x[3][at(x)][1] < n or y[3][at(y)][1] + n >= 2**256 or x[2] < 10:
            want[k] = ("not enough coins" if x[3][at(x)][1] < n else "overflow" if y[3][at(y)][1] + n >= 2**256 else "not enough for gas", None, None)
        else:
            moved = lambda acc, d: [(c, v + d if c == i else v) for c, v in acc[3]]
            want[k] = ("done", account(x[0], x[1] + 1, x[2] - 10, moved(x, -n)).hex(), account(y[0], y[1], y[2], moved(y, n)).hex())
    table = spark.createDataFrame([(n.hex(), account(*acc).hex()) for n, acc in accounts.items()], "num string, account string")
    feed = spark.createDataFrame([(e, k, a.hex(), b.hex(), n, i.hex()) for e, k, a, b, n, i in tx], "epoch long, idx long, from_num string, to_num string, amount long, coin_id string")
    got = {x["idx"]: (x["status"], x["from_account"], x["to_account"]) for x in transfers.execute_transactions(table, feed).collect()}
    assert got == want and len({s for s, _, _ in want.values()}) >= 6


def test_files(spark, tmp_path):
    r = random.Random(3)
    epochs = [[r.randbytes(32) for _ in range(bench_files.TX_IN_EPOCH)] for _ in range(2)]
    (tmp_path / "tx.dat").write_bytes(b"".join(bench_files.epoch_bytes(e, bytes([k]) * 8) for k, e in enumerate(epochs)))
    rows = bench_files.read_epochs(spark, str(tmp_path / "tx.dat"))
    assert rows.count() == 2 * bench_files.TX_IN_EPOCH
    packed = rows.select("epoch", "idx", "checksum", A.tx_hex(F.col("from_num"), F.col("to_num"), F.col("amount"), F.col("coin_id")).alias("tx")).where("idx in (0, 4095)").collect()
    assert {(x["epoch"], x["idx"], x["checksum"], x["tx"]) for x in packed} == {(k, i, f"{k:02x}" * 8, epochs[k][i].hex()) for k in (0, 1) for i in (0, 4095)}

    (tmp_path / "list.dat").write_bytes(b"".join(x.to_bytes(4, "little") for x in (7, 2**32 - 1, 0)))
    assert [(x["at"], x["sn"]) for x in bench_files.read_index_list(spark, str(tmp_path / "list.dat")).orderBy("at").collect()] == [(0, 7), (1, 2**32 - 1), (2, 0)]
    pairs = spark.createDataFrame([(bytearray(b"\x00k"), bytearray(b"\xffv")), (bytearray(b"a b"), bytearray(b""))], "key binary, value binary")
    bench_files.write_samples(pairs, str(tmp_path / "samples"))
    assert bench_files.read_samples(spark, str(tmp_path / "samples")).exceptAll(pairs).isEmpty()
    (tmp_path / "bad.txt").write_text("SAMPLE onlyone\n")
    with pytest.raises(PySparkException):
        bench_files.read_samples(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "map.json").write_text(json.dumps({"a": 1, "b": 2**40}))
    assert {(x["address"], x["num"]) for x in bench_files.read_address_map(spark, str(tmp_path / "map.json")).collect()} == {("a", 1), ("b", 2**40)}
    order = bench_files.shuffled_accounts(spark, 500)
    assert sorted(x["sn"] for x in order.collect()) == list(range(500)) and sorted(x["at"] for x in order.collect()) == list(range(500))
    assert order.exceptAll(bench_files.shuffled_accounts(spark, 500)).isEmpty() and order.where("at = sn").count() < 50


def test_edges_and_records(spark):
    rows = [(0, t, sha256(bytes([t])).hexdigest()) for t in range(16)]
    nodes = merkle.upper_nodes(spark.createDataFrame(rows, "shard int, twig long, twig_root string"))
    for end, want in ((3, [(12, 3), (13, 0), (14, 0), (15, 0), (16, 0)]), (4, [(12, 4), (13, 2), (14, 0), (15, 0), (16, 0)]), (11, [(12, 11), (13, 4), (14, 2), (15, 0), (16, 0)])):
        edges = merkle.edge_nodes(nodes, spark.createDataFrame([(0, end)], "shard int, end long"))
        assert sorted((x["level"], x["nth"]) for x in edges.collect()) == want
        kept = merkle.edge_nodes(nodes, spark.createDataFrame([(0, end)], "shard int, end long"), sibling=True)
        left = spark.createDataFrame([x for x in rows if x[1] >= end], "shard int, twig long, twig_root string")
        assert merkle.shard_roots(merkle.upper_nodes(left, kept)).first()["root"] == merkle.shard_roots(nodes).first()["root"]
        text = edges.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "nth", "hash"))), lambda e: merkle.edge_hex(e["level"], e["nth"], e["hash"])), "").alias("t"))
        back = text.select(F.explode(merkle.parse_edges(F.col("t"))).alias("e")).select("e.*")
        assert back.exceptAll(edges.select("level", "nth", "hash")).isEmpty() and back.count() == 5

    tree = {n: sha256(n.to_bytes(2, "big")).digest() for n in range(2048, 4096)}
    for n in range(2047, 0, -1):
        tree[n] = sha256(bytes([11 - n.bit_length()]) + tree[2 * n] + tree[2 * n + 1]).digest()
    record = spark.createDataFrame([([tree[n].hex() for n in range(1, 256)], [tree[n].hex() for n in range(2048, 4096)])], "top array<string>, leaves array<string>")
    asked = [1, 2, 255, 256, 300, 511, 512, 1023, 1024, 2047, 2048, 4095, 0, 4096]
    got = record.select(F.explode(F.array(*(F.lit(n) for n in asked))).alias("n"), "top", "leaves").select("n", twigfile.record_node(F.col("top"), F.col("leaves"), F.col("n")).alias("h"))
    assert {x["n"]: x["h"] for x in got.collect()} == {n: tree[n].hex() if n in tree else None for n in asked}
