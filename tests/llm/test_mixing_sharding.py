import pytest
from pyspark.sql import functions as F
from stratalog.llm import mixing as M
from stratalog.llm import sharding as H

from .helpers import documents, rng, words


def brute_targets(sizes, repeats=3):
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {k: i % 3 + 1 for i, k in enumerate(keys)}
    left, open_, target = float(sum(sizes.values())), set(keys), {}
    while True:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = [k for k in open_ if share[k] > repeats * sizes[k]]
        if not over:
            return target | share
        for k in over:
            target[k] = repeats * sizes[k]
            left -= target[k]
            open_.discard(k)
        if not open_:
            return target


def sample(r, n=400):
    rows = [(i, words(r, r.randint(0, 40)), "en", r.choice(["a", "a", "a", "a", "b", "é", "Z", None, "tiny"][: 9 if i % 40 == 0 else 8])) for i in range(n)]
    return rows + [(n, None, "en", "b"), (n + 1, "", "en", "zero"), (5, rows[5][1], "en", rows[5][3])]


def test_targets_and_taken(spark):
    rows = sample(rng(1))
    got = M.mix(documents(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    by = {}
    for _, t, _, s in rows:
        by[s] = by.get(s, 0) + size(t)
    want = brute_targets(by)
    source = {i: s for i, _, _, s in rows}
    taken, largest = {}, {}
    for x in got:
        s = source[x["id"]]
        assert x["source_size"] == by[s] and x["target"] == pytest.approx(want[s]) and 0 <= x["times"] <= 3
        taken[s] = taken.get(s, 0) + x["times"] * x["size"]
        largest[s] = max(largest.get(s, 0), x["size"])
    assert sum(want.values()) == pytest.approx(sum(by.values()))
    for s in by:
        assert abs(taken[s] - want[s]) <= largest[s] + 1
    again = M.mix(documents(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_takes_effect_and_edges(spark):
    rows = sample(rng(2))
    df = documents(spark, rows, extra=True)
    times = {(x["id"], x["times"]) for x in M.mix(df).collect()}
    out = M.apply_mix(df)
    assert out.columns == df.columns
    count = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(count.get(i, 0) == t * (2 if i == 5 else 1) for i, t in times)
    assert M.mix(documents(spark, [])).count() == 0 and M.apply_mix(documents(spark, [])).count() == 0
    blank = M.mix(documents(spark, [(1, None), (2, "")])).collect()
    assert [(x["size"], x["target"], x["times"]) for x in blank] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("bucket_rows", [10, 10_000])
def test_shards_match_the_mixture(spark, bucket_rows):
    rows = sample(rng(3), 500)
    got = H.interleave(documents(spark, rows, extra=True), shards=7, bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    shards = {}
    for x in got:
        shards.setdefault(x["shard"], []).append(x)
    assert set(shards) == set(range(7))
    counts = [len(v) for v in shards.values()]
    assert max(counts) - min(counts) <= 1
    for v in shards.values():
        assert sorted(x["slot"] for x in v) == list(range(len(v)))
    total = {}
    for x in got:
        total[x["source"]] = total.get(x["source"], 0) + 1
    for v in shards.values():
        for s, n in total.items():
            assert abs(sum(x["source"] == s for x in v) - n / 7) <= 2


def brute_places(rows, shards):
    import hashlib
    import zlib

    ranked, seen = [], {}
    key = lambda s: "1" if s is None else "0" + s
    h = lambda i: int(hashlib.md5(f"shard:{i}".encode()).hexdigest()[:15], 16)
    rows = [(key(s), h(i), i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t, _, s in rows]
    total = {}
    for r in rows:
        total[r[0]] = total.get(r[0], 0) + 1
    for r in sorted(rows):
        seen[r[0]] = seen.get(r[0], 0) + 1
        draw = (int(hashlib.md5(f"shard:source:{r[0]}".encode()).hexdigest()[:15], 16) >> 40) / (1 << 20)
        ranked.append(((seen[r[0]] - 1 + draw) / total[r[0]], *r))
    ranked.sort()
    n, out = len(ranked), []
    for at, r in enumerate(ranked):
        shard = at * shards // n
        out.append((r[3], r[5], r[4], shard, at - -(-shard * n // shards)))
    return sorted(out)


def test_places_against_brute_force(spark):
    rows = sample(rng(4), 300)
    for bucket_rows in (10, 10_000):
        got = H.interleave(documents(spark, rows), shards=24, bucket_rows=bucket_rows).collect()
        assert sorted((x["id"], x["size"], x["text_crc32"], x["shard"], x["slot"]) for x in got) == brute_places(rows, 24)
    assert H.interleave(documents(spark, []), shards=24).count() == 0


def test_sources_of_one_row_fall_over_all_shards(spark):
    rows = [(i, "a", "en", f"only{i}") for i in range(240)] + [(1000 + i, "b", "en", "large") for i in range(240)]
    got = H.interleave(documents(spark, rows), shards=12, bucket_rows=20).collect()
    small = [0] * 12
    for x in got:
        small[x["shard"]] += x["source"] != "large"
    assert sum(small) == 240 and min(small) >= 8 and max(small) <= 32
