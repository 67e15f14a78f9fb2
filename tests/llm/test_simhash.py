import numpy as np
import xxhash
from stratalog.llm import gray
from stratalog.llm import simhash as S

from .helpers import documents, rng, words


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_classes(ids, fps, limit):
    fp = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= limit
    label = np.array(ids)
    while True:
        new = np.where(near, label[None], 10**12).min(1)
        if (new == label).all():
            return label
        label = new


def near_copies(r, n):
    rows, base = [], [words(r, r.randint(30, 120)).split() for _ in range(6)]
    for i in range(n):
        w = list(base[i % 6]) if i % 3 else words(r, r.randint(0, 60)).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            if w:
                w[r.randrange(len(w))] = "edit"
        rows.append((i, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
    return rows + [(900, None), (901, ""), (902, "  \t "), (3, rows[3][1]), (903, "one"), (904, "ONE")]


def test_classes_against_brute_force(spark):
    rows = near_copies(rng(1), 150)
    got = S.near_duplicate_classes(documents(spark, rows, extra=True)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, brute_classes([i for i, _ in rows], fps, 3).tolist()))
    assert sorted((x["id"], x["fp"]["f0"] % (1 << 64), x["component_id"]) for x in got) == want


def test_very_long_text_and_empty_table(spark):
    text = words(rng(2), 150_000)
    [one] = S.near_duplicate_classes(documents(spark, [(5, text)])).collect()
    assert one["fp"]["f0"] % (1 << 64) == brute_fingerprint(text) and one["component_id"] == 5
    assert S.near_duplicate_classes(documents(spark, [])).count() == 0


def test_gray_index_finds_every_pair():
    r = np.random.default_rng(1)
    for lanes, limit, edits in ((1, 3, 3), (4, 40, 25)):
        base = r.integers(0, 2**63, (30, lanes), dtype=np.uint64)
        fp = np.repeat(base, [1] * 10 + [5] * 10 + [40] * 9 + [300], axis=0)
        for _ in range(edits):
            fp[np.arange(len(fp)), r.integers(0, lanes, len(fp))] ^= np.uint64(1) << r.integers(0, 64, len(fp)).astype(np.uint64)
        bucket = r.integers(0, 3, len(fp))
        order = gray.gray_order(fp, bucket)
        fp, bucket = fp[order], bucket[order]
        i, j = gray.near_pairs(fp, bucket, limit)
        got = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
        near = (np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= limit) & (bucket[:, None] == bucket[None])
        assert got == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))


def test_exact_tables_lose_no_pair():
    r = np.random.default_rng(3)
    for distinct in (10, 10**6, 10**9, 10**11):
        masks = S.exact_tables(distinct, 3)
        for _ in range(300):
            diff = sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 4)), replace=False))
            assert any(diff & m == 0 for m in masks)


def test_large_buckets_take_the_second_pass(spark):
    r = np.random.default_rng(4)
    fps = np.unique(np.concatenate([np.uint64(7) << np.uint64(48) | r.integers(0, 1 << 12, 300).astype(np.uint64), r.integers(0, 2**63, 100).astype(np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "f0 long")
    links = S.near_links(df, lanes=1, max_diff=3, tables=S.exact_tables(len(fps), 3), bucket=16).collect()
    at = {int(v): k for k, v in enumerate(fps)}
    pairs = [(at[x["a"]["f0"] % (1 << 64)], at[x["b"]["f0"] % (1 << 64)]) for x in links]
    assert all(int(np.bitwise_count(fps[a] ^ fps[b])) <= 64 for a, b in pairs)
    label = gray.forest(len(fps), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = brute_classes(list(range(len(fps))), fps, 3)
    assert (label == want).all()


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_wide_search_reaches_near_copies_and_spares_others(spark):
    r = rng(8)
    rows, pairs, i = [], [], 0
    for _ in range(60):
        w = words(r, r.randint(60, 300)).split()
        v = list(w)
        for _ in range(max(1, len(w) // 70)):
            v[r.randrange(len(v))] = "edit"
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
        pairs.append((i, i + 1))
        i += 2
    rows += [(1000 + k, words(r, r.randint(20, 200))) for k in range(60)]
    text = dict(rows)
    kept = {x["doc_id"] for x in S.drop_near_duplicates(documents(spark, rows, extra=True)).collect()}
    due = [(a, b) for a, b in pairs if jaccard(text[a], text[b]) >= 0.8]
    assert len(due) > 20 and sum(b not in kept for _, b in due) >= 0.95 * len(due)
    assert all(a in kept for a, _ in pairs) and all(1000 + k in kept for k in range(60))


def test_survivors_of_repeated_rows(spark):
    df = documents(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, "x y")], extra=True)
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 3, 5]


def test_repeated_ids_keep_every_distinct_text(spark):
    r = rng(5)
    a, b, c = (words(r, 40) for _ in range(3))
    kept = S.drop_near_duplicates(documents(spark, [(2, c), (5, a), (5, c), (7, a), (7, b), (7, b)], extra=True))
    assert sorted((x["doc_id"], x["text"]) for x in kept.collect()) == sorted([(2, c), (5, a), (7, b)])
    kept = S.drop_near_duplicates(documents(spark, [(None, a), (None, b), (1, b), (None, a), (3, None), (None, "")]))
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted([(None, a), (1, b), (3, None)], key=str)


def test_links_are_verified_and_none_is_lost(spark):
    r = rng(12)
    rows, i = [], 0
    for _ in range(150):
        w = words(r, r.randint(40, 300)).split()
        v = list(w)
        # edits of words far apart: similarity from about 0.6 to 0.95
        for at in r.sample(range(len(v)), max(1, round(len(v) * r.uniform(0.005, 0.06)))):
            v[at] = "edit"
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
        i += 2
    text = dict(rows)
    kept = {x["doc_id"] for x in S.drop_near_duplicates(documents(spark, rows)).collect()}
    near = {b for b in range(1, i, 2) if jaccard(text[b - 1], text[b]) >= 0.8}
    assert 40 < len(near) < 110 and kept == set(text) - near


def test_large_groups_are_compared_by_chunks(spark):
    r = rng(13)
    w = words(r, 200).split()
    rows = [(k, " ".join(w[:k] + [f"edit{k}"] + w[k + 1 :])) for k in range(40)]
    got = S.verified_classes(documents(spark, rows), words=5, lanes=4, max_diff=48, tables=48, similarity=0.8, id_col="doc_id", text_col="text", bucket=8).collect()
    assert sorted((x["id"], x["component_id"]) for x in got) == [(k, 0) for k in range(40)]


def test_parts_of_a_large_group_are_told_apart(spark):
    """A group of candidates, chunked, that holds several classes and single texts: the rest is compared with all chunks."""
    nodes = [(bytes([k]), k // 10 if k < 45 else k) for k in range(60)]
    members = spark.createDataFrame([(1, bytearray(n), c, 1) for n, c in nodes], "grp int, node binary, class int, weight int")

    def search(dealt):
        def run(pdf):
            rows = [(x["node"].iloc[0], n) for _, x in pdf.groupby("class") for n in x["node"].iloc[1:]]
            return __import__("pandas").DataFrame(rows, columns=["a", "b"])

        return dealt.groupBy("grp", "c0", "c1").applyInPandas(run, "a binary, b binary")

    _, classes = S.chunked_links(members, ["grp"], search, None, most=6, heaviest=1000)
    got = {bytes(x["node"]): bytes(x["component"]) for x in classes.collect()}
    want = {n: min(m for m, d in nodes if d == c) for n, c in nodes}
    assert {n: got.get(n, n) for n, _ in nodes} == want


def test_components_leave_few_shuffles_behind(spark):
    """Files of rounds that are over are released while the search goes on, not whenever the driver collects garbage."""
    import time

    from stratalog.llm.common import connected_components, release

    release(spark)
    time.sleep(2)
    held = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before = held()
    edges = spark.range(3000).selectExpr("id AS a", "id + 1 AS b")
    found = connected_components(edges, "a", "b")
    for _ in range(20):
        if held() - before <= 6:
            break
        time.sleep(0.1)
    assert held() - before <= 6
    assert found.select("component").distinct().count() == 1 and found.count() == 3001
