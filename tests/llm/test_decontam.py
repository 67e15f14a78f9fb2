from stratalog.llm import decontam as D

from .helpers import documents, rng, words


def brute(docs, items, t=0.8, k=5):
    out = set()
    for d, text in docs:
        w = (text or "").encode().lower().split()
        for i, item in items:
            v = (item or "").encode().lower().split()
            if not v:
                continue
            n = min(k, len(v))
            a = D.shingle_set(v, n)
            hit = len(a & D.shingle_set(w, n))
            if hit and hit / len(a) >= t - 1e-12:
                out.add((d, i, hit, len(a)))
    return out


def test_against_brute_force(spark, monkeypatch):
    r = rng(3)
    items = [(i, words(r, r.randint(1, 60))) for i in range(30)] + [(30, None), (31, ""), (32, "One TWO"), (33, "a b a b a b a b a b")]
    docs = []
    for d in range(60):
        body = words(r, r.randint(0, 400)).split()
        for _ in range(r.randint(0, 2)):
            item = items[r.randrange(30)][1].split()
            cut = item[: max(1, int(len(item) * r.choice([0.5, 0.8, 0.9, 1.0])))]
            for k in range(len(cut)):
                if r.random() < 0.01:
                    cut[k] = "zz"
            at = r.randint(0, len(body))
            body[at:at] = [w.upper() if r.random() < 0.2 else w for w in cut]
        docs.append((d, ("\n" if d % 3 else "  ").join(body)))
    docs += [(100, None), (101, ""), (102, "x one two y"), (102, "x one two y"), (103, "a b a b a b a b a b a b")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for bloom_bits in (D.BLOOM_BITS, 1 << 10):  # a filter that is full still loses nothing
        monkeypatch.setattr(D, "BLOOM_BITS", bloom_bits)
        found = D.contaminated_pairs(documents(spark, docs, extra=True), table).collect()
        assert sum(x["doc_id"] == 102 for x in found) == 2
        assert {(x["doc_id"], x["item_id"], x["shingles"], x["item_shingles"]) for x in found} == brute(docs, items)
    clean = D.drop_contaminated(documents(spark, docs, extra=True), table)
    assert clean.columns == documents(spark, docs, extra=True).columns
    hit = {x[0] for x in brute(docs, items)}
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted(d for d, _ in docs if d not in hit)


def test_short_item_in_a_very_long_text_and_empty_sides(spark):
    r = rng(4)
    item = words(r, 12)
    text = words(r, 60_000) + " " + item + " " + words(r, 60_000)
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = D.contaminated_pairs(documents(spark, [(1, text), (2, text[:1000])]), items).collect()
    assert [(x["doc_id"], x["item_id"], x["containment"]) for x in found] == [(1, 7, 1.0)]
    assert D.contaminated_pairs(documents(spark, []), items).count() == 0
    assert D.contaminated_pairs(documents(spark, [(1, text)]), items.limit(0)).count() == 0


def test_repeated_ids_are_judged_by_text(spark):
    r = rng(6)
    item = words(r, 20)
    docs = documents(spark, [(1, item), (1, words(r, 30)), (None, f"x {item}"), (None, "clean"), (2, None)])
    items = spark.createDataFrame([(7, item), (7, "other words here"), (None, item)], "item_id long, text string")
    assert sorted((x["doc_id"] or 0, x["item_id"] or 0) for x in D.contaminated_pairs(docs, items).collect()) == [(0, 0), (0, 7), (1, 0), (1, 7)]
    assert sorted((x["doc_id"] or 0, (x["text"] or "")[:5] == item[:5]) for x in D.drop_contaminated(docs, items).collect()) == [(0, False), (1, False), (2, False)]
