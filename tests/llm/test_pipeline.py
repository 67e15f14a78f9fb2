import hashlib

import corpus_pipeline as P
from pyspark.sql import functions as F
from stratalog.llm import decontam, langid, queries

from .helpers import documents, rng, words
from .test_decontam import brute as contained
from .test_langid import brute_prediction, sentence
from .test_mixing_sharding import brute_places, brute_targets
from .test_simhash import jaccard


def test_stages_take_effect(spark, tmp_path):
    r = rng(1)
    item = words(r, 30)
    texts = [words(r, r.randint(40, 120)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s1"), (101, " ".join(["edit", *texts[1].split()[1:]]), "en", "s2"), (102, None, "en", "s0"), (103, "123 !!", "en", "s0")]
    rows += [(104, texts[2] + " " + item + " " + words(r, 40), "en", "s0")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    found = {x["doc_id"] for x in out}
    assert not found & {100, 101, 102, 103, 104}
    assert {x["shard"] for x in out} <= set(range(P.SHARDS)) and len(P.STAGES) == 5
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_empty_documents(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert decontam.THRESHOLD == 0.8 and decontam.WIDTH == 5


def brute_mix(rows):
    """Rows as often as the mix takes them: whole passes, and the rest by hash up to the budget, to the nearer side of the last row."""
    size = lambda t: len((t or "").split())
    h = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16)
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sizes = {s: sum(size(r[1]) for r in own) for s, own in by.items()}
    target, out = brute_targets(sizes), []
    for s, own in by.items():
        passes = int(target[s] // sizes[s]) if sizes[s] else 0
        budget, before = target[s] - passes * sizes[s], 0
        mass = {}
        for r in own:
            mass[h(r[0])] = mass.get(h(r[0]), 0) + size(r[1])
        extra = set()
        for x in sorted(mass):
            upto = before + mass[x]
            if budget > 0 and (upto <= budget or (before <= budget and upto - budget <= budget - before)):
                extra.add(x)
            before = upto
        out += [r for r in own for _ in range(passes + (h(r[0]) in extra))]
    return out


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    r = rng(31)
    items = [(k, words(r, r.randint(12, 40))) for k in range(4)] + [(9, None)]
    rows = []
    for i in range(0, 160, 2):
        lang = r.choice(["aa", "bb", "cc"])
        text = sentence(r, lang, r.randint(12, 150))
        near = text.split()
        for _ in range(r.choice([0, 1, 2, 4])):
            near[r.randrange(len(near))] = sentence(r, lang, 1)
        if r.random() < 0.15:
            near[5:5] = r.choice(items[:4])[1].split()
        rows += [(i, text, lang, r.choice(["a", "a", "a", "b", "c", None])), (i + 1, " ".join(near), r.choice([lang, None]), r.choice(["a", "b", "d"]))]
    rows += [(200, None, "aa", "a"), (201, "12 34", None, "b"), (202, rows[0][1], "aa", "d"), (203, rows[7][1].upper(), None, None), (6, rows[6][1], rows[6][2], rows[6][3])]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = langid.train(docs, where=~langid.held_out(F.col("doc_id")))
    predicted = [brute_prediction(model, x[1]) for x in rows]
    kept = [x for x, (lang, score, _) in zip(rows, predicted, strict=True) if lang != "und" and score >= 0.5]
    assert len(rows) - len(kept) >= 2
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if jaccard(kept[i][1], kept[j][1]) >= 0.8 and label[i] != label[j]:
                label = [label[j] if v == label[i] else v for v in label]
    best = {}
    for k, x in zip(label, kept, strict=True):
        best[k] = min(best.get(k, x), x, key=lambda y: (y[0], hashlib.md5(y[1].encode()).digest()))
    once = list(best.values())
    assert len(kept) - len(once) > 20
    hit = {d for d, *_ in contained([x[:2] for x in once], items)}
    clean = [x for x in once if x[0] not in hit]
    assert 0 < len(once) - len(clean) < len(once) / 2
    want = brute_places(brute_mix(clean), P.SHARDS)
    got = [(x["doc_id"], x["size"], x["text_crc32"], x["shard"], x["slot"]) for x in P.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == want
