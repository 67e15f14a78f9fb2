import itertools

import numpy as np
import pytest
from stratalog.llm import langid as L

from .helpers import documents, rng

SYLLABLES = {"aa": ["ka", "ro", "mi", "ta"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["пре", "ста", "нов", "ком"]}


def sentence(r, lang, n=40):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = rng(2)
    rows = [(i, sentence(r, lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    return L.train(documents(spark, rows), where=~L.held_out(__import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id")))


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    for _ in range(100):
        scores = [r.normal(size=(int(r.integers(0, 6)), 3)).astype(np.float32) * 3 for _ in range(4)]
        for s, got in zip(scores, L.viterbi(scores, 2.0)):
            worth = lambda p: sum(float(s[i, x]) for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
            if len(s):
                assert abs(worth(got) - max(map(worth, itertools.product(range(3), repeat=len(s))))) < 1e-4


def test_predictions_spans_and_edge_cases(spark, model):
    r = rng(5)
    mixed = sentence(r, "aa", 30) + ". " + sentence(r, "cc", 12) + ". " + sentence(r, "aa", 30)
    rows = [(1, sentence(r, "bb")), (2, mixed), (3, None), (4, ""), (5, "123 -- !!"), (6, sentence(r, "cc", 30_000)), (7, "漢字"), (1, sentence(r, "bb")), (8, "ka")]
    found = {x["doc_id"]: x for x in L.identify(documents(spark, rows, extra=True), model).collect()}
    assert found[1]["lang_pred"] == "bb" and found[1]["lang_score"] == 1
    assert found[2]["lang_pred"] == "aa" and [s["lang"] for s in found[2]["lang_spans"]] == ["aa", "cc", "aa"]
    second = found[2]["lang_spans"][1]
    assert mixed[second["start"]] in "псн к".replace(" ", "к") and 0 < found[2]["lang_score"] < 1
    assert found[6]["lang_pred"] == "cc"
    for k in (3, 4, 5):
        assert (found[k]["lang_pred"], found[k]["lang_score"]) == ("und", 0.0)
    assert found[7]["lang_pred"] in model.languages
    assert L.identify(documents(spark, []), model).count() == 0


def test_held_out_accuracy(spark, model):
    r = rng(9)
    rows = [(i, sentence(r, lang, 6), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    got = {x["doc_id"]: x["lang_pred"] for x in L.identify(documents(spark, rows), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.98


def test_filter_keeps_columns_and_no_labels(spark, model):
    r = rng(6)
    df = documents(spark, [(1, sentence(r, "aa")), (2, None), (3, "...")], extra=True)
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and [x["doc_id"] for x in kept.collect()] == [1]
    blank = L.train(documents(spark, [(1, "text", None), (2, None, "aa")]))
    assert [x["lang_pred"] for x in L.identify(df, blank).collect()] == ["und"] * 3


def brute_prediction(model, text):
    """Language and score of a text by the definition: plain n-grams of each word, then every best path step by step."""
    names = L.SCRIPT_NAMES
    script_of = lambda c: next(n for s, n in reversed(L.SCRIPTS) if s <= ord(c))
    runs, word = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c
        elif word:
            runs.append(word)
            word = ""
    scores = []
    for w in runs:
        low = [0, *(ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in w), 0]
        total = np.zeros(len(model.languages))
        for n in L.ORDERS:
            for k in range(len(low) - n + 1):
                h = 0
                for x in low[k : k + n]:
                    h = (h * 0x100000001B3 + x) % 2**64
                total += model.weights[h * 0x9E3779B97F4A7C15 % 2**64 >> 48]
        can = np.any([model.allowed[names.index(script_of(c))] for c in w], axis=0)
        total = np.maximum(total - total.max(), -30)
        scores.append(np.where(can, total, -60.0) if can.any() else total * 0)
    if not runs:
        return "und", 0.0, 0.0
    best, back = scores[0], []
    for s in scores[1:]:
        stay = best >= best.max() - model.switch_penalty
        back.append([j if stay[j] else int(best.argmax()) for j in range(len(best))])
        best = np.maximum(best, best.max() - model.switch_penalty) + s
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    held = np.zeros(len(model.languages))
    for w, at in zip(runs, reversed(path), strict=True):
        held[at] += len(w)
    second = np.sort(held)[-2]
    return model.languages[int(held.argmax())], held.max() / held.sum(), second / held.sum()


def test_predictions_against_brute_force(spark, model):
    r = rng(21)
    rows = []
    for i in range(120):
        text = " ".join(sentence(r, r.choice(["aa", "bb", "cc"]), r.randint(1, 12)) for _ in range(r.randint(0, 5)))
        rows.append((i, "".join(c.upper() if r.random() < 0.1 else r.choice("- 1é漢") if r.random() < 0.05 else c for c in text)))
    found = {x["doc_id"]: x for x in L.identify(documents(spark, rows), model).collect()}
    for i, text in rows:
        lang, score, second = brute_prediction(model, text)
        assert abs(found[i]["lang_score"] - score) < 1e-6 and (found[i]["lang_pred"] == lang or score == second), text


def test_copies_of_one_text_still_teach_their_language(spark):
    r = rng(22)
    rows = [(7, sentence(r, "aa"), "aa")] * 40 + [(i, sentence(r, "bb"), "bb") for i in range(60)]
    model = L.train(documents(spark, rows), sample_per_lang=5)
    assert model.languages == ("aa", "bb")
    got = {x["doc_id"]: x["lang_pred"] for x in L.identify(documents(spark, [(1, rows[0][1]), (2, rows[50][1])]), model).collect()}
    assert got == {1: "aa", 2: "bb"}
