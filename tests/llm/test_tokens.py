import numpy as np
from stratalog.llm import tokens as T

from .helpers import documents

TEXTS = ["Hello world\nsecond line\n\n\n  third", "été — naïve\n日本語 text\n🙂🙂", "", None, "\n\n\n", "no feed " * 500, "x" * 5000 + "\n" + "y" * 10]


def encoder():
    with open(T.VOCABULARY, "rb") as f:
        return T.Encoder(f.read())


def test_spans_cover_the_text():
    e = encoder()
    for text in TEXTS:
        text = text or ""
        start, end = e.spans(text)
        assert len(start) == len(e.encoding.encode_ordinary(text))
        assert (start <= end).all() and (not len(end) or end[-1] == len(text))
        if text.isascii():
            assert (start[1:] == end[:-1]).all()
            assert "".join(text[a:b] for a, b in zip(start, end)) == text


def test_every_token_is_counted_once(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    e = encoder()
    rows = T.count_tokens(documents(spark, docs, extra=True)).collect()
    for i, text in enumerate(TEXTS):
        own = [r for r in rows if r["id"] == i]
        total = len(e.encoding.encode_ordinary(text or ""))
        assert sum(r["tokens"] for r in own) == total * (2 if i == 0 else 1)
        assert {r["document_tokens"] for r in own} == {total}
        assert len(own) == ((text or "").removesuffix("\n").count("\n") + 1 if text else 1) * (2 if i == 0 else 1)
    assert T.count_tokens(documents(spark, [])).count() == 0


def brute(starts, ends, sections, rule):
    counts, outside = [0.0] * len(sections), 0.0
    for a, b in zip(starts, ends):
        b = max(b, a + 1)
        share = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        if rule == "start":
            k = next((k for k, (s, e) in enumerate(sections) if s <= a < e), None)
        elif rule == "most":
            k = max(range(len(sections)), key=lambda k: (share[k], -k)) if sections and max(share) > 0 and max(share) >= (b - a) - sum(share) else None
        else:
            for k, x in enumerate(share):
                counts[k] += x / (b - a)
            outside += 1 - sum(share) / (b - a)
            continue
        if k is None:
            outside += 1
        else:
            counts[k] += 1
    return counts, outside


def test_rules_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cuts = np.sort(rng.choice(60, 12, replace=False))
        sections = [(int(cuts[2 * k]), int(cuts[2 * k + 1])) for k in range(6)]
        ends = np.sort(rng.choice(np.arange(1, 70), 20, replace=False))
        starts = np.r_[0, ends[:-1]]
        for rule in T.RULES:
            counts, _, outside = T.allocate(starts, ends, np.array([s for s, _ in sections]), np.array([e for _, e in sections]), rule)
            want, rest = brute(starts.tolist(), ends.tolist(), sections, rule)
            assert np.allclose(counts, want) and abs(outside - rest) < 1e-9, (rule, sections, starts, ends)


def test_given_sections(spark):
    from pyspark.sql import functions as F

    df = documents(spark, [(1, "Hello world again"), (2, None)]).withColumn("parts", F.expr("array(named_struct('name','b','start',6,'end',9), named_struct('name','a','start',0,'end',5))"))
    rows = T.count_tokens(df, sections_col="parts", rule="split").where("id = 1").collect()
    assert {r["name"] for r in rows} == {"a", "b", None}
    assert abs(sum(r["tokens"] for r in rows) - rows[0]["document_tokens"]) < 1e-9


def test_very_long_white_space(spark):
    e = encoder()
    for text in (" " * 2_000_000, "\n" * 1_000_000, "x" + " \t" * 400_000 + "end", " " * 150_000 + "\u3000" + "a"):
        start, end = e.spans(text)
        assert start[0] == 0 and end[-1] == len(text) and (start[1:] <= end[:-1]).all()
    rows = T.count_tokens(documents(spark, [(1, "a\n" + " " * 1_500_000 + "b\nc")])).collect()
    assert len(rows) == 3 and sum(r["tokens"] for r in rows) == rows[0]["document_tokens"]


def test_long_runs_are_cut_where_the_pattern_cuts(monkeypatch):
    import random
    import re

    e = encoder()
    blank = T.LONG_BLANK.pattern
    for seed in range(500):
        r = random.Random(seed)
        text = "".join(r.choice([" ", "  ", "\n", "\t", "a", "bc", "\u00e9", "1", "!", "'s", " \u3000", "\x1c", "\xa0"]) for _ in range(r.randint(0, 60)))
        monkeypatch.setattr(T, "LONG_BLANK", re.compile(blank.replace("100000", "2")))
        assert e._encode(text).tolist() == e.encoding.encode_ordinary(text)
