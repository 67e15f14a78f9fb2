import re

from stratalog.llm import secrets as S

from .helpers import documents, rng, words

HEX = "0123456789abcdef" * 2


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, (p, least) in enumerate((("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if m.end() - m.start() >= least]
    return sorted(out)


def test_base_spans_against_brute_force():
    r = rng(1)
    parts = ["token", "TOKEN", "password", "api_key", "apikey", "secret", '"', "'", ":", "=", " ", "abc123", "é", "日本", "AKIA", "ABCDEFGH12345678", HEX, "ſecret", "toKen", "\n", "f0", "a.b=c"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(0, 14)))
        raw = text.encode()
        assert [(s, k, e) for s, k, _, e in S.base_spans(text, raw)] == brute(text), text


def test_ownership_separates_examples_from_live(spark):
    own, copied = "Qz7Kp2Lm9Xw4Vb8Nc3Rt", "Ex4mpl3K3yC0pi3dAl1Ov"
    rows = [(1, f"see {own} here", "en", "ann/repo"), (2, f"key {own}", "en", "ann/fork")]
    rows += [(10 + k, f"doc {copied} token = {HEX}", "en", f"owner{k}/r") for k in range(5)]
    rows += [(20, None, "en", "ann/repo"), (21, "", "en", None), (22, f'password: "{own}"', "en", "ann/repo"), (1, f"see {own} here", "en", "ann/repo")]
    rows += [(30, f"é{own}", "en", None)]
    got = {x["id"]: x["spans"] for x in S.scan(documents(spark, rows, extra=True)).collect()}
    assert [(s["kind"], s["start"], s["end"], s["verdict"]) for s in got[1]] == [("owned", 4, 4 + len(own), "live")]
    assert [(s["kind"], s["verdict"]) for s in got[10]] == [("assign", "example"), ("hex", "example")]
    assert [s["kind"] for s in got[22]] == ["assign"] and got[22][0]["verdict"] == "live"
    assert got[20] == got[21] == []
    assert [(s["start"], s["end"]) for s in got[30]] == [(1, 1 + len(own))]
    assert S.scan(documents(spark, [])).count() == 0


def test_clean_prose_and_long_texts_have_no_spans(spark):
    r = rng(2)
    rows = [(1, words(r, 2000)), (2, "word " * 200_000 + "token=abcdef1"), (3, "supercalifragilisticexpialidocious-and-more")]
    got = {x["id"]: x["spans"] for x in S.scan(documents(spark, rows)).collect()}
    assert got[1] == got[3] == [] and [(s["kind"], s["start"]) for s in got[2]] == [("assign", 1_000_000)]


def test_ownership_against_brute_force(spark):
    r = rng(7)
    values = ["".join(r.choices("ABCDEFGHKLMabcdefghkm", k=14)) + "".join(r.choices("0123456789", k=8)) for _ in range(12)]
    rows = []
    for i in range(200):
        text = " ".join([words(r, 3), r.choice(values), words(r, 2), *(f"token={v}" for v in r.sample(values, r.choice([0, 0, 1])))])
        source = r.choice([None, "", "alone", *(f"owner{k}/repo{r.randint(0, 9)}" for k in range(4))])
        at = values.index(next(v for v in values if v in text))
        rows.append((i, text, "en", source if at > 5 else f"one/{r.randint(0, 3 * at)}"))
    seen = {v: (set(), set()) for v in values}
    for _, text, _, source in rows:
        for v in values:
            if v in text:
                seen[v][0].add((source or "").split("/")[0])
                seen[v][1].add(source or "")
    verdict = {v: "example" if len(o) > S.MAX_OWNERS or len(p) > S.MAX_REPOSITORIES else "live" for v, (o, p) in seen.items()}
    assert {(len(o) > S.MAX_OWNERS, verdict[v]) for v, (o, _) in seen.items()} == {(True, "example"), (False, "example"), (False, "live")}
    got = {x["id"]: x["spans"] for x in S.scan(documents(spark, rows, extra=True)).collect()}
    for i, text, _, _ in rows:
        want = []
        for v in values:
            for m in re.finditer(re.escape(v), text):
                if text[: m.start()].endswith("token="):
                    want.append((m.start() - 6, m.end(), "assign", verdict[v], len(seen[v][0]), len(seen[v][1])))
                elif verdict[v] == "live":
                    want.append((m.start(), m.end(), "owned", "live", len(seen[v][0]), len(seen[v][1])))
        assert [(s["start"], s["end"], s["kind"], s["verdict"], s["owners"], s["repositories"]) for s in got[i]] == sorted(want)
