from stratalog.llm import linededup as L

from .helpers import documents, rng, words


def brute(rows, min_sites, min_chars):
    sites = {}
    for _, text, _, source in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if len(line.strip(" ")) >= min_chars:
                sites.setdefault(line.strip(" "), set()).add(source)
    gone = {k for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for i, text, _, _ in rows:
        if text is None:
            out.append((i, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(" ") not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_against_exact_counts(spark):
    r = rng(1)
    common = [words(r, 6) for _ in range(40)]
    spread = {line: r.randint(1, 60) for line in common}
    rows = []
    for k in range(400):
        source = None if k % 61 == 60 else f"site{k % 61}"
        lines = [words(r, r.randint(1, 8)) for _ in range(r.randint(0, 6))] + [(" " + c) for c in common if k % 61 < spread[c] and r.random() < 0.9]
        r.shuffle(lines)
        rows.append((k, "\n".join(lines), "en", source))
    rows += [(500, None, "en", "site1"), (501, "", "en", "site1"), (502, common[0], "en", "site2"), (7, rows[7][1], "en", rows[7][3]), (503, "a\r\n\n" + "x " * 50_000, "en", "s")]
    for min_sites, lg_k in ((10, 12), (30, 4), (45, 6)):
        found = L.spread_lines(documents(spark, rows), min_sites=min_sites, lg_k=lg_k).count()
        exact = len({x for x in [line for line in common] if len({s for _, t, _, s in rows if t and x in [y.strip(" ") for y in t.split("\n")]}) >= min_sites and len(x) >= 20})
        assert abs(found - exact) <= (0 if lg_k == 12 else 4)
    got = L.remove_spread_lines(documents(spark, rows, extra=True)).collect()
    key = lambda x: (x[0], str(x[3]))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, L.MIN_SITES, L.MIN_CHARS), key=key)


def test_empty_table(spark):
    assert L.remove_spread_lines(documents(spark, [])).count() == 0
