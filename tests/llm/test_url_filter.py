from stratalog.llm import urlfilter as U


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def link(href):
    return f'<head><link rel="canonical" href="{href}"></head>'


def verdicts(df):
    return {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["reason"]) for r in df.collect()}


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "http://A.Example.NET/en/1?x#y", None),
        (2, "https://a.example.net/fr/1", None),
        (3, "https://notexample.com/de/", None),
        (4, "https://x.example.com/de", None),
        (5, "https://x.example.com/de/a", None),
        (6, "ftp://b.org/fr/q", None),
        (7, "https://org/fr/", None),
        (8, "no scheme", None),
        (9, None, "<p>"),
        (10, "https://deep.net#x", None),
        (11, "https://deep.net/#a", None),
        (12, "", None),
    ]
    got = verdicts(U.judge(pages(spark, rows)))
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow", "rule")
    assert got[2] == ("a.example.net", "/fr/1", "net/", "block", "rule")
    assert got[3][2:4] == (None, "allow")
    assert got[4][2] is None
    assert got[5][2:4] == ("example.com/de/", "block")
    assert got[6][2:4] == ("org/fr/", "allow")
    assert got[7][2:4] == ("org/fr/", "allow")
    for empty in (8, 9, 12):
        assert got[empty] == ("", "", None, "allow", "default")
    assert got[11][2:4] == ("net/", "block")
    # without a path no rule fits, but it is the same page as its site's root
    assert got[10] == ("deep.net", "", None, "block", "alias")


def test_a_host_without_path_is_its_root(spark):
    got = verdicts(U.judge(pages(spark, [(1, "https://deep.net", None), (2, "http://other.org", None), (3, "x://example.net?a=1", link("https://fine.org/"))])))
    assert got[1] == ("deep.net", "", None, "block", "alias")
    assert got[2] == ("other.org", "", None, "allow", "default")
    assert got[3] == ("example.net", "", None, "block", "alias")


def test_blocks_spread_over_links_and_allow_keeps_precedence(spark):
    rows = [
        (1, "https://bad.net/a", None),
        (2, "https://one.example.org/en/1", link("https://bad.net/a")),
        (3, "https://two.example.org/en/2", '<META http-equiv=refresh content="0; url=https://one.example.org/en/1#top">'),
        (4, "https://ok.example.net/en/3", link("//two.example.org/en/2")),
        (5, "https://three.example.org/en/x/4", link("../no")),
        (6, "https://four.example.org/en/5", link("/en/6")),
        (7, "http://four.example.org/en/6?utm_source=feed", None),
        (8, "https://one.example.org/en/1?utm_source=a", None),
    ]
    got = verdicts(U.judge(pages(spark, rows * 2)))
    assert got[2][3:] == ("block", "alias")
    assert got[3][3:] == ("block", "alias")
    assert got[4][3:] == ("allow", "rule")
    assert got[8][3:] == ("block", "alias")
    assert got[6][3:] == got[7][3:] == ("allow", "default")
    redirects = spark.createDataFrame([("http://four.example.org/en/6", "https://bad.net/a"), (None, "x")], "src string, dst string")
    got = verdicts(U.judge(pages(spark, rows), redirects=redirects))
    assert got[6][3:] == got[7][3:] == ("block", "alias")


def test_long_chain_and_empty_table(spark):
    n = 40
    rows = [(i, f"https://s.example.org/en/{i}", link(f"https://s.example.org/en/{i + 1}")) for i in range(n)] + [(n, f"https://s.example.org/en/{n}", link("https://z.net/"))]
    assert {v[3] for v in verdicts(U.judge(pages(spark, rows))).values()} == {"block"}
    assert U.judge(pages(spark, [])).count() == 0
