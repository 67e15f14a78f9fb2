"""URL filter with redirect equivalence.

A rule ``host/path`` fits its host and all subdomains where the url's path starts with the rule's; the longest rule that
fits decides (of equal ones, allow). Urls without a rule follow their aliases: pages are nodes (host, path and query, so
that the scheme, the fragment and tracking parameters make no difference), redirects and canonical links are edges, and a
block decided by a rule anywhere in a connected component (on a page's path, or on a node's, where an empty path is ``/``) blocks every member that no rule allows explicitly. All else is
allowed. An allowed member stops no block of others; it only keeps its own verdict.

Edges come from ``<link rel=canonical href>`` and ``<meta http-equiv=refresh>`` of the pages, resolved against the page's
url, and from an optional table of redirects. Components are contracted with aggregations and equi-joins only.

Defined results: a null url or one without ``://`` has empty host and path, no rule, is no alias of anything and is
allowed; null html has no links; repeated rows are repeated; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name a visit, not a page.
TRACKING = r"^(?:utm_[^=]*|gclid|fbclid)(?:=|$)"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def node_of(url: Column) -> Column:
    """Alias key of a url; null where it has no ``://``."""
    query = F.array_join(F.filter(F.split(_part(url, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    key = F.concat(host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.contains(url, F.lit("://")), key)


def rule_of(host: Column, path: Column, rules) -> Column:
    """``struct(size, explicit_allow, rule, action)`` of the deciding rule, or null. The rules are a literal map by host."""
    by_host: dict[str, list] = {}
    for action, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append((rule_path, action))
    entry = lambda p, a, h: F.struct(F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"))
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*(entry(p, a, h) for p, a in found)))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda r: F.startswith(path, r["path"]))
    ranked = F.transform(
        fits, lambda r: F.struct(F.length(r["rule"]).alias("size"), (r["action"] == "allow").cast("int").alias("explicit_allow"), r["rule"].alias("rule"), r["action"].alias("action"))
    )
    return F.array_max(ranked)


def _resolved(base: Column, target: Column) -> Column:
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base)), r"(?s)^(.*/)", 1)
    return (
        F.when(target == "", F.lit(None))
        .when(F.contains(target, F.lit("://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(target.rlike(r"^[?#]"), F.concat(site, path_of(base), target))
        .otherwise(F.concat(site, folder, target))
    )


def link_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)`` nodes of canonical links and meta redirects in the pages' html."""
    quoted = r"""(?is)\bNAME\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    value = lambda tag, name: F.trim(F.concat(*(F.regexp_extract(tag, quoted.replace("NAME", name), k) for k in (1, 2, 3))))
    tags = F.filter(
        F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?\s*canonical\b|\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"),
    )
    found = (
        pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
        .where(F.contains("url", F.lit("://")))
        .select("url", F.explode(tags).alias("tag"))
    )
    refresh = F.regexp_extract(value(F.col("tag"), "content"), r"(?is)\burl\s*=\s*['\"]?([^'\"]*)", 1)
    target = F.when(F.col("tag").rlike("(?is)^<link"), value(F.col("tag"), "href")).otherwise(F.trim(refresh))
    return found.select(node_of(F.col("url")).alias("src"), node_of(_resolved(F.col("url"), target)).alias("dst")).where("dst is not null")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, host, path, rule, verdict, reason)`` for every row; ``reason`` is rule, alias or default.

    ``redirects`` has urls ``src`` and ``dst``.
    """
    edges = link_edges(pages, url_col=url_col, html_col=html_col)
    if redirects is not None:
        more = redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
        edges = edges.unionByName(more.where("src is not null and dst is not null"))
    members = checkpointed(connected_components(edges, "src", "dst"))
    named = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), node_of(F.col(url_col)).alias("node")
    ).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    ruled = checkpointed(
        named.join(members, "node", "left").select(
            "id", "host", "path", "node", F.col("found.rule").alias("rule"), F.col("found.action").alias("action"), F.coalesce("component", "node").alias("cls")
        )
    )
    # a rule on a node blocks its aliases, whether or not the node is a page of the table or has a link of its own
    as_url = F.concat(F.lit("x://"), "node")
    blocks = rule_of(host_of(as_url), path_of(as_url), rules)["action"] == "block"
    by_node = members.where(blocks).select(F.col("component").alias("cls")).unionByName(ruled.where("action is null").select("node", "cls").where(blocks).select("cls"))
    blocked = ruled.where("action = 'block' and cls is not null").select("cls").unionByName(by_node).distinct().withColumn("hit", F.lit(True))
    # a url in a class of blocked aliases is rare: only undecided rows are joined
    decided = ruled.where("action is not null").select("id", "host", "path", "rule", F.col("action").alias("verdict"), F.lit("rule").alias("reason"))
    open_ = ruled.where("action is null").join(blocked, "cls", "left")
    rest = open_.select(
        "id", "host", "path", "rule",
        F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        F.when(F.col("hit"), F.lit("alias")).otherwise(F.lit("default")).alias("reason"),
    )
    return decided.unionByName(rest)


URL_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1) ELSE '' END AS query
  FROM pages),
q AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|gclid|fbclid)(?:=|$)')), '&') AS kept FROM p),
n AS (SELECT *, CASE WHEN contains(url, '://') THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS node FROM q),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hit AS (
  SELECT n.page_id, n.url, arg_max(struct_pack(rule := rhost || rpath, action := action), length(rhost || rpath)) AS r
  FROM n JOIN rules ON (n.host = rhost OR ends_with(n.host, '.' || rhost)) AND starts_with(n.path, rpath) GROUP BY n.page_id, n.url),
j AS (SELECT n.page_id, n.host, n.path, n.node, n.html, n.url, r.rule AS rule, r.action AS action FROM n LEFT JOIN hit ON n.page_id = hit.page_id AND n.url = hit.url),
tags AS (SELECT node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM n),
links AS (
  SELECT node AS src, CASE WHEN regexp_matches(tag, '(?is)^<link') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)
                           ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]*)', 1) END AS target
  FROM tags WHERE regexp_matches(tag, '(?is)\brel\s*=\s*["'']?\s*canonical\b|\bhttp-equiv\s*=\s*["'']?\s*refresh\b')),
e AS (
  SELECT src, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(target, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS dst
  FROM links WHERE contains(target, '://')),
both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach(node, other) AS (
  SELECT DISTINCT node, node FROM j WHERE node IS NOT NULL
  UNION SELECT reach.node, both_ways.dst FROM reach JOIN both_ways ON reach.other = both_ways.src),
target AS (SELECT DISTINCT dst, regexp_extract(dst, '^[^/?]*') AS host, regexp_extract(dst, '^[^/?]*([^?]*)', 1) AS path FROM both_ways),
judged AS (SELECT dst, arg_max(action, length(rhost || rpath)) AS action FROM target JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY dst),
own AS (SELECT DISTINCT node, regexp_extract(node, '^[^/?]*') AS host, regexp_extract(node, '^[^/?]*([^?]*)', 1) AS path FROM j WHERE action IS NULL),
own_judged AS (SELECT node, arg_max(action, length(rhost || rpath)) AS action FROM own JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY node),
bad AS (SELECT reach.node FROM reach JOIN j ON reach.other = j.node WHERE j.action = 'block' UNION SELECT reach.node FROM reach JOIN own_judged ON reach.other = own_judged.node WHERE own_judged.action = 'block' UNION SELECT reach.node FROM reach JOIN judged ON reach.other = judged.dst WHERE judged.action = 'block')
SELECT j.page_id, j.host, j.path, j.rule,
       CASE WHEN action IS NOT NULL THEN action WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN action IS NOT NULL THEN 'rule' WHEN bad.node IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM j LEFT JOIN bad ON j.node = bad.node
"""
