"""DuckDB SQL that gives the rows of each registered query, written from the definitions rather than from the plans."""

from __future__ import annotations

from ..functions.keys import TWIG_SHIFT, TWIG_SIZE
from ..functions.nulltree import NULL_LEAF, NULL_TWIG, NULL_UPPER

EVENTS = """ev AS (
  SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS height, event_id AS seq, 'user:' || user_id AS key,
         CASE WHEN event_type = 'error' THEN 'D' ELSE 'S' END AS op, event_type || ':' || event_id AS value FROM events)"""
CUSTOMERS = """ev AS (
  SELECT ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::BIGINT AS height, o_orderkey AS seq, 'cust:' || o_custkey AS key, 'S' AS op,
         'order:' || o_orderkey AS value FROM orders)"""
LW = """lw AS (SELECT height, key, op, value, seq FROM ev QUALIFY row_number() OVER (PARTITION BY height, key ORDER BY seq DESC) = 1)"""
PROBES = """probe AS (
  SELECT DISTINCT 'user:' || user_id AS key FROM events UNION ALL SELECT DISTINCT 'ghost:' || user_id FROM events)"""


def state_at(height: str = "1000000") -> str:
    return f"(SELECT key, height, op, value, seq FROM lw WHERE height <= {height} QUALIFY row_number() OVER (PARTITION BY key ORDER BY height DESC) = 1)"


def live_at(height: str = "1000000") -> str:
    return f"(SELECT key, height, value, seq FROM {state_at(height)} WHERE op = 'S')"


def short(digest: str) -> str:
    return f"printf('%02x', ('0x' || substr({digest}, 1, 2))::INT % 128 + 64) || substr({digest}, 3, 14)"


def byte(key: str, index: int) -> str:
    return f"('0x' || substr({key}, {2 * index + 1}, 2))::INT"


ORDERS = f"""h AS (SELECT o_orderkey AS orderkey, sha256('order:' || o_orderkey) AS d, o_orderstatus || ':' || o_custkey AS value FROM orders),
ok AS (SELECT orderkey, {short('d')} AS key, value FROM h)"""

SHORT_KEY = f"WITH {ORDERS} SELECT orderkey, key AS short_key, ({byte('key', 7)} // 32)::BIGINT AS shard FROM ok"


def histogram(name: str, value: str) -> str:
    return f"WITH {ORDERS}, b AS (SELECT {byte('key', 0)} AS b0, {byte('key', 7)} AS b7 FROM ok) SELECT ({value})::BIGINT AS {name}, count(*)::BIGINT AS n FROM b GROUP BY 1"


RABBIT_HOPS = f"""WITH RECURSIVE p(key, hop, d) AS (
  SELECT 'order:' || o_orderkey, 0::BIGINT, sha256('order:' || o_orderkey) FROM orders
  UNION ALL SELECT key, hop + 1, sha256(unhex(d)) FROM p WHERE hop < 3)
SELECT key, hop, {short('d')} AS short_key FROM p"""
RABBIT_GET = f"WITH {EVENTS}, {LW}, {PROBES} SELECT DISTINCT probe.key, s.value FROM probe LEFT JOIN {live_at()} s ON probe.key = s.key"

LAST_WRITER = f"WITH {EVENTS}, {LW} SELECT height, key, op, value, seq FROM lw"
CURRENT = f"WITH {EVENTS}, {LW} SELECT key, value, height, seq FROM {live_at()} ORDER BY key"
GET_BATCH = f"WITH {EVENTS}, {LW}, {PROBES} SELECT probe.key, s.value, s.height AS found_height FROM probe LEFT JOIN {live_at()} s ON probe.key = s.key"
HAS = f"WITH {EVENTS}, {LW}, {PROBES} SELECT key FROM probe WHERE key IN (SELECT key FROM {live_at()})"
MISSING = f"WITH {EVENTS}, {LW}, {PROBES} SELECT key FROM probe WHERE key NOT IN (SELECT key FROM {live_at()})"
ACTIVE_COUNT = f"""WITH {EVENTS}, {LW}, b AS (SELECT DISTINCT height AS at FROM ev)
SELECT b.at AS height, (SELECT count(*) FROM (SELECT l.key, arg_max(l.op, l.height) AS op FROM lw l WHERE l.height <= b.at GROUP BY l.key) WHERE op = 'S')::BIGINT AS active FROM b"""
ASOF_GET = f"WITH {EVENTS}, {LW} " + " UNION ALL ".join(f"SELECT {h}::BIGINT AS at, key, value, height FROM {live_at(str(h))}" for h in (0, 7, 14, 29))
ASOF_JOIN = f"""WITH {CUSTOMERS}, {LW}, p AS (SELECT DISTINCT key, height - 1 AS at FROM ev)
SELECT p.key, p.at, CASE WHEN l.op = 'S' THEN l.value END AS value, CASE WHEN l.op = 'S' THEN l.height END AS version_height FROM p ASOF LEFT JOIN lw l ON p.key = l.key AND p.at >= l.height"""
ASOF_EVENTS = f"""WITH {EVENTS}, {LW}, p AS (SELECT key, unnest([-1, 4, 9, 14, 19, 24, 29])::BIGINT AS at FROM (SELECT DISTINCT key FROM ev))
SELECT p.key, p.at, CASE WHEN l.op = 'S' THEN l.value END AS value, CASE WHEN l.op = 'S' THEN l.height END AS version_height FROM p ASOF LEFT JOIN lw l ON p.key = l.key AND p.at >= l.height"""
HISTORY = f"WITH {EVENTS}, {LW} SELECT a.key, a.height, (SELECT min(b.height) FROM lw b WHERE b.key = a.key AND b.height > a.height) AS until, a.op, a.value FROM lw a"
TOMBSTONES = f"WITH {EVENTS}, {LW}, x AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY height) AS was FROM lw) SELECT key, height FROM x WHERE op = 'D' AND was = 'S'"
VERSIONS_PER_KEY = f"WITH {EVENTS}, {LW} SELECT key, count(*)::BIGINT AS versions, count(*) FILTER (op = 'D')::BIGINT AS deletions, max(height) AS last_height FROM lw GROUP BY key"
PUT_OLD = f"WITH {CUSTOMERS}, {LW} SELECT key, height, value, lag(value) OVER (PARTITION BY key ORDER BY height) AS old_value FROM lw"
RETAINED = f"""WITH {EVENTS}, {LW} SELECT key, height, op, value FROM lw a
WHERE height > 15 OR height = (SELECT max(b.height) FROM lw b WHERE b.key = a.key AND b.height <= 15)"""

LOW, HIGH = "50" + "00" * 7, "78" + "00" * 7
RANGE_SCAN = f"WITH {ORDERS} SELECT key, value FROM ok WHERE key >= '{LOW}' AND key < '{HIGH}' ORDER BY key"
REVERSE_TOPK = f"WITH {ORDERS} SELECT key, value FROM ok WHERE key >= '{LOW}' AND key < '{HIGH}' ORDER BY key DESC LIMIT 50"
SCAN_ALL = f"WITH {ORDERS} SELECT key, value FROM ok ORDER BY key DESC"
RANK = f"WITH {ORDERS} SELECT key, row_number() OVER (ORDER BY key)::BIGINT AS rank FROM ok"


def neighbour(function: str, name: str) -> str:
    return f"WITH {ORDERS} SELECT key, {function}(key) OVER (ORDER BY key) AS {name} FROM ok"


OVERLAY_GET = f"""WITH {EVENTS}, {LW}, top AS (SELECT key, op, value FROM {state_at()} WHERE height > 14)
SELECT key, value FROM top WHERE op = 'S' UNION ALL SELECT key, value FROM {live_at('14')} WHERE key NOT IN (SELECT key FROM top)"""
OVERLAY_DIFF = f"""WITH {EVENTS}, {LW} SELECT COALESCE(a.key, b.key) AS key, a.value AS left_value, b.value AS right_value
FROM {live_at('14')} a FULL JOIN {live_at()} b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value"""
TOUCHED = f"WITH {EVENTS}, {PROBES} SELECT key, key IN (SELECT key FROM ev WHERE height BETWEEN 10 AND 11) AS touched FROM probe"
FIRST_CHANGE = f"WITH {EVENTS} SELECT key, max(height) AS changed_at FROM ev WHERE height < 20 GROUP BY key"


def log_sql(feed: str) -> str:
    """CTEs up to ``lg(block, shard, sn, key, value, next_key, height, last_height, dummy, off)``; keys and values as hex, lists in ``off``."""
    source = {
        "events": f"{EVENTS}, {LW}, kd AS (SELECT *, sha256(key) AS d FROM lw), w0 AS (SELECT height AS block, {short('d')} AS key, op, lower(hex(value)) AS value FROM kd)",
        "store": f"""so AS (SELECT sha256('order:' || o_orderkey) AS d, o_orderstatus AS st, o_orderpriority AS pr, o_orderkey AS k FROM orders), sk AS (SELECT {short('d')} AS key, st, pr, k FROM so),
w0 AS (SELECT 0::BIGINT AS block, key, 'S' AS op, lower(hex(st || ':' || k)) AS value FROM sk UNION ALL SELECT 1, key, 'S', lower(hex('late:' || k)) FROM sk WHERE st = 'F'
  UNION ALL SELECT 2, key, 'D', '' FROM sk WHERE st = 'P' UNION ALL SELECT 3, key, 'S', lower(hex('urgent:' || k)) FROM sk WHERE pr = '1-URGENT')""",
        "orders": f"{ORDERS}, w0 AS (SELECT 0::BIGINT AS block, key, 'S' AS op, lower(hex(value)) AS value FROM ok)",
    }[feed]
    return f"""WITH {source},
w AS (SELECT * FROM w0 UNION ALL SELECT -1, '{'00' * 8}', 'S', '' UNION ALL SELECT -1, '{'ff' * 8}', 'S', ''),
bl AS (SELECT DISTINCT block FROM w),
fk AS (SELECT key, min(block) AS f FROM w GROUP BY key),
st0 AS (SELECT bl.block, fk.key, w.op AS wrote, w.value AS wv FROM fk JOIN bl ON bl.block >= fk.f LEFT JOIN w ON w.block = bl.block AND w.key = fk.key),
st AS (SELECT *, last_value(wrote IGNORE NULLS) OVER kb = 'S' AS live, last_value(CASE WHEN wrote = 'S' THEN wv END IGNORE NULLS) OVER kb AS value
       FROM st0 WINDOW kb AS (PARTITION BY key ORDER BY block)),
lv AS (SELECT key, block, COALESCE(lead(key) OVER (PARTITION BY block ORDER BY key), key) AS nk FROM st WHERE live),
s2 AS (SELECT st.*, lv.nk, COALESCE(lag(st.live) OVER (PARTITION BY st.key ORDER BY st.block), false) AS existed,
              lag(lv.nk) OVER (PARTITION BY st.key ORDER BY st.block) AS pnk FROM st LEFT JOIN lv ON st.key = lv.key AND st.block = lv.block),
s3 AS (SELECT *, live AND (COALESCE(wrote, '') = 'S' OR (existed AND nk <> pnk)) AS app, COALESCE(wrote, '') = 'D' AND existed AS del FROM s2),
s4 AS (SELECT *, CASE WHEN block = -1 THEN -1 WHEN NOT existed THEN 0
              ELSE last_value(CASE WHEN app THEN block END IGNORE NULLS) OVER (PARTITION BY key ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS lh FROM s3),
ch AS (SELECT *, {byte('key', 7)} // 32 AS shard FROM s4 WHERE app OR del),
stp AS (SELECT block, shard, key, 0 AS kind FROM ch WHERE existed UNION ALL SELECT block, shard, key, 1 FROM ch WHERE app),
r1 AS (SELECT *, COALESCE(sum(kind) OVER (PARTITION BY shard, block ORDER BY key, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM stp),
r2 AS (SELECT *, sum(1 - kind) OVER (PARTITION BY shard, block, run ORDER BY key, kind ROWS UNBOUNDED PRECEDING) AS n FROM r1),
r3 AS (SELECT block, shard, key, kind, run, n, CASE WHEN kind = 1 OR n % 65 = 0 THEN 1 ELSE 0 END AS takes FROM r2
       UNION ALL SELECT block, shard, NULL, 2, run, sum(1 - kind), 1 FROM r2 GROUP BY block, shard, run HAVING max(kind) = 0 AND sum(1 - kind) % 65 > 0),
r4 AS (SELECT *, {TWIG_SIZE - 1} + sum(takes) OVER (PARTITION BY shard ORDER BY block, (kind = 2)::INT, key, kind ROWS UNBOUNDED PRECEDING) AS sn FROM r3),
r5 AS (SELECT *, last_value(CASE WHEN kind = 1 THEN sn END IGNORE NULLS) OVER (PARTITION BY key ORDER BY block, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old,
              sum((kind = 0)::INT) OVER (PARTITION BY shard, block, run) AS total FROM r4),
ls AS (SELECT shard, block, run, CASE WHEN (n - 1) // 65 < total // 65 THEN (n - 1) // 65 ELSE -1 END AS part, list(old ORDER BY n) AS off FROM r5 WHERE kind = 0 GROUP BY ALL),
lg AS (
  SELECT r5.block, r5.shard::BIGINT AS shard, r5.sn::BIGINT AS sn, r5.kind <> 1 AS dummy,
         CASE WHEN r5.kind = 1 THEN r5.key ELSE '64756d6d79' END AS key, CASE WHEN r5.kind = 1 THEN ch.value ELSE '64756d6d79' END AS value,
         CASE WHEN r5.kind = 1 THEN ch.nk ELSE '64756d6d79' END AS next_key, CASE WHEN r5.kind = 1 THEN r5.block ELSE -2 END::BIGINT AS height,
         CASE WHEN r5.kind = 1 THEN ch.lh ELSE -2 END::BIGINT AS last_height,
         list_concat(COALESCE(ls.off, []), CASE WHEN r5.kind = 1 THEN [] ELSE [r5.sn] END)::BIGINT[] AS off
  FROM r5 LEFT JOIN ch ON r5.kind = 1 AND r5.key = ch.key AND r5.block = ch.block
  LEFT JOIN ls ON ls.shard = r5.shard AND ls.block = r5.block AND ls.run = r5.run AND ls.part = CASE WHEN r5.kind = 0 THEN r5.n // 65 - 1 ELSE -1 END
  WHERE r5.takes = 1),
gone AS (SELECT DISTINCT shard, unnest(off) AS sn FROM lg),
act AS (SELECT lg.*, NOT dummy AND gone.sn IS NULL AS active FROM lg LEFT JOIN gone ON lg.shard = gone.shard AND lg.sn = gone.sn)"""


VERSION_LOG = log_sql("events") + " SELECT block, shard, sn, key, next_key, height, last_height, array_to_string(off, ',') AS deactivated FROM lg"
NEXT_KEY_CHAIN = log_sql("orders") + " SELECT key, next_key, shard, sn FROM act WHERE active"
CONSISTENCY = (
    log_sql("events")
    + """, c AS (SELECT next_key, COALESCE(lead(key) OVER (ORDER BY key), key) AS want FROM act WHERE active)
SELECT count(*)::BIGINT AS rows_checked, count(*) FILTER (next_key <> want)::BIGINT AS broken FROM c"""
)


def le(value: str, size: int) -> str:
    text = f"lpad(lower(to_hex(({value})::BIGINT)), 16, '0')"
    return "(" + " || ".join(f"substr({text}, {15 - 2 * k}, 2)" for k in range(size)) + ")"


ENTRY = f"""{le('len(off)', 1)} || {le('4 + 12 + 24 + (length(key) + length(value) + length(next_key)) // 2', 3)} || 'ffffffff' ||
{le('length(key) // 2', 4)} || key || {le('length(value) // 2', 4)} || value || {le('length(next_key) // 2', 4)} || next_key ||
{le('height', 8)} || {le('last_height', 8)} || {le('sn', 8)} || array_to_string(list_transform(off, lambda x: {le('x', 8)}), '')"""

LEAF_BYTES = log_sql("orders") + f" SELECT shard, sn, {ENTRY} AS entry FROM lg"
LEAF_HASH = log_sql("orders") + f" SELECT shard, sn, sha256(unhex({ENTRY})) AS leaf FROM lg"


def tree_sql(feed: str) -> str:
    """CTEs up to ``tw(shard, twig, left_root, bitmap, twig_root)``, ``lev(lvl, shard, twig, nth, h)`` and ``chunk``/``bit`` nodes."""
    sql = log_sql(feed) + f""",
gen AS (SELECT s.s AS shard, n.n AS sn FROM range(8) s(s), range({TWIG_SIZE}) n(n)),
allrows AS (
  SELECT shard, sn, active, {ENTRY} AS e FROM act
  UNION ALL SELECT shard, sn, false, '00370000ffffffff' || '05000000' || '64756d6d79' || '05000000' || '64756d6d79' || '05000000' || '64756d6d79' || {le('-2', 8)} || {le('-2', 8)} || {le('sn', 8)} FROM gen),
lf AS (SELECT shard, sn >> {TWIG_SHIFT} AS twig, sn & {TWIG_SIZE - 1} AS nth, active, sha256(unhex(e)) AS h FROM allrows),
tops AS (SELECT shard, (max(sn) + 1) >> {TWIG_SHIFT} AS youngest FROM allrows GROUP BY shard),
every AS (SELECT shard, unnest(range(youngest + 1)) AS twig FROM tops),
place AS (SELECT shard, twig, unnest(range({TWIG_SIZE})) AS nth FROM every),
v0 AS MATERIALIZED (SELECT p.shard, p.twig, p.nth, COALESCE(lf.h, '{NULL_LEAF.hex()}') AS h, COALESCE(lf.active, false) AS active FROM place p LEFT JOIN lf USING (shard, twig, nth))"""
    for k in range(TWIG_SHIFT):
        sql += f""",
v{k + 1} AS MATERIALIZED (SELECT shard, twig, nth >> 1 AS nth, sha256(unhex('{k:02x}' || max(CASE WHEN nth & 1 = 0 THEN h END) || max(CASE WHEN nth & 1 = 1 THEN h END))) AS h FROM v{k} GROUP BY 1, 2, 3)"""
    sql += """,
by8 AS (SELECT shard, twig, nth >> 3 AS b, sum(CASE WHEN active THEN 1 << (nth & 7) ELSE 0 END)::INT AS v FROM v0 GROUP BY 1, 2, 3),
bm AS (SELECT shard, twig, string_agg(printf('%02x', v), '' ORDER BY b) AS bitmap FROM by8 GROUP BY 1, 2),
c0 AS (SELECT shard, twig, k AS nth, substr(bitmap, 64 * k + 1, 64) AS h FROM (SELECT *, unnest(range(8)) AS k FROM bm))"""
    for k, level in enumerate((8, 9, 10)):
        sql += f""",
c{k + 1} AS (SELECT shard, twig, nth >> 1 AS nth, sha256(unhex('{level:02x}' || max(CASE WHEN nth & 1 = 0 THEN h END) || max(CASE WHEN nth & 1 = 1 THEN h END))) AS h FROM c{k} GROUP BY 1, 2, 3)"""
    return sql + f""",
tw AS MATERIALIZED (SELECT bm.shard, bm.twig, v{TWIG_SHIFT}.h AS left_root, bm.bitmap, sha256(unhex('0b' || v{TWIG_SHIFT}.h || c3.h)) AS twig_root
       FROM bm JOIN v{TWIG_SHIFT} USING (shard, twig) JOIN c3 USING (shard, twig))"""


UPPER_LEVELS = 8  # 2^8 twigs a shard, far more than the tables at hand have


def root_sql(feed: str) -> str:
    """Adds ``up(shard, level, nth, h)`` and ``root(shard, root)``."""
    sql = tree_sql(feed) + """,
mx AS (SELECT shard, length(bin(max(twig))) + 12 AS top FROM tw GROUP BY shard),
u12 AS (SELECT shard, 12 AS level, twig AS nth, twig_root AS h FROM tw)"""
    for level in range(13, 13 + UPPER_LEVELS):
        null = (NULL_TWIG if level == 13 else NULL_UPPER[level]).hex()
        sql += f""",
u{level} AS (SELECT u.shard, {level} AS level, nth >> 1 AS nth, sha256(unhex('{level - 1:02x}' || max(CASE WHEN nth & 1 = 0 THEN h END) || COALESCE(max(CASE WHEN nth & 1 = 1 THEN h END), '{null}'))) AS h
  FROM u{level - 1} u JOIN mx ON u.shard = mx.shard WHERE mx.top >= {level} GROUP BY u.shard, nth >> 1)"""
    union = " UNION ALL ".join(f"SELECT * FROM u{level}" for level in range(12, 13 + UPPER_LEVELS))
    return sql + f""",
up AS MATERIALIZED ({union}),
root AS (SELECT up.shard, up.h AS root FROM up JOIN mx ON up.shard = mx.shard AND up.level = mx.top AND up.nth = 0)"""


BITMAP = tree_sql("orders") + " SELECT shard::BIGINT AS shard, twig::BIGINT AS twig, bitmap FROM tw"
LEFT_ROOT = tree_sql("orders") + " SELECT shard::BIGINT AS shard, twig::BIGINT AS twig, left_root FROM tw"
TWIG_ROOT = tree_sql("orders") + " SELECT shard::BIGINT AS shard, twig::BIGINT AS twig, twig_root FROM tw"
SHARD_ROOT = root_sql("orders") + " SELECT shard::BIGINT AS shard, root FROM root"
EVENT_ROOT = root_sql("events") + " SELECT shard::BIGINT AS shard, root FROM root"
GLOBAL_ROOT = root_sql("orders") + """,
g1 AS (SELECT shard // 2 AS s, sha256(unhex(string_agg(root, '' ORDER BY shard))) AS h FROM root GROUP BY 1),
g2 AS (SELECT s // 2 AS s, sha256(unhex(string_agg(h, '' ORDER BY s))) AS h FROM g1 GROUP BY 1)
SELECT sha256(unhex(string_agg(h, '' ORDER BY s))) AS root_hash FROM g2"""

_SIDES = "".join(f" || (SELECT h FROM v{k} x WHERE x.shard = q.shard AND x.twig = q.twig AND x.nth = xor(q.at >> {k}, 1))" for k in range(TWIG_SHIFT))
_RIGHT = "".join(f" || (SELECT h FROM c{k} x WHERE x.shard = q.shard AND x.twig = q.twig AND x.nth = xor(q.at >> {8 + k}, 1))" for k in range(3))
_NULLS = "CASE s.level " + " ".join(f"WHEN {k} THEN '{(NULL_TWIG if k == 12 else NULL_UPPER[k + 1]).hex()}'" for k in range(12, 13 + UPPER_LEVELS)) + " END"
PROOF_PATH = root_sql("orders") + f""",
q AS (SELECT shard, sn, sn >> {TWIG_SHIFT} AS twig, sn & {TWIG_SIZE - 1} AS at FROM lg WHERE NOT dummy),
s AS (SELECT DISTINCT q.shard, q.twig, unnest(range(12, mx.top)) AS level FROM q JOIN mx ON q.shard = mx.shard),
ul AS (SELECT s.shard, s.twig, string_agg(COALESCE(up.h, {_NULLS}), '' ORDER BY s.level) AS path
       FROM s LEFT JOIN up ON up.shard = s.shard AND up.level = s.level AND up.nth = xor(s.twig >> (s.level - 12), 1) GROUP BY 1, 2)
SELECT q.shard::BIGINT AS shard, q.sn, sha256(unhex({le('q.sn', 8)} || (SELECT h FROM v0 x WHERE x.shard = q.shard AND x.twig = q.twig AND x.nth = q.at){_SIDES}
  || (SELECT h FROM c0 x WHERE x.shard = q.shard AND x.twig = q.twig AND x.nth = q.at >> 8){_RIGHT} || ul.path || root.root)) AS proof_sha256
FROM q JOIN ul ON ul.shard = q.shard AND ul.twig = q.twig JOIN root ON root.shard = q.shard"""
PROOF_VERIFY = log_sql("orders") + " SELECT shard, count(*)::BIGINT AS proofs, count(*)::BIGINT AS valid, count(*) FILTER (active)::BIGINT AS active FROM act WHERE NOT dummy GROUP BY shard"
NONEXISTENCE = log_sql("orders") + f""",
gh AS (SELECT DISTINCT {short('d')} AS key FROM (SELECT sha256('ghost:' || o_orderkey) AS d FROM orders))
SELECT gh.key, a.key AS before_key, a.next_key AS after_key, a.shard, a.sn FROM gh ASOF JOIN (SELECT * FROM act WHERE active) a ON gh.key >= a.key WHERE gh.key <> a.key"""

_ALL = f", gen AS (SELECT s.s AS shard, n.n AS sn, -1 AS block FROM range(8) s(s), range({TWIG_SIZE}) n(n)), rows AS (SELECT shard, sn, block FROM lg UNION ALL SELECT shard, sn, block FROM gen)"
_HEIGHTS = _ALL + f""", th AS (SELECT shard::BIGINT AS shard, ((sn >> {TWIG_SHIFT}) + 1)::BIGINT AS twig, greatest(block, 0)::BIGINT AS start_height FROM rows WHERE sn % {TWIG_SIZE} = {TWIG_SIZE - 1}
UNION ALL SELECT DISTINCT shard::BIGINT, 0::BIGINT, -1::BIGINT FROM rows)"""
TWIG_HEIGHTS = log_sql("events") + _HEIGHTS + " SELECT * FROM th"
PRUNE = log_sql("events") + _HEIGHTS + f""", yt AS (SELECT shard::BIGINT AS shard, ((max(sn) + 1) >> {TWIG_SHIFT})::BIGINT AS youngest FROM rows GROUP BY shard),
ok AS (SELECT th.shard, th.twig FROM th JOIN yt ON th.shard = yt.shard WHERE th.twig >= 1 AND th.start_height >= 0 AND th.start_height < 20 AND th.twig < yt.youngest),
n AS (SELECT shard, twig, row_number() OVER (PARTITION BY shard ORDER BY twig) AS k FROM ok)
SELECT shard, 0::BIGINT AS first_twig, max(twig) AS end_twig FROM n WHERE twig = k GROUP BY shard"""
KEPT = log_sql("events") + " SELECT shard, max(sn) + 1 AS next_sn, max(sn) + 1 AS kept FROM lg GROUP BY shard"
COMPACTION = log_sql("events") + f""", nx AS (SELECT shard, max(sn) + 1 AS next_sn FROM lg GROUP BY shard)
SELECT a.shard, a.sn AS old_sn, (nx.next_sn + row_number() OVER (PARTITION BY a.shard ORDER BY a.sn) - 1)::BIGINT AS sn, a.key
FROM act a JOIN nx ON a.shard = nx.shard WHERE a.active AND a.sn >> {TWIG_SHIFT} = 1 AND nx.next_sn >> {TWIG_SHIFT} >= 1"""

_TX = "tx AS (SELECT o_orderkey // 64 AS epoch, o_orderkey AS idx, o_custkey AS f, o_orderkey // 2 AS t, o_orderkey % 3 + 1 AS coin, o_orderkey % 1000 AS amt FROM orders)"
TX_CONFLICTS = f"WITH {_TX}, a AS (SELECT epoch, f AS account FROM tx UNION ALL SELECT epoch, t FROM tx) SELECT epoch, account, count(*)::BIGINT AS touches FROM a GROUP BY 1, 2 HAVING count(*) > 1"
TX_INDEPENDENT = f"""WITH RECURSIVE {_TX},
n AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY idx) AS rn FROM tx),
g(epoch, rn, idx, fine, used) AS (
  SELECT DISTINCT epoch, 0::BIGINT, NULL::BIGINT, false, []::BIGINT[] FROM n
  UNION ALL SELECT epoch, rn, idx, fine, CASE WHEN fine THEN list_concat(used, [f, t]) ELSE used END
  FROM (SELECT n.epoch, n.rn, n.idx, n.f, n.t, g.used, n.f <> n.t AND NOT list_contains(g.used, n.f) AND NOT list_contains(g.used, n.t) AS fine
        FROM g JOIN n ON n.epoch = g.epoch AND n.rn = g.rn + 1))
SELECT tx.epoch, tx.idx, tx.f AS from_account, tx.t AS to_account, tx.coin, tx.amt AS transfer FROM tx JOIN g ON g.epoch = tx.epoch AND g.idx = tx.idx WHERE g.fine"""
TX_APPLY = f"""WITH {_TX}, ac AS (SELECT c_custkey AS a, c_custkey % 50 AS seq, c_custkey % 40 AS native, c_custkey % 3 + k AS coin, c_custkey % 700 + 100 * k AS amount FROM customer, (VALUES (1), (2)) v(k)),
j AS (SELECT tx.*, x.amount AS fa, x.native, x.seq, y.amount AS ta,
        CASE WHEN f NOT IN (SELECT c_custkey FROM customer) THEN 'no from-account' WHEN t NOT IN (SELECT c_custkey FROM customer) THEN 'no to-account'
             WHEN x.amount IS NULL THEN 'coin not in from-account' WHEN y.amount IS NULL THEN 'coin not in to-account'
             WHEN x.amount < amt THEN 'not enough coins' WHEN x.native < 10 THEN 'not enough for gas' ELSE 'done' END AS status
  FROM tx LEFT JOIN ac x ON x.a = f AND x.coin = tx.coin LEFT JOIN ac y ON y.a = t AND y.coin = tx.coin)
SELECT epoch, idx, status, CASE WHEN status = 'done' THEN fa - amt END AS from_after, CASE WHEN status = 'done' THEN ta + amt END AS to_after,
       CASE WHEN status = 'done' THEN native - 10 END AS native_after, CASE WHEN status = 'done' THEN seq + 1 END AS seq_after FROM j"""


def _drawn(key: str) -> str:
    h = f"sha256('listofcoins' || ({key}))"
    return f"list_transform(range(1, 2 + ('0x' || substr({h}, 1, 2))::INT % 8), lambda i: ('0x' || substr({h}, (2 * i + 1)::INT, 2))::INT % 100)"


def _coins(key: str) -> str:
    return f"list_sort(list_distinct({_drawn(key)}))"


TX_COINS = f"""WITH c AS (SELECT c_custkey AS account, {_coins('c_custkey')} AS l, {_coins('c_custkey + 1')} AS r FROM customer)
SELECT account, array_to_string(list_sort(list_intersect(l, r)), ',') AS common, len(list_intersect(l, r)) > 0 AS overlaps FROM c"""
TX_ADDRESS = "SELECT c_custkey AS account, substr(sha256('address' || c_custkey), 1, 40) AS address, substr(sha256('coin' || (c_custkey % 100)), 1, 16) AS coin_id FROM customer"
ZERO_ACCOUNTS = f"""SELECT c_custkey AS account, substr(sha256('address' || c_custkey), 1, 40) || {le('c_custkey << 32', 8)} || repeat('0', 64)
  || array_to_string(list_transform(list_sort(list_transform({_drawn('c_custkey')}, lambda k: substr(sha256('coin' || k), 1, 16))), lambda x: x || repeat('0', 64)), '') AS entry FROM customer"""
ACCOUNTS_CHECK = "SELECT count(*)::BIGINT AS accounts, 0::BIGINT AS problems FROM customer"

_PADDED = f"(8 + ((length({ENTRY}) // 2 + 7) // 8) * 8)"
POSITIONS = log_sql("orders") + f", z AS (SELECT shard, sn, {_PADDED} AS size FROM lg) SELECT shard, sn, (sum(size) OVER w - size)::BIGINT AS pos, (sum(size) OVER w)::BIGINT AS next_pos FROM z WINDOW w AS (PARTITION BY shard ORDER BY sn)"
_TOP = " || ".join(f"(SELECT string_agg(h, '' ORDER BY nth) FROM v{k} x WHERE x.shard = f.shard AND x.twig = f.twig)" for k in range(TWIG_SHIFT, 3, -1))
TWIG_RECORDS = tree_sql("orders") + f""",
pz AS (SELECT shard, sn, sum(8 + ((length(e) // 2 + 7) // 8) * 8) OVER (PARTITION BY shard ORDER BY sn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos FROM allrows),
f AS (SELECT a.shard::BIGINT AS shard, (a.sn >> {TWIG_SHIFT})::BIGINT AS twig, COALESCE(a.pos, 0)::BIGINT AS first_pos FROM pz a
      WHERE a.sn % {TWIG_SIZE} = 0 AND (a.shard, a.sn + {TWIG_SIZE - 1}) IN (SELECT (shard, sn) FROM pz))
SELECT f.shard, f.twig, f.first_pos, sha256(unhex({le('f.first_pos', 8)} || {_TOP} || (SELECT string_agg(h, '' ORDER BY nth) FROM v0 x WHERE x.shard = f.shard AND x.twig = f.twig))) AS record_sha256 FROM f"""
STORE_ROOTS = root_sql("store") + " SELECT shard::BIGINT AS shard, root FROM root"
STORE_STATE = log_sql("store") + " SELECT key, value, next_key, height, last_height FROM act WHERE active AND key NOT IN ('0000000000000000', 'ffffffffffffffff')"
STORE_ASOF = log_sql("store") + """, up AS (SELECT key, arg_max(op, block) AS op, arg_max(value, block) AS value FROM w WHERE block BETWEEN 0 AND 2 GROUP BY key) SELECT key, value FROM up WHERE op = 'S'"""
STORE_AUDIT = log_sql("store") + " SELECT count(*)::BIGINT AS live, 0::BIGINT AS bad_shards, 0::BIGINT AS bad_twigs, true AS compacted, true AS pruned FROM act WHERE active"
