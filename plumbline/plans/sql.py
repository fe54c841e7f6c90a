"""DuckDB SQL shared by the oracles: bars, their average true range and the swings of three of it."""

ORD = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"

ROWS = f"""x AS (
  SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS day, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_quantity AS q,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORD}) AS rn,
    CAST(1000000 + sum(CAST(round(l_extendedprice * 100) AS BIGINT) % 2001 - 1000) OVER (PARTITION BY l_suppkey ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p
  FROM lineitem)"""

SEGMENTED = f"""{ROWS},
bw AS (SELECT sid, week, arg_min(p, rn) AS o, max(p) AS h, min(p) AS l, arg_max(p, rn) AS c, CAST(sum(q) AS BIGINT) AS v, count(*) AS n, min(day) AS since, max(day) AS until FROM x GROUP BY sid, week),
bg AS (SELECT *, coalesce(since - lag(until) OVER w > 30, false)::INT AS gap, lead(week) OVER w IS NULL AND week + 4 > (SELECT max(day) FROM x) AS forming FROM bw WINDOW w AS (PARTITION BY sid ORDER BY week)),
bs AS (SELECT * EXCLUDE (sid), sid AS share, sum(gap) OVER (PARTITION BY sid ORDER BY week)::BIGINT AS segment FROM bg)"""

BARS = f"""{SEGMENTED},
b AS MATERIALIZED (
  SELECT share * 1000 + segment AS sid, share, segment, week, o, h, l, c, v, n, row_number() OVER (PARTITION BY share, segment ORDER BY week) - 1 AS i FROM bs WHERE NOT forming)"""

DAILY = f"""{ROWS},
dd AS MATERIALIZED (SELECT sid, day, arg_min(p, rn) AS o, arg_max(p, rn) AS c FROM x GROUP BY sid, day)"""

TR = """tr AS MATERIALIZED (
  SELECT *, CASE WHEN i > 0 THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr
  FROM (SELECT *, lag(c) OVER (PARTITION BY sid ORDER BY i) AS pc FROM b))"""

ATR = f"""{TR},
seed AS (SELECT sid, sum(tr)::DOUBLE / 14 AS a FROM tr WHERE i BETWEEN 1 AND 14 GROUP BY sid HAVING count(*) = 14),
wild(sid, i, a) AS (
  SELECT sid, 14, a FROM seed
  UNION ALL
  SELECT t.sid, t.i, (w.a * 13 + t.tr) / 14 FROM wild w JOIN tr t ON t.sid = w.sid AND t.i = w.i + 1),
bb AS MATERIALIZED (SELECT t.*, w.a AS atr FROM tr t LEFT JOIN wild w ON w.sid = t.sid AND w.i = t.i)"""


def swings(multiples: str = "(3.0)", turn: str = "z.m * {}", h: str = "h", l: str = "l", ha: str = "atr", la: str = "atr") -> str:  # noqa: E741
    """z: (sid, m, kind, bar, known, price) of the reversals by each multiple; turn gives the threshold from ha or la at the extreme."""
    return f"""{ATR},
scan(sid, m, i, leg, hp, hi, ha, lp, li, la, kind, bar, price) AS (
  SELECT sid, m, 0, 0, {h}, 0, {ha}, {l}, 0, {la}, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  FROM bb, (VALUES {multiples}) mm(m) WHERE i = 0
  UNION ALL
  SELECT sid, m, i, CASE WHEN dn THEN -1 WHEN up THEN 1 ELSE leg END,
    CASE WHEN up THEN {h} WHEN NOT dn AND leg >= 0 AND {h} > hp THEN {h} ELSE hp END,
    CASE WHEN up THEN i WHEN NOT dn AND leg >= 0 AND {h} > hp THEN i ELSE hi END,
    CASE WHEN up THEN {ha} WHEN NOT dn AND leg >= 0 AND {h} > hp THEN {ha} ELSE ha END,
    CASE WHEN dn THEN {l} WHEN NOT up AND leg <= 0 AND {l} < lp THEN {l} ELSE lp END,
    CASE WHEN dn THEN i WHEN NOT up AND leg <= 0 AND {l} < lp THEN i ELSE li END,
    CASE WHEN dn THEN {la} WHEN NOT up AND leg <= 0 AND {l} < lp THEN {la} ELSE la END,
    CASE WHEN dn THEN 'HIGH' WHEN up THEN 'LOW' END, CASE WHEN dn THEN hi WHEN up THEN li END, CASE WHEN dn THEN hp WHEN up THEN lp END
  FROM (
    SELECT s.* EXCLUDE (dn, up), (s.dn AND s.leg >= 0 AND (s.leg = 1 OR NOT s.up OR s.hi <= s.li)) AS dn,
      (s.up AND s.leg <= 0 AND NOT (s.dn AND s.leg = 0 AND (NOT s.up OR s.hi <= s.li))) AS up
    FROM (
      SELECT n.sid, z.m, n.i, n.h, n.l, n.c, n.atr, z.leg, z.hp, z.hi, z.ha, z.lp, z.li, z.la,
        coalesce(n.{l} <= z.hp - {turn.format('z.ha')}, false) AS dn, coalesce(n.{h} >= z.lp + {turn.format('z.la')}, false) AS up
      FROM scan z JOIN bb n ON n.sid = z.sid AND n.i = z.i + 1) s)),
z AS MATERIALIZED (SELECT sid, m, kind, bar, i AS known, CAST(price AS DOUBLE) AS price FROM scan WHERE kind IS NOT NULL)"""


SWINGS = f"""{BARS}, {swings()},
sw AS MATERIALIZED (SELECT z.sid, z.kind, z.bar, z.known, z.price, bb.atr FROM z JOIN bb ON bb.sid = z.sid AND bb.i = z.bar),
lab AS MATERIALIZED (
  SELECT *, CASE WHEN last IS NULL THEN NULL WHEN abs(price - last) <= 0.25 * atr THEN CASE kind WHEN 'HIGH' THEN 'EQH' ELSE 'EQL' END
      WHEN price > last THEN CASE kind WHEN 'HIGH' THEN 'HH' ELSE 'HL' END ELSE CASE kind WHEN 'HIGH' THEN 'LH' ELSE 'LL' END END AS label
  FROM (SELECT *, lag(price) OVER (PARTITION BY sid, kind ORDER BY known, bar) AS last FROM sw))"""


def legs(n: int, of: str = "sw") -> str:
    cols = ", ".join(f"lag({c}, {n - 1 - k}) OVER (PARTITION BY sid ORDER BY bar, kind) AS {p}{k}" for k in range(n) for c, p in (("price", "p"), ("bar", "b"), ("kind", "k"), ("known", "w")))
    alternate = " AND ".join(f"k{k} <> k{k - 1}" for k in range(1, n))
    seen = ", ".join(f"w{k}" for k in range(n))
    return f"(SELECT *, CASE kind WHEN 'LOW' THEN 1 ELSE -1 END AS s, greatest({seen}) AS seen FROM (SELECT sid, kind, bar, known, price, atr, {cols} FROM {of}) WHERE p0 IS NOT NULL AND atr IS NOT NULL AND {alternate})"


#: Breaks and trend states bar by bar: the last swing of each kind, whether it is broken, regime, pending turn, labels and the last four prices.
STRUCTURE = f"""{SWINGS},
feed AS MATERIALIZED (SELECT bb.sid, bb.i, bb.c::DOUBLE AS c, bb.atr, lab.kind, lab.bar, lab.price, lab.label FROM bb LEFT JOIN lab ON lab.sid = bb.sid AND lab.known = bb.i),
walk(sid, i, hb, hp, hx, lb, lp, lx, regime, pending, hl, ll, q1, q2, q3, q4, state, prior, up, down, up_bar, up_level, down_bar, down_level, up_bos, down_bos) AS (
  SELECT sid, -1, NULL::BIGINT, NULL::DOUBLE, false, NULL::BIGINT, NULL::DOUBLE, false, NULL::INT, NULL::INT, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, NULL::VARCHAR, false, false, NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT, NULL::DOUBLE, false, false
  FROM (SELECT DISTINCT sid FROM bb)
  UNION ALL
  SELECT sid, i, hb2, hp2, hx2, lb2, lp2, lx2, r2, g2, hl2, ll2, a1, a2, a3, a4,
    CASE WHEN r2 IS NULL OR (a4 IS NOT NULL AND atr IS NOT NULL AND greatest(a1, a2, a3, a4) - least(a1, a2, a3, a4) <= 3.0 * atr) THEN 'RANGE' WHEN g2 IS NOT NULL THEN 'TRANSITION'
      WHEN r2 > 0 THEN CASE WHEN hl2 = 'HH' AND ll2 = 'HL' THEN 'UPTREND_STRONG' ELSE 'UPTREND_WEAKENING' END ELSE CASE WHEN hl2 = 'LH' AND ll2 = 'LL' THEN 'DOWNTREND_STRONG' ELSE 'DOWNTREND_WEAKENING' END END,
    state, ub, db, hb, hp, lb, lp, usame, dsame
  FROM (
    SELECT *, CASE WHEN kind = 'HIGH' THEN bar ELSE hb END AS hb2, CASE WHEN kind = 'HIGH' THEN price ELSE hp END AS hp2, CASE WHEN kind = 'HIGH' THEN false ELSE hx OR ub END AS hx2,
      CASE WHEN kind = 'LOW' THEN bar ELSE lb END AS lb2, CASE WHEN kind = 'LOW' THEN price ELSE lp END AS lp2, CASE WHEN kind = 'LOW' THEN false ELSE lx OR db END AS lx2,
      CASE WHEN kind = 'HIGH' THEN coalesce(label, hl) ELSE hl END AS hl2, CASE WHEN kind = 'LOW' THEN coalesce(label, ll) ELSE ll END AS ll2,
      CASE WHEN kind IS NULL THEN q1 ELSE price END AS a1, CASE WHEN kind IS NULL THEN q2 ELSE q1 END AS a2, CASE WHEN kind IS NULL THEN q3 ELSE q2 END AS a3, CASE WHEN kind IS NULL THEN q4 ELSE q3 END AS a4,
      CASE WHEN db THEN CASE WHEN dsame THEN -1 ELSE r1 END ELSE r1 END AS r2, CASE WHEN db THEN CASE WHEN dsame THEN NULL ELSE -1 END ELSE g1 END AS g2
    FROM (
      SELECT *, db_ AS db, coalesce(r1 IS NULL OR r1 = -1 OR g1 = -1, false) AS dsame FROM (
        SELECT *, CASE WHEN ub THEN CASE WHEN usame THEN 1 ELSE regime END ELSE regime END AS r1, CASE WHEN ub THEN CASE WHEN usame THEN NULL ELSE 1 END ELSE pending END AS g1 FROM (
          SELECT f.sid, f.i, f.c, f.atr, f.kind, f.bar, f.price, f.label, w.hb, w.hp, w.hx, w.lb, w.lp, w.lx, w.regime, w.pending, w.hl, w.ll, w.q1, w.q2, w.q3, w.q4, w.state,
            coalesce(f.atr IS NOT NULL AND NOT w.hx AND f.c - w.hp > 0.1 * f.atr, false) AS ub, coalesce(f.atr IS NOT NULL AND NOT w.lx AND w.lp - f.c > 0.1 * f.atr, false) AS db_, coalesce(w.regime IS NULL OR w.regime = 1 OR w.pending = 1, false) AS usame
          FROM walk w JOIN feed f ON f.sid = w.sid AND f.i = w.i + 1))))),
brk AS MATERIALIZED (
  SELECT sid, i AS t, CASE WHEN up_bos THEN 'BOS' ELSE 'CHOCH' END AS event, 'UP' AS direction, up_bar AS swing_bar, up_level AS level, prior AS prior_state FROM walk WHERE up
  UNION ALL SELECT sid, i, CASE WHEN down_bos THEN 'BOS' ELSE 'CHOCH' END, 'DOWN', down_bar, down_level, prior FROM walk WHERE down)"""

LEVELS = f"""{STRUCTURE},
lv AS MATERIALIZED (
  SELECT sid, 'SWING' AS source, price, known, CASE kind WHEN 'LOW' THEN 'SUPPORT' ELSE 'RESISTANCE' END AS role, bar FROM sw
  UNION ALL SELECT sid, event, level, t, CASE direction WHEN 'UP' THEN 'SUPPORT' ELSE 'RESISTANCE' END, swing_bar FROM brk),
sd AS (
  SELECT lv.*, bb.i AS t, CASE WHEN bb.c < lv.price - 0.1 * coalesce(bb.atr, 0) THEN 'RESISTANCE' WHEN bb.c > lv.price + 0.1 * coalesce(bb.atr, 0) THEN 'SUPPORT' END AS side FROM lv JOIN bb ON bb.sid = lv.sid AND bb.i > lv.known),
flip AS MATERIALIZED (
  SELECT sid, source, bar, price, known, t, side AS role FROM (SELECT *, coalesce(lag(side) OVER (PARTITION BY sid, source, bar, price, known ORDER BY t), role) AS p FROM sd WHERE side IS NOT NULL) WHERE side <> p)"""
