"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import series as S
from plumbline.operators import evidence, indicators, joins, lifecycle, patterns, quality, structure, swings
from plumbline.plans import identities, market, records, shapes, sql  # noqa: F401  they register their queries
from plumbline.plans.registry import QUERIES, SQL, query
from plumbline.sources.store import materialised
from plumbline.sources.tables import bars, hourly_events, table, trades, weekly


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars with every indicator and the sums that fits need."""
    return materialised(spark, sf_dir, "bars", lambda: S.moments(indicators.all_indicators(weekly(spark, sf_dir))))


def _swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(spark, sf_dir, "swings", lambda: swings.primary(_bars(spark, sf_dir)))


def _fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(spark, sf_dir, "fine", lambda: swings.fine(_bars(spark, sf_dir)))


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(spark, sf_dir, "walked", lambda: structure.walked(_bars(spark, sf_dir), _swings(spark, sf_dir)))


def _breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.found_breaks(_walked(spark, sf_dir))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.found_states(_walked(spark, sf_dir))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(trades(spark, sf_dir), "day")



@query(f"""WITH {sql.BARS}
SELECT sid, share, segment, i, week, o, h, l, c, v, n, CASE WHEN count(c) OVER w10 = 10 THEN round(avg(c) OVER w10, 6) END AS sma10,
  CASE WHEN count(v) OVER w20 = 20 THEN round(v / avg(v) OVER w20, 6) END AS rvol,
  CAST(sum(d * v) OVER (PARTITION BY sid ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS obv
FROM (SELECT *, coalesce(sign(c - lag(c) OVER (PARTITION BY sid ORDER BY i)), 0) AS d FROM b)
WINDOW w10 AS (PARTITION BY sid ORDER BY i ROWS 9 PRECEDING), w20 AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = weekly(spark, sf_dir).withColumn("dc", F.col("c") - F.lag("c").over(S.by_bar()))
    return b.select("sid", "share", "segment", "i", "week", *"ohlcv", "n", F.round(S.sma(F.col("c"), 10), 6).alias("sma10"), F.round(S.relative_volume(), 6).alias("rvol"), S.obv().alias("obv"))


_SMAS = ", ".join(f"CASE WHEN count(c) OVER w{n} = {n} THEN round(avg(c) OVER w{n}, 6) END AS sma{n}" for n in C.SMA)
_FRAMES = ", ".join(f"w{n} AS (PARTITION BY sid ORDER BY i ROWS {n - 1} PRECEDING)" for n in C.SMA)


@query(f"""WITH {sql.BARS}, {sql.TR},
a AS (
  SELECT *, CASE WHEN count(c) OVER w14 = 14 THEN CASE WHEN max(h) OVER w14 = min(l) OVER w14 THEN 50.0 ELSE 100.0 * (c - min(l) OVER w14) / (max(h) OVER w14 - min(l) OVER w14) END END AS raw_k,
    100 * (c::DOUBLE / nullif(lag(c, 12) OVER (PARTITION BY sid ORDER BY i), 0) - 1) AS roc,
    CASE WHEN count(c) OVER w20 = 20 THEN sqrt((20 * sum(c * c) OVER w20 - sum(c) OVER w20 * sum(c) OVER w20)::DOUBLE) / 20 END AS sd,
    CASE WHEN count(v) OVER w10 = 10 THEN avg(v) OVER w10 END AS v10, CASE WHEN count(v) OVER w20 = 20 THEN avg(v) OVER w20 END AS v20,
    CASE WHEN count(v) OVER before = 20 THEN v / avg(v) OVER before END AS rvol,
    {_SMAS}
  FROM tr WINDOW {_FRAMES}, w14 AS (PARTITION BY sid ORDER BY i ROWS 13 PRECEDING), before AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, CASE WHEN count(raw_k) OVER w3 = 3 THEN avg(raw_k) OVER w3 END AS k FROM a WINDOW w3 AS (PARTITION BY sid ORDER BY i ROWS 2 PRECEDING))
SELECT sid, i, {", ".join(f"sma{n}" for n in C.SMA)}, round(raw_k, 6) AS raw_k, round(k, 6) AS k, CASE WHEN count(k) OVER w3 = 3 THEN round(avg(k) OVER w3, 6) END AS d,
  round(roc, 6) AS roc, tr, round(sma20 + 2 * sd, 6) AS upper, round(sma20 - 2 * sd, 6) AS lower, round(4 * sd / sma20, 6) AS bandwidth, round(v20, 6) AS volume_sma,
  CASE WHEN v20 IS NULL OR v20 = 0 THEN NULL WHEN v10 >= v20 * 1.1 THEN 'RISING' WHEN v10 <= v20 * 0.9 THEN 'FALLING' ELSE 'FLAT' END AS volume_trend,
  CASE WHEN rvol IS NULL THEN NULL WHEN rvol >= 1.5 THEN 'EXPANSION' WHEN rvol <= 0.67 THEN 'CONTRACTION' ELSE 'NORMAL' END AS volume_state
FROM k WINDOW w3 AS (PARTITION BY sid ORDER BY i ROWS 2 PRECEDING)""")
def window_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _bars(spark, sf_dir)
    return x.select("sid", "i", *r6(*(f"sma{n}" for n in C.SMA), "raw_k", "k", "d", "roc"), "tr", *r6("upper", "lower", "bandwidth", "volume_sma"), "volume_trend", "volume_state")


def _ema_sql(n: int, x: str = "c") -> str:
    return f"CASE WHEN t.i < {n - 1} THEN NULL WHEN t.i = {n - 1} THEN t.s{n} ELSE e.e{n} + (2.0 / {n + 1}) * (t.{x} - e.e{n}) END"


_EMAS = sorted({*C.EMA, C.MACD_FAST, C.MACD_SLOW})


def _recursive_sql(digits: int) -> str:
    return f"""WITH RECURSIVE {sql.BARS}, {sql.ATR},
t AS MATERIALIZED (
  SELECT *, greatest(c - pc, 0) AS up, greatest(pc - c, 0) AS down, {", ".join(f"avg(c) OVER (PARTITION BY sid ORDER BY i ROWS {n - 1} PRECEDING) AS s{n}" for n in _EMAS)},
    avg(greatest(c - pc, 0)) OVER w14 AS up14, avg(greatest(pc - c, 0)) OVER w14 AS down14
  FROM bb WINDOW w14 AS (PARTITION BY sid ORDER BY i ROWS 13 PRECEDING)),
e AS (
  SELECT sid, i, {", ".join(f"CAST(NULL AS DOUBLE) AS e{n}" for n in _EMAS)}, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS f FROM t WHERE i = 0
  UNION ALL
  SELECT t.sid, t.i, {", ".join(_ema_sql(n) for n in _EMAS)},
    CASE WHEN t.i < 14 THEN NULL WHEN t.i = 14 THEN t.up14 ELSE (e.g * 13 + t.up) / 14 END, CASE WHEN t.i < 14 THEN NULL WHEN t.i = 14 THEN t.down14 ELSE (e.f * 13 + t.down) / 14 END
  FROM e JOIN t ON t.sid = e.sid AND t.i = e.i + 1),
m AS MATERIALIZED (SELECT *, e12 - e26 AS macd, avg(e12 - e26) OVER (PARTITION BY sid ORDER BY i ROWS 8 PRECEDING) AS s9 FROM e),
g AS (
  SELECT sid, i, CAST(NULL AS DOUBLE) AS signal FROM m WHERE i = 0
  UNION ALL
  SELECT m.sid, m.i, CASE WHEN m.i < 33 THEN NULL WHEN m.i = 33 THEN m.s9 ELSE g.signal + 0.2 * (m.macd - g.signal) END FROM g JOIN m ON m.sid = g.sid AND m.i = g.i + 1)
SELECT m.sid, m.i, {", ".join(f"round(m.e{n}, {digits}) AS ema{n}" for n in C.EMA)}, round(m.macd, {digits}) AS macd, round(g.signal, {digits}) AS macd_signal, round(m.macd - g.signal, {digits}) AS macd_histogram,
  round(CASE WHEN m.g IS NULL THEN NULL WHEN m.f = 0 THEN CASE WHEN m.g = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + m.g / m.f) END, {digits}) AS rsi, round(t.atr, {digits}) AS atr, round(100 * t.atr / t.c, {digits}) AS atr_percent
FROM m JOIN g ON g.sid = m.sid AND g.i = m.i JOIN t ON t.sid = m.sid AND t.i = m.i"""


@query(_recursive_sql(4))
def recursive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir).select("sid", "i", *[F.round(k, 4).alias(k) for k in indicators.RECURSIVE])


@query()
def fractal_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swings.fractals(weekly(spark, sf_dir))


def _fractal_sql() -> str:
    parts = []
    for name, k in C.FRACTAL.items():
        for kind, x, op, agg in (("HIGH", "h", ">", "max"), ("LOW", "l", "<", "min")):
            parts.append(f"""SELECT sid, '{name}' AS sensitivity, '{kind}' AS kind, i AS bar, i + {k} AS known, {x} AS price FROM (
  SELECT sid, i, {x}, count(*) OVER p AS np, count(*) OVER f AS nf, {agg}({x}) OVER p AS xp, {agg}({x}) OVER f AS xf FROM b
  WINDOW p AS (PARTITION BY sid ORDER BY i ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), f AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING))
WHERE np = {k} AND nf = {k} AND {x} {op} xp AND {x} {op}= xf""")
    return f"WITH {sql.BARS}\n" + "\nUNION ALL\n".join(parts)


SQL["fractal_swings"] = _fractal_sql()


@query(f"""WITH RECURSIVE {sql.BARS}, {sql.swings("(1.0), (2.0), (3.0), (5.0)")}
SELECT sid, CASE m WHEN 1 THEN 'MICRO' WHEN 2 THEN 'MINOR' WHEN 3 THEN 'INTERMEDIATE' ELSE 'MAJOR' END AS sensitivity, kind, bar, known, price FROM z""")
def reversal_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swings.found(weekly(spark, sf_dir), "ATR", C.ATR_MULTIPLE).drop("method")


_TIERS = f"CASE m {' '.join(f'WHEN {v} THEN {chr(39)}{k}{chr(39)}' for k, v in C.PERCENT.items())} ELSE 'FINE' END"
_PERCENTS = ", ".join(f"({v}.0)" for v in C.PERCENT.values())


@query(f"""WITH RECURSIVE {sql.BARS}, {sql.swings(_PERCENTS, "z.m * {} / 100", ha="h", la="l")},
y AS (SELECT * FROM (WITH RECURSIVE {sql.swings("(0.2), " + _PERCENTS, "z.m * {} / 100", "c", "c", "c", "c")} SELECT * FROM z))
SELECT sid, 'PERCENT' AS method, {_TIERS} AS sensitivity, kind, bar, known, price FROM z UNION ALL SELECT sid, 'ZIGZAG', {_TIERS}, kind, bar, known, price FROM y""")
def percent_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = weekly(spark, sf_dir)
    return swings.found(b, "PERCENT", C.PERCENT).unionByName(swings.found(b, "ZIGZAG", {"FINE": 0.2, **C.PERCENT}))


@query(f"""WITH RECURSIVE {sql.SWINGS}
SELECT sid, kind, bar, known, price, round(atr, 4) AS atr, label, price - lag(price) OVER w AS move, bar - lag(bar) OVER w AS bars,
  round(abs(price - lag(price) OVER w) / CASE WHEN atr > 0 THEN atr END, 4) AS strength
FROM lab WINDOW w AS (PARTITION BY sid ORDER BY known, bar, kind)""")
def swing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _swings(spark, sf_dir)
    return s.select("sid", "kind", "bar", "known", "price", F.round("atr", 4).alias("atr"), "label", "move", "bars", F.round("strength", 4).alias("strength"))


@query(f"WITH RECURSIVE {sql.STRUCTURE} SELECT * FROM brk")
def structure_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaks(spark, sf_dir)


@query(f"""WITH RECURSIVE {sql.STRUCTURE}
SELECT sid, i AS since, state, CASE regime WHEN 1 THEN 'UP' WHEN -1 THEN 'DOWN' END AS regime, CASE pending WHEN 1 THEN 'UP' WHEN -1 THEN 'DOWN' END AS pending FROM walk WHERE i >= 0 AND state IS DISTINCT FROM prior""")
def trend_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


_FIB = [*(f"r{int(r * 1000)}" for r in C.RETRACEMENTS), *(f"e{int(e * 1000)}" for e in C.EXTENSIONS)]


@query(f"""WITH RECURSIVE {sql.SWINGS},
leg AS (
  SELECT sid, kind, bar, price, atr, lag(price) OVER w AS anchor, lag(bar) OVER w AS anchor_bar, greatest(known, lag(known) OVER w) AS known FROM sw
  WINDOW w AS (PARTITION BY sid ORDER BY bar, kind)),
ok AS (SELECT * FROM leg WHERE anchor IS NOT NULL AND abs(price - anchor) >= 2.0 * atr),
hit AS (
  SELECT ok.sid, ok.bar, ok.anchor_bar, min(b.i) AS ended, arg_min(b.c, b.i) AS c FROM ok JOIN b ON b.sid = ok.sid AND b.i >= ok.known AND (b.c < least(anchor, price) OR b.c > greatest(anchor, price)) GROUP BY ALL)
SELECT ok.sid, ok.anchor_bar, ok.bar, ok.known, CASE WHEN price > anchor THEN 'UP' ELSE 'DOWN' END AS direction,
  CASE WHEN hit.ended IS NULL THEN 'ACTIVE' WHEN (price > anchor) = (hit.c < least(anchor, price)) THEN 'BROKEN' ELSE 'EXTENDED' END AS status, hit.ended,
  {", ".join(f"round(price - {r} * (price - anchor), 4) AS r{int(r * 1000)}" for r in C.RETRACEMENTS)}, {", ".join(f"round(anchor + {e} * (price - anchor), 4) AS e{int(e * 1000)}" for e in C.EXTENSIONS)}
FROM ok LEFT JOIN hit ON hit.sid = ok.sid AND hit.bar = ok.bar AND hit.anchor_bar = ok.anchor_bar""")
def retracements(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir)
    x = structure.retracements(_swings(spark, sf_dir), b)
    return x.select("sid", "anchor_bar", "bar", "known", "direction", "status", "ended", *[F.round(c, 4).alias(c) for c in _FIB])


@query(f"""WITH RECURSIVE {sql.SWINGS},
side AS (
  SELECT sw.sid, sw.kind, sw.bar, sw.price, sw.known, bb.i AS t, CASE WHEN bb.c < sw.price - 0.1 * coalesce(bb.atr, 0) THEN 'RESISTANCE' WHEN bb.c > sw.price + 0.1 * coalesce(bb.atr, 0) THEN 'SUPPORT' END AS side
  FROM sw JOIN bb ON bb.sid = sw.sid AND bb.i > sw.known),
chg AS (
  SELECT *, lag(side) OVER (PARTITION BY sid, kind, bar ORDER BY t) AS p FROM side WHERE side IS NOT NULL)
SELECT sid, 'SWING' AS source, bar, price, known, t, side AS role FROM chg
WHERE side <> coalesce(p, CASE kind WHEN 'LOW' THEN 'SUPPORT' ELSE 'RESISTANCE' END)""")
def swing_level_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir)
    return structure.role_changes(structure.swing_levels(_swings(spark, sf_dir)), b)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.level_sources(_swings(spark, sf_dir), _breaks(spark, sf_dir))


def _flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(spark, sf_dir, "flips", lambda: structure.role_changes(_levels(spark, sf_dir), _bars(spark, sf_dir)))


@query(f"""WITH RECURSIVE {sql.LEVELS}, n AS (SELECT sid, source, bar, price, known, arg_max(role, t) AS role, max(t) AS t, count(*) AS flips FROM flip GROUP BY ALL)
SELECT lv.sid, lv.source, lv.bar, lv.price, lv.known, coalesce(n.role, lv.role) AS role, coalesce(n.t, lv.known) AS since, coalesce(n.flips, 0) AS flips FROM lv LEFT JOIN n ON n.sid = lv.sid AND n.source = lv.source AND n.bar = lv.bar AND n.price = lv.price AND n.known = lv.known""")
def level_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.current_roles(_levels(spark, sf_dir), _flips(spark, sf_dir))


@query(f"""WITH RECURSIVE {sql.LEVELS},
last AS (SELECT sid, max(i) AS i, arg_max(c, i)::DOUBLE AS c, arg_max(atr, i) AS atr FROM bb GROUP BY sid),
src AS (SELECT lv.sid, lv.price, last.c, last.atr, row_number() OVER (PARTITION BY lv.sid ORDER BY lv.price, lv.known, lv.bar, lv.source) AS k FROM lv JOIN last ON last.sid = lv.sid WHERE last.atr IS NOT NULL),
cl(sid, k, zone, total, n) AS (
  SELECT sid, k, 1, price, 1 FROM src WHERE k = 1
  UNION ALL
  SELECT s.sid, s.k, CASE WHEN near THEN zone ELSE zone + 1 END, CASE WHEN near THEN total + s.price ELSE s.price END, CASE WHEN near THEN n + 1 ELSE 1 END
  FROM (SELECT src.*, cl.zone, cl.total, cl.n, abs(src.price - cl.total / cl.n) <= 0.5 * src.atr AS near FROM cl JOIN src ON src.sid = cl.sid AND src.k = cl.k + 1) s),
zz AS (SELECT src.sid, zone, min(price) AS lo, max(price) AS hi, any_value(src.atr) AS atr, any_value(c) AS c, count(*) AS members FROM cl JOIN src ON src.sid = cl.sid AND src.k = cl.k GROUP BY 1, 2),
zy AS (SELECT *, greatest(0, 0.25 * atr - (hi - lo)) / 2 AS pad FROM zz),
zw AS (SELECT sid, lo - pad AS low, hi + pad AS high, CASE WHEN (lo + hi) / 2 <= c THEN 'SUPPORT' ELSE 'RESISTANCE' END AS side, members, greatest(0, lo - pad - c, c - hi - pad) AS distance FROM zy)
SELECT sid, round(low, 4) AS low, round(high, 4) AS high, side, members, round(distance, 4) AS distance, place FROM (SELECT *, row_number() OVER (PARTITION BY sid, side ORDER BY distance, low) AS place FROM zw) WHERE place <= 4""")
def level_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = structure.zones(_levels(spark, sf_dir), _bars(spark, sf_dir))
    return z.select("sid", *[F.round(c, 4).alias(c) for c in ("low", "high")], "side", "members", F.round("distance", 4).alias("distance"), "place")


@query(f"""WITH RECURSIVE {sql.SWINGS},
p AS (
  SELECT x.sid, x.kind, x.bar AS a, y.bar AS b, x.price AS value, (y.price - x.price) / (y.bar - x.bar) AS slope, greatest(x.known, y.known) AS made, CASE x.kind WHEN 'LOW' THEN 1 ELSE -1 END AS up
  FROM sw x JOIN sw y ON x.sid = y.sid AND x.kind = y.kind AND y.bar BETWEEN x.bar + 4 AND x.bar + 104 WHERE (y.price - x.price) * CASE x.kind WHEN 'LOW' THEN 1 ELSE -1 END > 0),
n AS (
  SELECT p.*, s.bar AS z, s.known AS zk, coalesce(s.atr, 0) AS za, (s.price - p.value - p.slope * (s.bar - p.a)) * p.up AS away FROM p JOIN sw s ON s.sid = p.sid AND s.kind = p.kind AND s.bar > p.a AND s.bar <> p.b)
SELECT sid, kind, a, b, value, round(slope, 6) AS slope, min(CASE WHEN abs(away) <= 0.5 * za AND zk - b <= 104 THEN greatest(zk, made) END) AS known, sum((abs(away) <= 0.5 * za)::INT)::BIGINT AS touches
FROM n GROUP BY sid, kind, a, b, value, n.slope, made
HAVING max((z < b AND zk <= made AND away < -0.5 * za)::INT) = 0 AND min(CASE WHEN abs(away) <= 0.5 * za AND zk - b <= 104 THEN greatest(zk, made) END) IS NOT NULL""")
def trendlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir)
    return structure.trendline_pairs(_swings(spark, sf_dir), b).withColumn("slope", F.round("slope", 6))


@query(f"""WITH RECURSIVE {sql.BARS}, {sql.ATR},
q AS (
  SELECT *, 100 * atr / c AS ap, CASE WHEN count(c) OVER w20 = 20 THEN 4 * sqrt((20 * sum(c * c) OVER w20 - sum(c) OVER w20 * sum(c) OVER w20)::DOUBLE) / 20 / avg(c) OVER w20 END AS bw, lag(atr) OVER w AS pa
  FROM bb WINDOW w AS (PARTITION BY sid ORDER BY i), w20 AS (PARTITION BY sid ORDER BY i ROWS 19 PRECEDING)),
f AS (
  SELECT *, coalesce(CASE WHEN count(ap) OVER w52 = 52 THEN ap <= quantile_cont(ap, 0.2) OVER w52 END, false) AS e1, coalesce(CASE WHEN count(bw) OVER w52 = 52 THEN bw <= quantile_cont(bw, 0.2) OVER w52 END, false) AS e2,
    coalesce(count(*) OVER w6 = 6 AND h - l < min(h - l) OVER w6, false) AS e3
  FROM q WINDOW w52 AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING), w6 AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, coalesce(tr >= 1.5 * pa AND max((e1 OR e2 OR e3)::INT) OVER (PARTITION BY sid ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 1, false) AS e4 FROM f),
s AS (SELECT sid, i, {", ".join(f"e{k} AND NOT coalesce(lag(e{k}) OVER (PARTITION BY sid ORDER BY i), false) AS s{k}" for k in (1, 2, 3, 4))} FROM g)
{" UNION ALL ".join(f"SELECT sid, i, '{name}' AS event FROM s WHERE s{k}" for k, name in enumerate(("ATR_COMPRESSION", "BANDWIDTH_COMPRESSION", "NARROW_RANGE", "EXPANSION"), 1))}""")
def volatility_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.volatility(_bars(spark, sf_dir))


_CANDLES = {
    "DOJI": ("rng > 0 AND body <= 0.1 * rng", 1),
    "HAMMER": ("rng > 0 AND body > 0 AND lo >= 2 * body AND up <= 0.25 * body AND p1 = 'DOWN'", 1),
    "HANGING_MAN": ("rng > 0 AND body > 0 AND lo >= 2 * body AND up <= 0.25 * body AND p1 = 'UP'", 1),
    "INVERTED_HAMMER": ("rng > 0 AND body > 0 AND up >= 2 * body AND lo <= 0.25 * body AND p1 = 'DOWN'", 1),
    "SHOOTING_STAR": ("rng > 0 AND body > 0 AND up >= 2 * body AND lo <= 0.25 * body AND p1 = 'UP'", 1),
    "BULLISH_ENGULFING": ("c > o AND c1 < o1 AND o <= c1 AND c >= o1 AND body > b1 AND p2 = 'DOWN'", 2),
    "BEARISH_ENGULFING": ("c < o AND c1 > o1 AND o >= c1 AND c <= o1 AND body > b1 AND p2 = 'UP'", 2),
    "MORNING_STAR": ("r2 > 0 AND b2 >= 0.6 * r2 AND c2 < o2 AND r1 > 0 AND b1 <= 0.3 * r1 AND c > o AND c > (o2 + c2) / 2.0 AND p3 = 'DOWN'", 3),
    "EVENING_STAR": ("r2 > 0 AND b2 >= 0.6 * r2 AND c2 > o2 AND r1 > 0 AND b1 <= 0.3 * r1 AND c < o AND c < (o2 + c2) / 2.0 AND p3 = 'UP'", 3),
    "INSIDE_BAR": ("h < h1 AND l > l1", 1),
    "OUTSIDE_BAR": ("h > h1 AND l < l1", 1),
}


@query(f"""WITH {sql.BARS},
a AS (
  SELECT *, abs(c - o) AS body, h - l AS rng, h - greatest(o, c) AS up, least(o, c) - l AS lo, {", ".join(f"lag({x}, {k}) OVER w AS {x}{k}" for x in "ohlc" for k in (1, 2))},
    {", ".join(f"CASE WHEN lag(c, {k}) OVER w > lag(c, {k + 5}) OVER w THEN 'UP' WHEN lag(c, {k}) OVER w < lag(c, {k + 5}) OVER w THEN 'DOWN' END AS p{k}" for k in (1, 2, 3))}
  FROM b WINDOW w AS (PARTITION BY sid ORDER BY i)),
d AS (SELECT *, abs(c1 - o1) AS b1, abs(c2 - o2) AS b2, h1 - l1 AS r1, h2 - l2 AS r2 FROM a)
{" UNION ALL ".join(f"SELECT sid, i, '{k}' AS candle, p{n} AS direction FROM d WHERE {rule}" for k, (rule, n) in _CANDLES.items())}""")
def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.candles(_bars(spark, sf_dir))


@query(f"""WITH RECURSIVE {sql.BARS}, {sql.ATR},
a AS (SELECT *, sign(c - pc) AS d, CASE WHEN count(v) OVER p = 20 THEN v / avg(v) OVER p END AS rvol, CASE WHEN count(v) OVER w20 = 20 THEN avg(v) OVER w20 END AS vs, lag(atr) OVER w AS pa
  FROM bb WINDOW w AS (PARTITION BY sid ORDER BY i), w20 AS (PARTITION BY sid ORDER BY i ROWS 19 PRECEDING), p AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, sum(coalesce(d, 0) * v) OVER (PARTITION BY sid ORDER BY i ROWS UNBOUNDED PRECEDING) AS obv FROM a),
t AS (SELECT *, obv - lag(obv, 10) OVER (PARTITION BY sid ORDER BY i) AS chg FROM o),
s AS (SELECT *, CASE WHEN chg IS NULL OR vs IS NULL THEN NULL WHEN chg >= 0.1 * 10 * vs THEN 'RISING' WHEN chg <= -0.1 * 10 * vs THEN 'FALLING' ELSE 'FLAT' END AS trend FROM t),
u AS (SELECT *, lag(trend) OVER (PARTITION BY sid ORDER BY i) AS before FROM s)
SELECT sid, i, CASE WHEN c > pc THEN 'BUYING' ELSE 'SELLING' END || '_CLIMAX' AS event FROM u WHERE rvol >= 2.5 AND tr >= 2.0 * pa
UNION ALL SELECT sid, i, 'OBV_' || trend FROM u WHERE trend IS NOT NULL AND trend IS DISTINCT FROM before""")
def volume_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.volume_events(_bars(spark, sf_dir))


_DELTAS = {"rsi": "2.0", "macd": "0.05 * atr", "obv": "0.05 * vs"}
_DIVERGENCE = " UNION ALL ".join(f"""SELECT sid, '{x}' AS indicator, CASE WHEN label = 'LL' AND {x} - {x}0 > {d} THEN 'BULLISH' WHEN label = 'HL' AND {x}0 - {x} > {d} THEN 'HIDDEN_BULLISH' WHEN label = 'HH' AND {x}0 - {x} > {d} THEN 'BEARISH' WHEN label = 'LH' AND {x} - {x}0 > {d} THEN 'HIDDEN_BEARISH' END AS divergence,
  first, bar AS second, known, price, CASE kind WHEN 'LOW' THEN 1 ELSE -1 END AS side FROM pr WHERE bar BETWEEN first + 4 AND first + 52""" for x, d in _DELTAS.items())


@query(f"""WITH RECURSIVE {sql.SWINGS}, ri AS MATERIALIZED ({_recursive_sql(9)}),
vl AS MATERIALIZED (SELECT bb.sid, bb.i, ri.rsi, ri.macd, CASE WHEN count(v) OVER w20 = 20 THEN avg(v) OVER w20 END AS vs, sum(coalesce(sign(c - pc), 0) * v) OVER (PARTITION BY bb.sid ORDER BY bb.i ROWS UNBOUNDED PRECEDING) AS obv FROM bb JOIN ri ON ri.sid = bb.sid AND ri.i = bb.i WINDOW w20 AS (PARTITION BY bb.sid ORDER BY bb.i ROWS 19 PRECEDING)),
pr AS (SELECT lab.*, vl.rsi, vl.macd, vl.obv, vl.vs, lag(bar) OVER w AS first, lag(vl.rsi) OVER w AS rsi0, lag(vl.macd) OVER w AS macd0, lag(vl.obv) OVER w AS obv0 FROM lab JOIN vl ON vl.sid = lab.sid AND vl.i = lab.bar WINDOW w AS (PARTITION BY lab.sid, kind ORDER BY known, bar)),
dv AS (SELECT * FROM ({_DIVERGENCE}) WHERE divergence IS NOT NULL),
lv AS (SELECT d.*, max(m.price * d.side) * any_value(d.side) AS level FROM dv d JOIN sw m ON m.sid = d.sid AND m.bar > d.first AND m.bar < d.second AND m.known <= d.known AND CASE m.kind WHEN 'LOW' THEN 1 ELSE -1 END = -d.side GROUP BY d.sid, d.indicator, d.divergence, d.first, d.second, d.known, d.price, d.side),
jd AS (SELECT lv.sid, indicator, divergence, first, second, known, min(CASE WHEN (c - level) * side > 0 THEN i END) AS yes, min(CASE WHEN (c - lv.price) * side < 0 THEN i END) AS no, max(i) AS last FROM lv JOIN bb ON bb.sid = lv.sid AND bb.i BETWEEN known AND known + 26 GROUP BY ALL)
SELECT sid, indicator, divergence, first, second, known, CASE WHEN yes IS NOT NULL AND (no IS NULL OR yes <= no) THEN 'CONFIRMED' WHEN no IS NOT NULL THEN 'INVALIDATED' WHEN last = known + 26 THEN 'EXPIRED' ELSE 'FORMING' END AS status,
  CASE WHEN yes IS NOT NULL AND (no IS NULL OR yes <= no) THEN yes WHEN no IS NOT NULL THEN no WHEN last = known + 26 THEN last ELSE known END AS at FROM jd""")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.divergences(_swings(spark, sf_dir), _bars(spark, sf_dir))


@query(f"""WITH RECURSIVE {sql.STRUCTURE}, vo AS (SELECT sid, i, v, CASE WHEN count(v) OVER p = 20 THEN avg(v) OVER p END AS base FROM bb WINDOW p AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), r AS (SELECT *, CASE WHEN base > 0 THEN v / base END AS rvol FROM vo)
SELECT brk.sid, brk.t, brk.event, brk.direction, r.v AS volume, round(r.rvol, 6) AS rvol, CASE WHEN rvol IS NULL THEN NULL WHEN rvol >= 1.5 THEN 'EXPANSION' WHEN rvol <= 0.67 THEN 'CONTRACTION' ELSE 'NORMAL' END AS volume_state, CASE WHEN rvol >= 1.5 THEN 'CONFIRMED' WHEN rvol < 0.8 THEN 'CONTRADICTED' WHEN rvol IS NOT NULL THEN 'NEUTRAL' END AS verdict FROM brk JOIN r ON r.sid = brk.sid AND r.i = brk.t""")
def break_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume evidence of each break, as of its bar."""
    x = evidence.break_volume(_breaks(spark, sf_dir), _bars(spark, sf_dir))
    return x.withColumn("rvol", F.round("rvol", 6))


@query(f"""WITH RECURSIVE {sql.SWINGS}, s AS (SELECT lab.sid, lab.kind, lab.bar, lab.known, lab.label, bb.v, lag(bb.v) OVER (PARTITION BY lab.sid, lab.kind ORDER BY lab.known, lab.bar) AS v0 FROM lab JOIN bb ON bb.sid = lab.sid AND bb.i = lab.bar)
SELECT sid, kind, bar, known, round(1 - v / v0::DOUBLE, 6) AS fall FROM s WHERE label IN ('HH', 'LL') AND v0 > 0 AND 1 - v / v0::DOUBLE > 0.1""")
def volume_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Higher highs and lower lows on clearly less volume than the swing before."""
    x = evidence.volume_divergences(_swings(spark, sf_dir), _bars(spark, sf_dir))
    return x.withColumn("fall", F.round("fall", 6))


@query(f"""WITH RECURSIVE {sql.LEVELS}, n AS (SELECT lv.sid, lv.source, lv.bar, lv.price, lv.known, arg_max(flip.role, flip.t) AS role, max(flip.t) AS t FROM lv LEFT JOIN flip ON flip.sid = lv.sid AND flip.source = lv.source AND flip.bar = lv.bar AND flip.price = lv.price AND flip.known = lv.known AND flip.t <= 120 WHERE lv.known <= 120 GROUP BY ALL)
SELECT n.sid, n.source, n.bar, n.price, n.known, coalesce(n.role, lv.role) AS role, coalesce(n.t, n.known) AS since FROM n JOIN lv ON n.sid = lv.sid AND n.source = lv.source AND n.bar = lv.bar AND n.price = lv.price AND n.known = lv.known""")
def levels_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and their roles as they were known on bar 120."""
    levels, flips = _levels(spark, sf_dir).where("known <= 120"), _flips(spark, sf_dir).where("t <= 120")
    return structure.current_roles(levels, flips).select("sid", "source", "bar", "price", "known", "role", "since")


@query(f"""WITH RECURSIVE {sql.STRUCTURE}, cur AS (SELECT share, max(segment) AS segment FROM b GROUP BY 1), l AS (SELECT b.share, b.segment, b.sid, max(b.i) AS last, arg_max(b.c, b.i) AS close FROM b JOIN cur USING (share, segment) GROUP BY 1, 2, 3)
SELECT l.share, l.segment, l.last, l.close, (SELECT arg_max(state, i) FROM walk w WHERE w.sid = l.sid AND i >= 0) AS state, (SELECT count(*) FROM sw WHERE sw.sid = l.sid) AS swings, (SELECT count(*) FROM brk WHERE brk.sid = l.sid) AS breaks FROM l""")
def share_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current segment of each share: its last bar, trend state and how much structure it has."""
    return structure.overview(_bars(spark, sf_dir), _states(spark, sf_dir), _swings(spark, sf_dir), _breaks(spark, sf_dir))


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(spark, sf_dir, "specs", lambda: patterns.candidates(_swings(spark, sf_dir), _fine(spark, sf_dir), _bars(spark, sf_dir)))


def _life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(spark, sf_dir, "life", lambda: lifecycle.events(_specs(spark, sf_dir), _bars(spark, sf_dir)))


_ROUNDED = ", ".join(f"round({c}, 3) AS {c}" for c in ("c_value", "c_slope", "x_value", "x_slope", "stop", "height", "target"))


@query(f"WITH RECURSIVE {shapes.SPECS} SELECT sid, family, type, direction, first_bar, last_bar, known, c_at, x_at, {_ROUNDED}, wait, deadline, failed FROM found WHERE family <> 'cup_handle' OR known IS NOT NULL")
def pattern_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every family with the first rule it fails."""
    rounded = [F.round(c, 3).alias(c) for c in ("c_value", "c_slope", "x_value", "x_slope", "stop", "height", "target")]
    return _specs(spark, sf_dir).select("sid", "family", "type", "direction", "first_bar", "last_bar", "known", "c_at", "x_at", *rounded, "wait", "deadline", "failed")


@query(f"WITH RECURSIVE {shapes.SPECS} SELECT family, coalesce(failed, 'VALID') AS failed, count(*) AS n FROM found GROUP BY 1, 2")
def pattern_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.tally(_specs(spark, sf_dir))


@query(f"WITH RECURSIVE {shapes.LIFE} SELECT sid, family, type, direction, first_bar, last_bar, known, status, eat AS at, side, round(level, 3) AS level, round(near, 3) AS near, outcome, outcome_at FROM life")
def pattern_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every valid pattern: breakout, invalidation or expiry, then failure or the measured move."""
    x = _life(spark, sf_dir)
    return x.select("sid", "family", "type", "direction", "first_bar", "last_bar", "known", "status", "at", "side", F.round("level", 3).alias("level"), F.round("near", 3).alias("near"), "outcome", "outcome_at")


_PBE = "'PBE-' || substr(sha256(concat_ws('|', sid, type, direction, first_bar, last_bar, known, eat)), 1, 32)"


@query(f"WITH RECURSIVE {shapes.LIFE} SELECT {_PBE} AS event_id, sid, family, type, status, eat AS at, side, round(level, 3) AS level FROM life WHERE side IS NOT NULL")
def pattern_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = _life(spark, sf_dir).where("side is not null").withColumn("event_id", F.concat(F.lit("PBE-"), F.substring(F.sha2(F.concat_ws("|", *lifecycle.KEY, "at"), 256), 1, 32)))
    return event.select("event_id", "sid", "family", "type", "status", "at", "side", F.round("level", 3).alias("level"))


@query(f"WITH RECURSIVE {shapes.LIFE}, broken AS (SELECT {_PBE} AS event_id, sid, side, eat AS t, c_at, c_value, c_slope, CASE WHEN outcome = 'FAILED' THEN outcome_at END AS reversal, 8 AS win FROM life WHERE side IS NOT NULL), {shapes.follow('broken')}")
def breakout_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retests and reversals after the breakouts of patterns."""
    return lifecycle.follow_ups(lifecycle.breakouts(_life(spark, sf_dir)), _bars(spark, sf_dir))


@query(f"""WITH RECURSIVE {sql.LEVELS}, bp AS (SELECT sid, i, h::DOUBLE AS h, l::DOUBLE AS l, c::DOUBLE AS c, atr FROM bb),
broken AS (SELECT 'LBE-' || substr(sha256(concat_ws('|', sid, source, bar, known, t)), 1, 32) AS event_id, sid, CASE role WHEN 'SUPPORT' THEN 1 ELSE -1 END AS side, t, bar AS c_at, price AS c_value, 0.0 AS c_slope, lead(t) OVER (PARTITION BY sid, source, bar, price, known ORDER BY t) AS reversal, 3 AS win FROM flip), {shapes.follow('broken')}""")
def level_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retests and reversals after levels changed their role."""
    return lifecycle.follow_ups(lifecycle.level_breakouts(_flips(spark, sf_dir)), _bars(spark, sf_dir))


@query(f"""WITH {sql.DAILY}, g AS (SELECT *, lag(c) OVER (PARTITION BY sid ORDER BY day) AS before FROM dd),
r AS (SELECT sid, ln(o / before::DOUBLE) AS g, row_number() OVER (PARTITION BY sid ORDER BY day DESC) AS r FROM g WHERE before > 0),
m AS (SELECT sid, g, quantile_cont(g, 0.5) OVER (PARTITION BY sid) AS m FROM r WHERE r <= 250)
SELECT sid, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(1.4826 * quantile_cont(abs(g - m), 0.5), 10) END AS sigma FROM m GROUP BY sid""")
def robust_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.robust_sigma(quality.gaps(_daily(spark, sf_dir))).withColumn("sigma", F.round("sigma", 10))


@query(f"""WITH {sql.DAILY}, s AS (SELECT day, row_number() OVER (ORDER BY day) AS session FROM (SELECT DISTINCT day FROM dd)),
y AS (SELECT sid, lag(day) OVER w AS before, day, session - lag(session) OVER w - 1 AS missed FROM dd JOIN s USING (day) WINDOW w AS (PARTITION BY sid ORDER BY day))
SELECT sid, before, day, missed FROM y WHERE missed > 3""")
def trading_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.trading_gaps(_daily(spark, sf_dir), 3)


@query(f"""WITH {sql.DAILY}, g AS (SELECT *, o / lag(c) OVER (PARTITION BY sid ORDER BY day)::DOUBLE - 1 AS gap, row_number() OVER (PARTITION BY sid ORDER BY day) AS k FROM dd),
f AS (SELECT *, CASE WHEN k = 1 THEN 'FIRST_SESSION' WHEN abs(gap) > 0.0008 THEN CASE WHEN gap > 0 THEN 'GAP_UP' ELSE 'GAP_DOWN' END END AS cause FROM g),
p AS (SELECT *, count(cause) OVER (PARTITION BY sid ORDER BY day ROWS UNBOUNDED PRECEDING) AS part FROM f)
SELECT sid, min(day) AS start, max(day) AS "end", count(*) AS sessions, max(cause) AS cause FROM p GROUP BY sid, part""")
def continuity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    found = quality.gaps(d).where(F.abs("gap") > 0.0008).select("sid", "day", F.when(F.col("gap") > 0, "GAP_UP").otherwise("GAP_DOWN").alias("code"))
    return quality.segments(d, found)


@query(f"""WITH {sql.DAILY}, p AS (SELECT sid, min(day) AS lo, max(day) AS hi, count(DISTINCT day) AS traded FROM dd GROUP BY sid), s AS (SELECT DISTINCT day FROM dd)
SELECT sid, count(*) AS expected, traded - 0 AS traded, round((count(*) - traded) / count(*)::DOUBLE, 9) AS ratio, CASE WHEN (count(*) - traded) / count(*)::DOUBLE > 0.02 THEN 'WARN' ELSE 'PASS' END AS status
FROM p JOIN s ON s.day BETWEEN lo AND hi GROUP BY sid, traded""")
def missing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_sessions(_daily(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@query("""WITH t AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 AS BIGINT) - 20 AS o, CAST(round(l_extendedprice * 100) AS BIGINT) % 977 AS h, CAST(round(l_extendedprice * 100) AS BIGINT) % 500 - 5 AS l, CAST(round(l_extendedprice * 100) AS BIGINT) % 700 AS c, CAST(l_quantity AS BIGINT) - 2 AS v
  FROM lineitem),
p AS (SELECT *, CASE WHEN least(o, h, l, c) <= 0 THEN 'NON_POSITIVE_PRICE' WHEN v < 0 THEN 'NEGATIVE_VOLUME' WHEN h < l OR h < greatest(o, c) OR l > least(o, c) THEN 'INVALID_OHLC' END AS reason FROM t)
SELECT coalesce(reason, 'ACCEPTED') AS reason, count(*) AS n, count(DISTINCT l_suppkey) AS shares FROM p GROUP BY 1""")
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.round(F.col("l_extendedprice") * 100).cast("long")
    text = {"o": k % 1000 - 20, "h": k % 977, "l": k % 500 - 5, "c": k % 700}
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", *[quality.price(v.cast("string")).alias(n) for n, v in text.items()], (F.col("l_quantity").cast("long") - 2).alias("v"))
    return t.groupBy(F.coalesce(quality.problem(*"ohlcv"), F.lit("ACCEPTED")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("shares"))


@query("""WITH p AS (SELECT p_partkey, 'IN' || chr((65 + p_partkey % 26)::INT) || lpad(((p_partkey * 7919) % 100000000)::VARCHAR, 8, '0') AS code FROM part),
d AS (SELECT p_partkey, code, array_to_string(list_transform(string_split(code, ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE (ascii(x) - 55)::VARCHAR END), '') AS digits FROM p),
s AS (SELECT p_partkey, code, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN (substr(digits, length(digits) - i + 1, 1)::INT * 2) // 10 + (substr(digits, length(digits) - i + 1, 1)::INT * 2) % 10 ELSE substr(digits, length(digits) - i + 1, 1)::INT END)) AS total FROM d)
SELECT p_partkey, code, ((10 - total % 10) % 10)::INT AS digit FROM s""")
def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("IN"), F.char(65 + F.col("p_partkey") % 26), F.lpad(((F.col("p_partkey") * 7919) % 100000000).cast("string"), 8, "0"))
    p = table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))
    return p.select("p_partkey", "code", quality.check_digit(F.col("code")).cast("int").alias("digit"))


@query(f"""WITH {sql.DAILY}, f AS (SELECT sid, day, (1 + sid % 3) AS num, (2 + sid % 5) AS den FROM dd QUALIFY row_number() OVER (PARTITION BY sid ORDER BY day) % 50 = 0),
xx AS (
  SELECT d.sid, d.day, d.c, f.num, f.den, count(f.day) AS k FROM dd d LEFT JOIN f ON f.sid = d.sid AND f.day > d.day GROUP BY ALL),
y AS (SELECT sid, day, c, max(k) AS k, max(num) AS num, max(den) AS den FROM xx GROUP BY sid, day, c),
z AS (SELECT sid, day, c, k, CASE WHEN k = 0 THEN 1::HUGEINT ELSE (num::HUGEINT ** k)::HUGEINT END AS n, CASE WHEN k = 0 THEN 1::HUGEINT ELSE (den::HUGEINT ** k)::HUGEINT END AS d FROM y),
q AS (SELECT *, (c::HUGEINT * 10000 * n) // d AS w, (c::HUGEINT * 10000 * n) % d AS r FROM z)
SELECT sid, day, k AS events, CAST((w + CASE WHEN 2 * r > d OR (2 * r = d AND w % 2 = 1) THEN 1 ELSE 0 END) AS DECIMAL(38, 0)) AS micros FROM q""")
def adjusted_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes in hundredths, adjusted by the exact product of later factors, as whole millionths."""
    d = _daily(spark, sf_dir)
    w = Window.partitionBy("sid").orderBy("day")
    event = (F.row_number().over(w) % 50 == 0).cast("long")
    later = F.coalesce(F.sum("event").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    x = d.withColumn("event", event).withColumn("events", later)
    num, den = quality.power(1 + F.col("sid") % 3, "events"), quality.power(2 + F.col("sid") % 5, "events")
    price = (F.col("c").cast("decimal(18,0)") / 100).cast("decimal(18,4)")
    return x.select("sid", "day", "events", (quality.adjusted(price, num, den) * 1000000).cast("decimal(38,0)").alias("micros"))


@query("""SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, e.event_id, e.ts AS matched_at, e.value
FROM orders o ASOF LEFT JOIN (SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value, ts FROM events GROUP BY user_id, ts) e ON e.user_id = o.o_custkey AND e.ts <= o.o_orderdate + INTERVAL 9000 DAY""")
def as_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.expr("o_orderdate + INTERVAL 9000 DAYS").alias("at"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("o_custkey"), F.col("ts").alias("at")).agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    return joins.as_of(o, e, "o_custkey", "at", ["event_id", "value"]).drop("at")


@query(f"""WITH {sql.DAILY}, e AS (SELECT DISTINCT l_suppkey AS sid, CAST(o_orderdate AS DATE) AS day FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT e.sid, e.day, d.day AS matched_at, d.o FROM e ASOF LEFT JOIN dd d ON d.sid = e.sid AND d.day >= e.day""")
def next_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("sid"), F.to_date("o_orderdate").alias("day")).distinct()
    return joins.as_of(e, _daily(spark, sf_dir).select("sid", "day", "o"), "sid", "day", ["o"], forward=True)


@query("""WITH s AS (SELECT DISTINCT o_custkey AS key, o_orderpriority AS value, CAST(o_orderdate AS DATE) AS day FROM orders),
n AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 180 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY key, value ORDER BY day)),
i AS (SELECT *, sum(new) OVER (PARTITION BY key, value ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT key, value, min(day) AS since, max(day) AS until, count(*) AS n FROM i GROUP BY key, value, island""")
def identifier_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.to_date("o_orderdate").alias("day"))
    return quality.spans(seen, 180)


@query("""WITH s AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS since, max(CAST(o_orderdate AS DATE)) AS until FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, CAST(o.o_orderdate AS DATE) AS day, s.since, s.until FROM orders o JOIN s ON s.o_custkey = o.o_custkey AND CAST(o.o_orderdate AS DATE) BETWEEN s.since - 30 AND s.until + 30""")
def holders_with_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    s = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("day").alias("since"), F.max("day").alias("until"))
    return joins.within(o.drop("o_orderstatus"), s, "o_custkey", "day", "since", "until", 30)


@query("""WITH a AS (SELECT * FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'ADDED' WHEN b.p_partkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change, CASE WHEN a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL THEN 'p_size' ELSE '' END AS fields
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size IS DISTINCT FROM b.p_size""")
def reissued_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    new = p.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return joins.changes(p.where("p_partkey % 10 <> 0"), new, ["p_partkey"], ["p_brand", "p_size"])


@query("""WITH c AS (SELECT c_custkey, c_name, c_acctbal >= 0 AS active, c_custkey::VARCHAR AS symbol, (c_custkey * 7 + 2)::VARCHAR AS past FROM customer),
s AS (SELECT c_custkey, symbol, active, CASE WHEN symbol = '100' THEN 0 WHEN past = '100' THEN 1 WHEN symbol LIKE '100%' THEN 2 WHEN past LIKE '100%' THEN 3 WHEN c_name LIKE '%100%' THEN 4 END AS score FROM c)
SELECT c_custkey, symbol, active, score FROM s WHERE score IS NOT NULL ORDER BY score, active DESC, symbol LIMIT 50""")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 matches of a text: by score, active ones first, then by symbol."""
    c = table(spark, sf_dir, "customer").withColumns({"symbol": F.col("c_custkey").cast("string"), "active": F.col("c_acctbal") >= 0})
    past = F.array((F.col("c_custkey") * 7 + 2).cast("string"))
    x = c.withColumn("score", joins.search_score("100", F.col("symbol"), past, F.col("c_name"))).where("score is not null")
    return x.orderBy("score", F.col("active").desc(), "symbol").limit(50).select("c_custkey", "symbol", "active", "score")


@query("SELECT c_custkey, sha256('v1|' || c_custkey) AS digest FROM customer ORDER BY digest LIMIT 32")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat(F.lit("v1|"), F.col("c_custkey").cast("string")), 256).alias("digest"))
    return c.orderBy("digest").limit(32)


@query("""SELECT event_type, event_id, ts, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events) WHERE place BETWEEN 51 AND 100""")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.page(table(spark, sf_dir, "events"), [F.col("ts"), F.col("event_id")], 1, 50, "event_type").select("event_type", "event_id", "ts", "place")


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c, count(*) AS n FROM events GROUP BY 1, 2""")
def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(spark, sf_dir)


@query("""SELECT c_custkey AS id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("c_custkey").alias("id"))
    o = table(spark, sf_dir, "orders")
    return c.intersect(o.select("o_custkey")).subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("""SELECT l_suppkey AS sid, year(l_shipdate)::INT AS y, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1, 2""")
def price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sid"), F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


def _all() -> None:
    """The modules that build on the tables here register their queries when they are imported."""
    from plumbline.plans import attention, live, published, support, surroundings  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
