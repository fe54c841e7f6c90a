"""Queries of trendlines over their life and of zones with their tests and strength."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import evidence, lines, structure, zones
from plumbline.plans import catalogue, sql
from plumbline.plans.registry import query
from plumbline.sources.store import materialised

_LINES = f"""{sql.SWINGS},
p AS MATERIALIZED (
  SELECT x.sid, x.kind, x.bar AS a, y.bar AS b, x.price AS value, (y.price - x.price) / (y.bar - x.bar) AS slope, greatest(x.known, y.known) AS made, x.known AS ka, y.known AS kb, CASE x.kind WHEN 'LOW' THEN 1 ELSE -1 END AS up
  FROM sw x JOIN sw y ON x.sid = y.sid AND x.kind = y.kind AND y.bar BETWEEN x.bar + 4 AND x.bar + 104 WHERE (y.price - x.price) * CASE x.kind WHEN 'LOW' THEN 1 ELSE -1 END > 0),
n AS MATERIALIZED (
  SELECT p.*, s.bar AS z, s.known AS zk, (s.price - p.value - p.slope * (s.bar - p.a)) * p.up / s.atr AS away FROM p JOIN sw s ON s.sid = p.sid AND s.kind = p.kind AND s.bar > p.a AND s.bar <> p.b AND s.atr > 0),
bad AS (SELECT DISTINCT sid, kind, a, b FROM n WHERE z < b AND zk <= made AND away < -0.5),
brk0 AS (SELECT p.sid, p.kind, p.a, p.b, min(bb.i) AS broken FROM p JOIN bb ON bb.sid = p.sid AND bb.i >= p.a AND (bb.c - p.value - p.slope * (bb.i - p.a)) * p.up < -0.1 * coalesce(bb.atr, 0) GROUP BY ALL),
good AS MATERIALIZED (SELECT p.*, brk0.broken FROM p LEFT JOIN brk0 USING (sid, kind, a, b) ANTI JOIN bad USING (sid, kind, a, b) WHERE broken IS NULL OR broken > made),
tch AS MATERIALIZED (
  SELECT g.sid, g.kind, g.a, g.b, n.z, n.zk FROM good g JOIN n ON n.sid = g.sid AND n.kind = g.kind AND n.a = g.a AND n.b = g.b WHERE abs(away) <= 0.5 AND (broken IS NULL OR zk < broken)
  UNION ALL SELECT sid, kind, a, b, a, ka FROM good UNION ALL SELECT sid, kind, a, b, b, kb FROM good),
val AS MATERIALIZED (
  SELECT g.*, x.validated, x.touches, x.last_touch, row_number() OVER (PARTITION BY g.sid, g.kind ORDER BY validated, g.a, g.b) AS r
  FROM good g JOIN (SELECT g.sid, g.kind, g.a, g.b, greatest(any_value(g.made), min(zk) FILTER (z <> g.a AND z <> g.b AND zk - g.a <= 104)) AS validated, count(*) AS touches, max(zk) AS last_touch, count(*) FILTER (z <> g.a AND z <> g.b AND zk - g.a <= 104) AS timely
    FROM good g JOIN tch USING (sid, kind, a, b) GROUP BY g.sid, g.kind, g.a, g.b) x ON x.sid = g.sid AND x.kind = g.kind AND x.a = g.a AND x.b = g.b WHERE timely > 0),
same AS MATERIALIZED (
  SELECT sid, kind, r, list(DISTINCT o_r) AS others FROM (
    SELECT m.sid, m.kind, m.r, o.r AS o_r FROM val m JOIN tch t ON t.sid = m.sid AND t.kind = m.kind AND t.a = m.a AND t.b = m.b AND t.zk <= m.validated
    JOIN tch u ON u.sid = m.sid AND u.kind = m.kind AND u.z = t.z JOIN val o ON o.sid = u.sid AND o.kind = u.kind AND o.a = u.a AND o.b = u.b
    WHERE o.r < m.r AND (o.broken IS NULL OR o.broken > m.validated) GROUP BY m.sid, m.kind, m.r, o.r HAVING count(*) >= 2) GROUP BY sid, kind, r),
fold(sid, kind, r, gone) AS (
  SELECT DISTINCT sid, kind, 0::BIGINT, []::BIGINT[] FROM val
  UNION ALL
  SELECT v.sid, v.kind, v.r, CASE WHEN len(list_filter(coalesce(s.others, []), lambda o: NOT list_contains(f.gone, o))) > 0 THEN list_append(f.gone, v.r) ELSE f.gone END
  FROM fold f JOIN val v ON v.sid = f.sid AND v.kind = f.kind AND v.r = f.r + 1 LEFT JOIN same s ON s.sid = v.sid AND s.kind = v.kind AND s.r = v.r),
kept AS MATERIALIZED (
  SELECT v.* FROM val v JOIN (SELECT sid, kind, arg_max(gone, r) AS gone FROM fold GROUP BY 1, 2) f ON f.sid = v.sid AND f.kind = v.kind WHERE NOT list_contains(f.gone, v.r))"""

_RVOL = """vo AS (SELECT sid, i, v, h, l, c, atr, CASE WHEN count(v) OVER p = 20 THEN avg(v) OVER p END AS base, CASE WHEN count(*) OVER a50 = 50 THEN avg(c) OVER a50 END AS s50, CASE WHEN count(*) OVER a200 = 200 THEN avg(c) OVER a200 END AS s200
  FROM bb WINDOW p AS (PARTITION BY sid ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a50 AS (PARTITION BY sid ORDER BY i ROWS 49 PRECEDING), a200 AS (PARTITION BY sid ORDER BY i ROWS 199 PRECEDING)),
ind AS MATERIALIZED (SELECT *, CASE WHEN base > 0 THEN v / base END AS rvol FROM vo)"""

_ZONES = f"""{sql.LEVELS}, {_RVOL},
leg AS (SELECT sid, bar, price, atr, lag(price) OVER w AS anchor, lag(bar) OVER w AS anchor_bar, greatest(known, lag(known) OVER w) AS known FROM sw WINDOW w AS (PARTITION BY sid ORDER BY bar, kind)),
ok AS (SELECT * FROM leg WHERE anchor IS NOT NULL AND abs(price - anchor) >= 2.0 * atr),
lst AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY sid ORDER BY known DESC, bar DESC) = 1),
act AS (SELECT * FROM lst WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sid = lst.sid AND b.i >= lst.known AND (b.c < least(anchor, price) OR b.c > greatest(anchor, price)))),
fin AS MATERIALIZED (SELECT sid, i AS last, c::DOUBLE AS c, atr, s50, s200 FROM ind QUALIFY i = max(i) OVER (PARTITION BY sid)),
src0 AS (
  SELECT lv.sid, CASE source WHEN 'SWING' THEN 'SWING' ELSE 'STRUCTURE' END AS type, source, bar, price, known, CASE source WHEN 'SWING' THEN bar ELSE known END AS pos, source = 'SWING' AND coalesce(ind.rvol >= 1.5, false) AS heavy FROM lv LEFT JOIN ind ON ind.sid = lv.sid AND ind.i = lv.bar
  UNION ALL SELECT sid, 'DYNAMIC', 'sma50', NULL, s50, last, last, false FROM fin WHERE s50 IS NOT NULL
  UNION ALL SELECT sid, 'DYNAMIC', 'sma200', NULL, s200, last, last, false FROM fin WHERE s200 IS NOT NULL
  UNION ALL SELECT sid, 'FIBONACCI', r.name, bar, price - r.x * (price - anchor), known, bar, false FROM act, (VALUES ('r382', 0.382), ('r500', 0.5), ('r618', 0.618)) r(name, x)),
src AS MATERIALIZED (SELECT s.*, f.last, f.c, f.atr, row_number() OVER (PARTITION BY s.sid ORDER BY s.price, s.known, s.source, s.bar) AS k FROM src0 s JOIN fin f ON f.sid = s.sid WHERE f.atr IS NOT NULL),
cl(sid, k, zone, total, n) AS (
  SELECT sid, k, 1, price, 1 FROM src WHERE k = 1
  UNION ALL
  SELECT s.sid, s.k, CASE WHEN abs(s.price - z.total / z.n) <= 0.5 * s.atr THEN zone ELSE zone + 1 END, CASE WHEN abs(s.price - z.total / z.n) <= 0.5 * s.atr THEN z.total + s.price ELSE s.price END, CASE WHEN abs(s.price - z.total / z.n) <= 0.5 * s.atr THEN n + 1 ELSE 1 END
  FROM cl z JOIN src s ON s.sid = z.sid AND s.k = z.k + 1),
mem AS MATERIALIZED (SELECT src.*, cl.zone FROM src JOIN cl ON cl.sid = src.sid AND cl.k = src.k),
ag AS (SELECT sid, zone, min(price) AS lo, max(price) AS hi, count(*) AS members, count(DISTINCT type) + max(heavy::INT) AS types, min(known) AS since, max(known) AS known, max(pos) AS pos, any_value(last) AS last, any_value(c) AS c, any_value(atr) AS atr FROM mem GROUP BY 1, 2),
wide AS (SELECT *, lo - greatest(0, 0.25 * atr - (hi - lo)) / 2 AS low, hi + greatest(0, 0.25 * atr - (hi - lo)) / 2 AS high FROM ag),
sided AS (SELECT *, CASE WHEN (low + high) / 2 <= c THEN 'SUPPORT' ELSE 'RESISTANCE' END AS side, greatest(0, low - c, c - high) AS distance FROM wide),
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, side ORDER BY distance, low) AS place FROM sided) WHERE place <= 4),
tn AS (SELECT m.sid, m.zone, max(flip.t) AS turned FROM mem m JOIN flip ON flip.sid = m.sid AND flip.source = m.source AND flip.bar = m.bar AND flip.price = m.price AND flip.known = m.known GROUP BY 1, 2),
zn AS MATERIALIZED (SELECT near.*, tn.turned, greatest(since, coalesce(turned, since)) + 1 AS start FROM near LEFT JOIN tn USING (sid, zone)),
meet AS (SELECT z.sid, z.zone, b.i, b.rvol, CASE z.side WHEN 'SUPPORT' THEN b.l <= z.high AND b.c >= z.low ELSE b.h >= z.low AND b.c <= z.high END AS hit FROM zn z JOIN ind b ON b.sid = z.sid AND b.i >= z.start),
firsts AS (SELECT *, hit AND NOT coalesce(lag(hit) OVER (PARTITION BY sid, zone ORDER BY i), false) AS first FROM meet),
tests AS (SELECT sid, zone, sum(first::INT)::BIGINT AS touches, max(CASE WHEN first THEN i END) AS last_test, max(rvol) AS rvol FROM firsts WHERE hit GROUP BY 1, 2),
full_zone AS (SELECT z.*, coalesce(t.touches, 0) AS touches, t.last_test, coalesce(t.rvol, 0) AS rvol, exp(-(z.last - coalesce(t.last_test, greatest(pos, coalesce(turned, pos)))) / 26.0) AS recency FROM zn z LEFT JOIN tests t USING (sid, zone))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(spark, sf_dir, "lines", lambda: lines.life(catalogue._swings(spark, sf_dir), catalogue._bars(spark, sf_dir)))


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        b = catalogue._bars(spark, sf_dir)
        found = zones.sources(catalogue._levels(spark, sf_dir), b, structure.retracements(catalogue._swings(spark, sf_dir), b))
        members = zones.clustered(found, zones.last_bars(b))
        return zones.strengths(zones.tested(zones.nearest(members), members, catalogue._flips(spark, sf_dir), b))

    return materialised(spark, sf_dir, "zones", build)


@query(f"WITH RECURSIVE {_LINES} SELECT sid, kind, a, b, value, round(slope, 6) AS slope, validated AS known, broken, touches, last_touch FROM kept")
def trendline_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trendlines with the bar that validated them, their touches and the close that broke them; of lines that are one, the first."""
    return _lines(spark, sf_dir).withColumn("slope", F.round("slope", 6))


@query(f"""WITH RECURSIVE {_LINES}, e AS (SELECT sid, max(i) AS i, arg_max(c, i)::DOUBLE AS c, arg_max(atr, i) AS atr FROM bb GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY sid, kind ORDER BY last_touch DESC, validated DESC, a, b) AS place FROM kept WHERE broken IS NULL)
SELECT o.sid, kind, a, b, round(value + slope * (e.i - a), 4) AS value, round(abs(e.c - value - slope * (e.i - a)) / e.atr, 6) AS distance, place FROM o JOIN e ON e.sid = o.sid WHERE place <= 2 AND e.atr > 0""")
def active_trendlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two unbroken trendlines of each side that were touched last."""
    x = lines.active(_lines(spark, sf_dir), catalogue._bars(spark, sf_dir))
    return x.select("sid", "kind", "a", "b", F.round("value", 4).alias("value"), F.round("distance", 6).alias("distance"), "place")


@query(f"""WITH RECURSIVE {_LINES}, {_RVOL} SELECT k.sid, k.broken AS t, 'TRENDLINE' AS event, CASE kind WHEN 'LOW' THEN 'DOWN' ELSE 'UP' END AS direction, ind.v AS volume, round(rvol, 6) AS rvol,
CASE WHEN rvol >= 1.5 THEN 'EXPANSION' WHEN rvol <= 0.67 THEN 'CONTRACTION' WHEN rvol IS NOT NULL THEN 'NORMAL' END AS volume_state, CASE WHEN rvol >= 1.5 THEN 'CONFIRMED' WHEN rvol < 0.8 THEN 'CONTRADICTED' WHEN rvol IS NOT NULL THEN 'NEUTRAL' END AS verdict
FROM kept k JOIN ind ON ind.sid = k.sid AND ind.i = k.broken""")
def trendline_break_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the volume of the bar that breaks a trendline confirms the break."""
    return evidence.break_volume(lines.breaks(_lines(spark, sf_dir)), catalogue._bars(spark, sf_dir)).withColumn("rvol", F.round("rvol", 6))


@query(f"WITH RECURSIVE {_ZONES} SELECT sid, side, place, round(low, 4) AS low, round(high, 4) AS high, members, types, turned, start, touches, last_test FROM full_zone")
def zone_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest zones with the tests of each since it was first known or last changed its role."""
    x = _zones(spark, sf_dir)
    return x.select("sid", "side", "place", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "members", F.col("types").cast("long").alias("types"), "turned", "start", "touches", "last_test")


@query(f"WITH RECURSIVE {_ZONES} SELECT sid, side, place, touches, types, round(rvol, 6) AS rvol, round(recency, 6) AS recency, round(1.0 * touches + 1.0 * types + 0.5 * rvol + 2.0 * recency, 6) AS strength, round(distance / atr, 6) AS distance FROM full_zone")
def zone_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strong each of the nearest zones is, with what makes it so."""
    x = _zones(spark, sf_dir)
    return x.select("sid", "side", "place", "touches", F.col("types").cast("long").alias("types"), *[F.round(c, 6).alias(c) for c in ("rvol", "recency", "strength")], F.round(F.col("distance") / F.col("atr"), 6).alias("distance"))
