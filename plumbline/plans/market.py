"""Queries of exchange files, feeds, corporate actions, findings and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import actions, identity, joins, quality, records
from plumbline.plans import sql
from plumbline.plans.registry import query
from plumbline.sources import exchange
from plumbline.sources.tables import bars, table, trades

# What a line item puts into its day's file; some have one fault. Written for both engines: they derive the texts alike, the operator parses them.
_ITEM = """CAST(round(l_extendedprice * 100) AS BIGINT) AS k, CAST(l_shipdate AS DATE) AS day, l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q"""
_TEXTS = """concat('S', CAST(l_suppkey AS VARCHAR(9))) AS symbol, CASE k % 10 WHEN 0 THEN 'GB' WHEN 1 THEN 'BE' ELSE 'EQ' END AS series, 'IN0000' AS isin,
  concat(CAST(1000 + k % 9000 AS VARCHAR(9)), CASE WHEN k % 97 = 0 THEN '.12345' WHEN k % 89 = 0 THEN 'abc' ELSE '.25' END) AS o,
  concat(CAST(1005 + k % 9000 AS VARCHAR(9)), '.5') AS h, CASE WHEN k % 83 = 0 THEN '99999' ELSE concat(CAST(990 + k % 9000 AS VARCHAR(9)), '') END AS l, concat(CAST(1001 + k % 9000 AS VARCHAR(9)), '') AS c,
  concat(CAST(q AS VARCHAR(9)), CASE WHEN k % 79 = 0 THEN '.5' WHEN k % 7 = 0 THEN '.0' ELSE '' END) AS v"""
_EXPECTED = f"""x AS (SELECT *, dayofyear(day) % 2 = 0 AS legacy, k % 73 = 0 AS late FROM (SELECT {_ITEM} FROM lineitem)),
t AS (SELECT *, {_TEXTS} FROM x),
r AS (SELECT *, series = 'GB' OR (NOT legacy AND k % 71 = 0) AS out_, CASE WHEN k % 67 = 0 THEN 'FIELD_COUNT' WHEN series = 'GB' OR (NOT legacy AND k % 71 = 0) THEN NULL WHEN late THEN 'DATE_MISMATCH' WHEN k % 97 <> 0 AND k % 89 = 0 THEN 'BAD_PRICE' WHEN k % 79 = 0 THEN 'BAD_QUANTITY' WHEN k % 97 = 0 THEN 'PRICE_PRECISION' WHEN k % 83 = 0 THEN 'INVALID_OHLC' END AS fault FROM t),
u AS (SELECT *, CASE WHEN k % 67 = 0 THEN false ELSE out_ END AS scope_out FROM r),
d AS (SELECT *, CASE WHEN fault IS NULL AND NOT scope_out AND sum(CASE WHEN scope_out OR k % 67 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY day, symbol, series) > 1 THEN 'DUPLICATE_ROW' ELSE fault END AS reason FROM u),
e AS (SELECT *, CASE WHEN scope_out THEN 'OUT_OF_SCOPE' WHEN reason IS NULL THEN 'ACCEPTED' ELSE 'QUARANTINED' END AS status FROM d)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lines of daily files in either layout, with a header each."""
    x = table(spark, sf_dir, "lineitem").selectExpr(*_split(_ITEM))
    x = x.selectExpr("*", "dayofyear(day) % 2 = 0 AS legacy", "k % 73 = 0 AS late").selectExpr("*", *[p.strip() for p in _split(_TEXTS)])
    date = F.when(F.col("late"), F.date_add("day", 1)).otherwise(F.col("day"))
    legacy = F.concat_ws(",", "symbol", "series", *"ohlc", "v", F.date_format(date, "dd-MMM-yyyy"), "isin")
    udiff = F.concat_ws(",", F.date_format(date, "yyyy-MM-dd"), F.when(F.col("k") % 71 == 0, "FO").otherwise("CM"), "symbol", "series", *"ohlc", "v", "isin")
    line = F.when(F.col("legacy"), legacy).otherwise(udiff)
    line = F.when(F.col("k") % 67 == 0, F.concat(line, F.lit(",extra"))).otherwise(line)
    name = F.concat(F.lit("F"), F.date_format("day", "yyyyMMdd"))
    no = F.row_number().over(Window.partitionBy("day").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "k"))
    body = x.select(name.alias("file"), F.col("day").alias("file_day"), no.alias("line_no"), line.alias("line"))
    head = F.when(F.col("legacy"), "﻿Symbol,SERIES, OPEN,HIGH,LOW,CLOSE,TOTTRDQTY,TIMESTAMP,ISIN").otherwise("TradDt,Sgmt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol,ISIN")
    return body.unionByName(x.select("day", "legacy").distinct().select(name.alias("file"), F.col("day").alias("file_day"), F.lit(0).alias("line_no"), head.alias("line")))


def _split(columns: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


@query(f"WITH {_EXPECTED} SELECT day AS file_day, status, coalesce(reason, '') AS reason, count(*) AS n FROM e GROUP BY 1, 2, 3")
def daily_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the daily files by status and reason."""
    return exchange.parsed(_lines(spark, sf_dir)).groupBy("file_day", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {_EXPECTED}, g AS (SELECT 'F' || strftime(day, '%Y%m%d') AS file, sum((status <> 'OUT_OF_SCOPE')::BIGINT)::BIGINT AS in_scope, sum((status = 'QUARANTINED')::BIGINT)::BIGINT AS rejected FROM e GROUP BY 1)
SELECT *, CASE WHEN in_scope = 0 OR rejected > 0.05 * in_scope THEN 'QUARANTINED' ELSE 'INGESTED' END AS state FROM g""")
def daily_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with too many rejected rows are quarantined as a whole."""
    return exchange.sessions(exchange.parsed(_lines(spark, sf_dir)))


_FEED = """o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE concat(' S', CAST(o_custkey AS VARCHAR(12)), ' ') END AS symbol, CAST(o_orderdate AS DATE) AS day, o_orderkey % 19 = 0 AS undated, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE concat('Bonus  ', CAST(o_orderkey % 5 + 1 AS VARCHAR(2)), ':1') END AS subject, o_orderkey % 3 AS version"""


@query(f"""WITH x AS (SELECT {_FEED} FROM orders), w AS (SELECT *, date_trunc('month', day) AS win FROM x), l AS (SELECT * FROM w QUALIFY rank() OVER (PARTITION BY win ORDER BY version DESC) = 1),
i AS (SELECT DISTINCT symbol, CASE WHEN undated THEN 'soon' ELSE strftime(day, '%d-%b-%Y') END AS d, day, undated, subject FROM l),
c AS (SELECT sha256('{{"symbol":"' || symbol || '","exDate":"' || d || '","subject":"' || subject || '"}}') AS record_key, nullif(trim(symbol), '') AS symbol, CASE WHEN NOT undated THEN day END AS ex_date, nullif(regexp_replace(trim(subject), ' +', ' ', 'g'), '') AS subject FROM i)
SELECT DISTINCT *, CASE WHEN symbol IS NULL THEN 'NO_SYMBOL' WHEN ex_date IS NULL THEN 'NO_EX_DATE' WHEN subject IS NULL THEN 'NO_SUBJECT' END AS reason FROM c""")
def action_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action feed in JSON: the latest version of each month, each record once, faults by item."""
    x = table(spark, sf_dir, "orders").selectExpr(*_split(_FEED))
    date = F.when(F.col("undated"), "soon").otherwise(F.date_format("day", "dd-MMM-yyyy"))
    item = F.to_json(F.struct("symbol", date.alias("exDate"), "subject"))
    return exchange.feed(x.select(F.trunc("day", "month").alias("window"), F.col("version").alias("downloaded_at"), item.alias("item")))


# Rare line items as actions of a share: small factors that fit the gaps and ones that don't.
_ACTIONS = """acts AS (
  SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) + 1 AS ex_date, CASE WHEN l_orderkey % 2 = 0 THEN 'BONUS' ELSE 'SPLIT' END AS kind, CASE WHEN l_orderkey % 4 = 3 THEN 1 ELSE 998 + l_orderkey % 5 END AS num, CASE WHEN l_orderkey % 4 = 3 THEN 2 ELSE 1000 END AS den
  FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.09)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    x = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_discount >= 0.09")
    return x.select(F.col("l_suppkey").alias("sid"), F.date_add(F.to_date("l_shipdate"), 1).alias("ex_date"), F.when(k % 2 == 0, "BONUS").otherwise("SPLIT").alias("kind"), F.when(k % 4 == 3, 1).otherwise(998 + k % 5).cast("long").alias("num"), F.when(k % 4 == 3, 2).otherwise(1000).cast("long").alias("den"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(trades(spark, sf_dir), "day")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    return actions.decisions(_actions(spark, sf_dir), d, quality.robust_sigma(quality.gaps(d)))


_DECIDED = f"""{sql.DAILY}, {_ACTIONS},
gg AS (SELECT *, lag(c) OVER (PARTITION BY sid ORDER BY day) AS before FROM dd),
rr AS (SELECT sid, ln(o / before::DOUBLE) AS g, row_number() OVER (PARTITION BY sid ORDER BY day DESC) AS r FROM gg WHERE before > 0),
mm AS (SELECT sid, g, quantile_cont(g, 0.5) OVER (PARTITION BY sid) AS m FROM rr WHERE r <= 250),
sg AS (SELECT sid, CASE WHEN count(*) >= 20 THEN 1.4826 * quantile_cont(abs(g - m), 0.5) END AS sigma FROM mm GROUP BY sid),
tm AS (SELECT sid, ex_date, kind, count(DISTINCT (num, den)) AS n, min(num) AS num, min(den) AS den FROM acts GROUP BY 1, 2, 3),
bd AS (SELECT tm.*, d.day AS boundary, d.o, d.before FROM tm ASOF LEFT JOIN gg d ON d.sid = tm.sid AND d.day >= tm.ex_date),
cl AS (SELECT *, CASE WHEN boundary IS NULL THEN 'PENDING' WHEN n > 1 THEN 'CONFLICTING' WHEN before IS NULL THEN 'NO_BOUNDARY' ELSE 'JUDGED' END AS class FROM bd),
jg AS (SELECT sid, class, CASE WHEN class = 'JUDGED' THEN boundary ELSE ex_date END AS boundary, count(*) AS n_events, list_reduce(list(num::HUGEINT), lambda a, b: a * b) AS num, list_reduce(list(den::HUGEINT), lambda a, b: a * b) AS den, sum(ln(num / den::DOUBLE)) AS f, ln(any_value(o) / any_value(before)::DOUBLE) AS raw FROM cl GROUP BY 1, 2, 3),
tl AS (SELECT jg.*, greatest(0.15, 5.0 * coalesce(sigma, 0)) AS tol FROM jg LEFT JOIN sg USING (sid)),
dec AS MATERIALIZED (SELECT sid, boundary, n_events, num, den, raw, f, tol, CASE WHEN class <> 'JUDGED' THEN class
  WHEN abs(f) <= tol THEN CASE WHEN abs(raw - f) <= least(tol, ln(1.25)) THEN 'CONSISTENT' WHEN abs(raw - f) < abs(raw) THEN 'SUSPECT' ELSE 'REJECTED' END ELSE CASE WHEN abs(raw - f) <= tol THEN 'VERIFIED' WHEN abs(raw - f) < abs(raw) THEN 'SUSPECT' ELSE 'REJECTED' END END AS status FROM tl)"""


@query(f"WITH {_DECIDED} SELECT sid, boundary, n_events, CASE WHEN status <> 'CONFLICTING' THEN num::VARCHAR END AS num, CASE WHEN status <> 'CONFLICTING' THEN den::VARCHAR END AS den, CASE WHEN status IN ('PENDING', 'CONFLICTING') THEN NULL ELSE round(raw, 9) END AS raw_gap, round(tol, 9) AS tolerance, status FROM dec")
def action_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of actions against the gap of their boundary session, jointly where they share one."""
    x = _decided(spark, sf_dir)
    clear = F.col("status") != "CONFLICTING"
    return x.select("sid", "boundary", "n_events", F.when(clear, F.col("num")).alias("num"), F.when(clear, F.col("den")).alias("den"), F.when(~F.col("status").isin("PENDING", "CONFLICTING"), F.round("raw_gap", 9)).alias("raw_gap"), F.round("tolerance", 9).alias("tolerance"), "status")


@query(f"""WITH {_DECIDED}, us AS (SELECT * FROM dec WHERE status IN ('VERIFIED', 'CONSISTENT', 'SUSPECT')),
f AS (SELECT dd.sid, dd.day, any_value(dd.c) AS c, list_reduce(list(us.num) FILTER (us.num IS NOT NULL), lambda a, b: a * b) AS num, list_reduce(list(us.den) FILTER (us.den IS NOT NULL), lambda a, b: a * b) AS den, min(us.boundary) AS next_factor FROM dd LEFT JOIN us ON us.sid = dd.sid AND us.boundary > dd.day GROUP BY 1, 2),
br AS (SELECT DISTINCT sid, boundary AS day FROM dec WHERE status = 'CONFLICTING' OR (status = 'REJECTED' AND abs(raw) > tol)),
q AS (SELECT f.*, coalesce(num, 1) AS n, coalesce(den, 1) AS d, br.day IS NOT NULL AS break_before FROM f LEFT JOIN br ON br.sid = f.sid AND br.day = f.day),
r AS (SELECT *, (c::HUGEINT * 10000 * n) // d AS w, (c::HUGEINT * 10000 * n) % d AS rest FROM q)
SELECT sid, day, next_factor, break_before, CAST(w + CASE WHEN 2 * rest > d OR (2 * rest = d AND w % 2 = 1) THEN 1 ELSE 0 END AS DECIMAL(38, 0)) AS micros FROM r""")
def adjusted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes times the exact product of the applied factors of later boundaries, rounded once."""
    x = actions.series(_daily(spark, sf_dir), _decided(spark, sf_dir))
    price = (F.col("c").cast("decimal(18,0)") / 100).cast("decimal(18,4)")
    return x.select("sid", "day", "next_factor", "break_before", (quality.adjusted(price, "num", "den") * 1000000).cast("decimal(38,0)").alias("micros"))


_CHANGES = "SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS ex_date, CASE WHEN l_orderkey % 11 = 0 THEN 'REDUCTION' ELSE 'SPLIT' END AS kind, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) - 40 AS b FROM lineitem WHERE l_quantity >= 45 AND l_discount = 0.1 AND l_tax >= 0.07"


@query(f"""WITH ch AS ({_CHANGES}), d AS (SELECT DISTINCT l_suppkey AS sid, CAST(date_trunc('month', l_shipdate) AS DATE) AS day FROM lineitem),
now AS (SELECT sid, arg_max(b, ex_date) AS now FROM ch GROUP BY 1),
x AS (SELECT d.sid, d.day, min(ex_date) AS nx, max((kind = 'REDUCTION')::INT) AS spoiled FROM d LEFT JOIN ch ON ch.sid = d.sid AND ch.ex_date > d.day GROUP BY 1, 2),
y AS (SELECT x.*, min(ch.a) AS a FROM x LEFT JOIN ch ON ch.sid = x.sid AND ch.ex_date = x.nx GROUP BY ALL)
SELECT y.sid, y.day, CASE WHEN nx IS NULL THEN NULL WHEN spoiled = 0 THEN a END AS face_value FROM y LEFT JOIN now USING (sid) WHERE nx IS NOT NULL""")
def face_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face values of shares on days before a later change, by undoing it."""
    li = table(spark, sf_dir, "lineitem")
    changes = li.where("l_quantity >= 45 and l_discount = 0.1 and l_tax >= 0.07").select(F.col("l_suppkey").alias("sid"), F.to_date("l_shipdate").alias("ex_date"), F.when(F.col("l_orderkey") % 11 == 0, "REDUCTION").otherwise("SPLIT").alias("kind"), F.col("l_quantity").cast("long").alias("a"), (F.col("l_quantity").cast("long") - 40).alias("b"))
    days = li.select(F.col("l_suppkey").alias("sid"), F.trunc(F.to_date("l_shipdate"), "month").alias("day"))
    last = changes.groupBy("sid").agg(F.max("ex_date").alias("last"))
    return actions.face_values(days, changes).join(last, "sid").where("day < last").select("sid", "day", "face_value")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 AND p_retailprice <= 5 * p_size THEN 1 WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN p_size ELSE p_size * CAST(round(p_retailprice * 100) AS BIGINT) + (p_partkey % 4 + 1) * (p_size * 500) END AS num,
  CASE WHEN p_partkey % 3 = 2 AND p_retailprice <= 5 * p_size THEN 1 WHEN p_partkey % 3 = 0 THEN p_size * 2 WHEN p_partkey % 3 = 1 THEN p_size + p_partkey % 4 + 1 ELSE (p_size + p_partkey % 4 + 1) * CAST(round(p_retailprice * 100) AS BIGINT) END AS den FROM part""")
def component_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact factors of splits, bonuses and rights (by the theoretical price)."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "SPLIT").when(F.col("p_partkey") % 3 == 1, "BONUS").otherwise("RIGHTS")
    new = F.col("p_partkey") % 4 + 1
    a = F.when(kind == "SPLIT", F.col("p_size") * 2).otherwise(new)
    close = F.round(F.col("p_retailprice") * 100).cast("long")
    return p.withColumn("f", actions.factor(kind, a, F.col("p_size"), close, F.col("p_size") * 500)).select("p_partkey", "f.num", "f.den")


# Findings of all kinds about a share, from daily bars with limits that this data reaches.
_FINDINGS = f"""{_DECIDED},
gp AS (SELECT *, o / before::DOUBLE - 1 AS gap FROM gg WHERE before > 0),
ms AS (SELECT p.sid, p.hi, (count(*) - traded) / count(*)::DOUBLE AS ratio FROM (SELECT sid, min(day) AS lo, max(day) AS hi, count(DISTINCT day) AS traded FROM dd GROUP BY sid) p JOIN (SELECT DISTINCT day FROM dd) s ON s.day BETWEEN p.lo AND p.hi GROUP BY p.sid, p.hi, traded),
ss AS (SELECT day, row_number() OVER (ORDER BY day) AS session FROM (SELECT DISTINCT day FROM dd)),
tg AS (SELECT sid, day, session - lag(session) OVER (PARTITION BY sid ORDER BY day) - 1 AS missed FROM dd JOIN ss USING (day)),
fi AS MATERIALIZED (
  SELECT sid, boundary AS day, CASE status WHEN 'REJECTED' THEN 'FACTOR_REJECTED' WHEN 'SUSPECT' THEN 'FACTOR_SUSPECT' WHEN 'CONFLICTING' THEN 'FACTOR_CONFLICT' ELSE 'FACTOR_PENDING' END AS code, CASE WHEN status = 'PENDING' THEN 'INFO' ELSE 'WARN' END AS severity, status = 'CONFLICTING' OR (status = 'REJECTED' AND abs(raw) > tol) AS breaks FROM dec WHERE status IN ('REJECTED', 'SUSPECT', 'CONFLICTING', 'PENDING')
  UNION ALL SELECT sid, hi, 'MISSING_SESSIONS', 'WARN', false FROM ms WHERE ratio > 0.02
  UNION ALL SELECT sid, day, 'TRADING_GAP', 'WARN', true FROM tg WHERE missed > 30
  UNION ALL SELECT sid, day, 'UNEXPLAINED_PRICE_DISCONTINUITY', 'WARN', true FROM gp WHERE abs(gap) > 0.0009 AND NOT EXISTS (SELECT 1 FROM dec WHERE dec.sid = gp.sid AND dec.boundary = gp.day)
  UNION ALL SELECT sid, day, 'UNEXPLAINED_MOVE', 'INFO', false FROM gp WHERE abs(gap) > 0.0007 AND abs(gap) <= 0.0009 AND NOT EXISTS (SELECT 1 FROM dec WHERE dec.sid = gp.sid AND dec.boundary = gp.day))"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.findings(_daily(spark, sf_dir), _decided(spark, sf_dir), gap_sessions=30, discontinuity=0.0009, move=0.0007)


@query(f"WITH {_FINDINGS} SELECT sid, day, code, severity, breaks FROM fi")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of actions, missing sessions, trading gaps and unexplained moves."""
    return _found(spark, sf_dir).select("sid", "day", "code", "severity", "breaks")


@query(f"""WITH {_FINDINGS}, s AS (SELECT sid, min(day) AS first FROM dd GROUP BY 1), g AS (SELECT sid, max(CASE WHEN breaks THEN day END) AS cut, max(CASE WHEN severity = 'WARN' THEN day END) AS warn, count(*) AS n FROM fi GROUP BY 1)
SELECT s.sid, greatest(first, coalesce(cut, first)) AS usable_from, CASE WHEN warn >= greatest(first, coalesce(cut, first)) THEN 'USABLE_WITH_WARNINGS' ELSE 'USABLE' END AS status, coalesce(n, 0) AS findings FROM s LEFT JOIN g USING (sid)""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data-quality service: findings, usable window and status of every share."""
    f = _found(spark, sf_dir)
    spans = _daily(spark, sf_dir).groupBy("sid").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return records.status(spans, f).join(f.groupBy("sid").agg(F.count("*").alias("findings")), "sid", "left").select("sid", "usable_from", "status", F.coalesce("findings", F.lit(0)).alias("findings"))


@query(f"WITH {_FINDINGS} SELECT coalesce(code, 'ALL') AS code, coalesce(severity, 'ALL') AS severity, count(*) AS n, count(DISTINCT sid) AS shares FROM fi GROUP BY ROLLUP (code, severity)")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by code and severity, with totals."""
    g = _found(spark, sf_dir).rollup("code", "severity").agg(F.count("*").alias("n"), F.countDistinct("sid").alias("shares"))
    return g.select(F.coalesce("code", F.lit("ALL")).alias("code"), F.coalesce("severity", F.lit("ALL")).alias("severity"), "n", "shares")


@query(f"""WITH {_DECIDED}, us AS (SELECT sid, boundary, exp(f) AS fac FROM dec WHERE status IN ('VERIFIED', 'CONSISTENT', 'SUSPECT')), xg AS (SELECT gg.*, o / before::DOUBLE - 1 AS raw, o / (before * coalesce(fac, 1)) - 1 AS adj, fac IS NOT NULL AS acted FROM gg LEFT JOIN us ON us.sid = gg.sid AND us.boundary = gg.day WHERE before > 0)
SELECT CASE WHEN abs(raw) > 0.0007 AND abs(adj) <= 0.0007 THEN 'RESOLVED' WHEN abs(raw) <= 0.0007 THEN 'NEW' WHEN acted AND abs(adj) > abs(raw) THEN 'WORSENED' WHEN acted THEN 'REDUCED' ELSE 'UNEXPLAINED' END AS class, count(*) AS n FROM xg WHERE abs(raw) > 0.0007 OR abs(adj) > 0.0007 GROUP BY 1""")
def gap_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discontinuities before and after adjustment: resolved, new, worsened, reduced or unexplained."""
    return quality.gap_tally(_daily(spark, sf_dir), _decided(spark, sf_dir), 0.0007)


@query("""WITH s AS (SELECT o_custkey AS key, o_orderpriority AS value, CAST(min(o_orderdate) AS DATE) AS since FROM orders GROUP BY 1, 2), p AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY since, value) AS before FROM s)
SELECT key, before, value, since FROM p WHERE before IS NOT NULL AND before <> value""")
def identifier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one identifier of a share follows another."""
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.to_date("o_orderdate").alias("day"))
    return identity.changes(seen.groupBy("key", "value").agg(F.min("day").alias("since")))


@query("""WITH p AS (SELECT p_partkey, substr(p_name, 1, 9) AS issuer FROM part), n AS (SELECT issuer, min(p_partkey) AS first, count(*) AS n FROM p GROUP BY 1)
SELECT p.p_partkey, n.first AS linked_to FROM p JOIN n USING (issuer) WHERE n.n > 1 AND p.p_partkey <> n.first""")
def issuer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities linked to the first one of the same issuer, by the start of their code."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("isin"))
    return identity.same_issuer(p).select(F.col("id").alias("p_partkey"), "linked_to")


@query("""WITH old AS (SELECT c_custkey AS id, c_nationkey AS code FROM customer), new AS (SELECT c_custkey AS id, c_nationkey AS code FROM customer WHERE c_custkey % 5 <> 0), gone AS (SELECT * FROM old WHERE id NOT IN (SELECT id FROM new))
SELECT gone.id, min(new.id) AS successor, count(new.id) AS candidates FROM gone LEFT JOIN new ON new.code = gone.code AND new.id > gone.id AND new.id <= gone.id + 50 GROUP BY 1""")
def retired_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a rebuild no longer has, with their successors."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("code"))
    return identity.successors(c, c.where("id % 5 <> 0"), 50)


@query("""WITH s AS (SELECT o_custkey AS key, o_orderpriority AS value, CAST(min(o_orderdate) AS DATE) AS since, CAST(max(o_orderdate) AS DATE) AS until FROM orders GROUP BY 1, 2),
n AS (SELECT o_orderkey, o_custkey AS key, o_orderpriority AS old, CAST(o_orderdate AS DATE) AS effective FROM orders)
SELECT n.o_orderkey, a.value AS old, b.value AS new FROM n JOIN s a ON a.key = n.key AND a.value = n.old AND abs(n.effective - a.until) <= 45 JOIN s b ON b.key = n.key AND b.value <> n.old AND abs(b.since - n.effective) <= 45""")
def notice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change notices joined with the old identifier's end and the new one's start, both within 45 days."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.to_date("o_orderdate").alias("day"))
    spans = o.groupBy("key", "value").agg(F.min("day").alias("since"), F.max("day").alias("until"))
    return identity.by_notice(o.select("o_orderkey", "key", F.col("value").alias("old"), F.col("day").alias("effective")), spans, 45).select("o_orderkey", "old", "new")


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'INF' ELSE 'INE' END || lpad(p_partkey::VARCHAR, 4, '0') || CASE p_partkey % 3 WHEN 0 THEN '01' WHEN 1 THEN '20' ELSE '08' END || '015' AS isin FROM part)
SELECT p_partkey, isin, CASE WHEN isin LIKE 'INF%' THEN 'FUND_UNIT' WHEN substr(isin, 8, 2) = '01' THEN 'EQUITY_SHARE' WHEN substr(isin, 8, 2) = '20' THEN 'RIGHTS_ENTITLEMENT' ELSE 'OTHER' END AS kind FROM c""")
def instrument_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of instrument that a code stands for."""
    k = F.col("p_partkey")
    isin = F.concat(F.when(k % 4 == 0, "INF").otherwise("INE"), F.lpad(k.cast("string"), 4, "0"), F.when(k % 3 == 0, "01").when(k % 3 == 1, "20").otherwise("08"), F.lit("015"))
    return table(spark, sf_dir, "part").select("p_partkey", isin.alias("isin")).withColumn("kind", identity.instrument(F.col("isin")))


@query("""WITH e AS (SELECT c_custkey AS id FROM customer), g AS (SELECT DISTINCT o_custkey AS id FROM orders)
SELECT 'MISSING' AS side, count(*) AS n FROM (SELECT id FROM e EXCEPT SELECT id FROM g) UNION ALL SELECT 'EXTRA', count(*) FROM (SELECT id FROM g EXCEPT SELECT id FROM e)""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a result lacks of its universe and has beyond it."""
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return identity.coverage(e, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct())


@query("""WITH m AS (SELECT n_nationkey AS id, n_name AS name FROM nation), s AS (SELECT c_nationkey AS id, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1), g AS (SELECT s_nationkey AS id, max(s_acctbal) AS top FROM supplier GROUP BY 1)
SELECT m.id, m.name, coalesce(s.n, 0) AS n, g.top FROM m LEFT JOIN s USING (id) LEFT JOIN g USING (id)""")
def serving_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master with what is known of each of its rows."""
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    s = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("n"))
    g = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.max("s_acctbal").alias("top"))
    return m.join(s, "id", "left").join(g, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"), "top")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def published_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of what is published."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""WITH x AS (SELECT event_id, ts, value, sha256('click' || '|' || 'v1') AS bound FROM events WHERE event_type = 'click'), p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS place FROM x)
SELECT event_id, value, place, substr(bound, 1, 12) || ':' || place AS cursor FROM p WHERE place BETWEEN 26 AND 50""")
def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of one type's events after the cursor of the first, which is bound to content and predicates."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    bound = joins.cursor("v1", "click", 25)
    return joins.after(e, [F.col("ts"), F.col("event_id")], bound, "v1", "click", 25).select("event_id", "value", "place", "cursor")
