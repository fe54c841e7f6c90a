"""Queries of calendars, statuses, identities and action texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import records
from plumbline.plans import sql
from plumbline.plans.registry import query
from plumbline.sources.tables import bars, table, trades, weekly


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))


_DAYS = "d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"
_CALENDAR = f"""{_DAYS}, every AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d),
cal AS (SELECT * FROM (
  SELECT every.day, CASE WHEN d.day IS NOT NULL AND isodow(every.day) >= 6 THEN 'SPECIAL' WHEN d.day IS NOT NULL THEN 'SESSION' WHEN isodow(every.day) < 6 THEN 'HOLIDAY' END AS kind
  FROM every LEFT JOIN d ON d.day = every.day) WHERE kind IS NOT NULL)"""


@query(f"WITH {_CALENDAR} SELECT day, kind FROM cal")
def derived_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.derived_calendar(_order_days(spark, sf_dir))


@query(f"WITH {_CALENDAR} SELECT CAST(date_trunc('week', day) AS DATE) AS week, max(day) AS last FROM cal WHERE kind <> 'HOLIDAY' GROUP BY 1")
def week_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.week_ends(records.derived_calendar(_order_days(spark, sf_dir)))


@query("""WITH s AS (SELECT l_suppkey AS sid, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1),
f AS (SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08 THEN 'FAIL' ELSE 'WARN' END AS severity, l_tax <= 0.0 AS breaks FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09),
g AS (SELECT sid, max(CASE WHEN breaks THEN day END) AS cut, bool_or(severity = 'FAIL') AS fail, max(CASE WHEN severity = 'WARN' THEN day END) AS warn FROM f GROUP BY sid)
SELECT s.sid, greatest(first, coalesce(cut, first)) AS usable_from, CASE WHEN fail THEN 'NOT_USABLE' WHEN warn >= greatest(first, coalesce(cut, first)) THEN 'USABLE_WITH_WARNINGS' ELSE 'USABLE' END AS status FROM s LEFT JOIN g USING (sid)""")
def share_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate")).withColumnRenamed("l_suppkey", "sid")
    spans = li.groupBy("sid").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    severity = F.when((F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.08), "FAIL").otherwise("WARN")
    found = li.where("l_quantity >= 50 and l_discount >= 0.09").select("sid", "day", severity.alias("severity"), (F.col("l_tax") <= 0.0).alias("breaks"))
    return records.status(spans, found)


@query("""WITH s AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day FROM orders), c AS (SELECT min(day) AS cutoff FROM (SELECT DISTINCT day FROM s ORDER BY day DESC LIMIT 200))
SELECT key, max(day) AS last_seen, CASE WHEN max(day) >= any_value(cutoff) THEN 'ACTIVE' ELSE 'INACTIVE' END AS state FROM s, c GROUP BY key""")
def listing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.listing(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day")), 200)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
n AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_suppkey) AS v FROM r GROUP BY 1, 2 HAVING count(*) > 1)
SELECT r.*, CASE WHEN v > 1 THEN 'CONFLICT' ELSE 'DUPLICATE' END AS reason FROM r JOIN n USING (l_orderkey, l_linenumber)""")
def conflicting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return records.conflicts(rows, ["l_orderkey", "l_linenumber"], "l_suppkey")


@query(f"""WITH {sql.BARS} SELECT sid, sha256(string_agg(i || '|' || o || '|' || h || '|' || l || '|' || c || '|' || v, chr(10) ORDER BY i)) AS digest FROM b GROUP BY sid""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.content_hash(weekly(spark, sf_dir), "sid", ["i"], ["i", *"ohlcv"])


_SUBJECT = """CASE p_partkey % 8 WHEN 0 THEN 'Face Value  Split From Rs ' || (p_size * 2) || '/- To Rs ' || p_size || '/-' WHEN 1 THEN 'BONUS ' || p_size || ':' || (p_size % 7 + 1) WHEN 2 THEN 'Rights ' || (p_size % 3 + 1) || ' : ' || p_size || ' @ premium Rs 5'
  WHEN 3 THEN 'Interim Dividend Rs ' || p_size WHEN 4 THEN 'Scheme of arrangement' WHEN 5 THEN 'Consolidation of shares from Re 1 to Rs ' || p_size WHEN 6 THEN 'Annual general meeting' ELSE p_name END"""


@query(f"""WITH s AS (SELECT p_partkey, p_partkey % 8 AS k, p_size, {_SUBJECT} AS subject FROM part)
SELECT p_partkey, subject, CASE k WHEN 0 THEN 'SPLIT' WHEN 1 THEN 'BONUS' WHEN 2 THEN 'RIGHTS' WHEN 3 THEN 'CASH' WHEN 4 THEN 'UNQUANTIFIED' WHEN 5 THEN 'CONSOLIDATION' WHEN 6 THEN 'NONE' ELSE 'UNRECOGNISED' END AS kind,
  CAST(CASE k WHEN 0 THEN p_size WHEN 1 THEN p_size % 7 + 1 WHEN 2 THEN p_size % 3 + 1 WHEN 5 THEN p_size END AS DOUBLE) AS num,
  CAST(CASE k WHEN 0 THEN p_size * 2 WHEN 1 THEN p_size + p_size % 7 + 1 WHEN 2 THEN p_size WHEN 5 THEN 1 END AS DOUBLE) AS den FROM s""")
def action_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SUBJECT).alias("subject"))
    return s.withColumn("a", records.action(F.col("subject"))).select("p_partkey", "subject", "a.kind", F.col("a.num").cast("double").alias("num"), F.col("a.den").cast("double").alias("den"))


@query(f"""WITH {sql.ROWS}, cut AS (SELECT sid, max(day) - 400 AS as_of FROM x GROUP BY sid), y AS (SELECT x.*, as_of FROM x JOIN cut USING (sid) WHERE day <= as_of),
w AS (SELECT sid, week, arg_min(p, rn) AS o, max(p) AS h, min(p) AS l, arg_max(p, rn) AS c, max(day) AS last, any_value(as_of) AS as_of FROM y GROUP BY sid, week)
SELECT sid, week, o, h, l, c, last, week + 6 <= as_of AS is_complete FROM w""")
def weekly_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each share as they were known 400 days before its last trade; the last week may be unfinished."""
    t = trades(spark, sf_dir)
    t = t.join(t.groupBy("sid").agg(F.date_sub(F.max("day"), 400).alias("as_of")), "sid").where("day <= as_of")
    last = t.groupBy("sid", "week").agg(F.max("day").alias("last"), F.first("as_of").alias("as_of"))
    b = bars(t, "week").join(last, ["sid", "week"])
    return b.select("sid", "week", *"ohlc", "last", (F.date_add("week", 6) <= F.col("as_of")).alias("is_complete"))
