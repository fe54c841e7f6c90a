"""Queries of identity resolution, over daily rows that line items give.

A supplier is a company with a symbol and an ISIN of its own. Sessions before August 1995 publish no ISINs; some companies change symbol, ISIN
or both, with or without a notice; some rows come twice in a day, and some bear another company's symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import resolution
from plumbline.plans.registry import query
from plumbline.sources.store import once
from plumbline.sources.tables import table

# Written for both engines: they derive the rows alike, the operator resolves them.
_ROWS = """SELECT (CAST(k AS BIGINT) * 100000000 + year(day) * 10000 + month(day) * 100 + day(day)) * 2 + CASE series WHEN 'BE' THEN 1 ELSE 0 END AS id, day, k, series, concat('Company ', CAST(k AS VARCHAR(9))) AS name,
    CASE WHEN day >= DATE '1996-06-01' AND strange = 1 THEN concat('S', CAST(k + 1 AS VARCHAR(9))) WHEN k % 5 = 0 AND day >= DATE '1998-01-01' THEN concat('T', CAST(k AS VARCHAR(9)))
      ELSE concat('S', CAST(k AS VARCHAR(9))) END AS symbol,
    CASE WHEN day >= DATE '1995-08-01' THEN concat('I', lpad(CAST(k AS VARCHAR(9)), 8, '0'), CASE WHEN k % 3 = 0 AND day >= CASE WHEN k % 15 = 0 THEN DATE '1998-01-01' ELSE DATE '1997-07-01' END THEN '028' ELSE '010' END) END AS isin
  FROM (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS k, CASE WHEN l_orderkey % 50 = 0 THEN 'BE' ELSE 'EQ' END AS series,
      max(CASE WHEN l_orderkey % 97 = 0 AND l_suppkey % 4 = 0 THEN 1 ELSE 0 END) AS strange
    FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE), l_suppkey, CASE WHEN l_orderkey % 50 = 0 THEN 'BE' ELSE 'EQ' END)"""
_NOTICES = "SELECT concat('S', CAST(s_suppkey AS VARCHAR(9))) AS old, concat('T', CAST(s_suppkey AS VARCHAR(9))) AS new, DATE '1998-01-01' AS effective FROM {supplier} WHERE s_suppkey % 10 = 0"

# What the rules come to on these rows, in closed form.
_RESOLVED = f"""r AS MATERIALIZED ({_ROWS.replace("{lineitem}", "lineitem")}),
judged AS (SELECT *, count(*) OVER (PARTITION BY k, day) > 1 AS twice, min(k) OVER (PARTITION BY symbol, day) <> max(k) OVER (PARTITION BY symbol, day) AS claimed FROM r),
fine AS MATERIALIZED (SELECT * FROM judged WHERE NOT twice AND NOT claimed),
-- the first accepted row of a second ISIN, and whether its symbol, or the one that a notice ties to it, was the company's within 45 days
turn AS (
  SELECT b.k, b.isin, b.day, (SELECT count(*) > 0 FROM fine a WHERE a.k = b.k AND a.isin IS NOT NULL AND a.day < b.day AND a.day >= b.day - 45
      AND (a.symbol = b.symbol OR (b.k % 10 = 0 AND b.symbol = 'T' || b.k AND a.symbol = 'S' || b.k AND abs(b.day - DATE '1998-01-01') <= 45))) AS linked
  FROM fine b JOIN (SELECT k, min(day) AS day FROM fine WHERE isin LIKE '%028' GROUP BY k) USING (k, day)),
anchor AS (SELECT min(day) AS day FROM r WHERE isin IS NOT NULL),
-- backwards from the anchor: a gap of more than 45 days begins another security
back AS (
  SELECT f.id, f.k, f.day, f.symbol, coalesce(lead(f.day) OVER w, on_anchor.day) AS after
  FROM fine f LEFT JOIN (SELECT k, day FROM fine JOIN anchor USING (day)) on_anchor ON on_anchor.k = f.k WHERE f.isin IS NULL WINDOW w AS (PARTITION BY f.k ORDER BY f.day)),
runs AS (SELECT *, after IS NULL OR after - day > 45 AS starts, sum((after IS NULL OR after - day > 45)::INT) OVER (PARTITION BY k ORDER BY day DESC) AS run FROM back),
old AS (SELECT id, CASE WHEN run = 0 THEN 'ISIN|I' || lpad(k::VARCHAR, 8, '0') || '010' ELSE 'SYMBOL_CONTINUITY|' || symbol || ':' || max(CASE WHEN starts THEN day END) OVER (PARTITION BY k, run) END AS key FROM runs),
res AS MATERIALIZED (
  SELECT j.id, j.k, j.day, j.symbol, j.isin, j.series, CASE WHEN twice THEN 'DUPLICATE_SECURITY_DATE' WHEN claimed THEN 'IDENTITY_CONFLICT' ELSE 'ASSIGNED' END AS outcome,
    CASE WHEN twice OR claimed THEN NULL WHEN j.isin IS NULL THEN old.key WHEN turn.linked THEN 'ISIN|' || replace(j.isin, '028', '010') ELSE 'ISIN|' || j.isin END AS key,
    CASE WHEN twice OR claimed THEN NULL WHEN j.isin IS NULL THEN 'SYMBOL_CONTINUITY' WHEN turn.linked AND turn.day = j.day THEN 'SAME_ISSUER_ISIN' ELSE 'OBSERVED' END AS evidence
  FROM judged j LEFT JOIN old ON old.id = j.id LEFT JOIN turn ON turn.k = j.k AND turn.isin = j.isin),
named AS (SELECT *, 'SEC-' || substr(sha256(key), 1, 20) AS sid FROM res)"""


def daily_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ROWS, lineitem=table(spark, sf_dir, "lineitem"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NOTICES, supplier=table(spark, sf_dir, "supplier"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "isin string, other string")
    return once(spark, sf_dir, "resolved", lambda: resolution.resolved(daily_names(spark, sf_dir), notices(spark, sf_dir), none))


@query(f"WITH {_RESOLVED} SELECT id, CASE WHEN key IS NOT NULL THEN sid END AS sid, outcome, evidence FROM named")
def identity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each daily row's security and the evidence for it, or why it has none."""
    return _resolved(spark, sf_dir).where(F.col("kind") == resolution.ROW).select("id", "sid", "outcome", "evidence")


@query(f"""WITH {_RESOLVED}, v AS (
  SELECT sid, 'ISIN' AS what, isin AS value, day, evidence FROM named WHERE key IS NOT NULL AND isin IS NOT NULL
  UNION ALL SELECT sid, 'SYMBOL', symbol, day, CASE WHEN isin IS NULL THEN evidence ELSE 'OBSERVED' END FROM named WHERE key IS NOT NULL
  UNION ALL SELECT sid, 'SERIES', series, day, 'OBSERVED' FROM named WHERE key IS NOT NULL),
g AS (SELECT *, coalesce(day - lag(day) OVER w > 45, true) AS starts FROM v WINDOW w AS (PARTITION BY sid, what, value, evidence ORDER BY day)),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY sid, what, value, evidence ORDER BY day) AS span FROM g)
SELECT sid, what, value, evidence, min(day) AS since, max(day) AS until FROM n GROUP BY sid, what, value, evidence, span""")
def identity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when to when each security had which ISIN, symbol and series, by which evidence."""
    return _resolved(spark, sf_dir).where((F.col("kind") == resolution.SPAN) & (F.col("what") != "SECURITY")).select("sid", "what", "value", "evidence", "since", "until")


@query(f"""WITH {_RESOLVED} SELECT sid, any_value(split_part(key, '|', 1)) AS basis, min(day) AS first_seen, max(day) AS last_seen, 'Company ' || any_value(k) AS name
FROM named WHERE key IS NOT NULL GROUP BY sid""")
def identity_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The securities: what they are known by, when they were seen and their latest name."""
    x = _resolved(spark, sf_dir).where((F.col("kind") == resolution.SPAN) & (F.col("what") == "SECURITY"))
    return x.select("sid", "basis", F.col("since").alias("first_seen"), F.col("until").alias("last_seen"), "name")


@query(f"""WITH {_RESOLVED} SELECT isin IS NULL AS waits, outcome, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM named WHERE key IS NULL GROUP BY 1, 2""")
def identity_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a security by reason; those without an ISIN are tried again when more is known."""
    rows = daily_names(spark, sf_dir).select("id", F.col("isin").isNull().alias("waits"))
    x = _resolved(spark, sf_dir).where((F.col("kind") == resolution.ROW) & F.col("sid").isNull()).join(rows, "id")
    return x.groupBy("waits", "outcome").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
