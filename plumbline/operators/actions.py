"""Corporate actions: exact factors, their check against the price gap, and adjusted series."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline import config as C
from plumbline.operators import joins


@F.pandas_udf(StringType())
def product(values: pd.Series) -> pd.Series:
    """The exact product of a list of whole numbers, as text of any length; 1 for none."""
    return pd.Series([None if v is None else str(math.prod(int(x) for x in v)) for v in values], dtype=object)


def factor(kind: Column, a: Column, b: Column, close: Column, issue: Column) -> Column:
    """num, den of a component: a split or consolidation from a to b gives b / a, a bonus of a for b held b / (a + b), rights of a for
    b at the issue price the theoretical price by the close: (b * close + a * issue) / ((a + b) * close), 1 if they cost no less.
    All are whole numbers; prices are in hundredths."""

    def pair(num: Column, den: Column) -> Column:
        return F.struct(num.cast("long").alias("num"), den.cast("long").alias("den"))

    rights = F.when(issue >= close, pair(F.lit(1), F.lit(1))).otherwise(pair(b * close + a * issue, (a + b) * close))
    return F.when(kind.isin("SPLIT", "CONSOLIDATION"), pair(b, a)).when(kind == "BONUS", pair(b, a + b)).when(kind == "RIGHTS", rights)


def face_values(days: DataFrame, changes: DataFrame) -> DataFrame:
    """days (sid, day) with face_value: the value before the first later change of changes (sid, ex_date, kind, a, b), the last one's
    new value if none is later; null if a capital reduction is later, for it can't be undone."""
    c = changes.select("sid", F.col("ex_date").alias("day"), F.when(F.col("kind") == "REDUCTION", F.lit(1)).otherwise(0).alias("reduction"), "a", "b")
    after = F.date_sub("day", 1)  # a change counts from its own day on
    later = Window.partitionBy("sid").orderBy(F.col("day").desc())
    c = c.withColumn("spoiled", F.max("reduction").over(later)).groupBy("sid", after.alias("day")).agg(F.max("spoiled").alias("spoiled"), F.min("a").alias("a"))
    now = changes.groupBy("sid").agg(F.max_by("b", "ex_date").alias("now"))
    x = joins.as_of(days.select("sid", "day").distinct(), c, "sid", "day", ["spoiled", "a"], forward=True).join(now, "sid", "left")
    return x.select("sid", "day", F.when(F.col("matched_at").isNull(), F.col("now")).when(F.col("spoiled") == 0, F.col("a")).alias("face_value"))


def decisions(events: DataFrame, daily: DataFrame, sigma: DataFrame) -> DataFrame:
    """sid, boundary, ex_dates, num, den (text), raw_gap, log_factor, tolerance, status of the events (sid, ex_date, kind, num, den).

    Events of one ex-date and kind with different terms are CONFLICTING, those after the last session PENDING. The boundary of an
    event is the first session on or after its ex-date with one before it; events that share it are judged together, by the product of
    their factors. A factor within the tolerance is CONSISTENT if it leaves little of the gap, SUSPECT if it makes it smaller; one
    beyond it is VERIFIED if the rest is within the tolerance, SUSPECT if smaller than the gap. All else is REJECTED.
    """
    terms = events.groupBy("sid", "ex_date", "kind").agg(F.countDistinct("num", "den").alias("n"), F.first("num").alias("num"), F.first("den").alias("den"))
    w = Window.partitionBy("sid").orderBy("day")
    rows = daily.select("sid", "day", "o", F.lag("c").over(w).alias("before"))
    e = joins.as_of(terms.select("sid", F.col("ex_date").alias("day"), "kind", "n", "num", "den"), rows, "sid", "day", ["o", "before"], forward=True)
    e = e.withColumn("class", F.when(F.col("matched_at").isNull(), "PENDING").when(F.col("n") > 1, "CONFLICTING").when(F.col("before").isNull(), "NO_BOUNDARY").otherwise("JUDGED"))
    g = e.groupBy("sid", "class", F.when(F.col("class") == "JUDGED", F.col("matched_at")).otherwise(F.col("day")).alias("boundary"))
    g = g.agg(F.count("*").alias("n_events"), F.sort_array(F.collect_list("num")).alias("nums"), F.sort_array(F.collect_list("den")).alias("dens"), F.sum(F.log(F.col("num") / F.col("den"))).alias("log_factor"), F.first("o").alias("o"), F.first("before").alias("before"))
    g = g.join(sigma.select("sid", "sigma"), "sid", "left").withColumns({"raw_gap": F.log(F.col("o") / F.col("before")), "tolerance": F.greatest(F.lit(C.TOLERANCE), C.SIGMA_MULTIPLE * F.coalesce("sigma", F.lit(0.0)))})
    rest, raw, tol, size = F.abs(F.col("raw_gap") - F.col("log_factor")), F.abs("raw_gap"), F.col("tolerance"), F.abs("log_factor")
    judged = F.when(size <= tol, F.when(rest <= F.least(tol, F.lit(math.log(1.25))), "CONSISTENT").when(rest < raw, "SUSPECT").otherwise("REJECTED")).otherwise(F.when(rest <= tol, "VERIFIED").when(rest < raw, "SUSPECT").otherwise("REJECTED"))
    return g.select("sid", "boundary", "n_events", product("nums").alias("num"), product("dens").alias("den"), "raw_gap", "log_factor", "tolerance", F.when(F.col("class") == "JUDGED", judged).otherwise(F.col("class")).alias("status"))


APPLIED = ("VERIFIED", "CONSISTENT", "SUSPECT")


def series(daily: DataFrame, decided: DataFrame) -> DataFrame:
    """daily (sid, day, c) with num, den (text): the exact product of the applied factors whose boundary is later, next_factor and
    break_before, whether a rejected, conflicting or unquantified action begins the day with a gap beyond its tolerance."""
    later = Window.partitionBy("sid").orderBy(F.col("boundary").desc())
    used = decided.where(F.col("status").isin(*APPLIED)).withColumns({k: F.collect_list(k).over(later) for k in ("num", "den")})
    used = used.select("sid", F.date_sub("boundary", 1).alias("day"), F.col("boundary").alias("next_factor"), product("num").alias("num"), product("den").alias("den"))
    x = joins.as_of(daily.select("sid", "day", "c"), used, "sid", "day", ["next_factor", "num", "den"], forward=True).drop("matched_at")
    broken = decided.where((F.col("status") == "CONFLICTING") | ((F.col("status") == "REJECTED") & (F.abs("raw_gap") > F.col("tolerance")))).select("sid", F.col("boundary").alias("day"), F.lit(True).alias("break_before")).distinct()
    return x.join(broken, ["sid", "day"], "left").select("sid", "day", "c", F.coalesce("num", F.lit("1")).alias("num"), F.coalesce("den", F.lit("1")).alias("den"), "next_factor", F.coalesce("break_before", F.lit(False)).alias("break_before"))
