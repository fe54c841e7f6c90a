"""Row validation, price adjustment and data-quality findings."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType

from plumbline import config as C


def price(text: Column) -> Column:
    """A price text as decimal(18,4), null if it is none or has more than four decimals: never rounded."""
    return F.when(text.rlike(r"^-?\d{1,14}(\.\d{1,4})?$"), text.cast("decimal(18,4)"))


def problem(o: str, h: str, l: str, c: str, v: str) -> Column:  # noqa: E741
    """The first structural problem of a bar, in order of precedence; null if there is none."""
    lowest = F.least(o, h, l, c)
    return F.when(F.col(o).isNull() | F.col(h).isNull() | F.col(l).isNull() | F.col(c).isNull(), "PRICE_PRECISION").when(lowest <= 0, "NON_POSITIVE_PRICE").when(F.col(v) < 0, "NEGATIVE_VOLUME").when((F.col(h) < F.col(l)) | (F.col(h) < F.greatest(o, c)) | (F.col(l) > F.least(o, c)), "INVALID_OHLC")


def check_digit(code: Column) -> Column:
    """The Luhn digit of a code of letters and digits; letters count as two digits from 10."""
    digits = F.array_join(F.transform(F.filter(F.split(F.upper(code), ""), lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]"), x).otherwise((F.ascii(x) - 55).cast("string"))), "")
    reverse = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    total = F.aggregate(F.transform(reverse, lambda x, i: F.when(i % 2 == 0, F.floor(x.cast("int") * 2 / 10) + (x.cast("int") * 2) % 10).otherwise(x.cast("int")).cast("int")), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


@F.pandas_udf(DecimalType(24, 6))
def adjusted(value: pd.Series, num: pd.Series, den: pd.Series) -> pd.Series:
    """value * num / den for whole numbers of any length as text, rounded once, half to even, to six decimals."""
    exact = Context(prec=200)
    step = Decimal("0.000001")

    def one(v, n, d):  # noqa: ANN001, ANN202
        if v is None or n is None or d is None:
            return None
        whole, bottom = int(Decimal(v).scaleb(10, exact)) * int(n), int(d)  # values have four decimals
        q, r = divmod(whole, bottom * 10**4)
        half = 2 * r - bottom * 10**4
        q += half > 0 or (half == 0 and q % 2 == 1)
        return exact.multiply(Decimal(q), step).quantize(step, rounding=ROUND_HALF_EVEN, context=exact)

    return pd.Series([one(*x) for x in zip(value, num, den)], dtype=object)


@F.pandas_udf(StringType())
def power(base: pd.Series, exponent: pd.Series) -> pd.Series:
    """base to the exponent, whole numbers, exact and as text of any length."""
    return pd.Series([None if pd.isna(b) or pd.isna(e) else str(int(b) ** int(e)) for b, e in zip(base, exponent)], dtype=object)


def gaps(daily: DataFrame) -> DataFrame:
    """daily (sid, day, o, c) with before (last close), gap (o / before - 1) and log_gap."""
    w = Window.partitionBy("sid").orderBy("day")
    before = F.lag("c").over(w)
    return daily.withColumn("before", before).withColumn("gap", F.when(before > 0, F.col("o") / before - 1)).withColumn("log_gap", F.when(before > 0, F.log(F.col("o") / before)))


def robust_sigma(with_gaps: DataFrame) -> DataFrame:
    """sid, n, sigma: 1.4826 times the median absolute deviation of the last log gaps; null under 20 of them."""
    recent = F.row_number().over(Window.partitionBy("sid").orderBy(F.col("day").desc()))
    x = with_gaps.where("log_gap is not null").withColumn("r", recent).where(F.col("r") <= C.SIGMA_WINDOW)
    middle = x.groupBy("sid").agg(F.expr("percentile(log_gap, 0.5)").alias("m"))
    out = x.join(middle, "sid").groupBy("sid").agg(F.count("*").alias("n"), F.expr("percentile(abs(log_gap - m), 0.5)").alias("mad"))
    return out.select("sid", "n", F.when(F.col("n") >= 20, 1.4826 * F.col("mad")).alias("sigma"))


def trading_gaps(daily: DataFrame, most: int) -> DataFrame:
    """sid, before, day, missed: breaks of more than `most` sessions of the common calendar between two trades."""
    days = daily.select("day").distinct()
    calendar = days.withColumn("session", F.row_number().over(Window.orderBy("day")))  # a row a day: bounded by time, not by data
    w = Window.partitionBy("sid").orderBy("day")
    x = daily.select("sid", "day").join(F.broadcast(calendar), "day").withColumns({"before": F.lag("day").over(w), "missed": F.col("session") - F.lag("session").over(w) - 1})
    return x.where(F.col("missed") > most).select("sid", "before", "day", "missed")


def segments(daily: DataFrame, breaks: DataFrame) -> DataFrame:
    """sid, start, end, sessions, cause: runs of days between breaks (sid, day, code); causes are joined in order."""
    causes = breaks.groupBy("sid", "day").agg(F.array_join(F.sort_array(F.collect_set("code")), "+").alias("cause"))
    w = Window.partitionBy("sid").orderBy("day")
    x = daily.select("sid", "day").join(causes, ["sid", "day"], "left").withColumn("first", F.row_number().over(w) == 1)
    x = x.withColumn("cause", F.when(F.col("first"), "FIRST_SESSION").otherwise(F.col("cause")))
    x = x.withColumn("part", F.count("cause").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("sid", "part").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("sessions"), F.max("cause").alias("cause")).drop("part")


def missing_sessions(daily: DataFrame, most: float = C.MISSING_RATIO) -> DataFrame:
    """sid, expected, traded, ratio, status: sessions of the calendar within each share's span that it did not trade."""
    calendar = daily.select("day").distinct().withColumn("session", F.row_number().over(Window.orderBy("day")))  # a row a day: bounded by time, not by data
    x = daily.select("sid", "day").join(F.broadcast(calendar), "day").groupBy("sid").agg((F.max("session") - F.min("session") + 1).cast("long").alias("expected"), F.countDistinct("day").alias("traded"))
    ratio = (F.col("expected") - F.col("traded")) / F.col("expected")
    return x.select("sid", "expected", "traded", ratio.alias("ratio"), F.when(ratio > most, "WARN").otherwise("PASS").alias("status"))


def spans(seen: DataFrame, gap: int) -> DataFrame:
    """key, value, since, until, n: sightings (key, value, day) merged where they are at most `gap` days apart."""
    w = Window.partitionBy("key", "value").orderBy("day")
    new = F.coalesce(F.datediff("day", F.lag("day").over(w)) > gap, F.lit(True))
    x = seen.distinct().withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("key", "value", "island").agg(F.min("day").alias("since"), F.max("day").alias("until"), F.count("*").alias("n")).drop("island")


def findings(daily: DataFrame, decided: DataFrame, gap_sessions: int = C.GAP_SESSIONS, discontinuity: float = C.MOVE_BREAK, move: float = C.MOVE_WARN) -> DataFrame:
    """sid, day, code, severity, breaks: what is wrong with shares, from daily bars (sid, day, o, c) and their actions' decisions.

    Actions that were refused, doubted or conflict, too many missing sessions, long trading gaps, and jumps of the open over the
    close before that no action's boundary explains: those beyond `discontinuity` break the series, those beyond `move` are told.
    """
    judged = decided.where(F.col("status").isin("REJECTED", "SUSPECT", "CONFLICTING", "PENDING"))
    code = F.when(F.col("status") == "REJECTED", "FACTOR_REJECTED").when(F.col("status") == "SUSPECT", "FACTOR_SUSPECT").when(F.col("status") == "CONFLICTING", "FACTOR_CONFLICT").otherwise("FACTOR_PENDING")
    broken = (F.col("status") == "CONFLICTING") | ((F.col("status") == "REJECTED") & (F.abs("raw_gap") > F.col("tolerance")))
    a = judged.select("sid", F.col("boundary").alias("day"), code.alias("code"), F.when(F.col("status") == "PENDING", "INFO").otherwise("WARN").alias("severity"), F.coalesce(broken, F.lit(False)).alias("breaks"))

    def told(df: DataFrame, name: str, severity: str, breaks: bool) -> DataFrame:
        return df.select("sid", "day", F.lit(name).alias("code"), F.lit(severity).alias("severity"), F.lit(breaks).alias("breaks"))

    last = daily.groupBy("sid").agg(F.max("day").alias("day"))
    lacking = missing_sessions(daily).where("status = 'WARN'").join(last, "sid")
    jumps = gaps(daily).where(F.abs("gap") > move).join(decided.select("sid", F.col("boundary").alias("day")).distinct(), ["sid", "day"], "left_anti")
    big = F.abs("gap") > discontinuity
    return a.unionByName(told(lacking, "MISSING_SESSIONS", "WARN", False)).unionByName(told(trading_gaps(daily, gap_sessions), "TRADING_GAP", "WARN", True)).unionByName(told(jumps.where(big), "UNEXPLAINED_PRICE_DISCONTINUITY", "WARN", True)).unionByName(told(jumps.where(~big), "UNEXPLAINED_MOVE", "INFO", False))


def gap_tally(daily: DataFrame, decided: DataFrame, limit: float) -> DataFrame:
    """class, n: jumps beyond the limit before or after the applied factors: RESOLVED, NEW, WORSENED, REDUCED by them, or UNEXPLAINED."""
    used = decided.where(F.col("status").isin("VERIFIED", "CONSISTENT", "SUSPECT")).select("sid", F.col("boundary").alias("day"), F.exp("log_factor").alias("factor"))
    x = gaps(daily).where("before > 0").join(used, ["sid", "day"], "left")
    x = x.withColumn("adjusted", F.col("o") / (F.col("before") * F.coalesce("factor", F.lit(1.0))) - 1)
    raw, adj, acted = F.abs("gap"), F.abs("adjusted"), F.col("factor").isNotNull()
    kind = F.when((raw > limit) & (adj <= limit), "RESOLVED").when(raw <= limit, "NEW").when(acted & (adj > raw), "WORSENED").when(acted, "REDUCED").otherwise("UNEXPLAINED")
    return x.where((raw > limit) | (adj > limit)).groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
