"""Calendars, statuses, identities and action texts: the record keeping around price bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def derived_calendar(days: DataFrame) -> DataFrame:
    """day, kind: every date between the first and last of days (day); a weekday without data is a holiday, a weekend with data special."""
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    j = every.join(days.distinct().withColumn("open", F.lit(True)), "day", "left")
    weekend = F.weekday("day") >= 5
    kind = F.when(F.col("open") & weekend, "SPECIAL").when(F.col("open"), "SESSION").when(~weekend, "HOLIDAY")
    return j.select("day", kind.alias("kind")).where("kind is not null")


def week_ends(calendar: DataFrame) -> DataFrame:
    """week, last: the last open day of each ISO week."""
    return calendar.where("kind <> 'HOLIDAY'").groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.max("day").alias("last"))


def status(spans: DataFrame, findings: DataFrame) -> DataFrame:
    """sid, usable_from, status of spans (sid, first, last) and findings (sid, day, severity, breaks).

    A FAIL makes a share unusable; a WARN counts from the last break on only.
    """
    f = findings.groupBy("sid").agg(F.max(F.when(F.col("breaks"), F.col("day"))).alias("cut"), F.max((F.col("severity") == "FAIL").cast("int")).alias("fail"), F.max(F.when(F.col("severity") == "WARN", F.col("day"))).alias("warn"))
    j = spans.join(f, "sid", "left")
    usable = F.greatest("first", "cut")
    return j.select("sid", usable.alias("usable_from"), F.when(F.col("fail") == 1, "NOT_USABLE").when(F.col("warn") >= usable, "USABLE_WITH_WARNINGS").otherwise("USABLE").alias("status"))


def listing(seen: DataFrame, sessions: int) -> DataFrame:
    """key, last_seen, state: ACTIVE if seen in the last `sessions` days of all of seen (key, day), else INACTIVE."""
    cutoff = seen.select("day").distinct().orderBy(F.col("day").desc()).limit(sessions).agg(F.min("day").alias("cutoff"))
    last = seen.groupBy("key").agg(F.max("day").alias("last_seen"))
    return last.join(F.broadcast(cutoff)).select("key", "last_seen", F.when(F.col("last_seen") >= F.col("cutoff"), "ACTIVE").otherwise("INACTIVE").alias("state"))


def conflicts(rows: DataFrame, group: list[str], one: str) -> DataFrame:
    """The rows of groups that hold more than one row or more than one value of `one`; all of them, none is picked."""
    w = Window.partitionBy(*group)
    return rows.withColumn("_n", F.count("*").over(w)).withColumn("_v", F.size(F.collect_set(one).over(w))).where("_n > 1").withColumn("reason", F.when(F.col("_v") > 1, "CONFLICT").otherwise("DUPLICATE")).drop("_n", "_v")


def content_hash(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """key, digest: SHA-256 over a key's rows as text in order; the same rows in any partitioning give the same digest."""
    line = F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
    lines = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(key).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("digest"))


#: A number in an action's text.
NUMBER = r"(\d+(?:\.\d+)?)"


def action(subject: Column) -> Column:
    """kind, num, den of a corporate action's text: the factor num / den that earlier prices are multiplied with.

    SPLIT and CONSOLIDATION from a to b: b / a. BONUS a : b (a new for b held): b / (a + b). RIGHTS has terms but
    needs the price. Mergers and the like are UNQUANTIFIED, dividends CASH, meetings NONE, all else UNRECOGNISED.
    """
    s = F.lower(F.trim(F.regexp_replace(subject, r"\s+", " ")))
    split = rf"(?:split|sub-?division)\D{{0,60}}{NUMBER}\D{{0,40}}\bto\b\D{{0,20}}{NUMBER}"
    merge = rf"consolidation\D{{0,60}}{NUMBER}\D{{0,40}}\bto\b\D{{0,20}}{NUMBER}"
    bonus, rights = rf"\bbonus\b\D{{0,40}}{NUMBER}\s*:\s*{NUMBER}", rf"\brights?\b\D{{0,40}}{NUMBER}\s*:\s*{NUMBER}"

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(s, pattern, k).cast("decimal(18,4)")

    def terms(kind: str, num: Column, den: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), num.cast("decimal(20,4)").alias("num"), den.cast("decimal(20,4)").alias("den"))

    none = F.lit(None)
    return (
        F.when(s.rlike(r"demerger|amalgam|\bscheme\b|arrangement|capital reduction"), terms("UNQUANTIFIED", none, none))
        .when(s.rlike(split), terms("SPLIT", part(split, 2), part(split, 1)))
        .when(s.rlike(merge), terms("CONSOLIDATION", part(merge, 2), part(merge, 1)))
        .when(s.rlike(bonus), terms("BONUS", part(bonus, 2), part(bonus, 1) + part(bonus, 2)))
        .when(s.rlike(rights), terms("RIGHTS", part(rights, 1), part(rights, 2)))
        .when(s.rlike(r"\bdividend\b|interest|distribution"), terms("CASH", none, none))
        .when(s.rlike(r"\bagm\b|\begm\b|meeting|buy-?back|closure"), terms("NONE", none, none))
        .otherwise(terms("UNRECOGNISED", none, none))
    )
