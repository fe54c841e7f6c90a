"""Reads the star-schema tables and derives price bars from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The order of a supplier's rows; unique.
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, day, week, step, q and the order columns: line items as trades of a supplier's share."""
    step = F.round(F.col("l_extendedprice") * 100).cast("long") % 2001 - 1000
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sid"), F.to_date("l_shipdate").alias("day"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("week"), step.alias("step"), F.col("l_quantity").alias("q"), *ORDER)


def bars(rows: DataFrame, period: str) -> DataFrame:
    """sid, i, `period`, o, h, l, c (bigint), v, n, since, until: bars of the price 1000000 + running sum of step.

    Running sums start anew in each (sid, period), so that a supplier with many rows is spread over its periods;
    a window over the few bars then adds what came before.
    """
    inside = Window.partitionBy("sid", period).orderBy(*ORDER)
    run = rows.select("sid", *{period, "day"}, "q", "step", F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.row_number().over(inside).alias("rn"))
    bar = run.groupBy("sid", period).agg(F.min_by("p", "rn").alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", "rn").alias("c"), F.sum("q").cast("long").alias("v"), F.count("*").alias("n"), F.min("day").alias("since"), F.max("day").alias("until"))
    order = Window.partitionBy("sid").orderBy(period)
    before = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1000000
    return bar.select("sid", (F.row_number().over(order) - 1).alias("i"), period, *[(F.col(x) + before).alias(x) for x in "ohlc"], "v", "n", "since", "until")


#: Days without a trade after which a share's series starts anew.
GAP_DAYS = 30
#: Segments that a share can have; gaps of GAP_DAYS keep it far below for 80 years.
SEGMENTS = 1000


def segmented(weeks: DataFrame) -> DataFrame:
    """share, segment, sid, i, week, o, h, l, c, v, n, since, until, forming: weekly bars in continuity segments.

    sid is a series, one segment of one share; i counts within it. A break never parts a week here: the gap is longer.
    The last bar of a share is forming until the Friday of its week is over in the data.
    """
    w = Window.partitionBy("sid").orderBy("week")
    new = F.coalesce(F.datediff("since", F.lag("until").over(w)) > GAP_DAYS, F.lit(False)).cast("int")
    x = weeks.withColumns({"new": new, "last": F.lead("week").over(w).isNull()}).withColumn("segment", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    as_of = weeks.agg(F.max("until").alias("as_of")).scalar()
    x = x.withColumn("forming", F.col("last") & (F.date_add("week", 4) > as_of)).withColumn("share", F.col("sid"))
    order = Window.partitionBy("share", "segment").orderBy("week")
    series = F.col("share").cast("long") * SEGMENTS + F.col("segment")
    return x.select("share", "segment", series.alias("sid"), (F.row_number().over(order) - 1).alias("i"), "week", *"ohlcv", "n", "since", "until", "forming")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete weekly bars of every series."""
    return segmented(bars(trades(spark, sf_dir), "week")).where("not forming").drop("forming")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, hour, o, h, l, c, volume, n: bars of the events' values."""
    e = table(spark, sf_dir, "events")
    return hourly(e)


def hourly(events: DataFrame) -> DataFrame:
    at = F.struct("ts", "event_id")
    return events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.min_by("value", at).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", at).alias("c"), F.count("*").alias("n"))
