"""Zones of prices that several sources share: their tests since they last changed their role, and how strong they are.

Sources of a series as of its last bar: levels of swings and of structure breaks, moving averages, and the levels of the latest retracement
while it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import config as C

AVERAGES = ("sma50", "sma200")
#: A level; what a source of another kind is called by.
LEVEL = ["source", "bar", "price", "known"]


def last_bars(bars: DataFrame) -> DataFrame:
    """sid, last, c, atr and the averages of each series' last bar that has an ATR."""
    own = F.struct(F.col("i").cast("long").alias("last"), F.col("c").cast("double").alias("c"), "atr", *AVERAGES)
    return bars.groupBy("sid").agg(F.max_by(own, "i").alias("x")).select("sid", "x.*").where("atr is not null")


def sources(levels: DataFrame, bars: DataFrame, legs: DataFrame) -> DataFrame:
    """sid, type, source, bar, price, known, at, heavy: at is the bar that a source belongs to; heavy ones are swings of high volume.

    levels: structure.level_sources(); legs: structure.retracements().
    """
    state = bars.select("sid", F.col("i").cast("long").alias("bar"), (F.col("volume_state") == "EXPANSION").alias("heavy"))
    swing = F.col("source") == "SWING"
    fixed = levels.join(state, ["sid", "bar"], "left").select(
        "sid", F.when(swing, "SWING").otherwise("STRUCTURE").alias("type"), *[F.col(c).cast("double" if c == "price" else "string" if c == "source" else "long").alias(c) for c in LEVEL],
        F.when(swing, F.col("bar")).otherwise(F.col("known")).cast("long").alias("at"), (swing & F.coalesce("heavy", F.lit(False))).alias("heavy"),
    )
    last = last_bars(bars)
    none = F.lit(None).cast("long")
    average = last.select("sid", "last", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("price")) for k in AVERAGES])).alias("x")).where("x.price is not null")
    average = average.select("sid", F.lit("DYNAMIC").alias("type"), F.col("x.name").alias("source"), none.alias("bar"), F.col("x.price").alias("price"), F.col("last").alias("known"), F.col("last").alias("at"), F.lit(False).alias("heavy"))
    latest = legs.groupBy("sid").agg(F.max(F.struct("known", "bar", "status", *[f"r{int(r * 1000)}" for r in C.FIB_IN_ZONES])).alias("x")).where("x.status = 'ACTIVE'")
    fib = latest.select("sid", "x.known", "x.bar", F.explode(F.array(*[F.struct(F.lit(f"r{int(r * 1000)}").alias("name"), F.col(f"x.r{int(r * 1000)}").alias("price")) for r in C.FIB_IN_ZONES])).alias("y"))
    fib = fib.select("sid", F.lit("FIBONACCI").alias("type"), F.col("y.name").alias("source"), F.col("bar").cast("long").alias("bar"), F.col("y.price").alias("price"), F.col("known").cast("long").alias("known"), F.col("bar").cast("long").alias("at"), F.lit(False).alias("heavy"))
    return fixed.unionByName(average).unionByName(fib)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """zone: sources come by series and price; one joins the zone before it if it is within the tolerance of its mean."""
    sid = zone = None
    total, n = 0.0, 0
    for batch in batches:
        out = []
        for s, price, reach in zip(*(batch.column(c).to_pylist() for c in ("sid", "price", "reach"))):
            if s != sid:
                sid, zone, n = s, 0, 0
            if n == 0 or abs(price - total / n) > reach:
                zone, total, n = zone + 1, 0.0, 0
            total, n = total + price, n + 1
            out.append(zone)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "zone"])


def clustered(found: DataFrame, last: DataFrame) -> DataFrame:
    """found with its zone (counted by price) and the last bar's columns; one pass in price order, a mean and a count held a series."""
    x = found.join(last.select("sid", "last", "c", "atr"), "sid").withColumn("reach", C.ZONE_TOLERANCE * F.col("atr"))
    x = x.repartition("sid").sortWithinPartitions("sid", "price", "known", "source", "bar")
    return x.mapInArrow(_fold, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema) + ", zone long")


def nearest(members: DataFrame) -> DataFrame:
    """sid, zone, low, high, side, members, types, since, known, at, distance, last, atr, place: the nearest zones of each side of the last close."""
    z = members.groupBy("sid", "zone").agg(
        F.min("price").alias("lo"), F.max("price").alias("hi"), F.count("*").alias("members"), (F.count_distinct("type") + F.max("heavy").cast("int")).alias("types"), F.min("known").alias("since"), F.max("known").alias("known"),
        F.max("at").alias("at"), *[F.first(c).alias(c) for c in ("last", "c", "atr")],
    )
    pad = F.greatest(F.lit(0.0), C.ZONE_WIDTH * F.col("atr") - (F.col("hi") - F.col("lo"))) / 2
    z = z.withColumns({"low": F.col("lo") - pad, "high": F.col("hi") + pad})
    z = z.withColumns({"side": F.when((F.col("low") + F.col("high")) / 2 <= F.col("c"), "SUPPORT").otherwise("RESISTANCE"), "distance": F.greatest(F.lit(0.0), F.col("low") - F.col("c"), F.col("c") - F.col("high"))})
    place = F.row_number().over(Window.partitionBy("sid", "side").orderBy("distance", "low"))
    return z.withColumn("place", place).where(F.col("place") <= C.ZONES_A_SIDE).select("sid", "zone", "low", "high", "side", "members", "types", "since", "known", "at", "distance", "last", "atr", "place")


def tested(found: DataFrame, members: DataFrame, flips: DataFrame, bars: DataFrame) -> DataFrame:
    """nearest() with start (the bar from which tests count), turned (the last change of role of a level in it) and bars that meet it:
    runs of bars in it are tests. A support is met by a low in or below it and a close not below it.

    A series has at most ZONES_A_SIDE zones a side, so each bar meets few.
    """
    turned = members.where("type in ('SWING', 'STRUCTURE')").join(flips.select("sid", *LEVEL, F.col("t").cast("long").alias("t")), ["sid", *LEVEL]).groupBy("sid", "zone").agg(F.max("t").alias("turned"))
    z = found.join(turned, ["sid", "zone"], "left").withColumn("start", F.greatest("since", F.coalesce("turned", "since")) + 1)
    b = bars.select("sid", F.col("i").cast("long").alias("t"), *[F.col(c).cast("double").alias(f"b_{c}") for c in "hlc"], "rvol")
    meets = F.when(F.col("side") == "SUPPORT", (F.col("b_l") <= F.col("high")) & (F.col("b_c") >= F.col("low"))).otherwise((F.col("b_h") >= F.col("low")) & (F.col("b_c") <= F.col("high")))
    j = z.join(b, "sid").where("t >= start").withColumn("hit", meets)
    first = F.col("hit") & ~F.coalesce(F.lag("hit").over(Window.partitionBy("sid", "zone").orderBy("t")), F.lit(False))
    tests = j.withColumn("first", first).where("hit").groupBy("sid", "zone").agg(F.sum(F.col("first").cast("long")).alias("touches"), F.max(F.when(F.col("first"), F.col("t"))).alias("last_test"), F.max("rvol").alias("rvol"))
    return z.join(tests, ["sid", "zone"], "left").withColumns({"touches": F.coalesce("touches", F.lit(0)), "rvol": F.coalesce("rvol", F.lit(0.0))})


def strengths(zones: DataFrame) -> DataFrame:
    """tested() with recency and strength: tests, kinds of sources, the volume of tests, and how long ago the last one was (of an untested zone its
    latest source or change of role)."""
    w = C.ZONE_WEIGHTS
    ago = F.col("last") - F.coalesce("last_test", F.greatest("at", F.coalesce("turned", "at")))
    z = zones.withColumn("recency", F.exp(-ago / F.lit(C.RECENCY)))
    return z.withColumn("strength", w["touch"] * F.col("touches") + w["sources"] * F.col("types") + w["volume"] * F.col("rvol") + w["recency"] * F.col("recency"))

