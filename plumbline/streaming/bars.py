"""Streaming twins of the batch operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, a few at a time."""
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    plain = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]  # watermarks need instants; the session's zone gives them
    return found.withColumns({c: found[c].cast("timestamp") for c in plain}) if plain else found


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly bars of each event type; the watermark closes an hour, so that a bar is given once and is final."""
    at = F.struct("ts", "event_id")
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.min_by("value", at).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", at).alias("c"), F.count("*").alias("n")).select("event_type", F.col("w.start").alias("hour"), "o", "h", "l", "c", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events at most `gap` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n", "total")


def _turns(percent: float):  # noqa: ANN202
    def run(key, batches, state):  # noqa: ANN001, ANN202
        leg, top, low = state.get if state.exists else (0, None, None)
        rows = []
        for x in pd.concat(list(batches)).sort_values("hour").itertuples():
            if top is None:
                top = low = x.c
                continue
            down, up = x.c <= top * (1 - percent / 100), x.c >= low * (1 + percent / 100)
            if leg >= 0 and down:
                rows.append((key[0], "HIGH", top, x.hour))
                leg, low = -1, x.c
            elif leg <= 0 and up:
                rows.append((key[0], "LOW", low, x.hour))
                leg, top = 1, x.c
            else:
                top, low = (max(top, x.c) if leg >= 0 else top), (min(low, x.c) if leg <= 0 else low)
        state.update((leg, top, low))
        yield pd.DataFrame(rows, columns=["event_type", "kind", "price", "known"])

    return run


def turns(bars: DataFrame, percent: float = 50.0) -> DataFrame:
    """Reversals of the closes of each event type by `percent`, from a state of one leg a type."""
    return bars.groupBy("event_type").applyInPandasWithState(_turns(percent), "event_type string, kind string, price double, known timestamp", "leg long, top double, low double", "append", "NoTimeout")
