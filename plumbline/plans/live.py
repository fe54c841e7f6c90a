"""Queries of streams: the events' table read as a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.sources.store import once, shared_dir
from plumbline.streaming import bars, machines

#: The table is one delivery: its files come in any order, so that they are one batch, and the watermark moves after it.
ALL_FILES = 1 << 30


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        path = f"{sf_dir}/events.parquet"
        source = f"{sf_dir}/events.parque[t]"  # a pattern, as a stream takes no path of a single file
        out = f"{shared_dir(spark)}/live_{uuid.uuid4().hex}"
        machines.written(machines.live(bars.read(spark, source, spark.read.parquet(path).schema, ALL_FILES)), f"{out}/rows", f"{out}/checkpoint")
        return spark.read.parquet(f"{out}/rows").drop("batch")

    return once(spark, sf_dir, "live", build, "events")


_CLOSED = """b AS (SELECT event_type, date_trunc('hour', ts) AS hour, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c, count(*) AS n FROM events GROUP BY 1, 2),
k AS (SELECT * FROM b WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR)"""


@query(f"WITH {_CLOSED} SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS i, hour, o, h, l, c, n FROM k")
def live_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars that a stream of the events closed."""
    return _live(spark, sf_dir).where("kind = 'BAR'").select("event_type", "i", F.col("hour").cast("timestamp_ntz").alias("hour"), *"ohlcn")


@query(f"""WITH {_CLOSED} SELECT event_type, hour, o, h, l, c, n FROM b WHERE hour + INTERVAL 1 HOUR > (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def live_forming_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that are still open at the stream's end, as last told; they confirm nothing."""
    x = _live(spark, sf_dir)
    open_ = x.where("kind = 'FORMING'").join(x.where("kind = 'BAR'").select("event_type", "hour"), ["event_type", "hour"], "left_anti")
    last = open_.groupBy("event_type", "hour").agg(F.max_by(F.struct(*"ohlcn"), "n").alias("x"))
    return last.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "x.*")


@query()
def live_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swings, breaks, trend states and roles of levels that a stream of the events found bar by bar."""
    return _live(spark, sf_dir).where("kind in ('SWING', 'BREAK', 'STATE', 'ROLE')").select("event_type", "kind", "i", "what", "direction", "bar", F.round("price", 6).alias("price"))
