"""Queries of published tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import catalogue, sql
from plumbline.plans.registry import query
from plumbline.sources import publish
from plumbline.sources.store import shared_dir


@query(f"WITH {sql.BARS} SELECT sid, i, week, o, h, l, c, v FROM b")
def published_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars published without those of every third series, then with all: the second publication writes the buckets of the rest anew and keeps
    the others' rows. Read back and compared with the manifest."""
    bars = catalogue._bars(spark, sf_dir).select("sid", "i", "week", *"ohlcv")
    root = f"{shared_dir(spark)}/published_{uuid.uuid4().hex}"
    wanted = publish.dependencies(bars, {"bars": "weekly"})
    for part in (wanted.where(F.col("sid") % 3 > 0), wanted):
        publish.publish(spark, root, part, lambda series: bars.join(series, "sid"))
    return publish.read(spark, root, verify=True)
