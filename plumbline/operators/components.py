"""Connected components of a graph of identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.store import shared_dir


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/components_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, most: int = 100) -> DataFrame:
    """node, component of edges (a, b: string): the component is its least node. A node alone is an edge with itself.

    Each round a node takes the least label of its neighbours, then its label's label, so that chains shorten by half; labels are
    written to the shared folder between rounds. Rows with a null end are left out.
    """
    e = edges.select("a", "b").where("a is not null and b is not null").distinct()
    e = _written(e.union(e.select("b", "a")).distinct())
    labels = _written(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(most):
        seen = e.join(labels, e["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        of = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = _written(least.join(of, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old"))
        labels = now.select("node", "label")
        if now.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most} rounds")
