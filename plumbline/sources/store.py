"""Tables that several queries derive from, written once: a shared folder, bucketed by series."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _changed(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()


def materialised(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], source: str = "lineitem") -> DataFrame:
    """build()'s rows (with a column sid), written once a session and state of the source table.

    They are bucketed by sid, one file a bucket, so that windows, joins and ordered scans of series read them without a
    shuffle; joins on sid and more keys too, for which Spark must not ask that rows are dealt by all keys of a join. A lost executor costs nothing: the files are in the shared folder.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = spark.sparkContext.applicationId, sf_dir, _changed(spark, f"{sf_dir}/{source}.parquet"), name, parts
    if key not in _TABLES:
        table = f"plumbline_{name}_{uuid.uuid4().hex}"
        build().repartition(parts, "sid").write.bucketBy(parts, "sid").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
        _TABLES[key] = table
    return spark.table(_TABLES[key])


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], source: str = "lineitem") -> DataFrame:
    """build()'s rows, written once a session and state of the source table, without buckets."""
    key = spark.sparkContext.applicationId, sf_dir, _changed(spark, f"{sf_dir}/{source}.parquet"), name
    if key not in _TABLES:
        path = f"{shared_dir(spark)}/plumbline_{name}_{uuid.uuid4().hex}"
        build().write.parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def forget() -> None:
    """Build the tables anew from now on."""
    _TABLES.clear()
