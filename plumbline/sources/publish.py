"""A published table that is written anew only where its content changed.

The table's series are dealt to buckets; each bucket is a folder of Parquet files of one version. A manifest says of each series what it was made of
(its dependency), what it holds (a hash of its rows), and in which version its bucket lies. A publication

* drops series whose dependency is the manifest's: they are not even computed;
* computes the others and compares their hashes: equal ones only get their new dependency;
* rewrites the buckets of those that changed, came or went, under a new version, from the old bucket and the new rows;
* writes the manifest last. Until then readers see the version before; a run that dies leaves folders that no manifest names.

Folders that neither of the last two manifests names are deleted. Nothing that grows with the rows goes through the driver: it sees the numbers of
buckets and versions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
PART_ROWS = 2_000_000
KEPT = 2  # manifests
MANIFEST = "sid long, dependency string, content string, rows long, bucket int, version string"


class Mismatch(Exception):
    """A published table is not what its manifest or its reader says."""


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def stamp(kind: str, text: str) -> str:
    """A version: its kind and twelve hex digits of what it stands for."""
    return f"{kind}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def fingerprint(parts: dict) -> str:
    """A hash of what a result depends on, whatever the order of its parts."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str, allow_nan=False).encode()).hexdigest()


def dependencies(rows: DataFrame, methods: dict, key: str = "sid") -> DataFrame:
    """sid, dependency: of each series, the hash of its input rows together with the methods' fingerprint. Order and place of rows do not matter."""
    return contents(rows, key).select("sid", F.sha2(F.concat_ws("|", "content", F.lit(fingerprint(methods))), 256).alias("dependency"))


def contents(rows: DataFrame, key: str = "sid") -> DataFrame:
    """sid, content, rows: an order-free hash of each series' rows: sums of two 64-bit hashes and the count, over columns in order of their names.

    A sum is exact in decimals and combined before the shuffle, so that a long series costs no more than a short one.
    """
    columns = sorted(rows.columns)
    one = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string").alias(n) for n, h in (("a", F.xxhash64(one)), ("b", F.xxhash64(F.concat(F.lit("+"), one))))]
    x = rows.groupBy(F.col(key).cast("long").alias("sid")).agg(*sums, F.count("*").alias("rows"))
    return x.select("sid", F.sha2(F.concat_ws("|", "a", "b", "rows", F.lit(",".join(columns))), 256).alias("content"), "rows")


def bucket(sid: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(sid), F.lit(buckets)).cast("int")


def manifests(spark: SparkSession, root: str) -> list[str]:
    """The numbers of the complete manifests, oldest first."""
    return [n for n in _names(spark, f"{root}/manifests") if "_SUCCESS" in _names(spark, f"{root}/manifests/{n}")]


def manifest(spark: SparkSession, root: str, number: str | None = None) -> DataFrame:
    """The rows of a manifest, by default the latest; none before the first publication."""
    found = manifests(spark, root)
    if not found:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{number or found[-1]}")


def _schema_of(spark: SparkSession, root: str) -> str | None:
    names = [n for n in _names(spark, f"{root}/schema") if n.startswith("part-")]
    return spark.read.text(f"{root}/schema").first()[0] if names else None


def publish(spark: SparkSession, root: str, wanted: DataFrame, build: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> dict:
    """Bring the table at root to the wanted series (sid, dependency); build(series) gives the rows (with sid) of some of them.

    Returns how many series were kept, computed, changed and removed, how many buckets were written, and the manifest's number. If nothing is to do, nothing is written.
    """
    old = manifest(spark, root)
    # what is published keeps its number of buckets
    before = manifests(spark, root)
    todo = wanted.join(old.select("sid", "dependency"), ["sid", "dependency"], "left_anti").select("sid", "dependency")
    gone = old.join(wanted.select("sid"), "sid", "left_anti")
    kept = old.join(wanted.select("sid", "dependency"), ["sid", "dependency"], "left_semi")
    number = f"{int(before[-1]) + 1 if before else 1:08d}"
    counts = {"kept": kept.count(), "computed": todo.count(), "removed": gone.count()}
    if not counts["computed"] and not counts["removed"] and before:
        return counts | {"changed": 0, "buckets": 0, "manifest": before[-1]}

    staged = f"{root}/staged/{number}"
    fresh = build(todo.select("sid"))
    kind = _schema_of(spark, root)
    if kind is None:
        spark.createDataFrame([(fresh.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/schema")
    elif kind != fresh.schema.json():
        raise Mismatch("the rows' schema is not the published one")
    fresh.write.mode("overwrite").parquet(staged)
    fresh = spark.read.schema(fresh.schema).parquet(staged)
    made = todo.join(contents(fresh), "sid", "left").select("sid", "dependency", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("rows", F.lit(0)).alias("rows"), bucket(F.col("sid"), buckets).alias("bucket"))
    same = made.join(old.select("sid", "content", F.col("version").alias("version")), ["sid", "content"])
    changed = made.join(old.select("sid", "content"), ["sid", "content"], "left_anti")
    dirty = sorted(r[0] for r in changed.select("bucket").union(gone.select("bucket")).distinct().collect())  # at most `buckets` numbers
    version = stamp("v", f"{number}|{root}")
    stay = kept.select("sid", "dependency", "content", "rows", "bucket", "version").unionByName(same.select("sid", "dependency", "content", "rows", "bucket", "version"))
    if dirty:
        touched = F.col("bucket").isin(dirty)
        rows = fresh.join(changed.select("sid", "bucket"), "sid")
        for (was,) in old.where(touched).select("version").distinct().collect():  # at most as many versions as buckets
            held = stay.where(touched & (F.col("version") == was)).select("sid", "bucket")
            rows = rows.unionByName(spark.read.schema(fresh.schema).parquet(*[f"{root}/data/{was}/bucket={b}" for b in dirty if f"bucket={b}" in _names(spark, f"{root}/data/{was}")]).join(held, "sid"))
        rows.repartition(min(len(dirty), buckets), "bucket").sortWithinPartitions("bucket", "sid").write.mode("overwrite").option("maxRecordsPerFile", PART_ROWS).partitionBy("bucket").parquet(f"{root}/data/{version}")
        stay = stay.withColumn("version", F.when(touched, F.lit(version)).otherwise(F.col("version")))
    now = stay.unionByName(changed.withColumn("version", F.lit(version)).select(*stay.columns))
    now.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1 if counts["kept"] + counts["computed"] < PART_ROWS else 16).write.parquet(f"{root}/manifests/{number}")
    n = changed.count()
    _clean(spark, root)
    return counts | {"changed": n, "buckets": len(dirty), "manifest": number}


def _clean(spark: SparkSession, root: str) -> None:
    """Delete what the last KEPT manifests do not name, and staged rows."""
    found = manifests(spark, root)
    named = {r[0] for k in found[-KEPT:] for r in manifest(spark, root, k).select("version").distinct().collect()}
    old = [f"{root}/manifests/{n}" for n in _names(spark, f"{root}/manifests") if n not in found[-KEPT:]]
    for path in [*old, *(f"{root}/data/{v}" for v in _names(spark, f"{root}/data") if v not in named), f"{root}/staged"]:
        fs, where = _path(spark, path)
        fs.delete(where, True)


def read(spark: SparkSession, root: str, number: str | None = None, verify: bool = False) -> DataFrame:
    """The published rows. verify: compare the hash of every series with the manifest, and raise Mismatch if one differs."""
    found = manifest(spark, root, number)
    kind = _schema_of(spark, root)
    if kind is None:
        raise Mismatch("nothing is published there")
    schema = spark.createDataFrame([], "x int").schema.fromJson(json.loads(kind))
    places = found.where("rows > 0").select("version", "bucket").distinct().collect()  # at most a row a bucket
    if not places:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{root}/data/{p.version}/bucket={p.bucket}" for p in places])
    if verify:
        odd = contents(rows).select("sid", "content").join(found.where("rows > 0").select("sid", F.col("content").alias("said")), "sid", "full").where(~F.col("content").eqNullSafe(F.col("said")))
        first = odd.select("sid").orderBy("sid").limit(3).collect()
        if first:
            raise Mismatch(f"series {[r.sid for r in first]} are not what the manifest says")
    return rows


def version_of(spark: SparkSession, root: str, kind: str = "wk") -> str:
    """The stamp of all that is published: the same content has the same stamp, however it was written."""
    x = manifest(spark, root).where("rows > 0").agg(F.sum(F.xxhash64("sid", "content").cast("decimal(38,0)")).cast("string"), F.count("*")).first()
    return stamp(kind, f"{x[0]}|{x[1]}")
