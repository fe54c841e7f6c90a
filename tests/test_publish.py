"""A published table: nothing is written twice, one change rewrites one bucket, and readers never see half a publication."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.sources import publish as P


def rows(spark, change=None, without=()):
    data = [(s, i, float(s * 100 + i) + (0.5 if s == change and i == 3 else 0), None if i % 2 else "x") for s in range(40) for i in range(5) if s not in without]
    return spark.createDataFrame(data, "sid long, i long, price double, note string").repartition(3)


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def run(spark, root, table, methods=None, seen=None):
    wanted = P.dependencies(table, methods or {"a": 1})

    def build(series):
        if seen is not None:
            seen.append(series.count())
        return table.join(series, "sid").withColumn("double", F.col("price") * 2)

    return P.publish(spark, root, wanted, build, buckets=8)


def held(df):
    return {(r.sid, r.i, r.price, r.note, r.double) for r in df.collect()}


def test_only_what_changed_is_written(spark, tmp_path):
    root, seen = str(tmp_path / "t"), []
    first = run(spark, root, rows(spark), seen=seen)
    assert (first["computed"], first["changed"], first["buckets"]) == (40, 40, 8) and seen == [40]
    whole, before, stamp = held(P.read(spark, root, verify=True)), files(root), P.version_of(spark, root)
    assert len(whole) == 200

    again = run(spark, root, rows(spark).repartition(7), {"a": 1}, seen)  # the same rows in another order
    assert (again["kept"], again["computed"], again["buckets"]) == (40, 0, 0) and seen == [40] and files(root) == before

    one = run(spark, root, rows(spark, change=7), seen=seen)
    assert (one["kept"], one["computed"], one["changed"], one["buckets"]) == (39, 1, 1, 1) and seen == [40, 1]
    after = files(root)
    data = {f: t for f, t in before.items() if "/data/" in f}
    assert all(after[f] == t for f, t in data.items())  # buckets of others are as they were
    new = {f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before) if "bucket=" in f}
    assert len(new) == 1
    assert held(P.read(spark, root, verify=True)) == {r if (r[0], r[1]) != (7, 3) else (7, 3, 703.5, None, 1407.0) for r in whole} != whole
    assert held(P.read(spark, root, number=first["manifest"], verify=True)) == whole and P.version_of(spark, root) != stamp

    # another method, the same result: computed, but no bucket is written
    method = run(spark, root, rows(spark, change=7), {"a": 2}, seen)
    assert (method["computed"], method["changed"], method["buckets"]) == (40, 0, 0)
    back = run(spark, root, rows(spark), {"a": 2}, seen)
    assert (back["computed"], back["changed"]) == (1, 1) and P.version_of(spark, root) == stamp and len(P.manifests(spark, root)) == P.KEPT
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        P.manifest(spark, root, first["manifest"]).count()


def test_series_come_and_go(spark, tmp_path):
    root = str(tmp_path / "t")
    run(spark, root, rows(spark, without=(5, 6)))
    got = run(spark, root, rows(spark, without=(6, 9)))
    assert (got["computed"], got["changed"], got["removed"]) == (1, 1, 1)
    assert {r[0] for r in held(P.read(spark, root, verify=True))} == set(range(40)) - {6, 9}
    empty = rows(spark).limit(0)
    assert run(spark, root, empty)["removed"] == 38 and P.read(spark, root).collect() == []


def test_half_a_publication_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "t")
    run(spark, root, rows(spark))
    whole = held(P.read(spark, root))

    def build(series):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        P.publish(spark, root, P.dependencies(rows(spark, change=7), {"a": 1}), build, buckets=8)
    os.makedirs(f"{root}/manifests/00000099")  # a manifest that was not finished
    assert held(P.read(spark, root, verify=True)) == whole
    run(spark, root, rows(spark, change=7))
    assert held(P.read(spark, root, verify=True)) != whole


def test_a_table_that_was_touched_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    run(spark, root, rows(spark))
    folder = next(os.path.dirname(f) for f in files(root) if "/bucket=" in f and f.endswith(".parquet"))
    spark.read.parquet(folder).limit(1).coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(P.Mismatch, match="manifest"):
        P.read(spark, root, verify=True)
    with pytest.raises(P.Mismatch, match="schema"):
        P.publish(spark, root, P.dependencies(rows(spark, change=3), {"a": 1}), lambda s: rows(spark).join(s, "sid"), buckets=8)
    with pytest.raises(P.Mismatch, match="nothing"):
        P.read(spark, str(tmp_path / "none"))


def test_stamps_and_fingerprints():
    assert P.fingerprint({"b": 1, "a": [2, {"y": 1, "x": 2}]}) == P.fingerprint({"a": [2, {"x": 2, "y": 1}], "b": 1}) != P.fingerprint({"a": 1})
    assert P.stamp("wk", "x").startswith("wk-") and len(P.stamp("wk", "x")) == 15
    with pytest.raises(ValueError):
        P.fingerprint({"a": float("nan")})
