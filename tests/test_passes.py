"""Passes over many series at once: the same as one by one, however rows are cut into batches, files and partitions."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evidence, indicators, passes, patterns, structure, swings
from plumbline.sources import store


def series(lengths, seed=5):
    r = np.random.default_rng(seed)
    parts = []
    for sid, n in enumerate(lengths):
        c = 1000 + np.cumsum(r.integers(-9, 10, n))
        parts.append(pd.DataFrame({"sid": sid * 7, "i": np.arange(n), "o": c, "h": c + r.integers(0, 6, n), "l": c - r.integers(0, 6, n), "c": c, "v": r.integers(1, 99, n)}))
    return pd.concat(parts, ignore_index=True)


def test_steps_and_whole_series():
    of = passes.Stack([2, 0, 3, 1])
    assert [(t, sorted(at.tolist())) for t, at in of.steps()] == [(0, [0, 2, 5]), (1, [1, 3]), (2, [4])]
    assert list(passes.Stack([]).steps()) == []
    sid = [1, 1, 1, 2, 3, 3, None, None]
    table = pa.table({"sid": pa.array(sorted(sid, key=lambda x: (x is not None, x or 0)), pa.int64()), "k": range(8)})
    for size in range(1, 9):
        for rows in (1, 3, 100):
            got = list(passes.whole(iter(table.to_batches(max_chunksize=size)), rows=rows))
            assert pa.concat_tables(got).column("k").to_pylist() == list(range(8))
            keys = [set(t.column("sid").to_pylist()) for t in got]
            assert sum(map(len, keys)) == 4  # no series in two tables
    which, place = passes.ranges(np.array([5, 0, 9]), np.array([2, -1, 3]))
    assert (which.tolist(), place.tolist()) == ([0, 0, 2, 2, 2], [5, 6, 9, 10, 11])


def test_many_series_are_as_one():
    df = series([0, 1, 40, 15, 300, 14, 2])
    parts = [g for _, g in df.groupby("sid")]
    h, l, c = (df[x].to_numpy(float) for x in "hlc")  # noqa: E741
    of = passes.Stack([len(g) for g in parts])
    alone = lambda f: np.concatenate([f(*(g[x].to_numpy(float) for x in "hlc")) for g in parts])
    np.testing.assert_array_equal(indicators.atr(h, l, c, of=of), alone(lambda h, l, c: indicators.atr(h, l, c)))  # noqa: E741
    np.testing.assert_array_equal(indicators.rsi(c, of=of), alone(lambda h, l, c: indicators.rsi(c)))  # noqa: E741
    np.testing.assert_array_equal(indicators.emas(c, [3, 20], of)[1], alone(lambda h, l, c: indicators.emas(c, [3, 20])[1]))  # noqa: E741
    place, known, is_high = swings.turns(h, l, np.full(len(c), 20.0), np.full(len(c), 20.0), of)
    got = sorted(zip(df["sid"][place], df["i"][place], known, is_high))
    want = sorted((g["sid"].iloc[0], bar, t, kind == "HIGH") for g in parts for kind, bar, t, _ in swings.reversals(*(g[x].to_numpy(float) for x in "hl"), np.full(len(g), 20.0), np.full(len(g), 20.0)))
    assert got == want and len(want) > 10


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    """Bars and swings of many series, bucketed, and read in splits far smaller than a bucket."""
    folder = tmp_path_factory.mktemp("bars")
    spark.createDataFrame(series([60 + k % 50 for k in range(120)])).write.parquet(f"{folder}/lineitem.parquet")
    # what the tables of weekly bars carry besides
    raw = spark.read.parquet(f"{folder}/lineitem.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    bars = store.materialised(spark, str(folder), "b", lambda: indicators.all_indicators(raw))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield bars, store.materialised(spark, str(folder), "s", lambda: swings.primary(bars))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_passes_read_bucketed_tables_whole(bucketed):
    bars, found = bucketed
    b, s = bars.toPandas().sort_values(["sid", "i"]), found.toPandas()
    assert len(s) > 300
    want = [(sid, *x[1:3]) for sid, g in b.groupby("sid") for x in swings.reversals(*(g[k].to_numpy(float) for k in "hl"), *[3 * g["atr"].to_numpy(float)] * 2)]
    assert sorted(zip(s["sid"], s["bar"], s["known"])) == sorted(want)
    levels = structure.swing_levels(found)
    lv, breaks, states, flips = levels.toPandas(), [], [], 0
    for sid, g in b.groupby("sid"):
        one = structure._scan(sid, g, s[s["sid"] == sid])
        breaks, states = breaks + [x[:2] for x in one[0]], states + [x[:3] for x in one[1]]
        flips += len(structure._flips((sid,), g, lv[lv["sid"] == sid]))
    assert sorted((r.sid, r.t) for r in structure.breaks(bars, found).collect()) == sorted(breaks) and len(breaks) > 50
    assert sorted((r.sid, r.since, r.state) for r in structure.trend_states(bars, found).collect()) == sorted(states)
    assert structure.role_changes(levels, bars).count() == flips > 100


def test_running_sums_and_quantiles_by_definition(bucketed):
    bars, _ = bucketed
    b = bars.toPandas().sort_values(["sid", "i"])
    b["below"] = evidence_percentile(bars, b)
    for _, g in list(b.groupby("sid"))[:10]:
        c, v = g["c"].astype(float), g["v"].astype(float)
        for got, want in (("sma20", c.rolling(20).mean()), ("sma50", c.rolling(50).mean()), ("sd", c.rolling(20).std(ddof=0)), ("volume_sma", v.rolling(20).mean()), ("rvol", v / v.rolling(20).mean().shift(1)), ("below", g["atr_percent"].rolling(52).quantile(0.2).shift(1))):
            np.testing.assert_allclose(g[got].to_numpy(float), want.to_numpy(float), rtol=1e-9, err_msg=got)


def evidence_percentile(bars, b):
    x = bars.select("sid", "i", evidence.trailing_percentile("atr_percent", 52, 0.2).alias("p")).toPandas()
    return b.merge(x, on=["sid", "i"], how="left")["p"].to_numpy(float)


def test_parabola_by_polynomial_fit(spark, bucketed):
    bars, _ = bucketed
    b = bars.toPandas().sort_values(["sid", "i"])
    rows = [(7, 1.0, 3, 40), (14, -1.0, 0, 25), (21, 1.0, 9, 9), (21, 1.0, 9, None)]
    specs = spark.createDataFrame(rows, "sid long, s double, first long, last long")
    got = {(r.sid, r["last"]): r for r in patterns.fitted(specs, bars, "first", "last").collect()}
    for sid, s, first, last in rows[:2]:
        y = s * b[(b["sid"] == sid) & b["i"].between(first, last)]["c"].to_numpy(float)
        x = np.arange(len(y))
        r = got[sid, last]
        want = np.polyfit(x, y, 2)
        assert (r.a, r.b, r.c) == pytest.approx(tuple(want), rel=1e-6)
        assert r.r2 == pytest.approx(1 - ((y - np.polyval(want, x)) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-6)
    assert (got[21, 9].a, got[21, 9].r2) == (None, 0.0) and (got[21, None].a, got[21, None].r2) == (None, None)


def test_series_meet_without_a_shuffle(bucketed):
    """Joins on the series and a bar, and aggregates of them, use the buckets that are there."""
    bars, found = bucketed
    x = found.join(bars.select("sid", F.col("i").cast("long").alias("bar"), "rvol").hint("merge"), ["sid", "bar"]).groupBy("sid", "kind").count()
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
