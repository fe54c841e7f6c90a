"""Trendlines and zones by hand, against loops, and as of an earlier bar."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.operators import lines, zones
from plumbline.plans import catalogue, support

SWINGS = "sid long, kind string, bar long, known long, price double, atr double"


def bars(spark, closes, lows=None, highs=None, sid=1, atr=2.0):
    rows = [(sid, i, float(h), float(low), float(c), atr, 1.0 + i / 10) for i, (c, low, h) in enumerate(zip(closes, lows or closes, highs or closes))]
    return spark.createDataFrame(rows, "sid long, i long, h double, l double, c double, atr double, rvol double")


def test_a_line_is_validated_and_broken(spark):
    lows = [(1, "LOW", 5, 7, 100.0, 2.0), (1, "LOW", 15, 18, 110.0, 2.0), (1, "LOW", 25, 27, 120.4, 2.0), (1, "LOW", 40, 44, 135.0, 2.0)]
    closes = [130.0 + i for i in range(42)] + [130.0] * 10  # the line is at 137 on bar 42
    got = lines.life(spark.createDataFrame(lows, SWINGS), bars(spark, closes)).where("a = 5 and b = 15").collect()
    assert [tuple(r) for r in got] == [(1, "LOW", 5, 15, 100.0, 1.0, 27, 42, 3, 27)]  # the touch of bar 40 is known after the break
    beyond = [*lows, (1, "LOW", 10, 12, 103.0, 2.0)]
    assert lines.life(spark.createDataFrame(beyond, SWINGS), bars(spark, closes)).where("a = 5 and b = 15").isEmpty()
    late = [(*x[:2], x[2], x[3] + (200 if x[2] > 15 else 0), *x[4:]) for x in lows]
    assert lines.life(spark.createDataFrame(late, SWINGS), bars(spark, closes)).isEmpty()  # no third touch in time
    assert lines.life(spark.createDataFrame(lows, SWINGS).limit(0), bars(spark, closes)).collect() == []


def test_lines_that_share_two_touches_are_one():
    line = lambda a, b, validated, broken, own: (a, b, 0.0, 0.0, validated, broken, np.array(own), np.array([x + 1 for x in own]))
    first, second, third = line(0, 5, 20, 50, [0, 5, 18]), line(0, 18, 22, lines.NEVER, [0, 18, 21]), line(5, 18, 60, lines.NEVER, [5, 18, 55])
    assert [x[:2] for x in lines._distinct([third, second, first])] == [(0, 5), (5, 18)]  # the first is broken when the third is validated
    unborn = line(0, 6, 21, lines.NEVER, [0, 6, 30])
    assert len(lines._distinct([first, unborn])) == 2


def test_a_longer_run_keeps_the_lines(spark, sf):
    b, s = catalogue._bars(spark, sf), catalogue._swings(spark, sf)
    whole = support._lines(spark, sf).cache()
    for cut in (90, 180):
        early = lines.life(s.where(F.col("known") <= cut), b.where(F.col("i") <= cut))
        then = whole.where(F.col("known") <= cut).withColumn("broken", F.when(F.col("broken") <= cut, F.col("broken")))
        key = ["sid", "kind", "a", "b", "value", "slope", "known", "broken"]
        assert {tuple(r) for r in early.select(key).collect()} == {tuple(r) for r in then.select(key).collect()}


def test_clusters_against_a_loop(spark):
    r = random.Random(2)
    rows = [(sid, "SWING", "SWING", k, round(r.uniform(0, 60), 2), k + 3, k, False) for sid in (1, 2, 3) for k in range(70)]
    found = spark.createDataFrame(rows, "sid long, type string, source string, bar long, price double, known long, at long, heavy boolean").repartition(5)
    last = spark.createDataFrame([(1, 90, 30.0, 2.0), (2, 90, 5.0, 1.0)], "sid long, last long, c double, atr double")
    got = {(x.sid, x.bar): x.zone for x in zones.clustered(found, last).collect()}
    for sid, atr in ((1, 2.0), (2, 1.0)):
        zone, group = 0, []
        for price, _, k in sorted((x[4], x[5], x[3]) for x in rows if x[0] == sid):
            if not group or abs(price - sum(group) / len(group)) > C.ZONE_TOLERANCE * atr:
                zone, group = zone + 1, []
            group.append(price)
            assert got[sid, k] == zone
    assert len(got) == 140  # a series without a last bar has no zones
    near = zones.nearest(zones.clustered(found, last)).collect()
    assert all(x.high - x.low >= C.ZONE_WIDTH * x.atr - 1e-9 and x.place <= C.ZONES_A_SIDE for x in near)
    assert {x.side for x in near} == {"SUPPORT", "RESISTANCE"}


def test_tests_of_a_zone(spark):
    """Runs of bars in the zone count once, after the last change of role only."""
    r = random.Random(7)
    closes = [100 + r.uniform(-4, 4) for _ in range(80)]
    lows, highs = [c - r.uniform(0, 3) for c in closes], [c + r.uniform(0, 3) for c in closes]
    members = spark.createDataFrame([(1, "SWING", "SWING", 3, 98.0, 5, 3, True, 1, 79, closes[-1], 2.0), (1, "STRUCTURE", "BOS", 8, 98.5, 10, 10, False, 1, 79, closes[-1], 2.0)], "sid long, type string, source string, bar long, price double, known long, at long, heavy boolean, zone long, last long, c double, atr double")
    b = bars(spark, closes, lows, highs)
    for turned in (None, 31):
        flips = spark.createDataFrame([(1, "SWING", 3, 98.0, 5, 20, "RESISTANCE"), (1, "BOS", 8, 98.5, 10, turned or 12, "SUPPORT")], "sid long, source string, bar long, price double, known long, t long, role string")
        z = zones.strengths(zones.tested(zones.nearest(members), members, flips, b)).collect()[0]
        start = max(5, 20, turned or 12) + 1
        inside = [t >= start and (lows[t] <= z.high and closes[t] >= z.low if z.side == "SUPPORT" else highs[t] >= z.low and closes[t] <= z.high) for t in range(80)]
        first = [t for t in range(80) if inside[t] and not inside[t - 1]]
        volume = max(1.0 + t / 10 for t in range(80) if inside[t])
        assert (z.start, z.turned, z.touches, z.last_test, z.types) == (start, start - 1, len(first), first[-1], 3)
        assert math.isclose(z.strength, len(first) + 3 + 0.5 * volume + 2 * math.exp(-(79 - first[-1]) / 26))
    none = zones.strengths(zones.tested(zones.nearest(members), members, flips, b.where("i < 20"))).collect()[0]
    assert none.touches == 0 and math.isclose(none.recency, math.exp(-(79 - 31) / 26))  # untested: its latest change of role
