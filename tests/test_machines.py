"""Streams of shuffled, late events against the batch operators over the same closed bars."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from plumbline import config as C
from plumbline.operators import structure, swings
from plumbline.operators.indicators import atr
from plumbline.streaming import bars as reader
from plumbline.streaming import machines as M

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, event_type string, ts timestamp, value double"


def walk(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    c = 100 + np.cumsum(r.normal(0, 1, n))
    return c + r.random(n), c - r.random(n), c


def batch(h, l, c):  # noqa: E741
    """What the batch operators find: (kind, bar it is known from, what, direction, bar, price)."""
    a = atr(h, l, c)
    step = C.ATR_MULTIPLE["INTERMEDIATE"] * a
    found = swings.reversals(h, l, step, step)
    s = pd.DataFrame(found, columns=["kind", "bar", "known", "price"])
    s["atr"] = [a[b] for b in s["bar"]]
    b = pd.DataFrame({"i": range(len(c)), "c": c, "atr": a})
    breaks, states = structure._scan(1, b, s)
    levels = [("SWING", x.bar, x.price, x.known, "SUPPORT" if x.kind == "LOW" else "RESISTANCE") for x in s.itertuples()] + [(x[2], x[4], x[5], x[1], "SUPPORT" if x[3] == "UP" else "RESISTANCE") for x in breaks]
    flips = structure._flips((1,), b, pd.DataFrame([(1, *x) for x in levels], columns=["sid", "source", "bar", "price", "known", "role"]))
    out = {("SWING", known, kind, None, bar, round(price, 6)) for kind, bar, known, price in found}
    out |= {("BREAK", x[1], x[2], x[3], x[4], round(x[5], 6)) for x in breaks}
    out |= {("STATE", x[1], x[2], x[3], None, None) for x in states}
    return out | {("ROLE", x.t, x.source, x.role, x.bar, round(x.price, 6)) for x in flips.itertuples()}


def test_a_machine_equals_the_batch():
    for seed in range(4):
        h, l, c = walk(seed, 400)  # noqa: E741
        got, m = set(), M.Machine(None, [])
        for t, bar in enumerate(zip(h, l, c)):
            if t % 7 == 0:  # as after a restart
                m = M.Machine(m.core() if t else None, [tuple(x) for x in m.levels])
            got |= {(kind, t, what, direction, b, None if price is None else round(price, 6)) for kind, what, direction, b, price in m.step(*map(float, bar))}
        want = batch(h, l, c)
        assert got == want and {x[0] for x in got} == {"SWING", "BREAK", "STATE", "ROLE"}


def test_parts_of_a_bar_in_any_order():
    r = random.Random(3)
    ticks = [(k * 10, k, r.random()) for k in range(12)]
    parts = [(t, i, v, v, v, t, i, v, 1) for t, i, v in ticks]
    for _ in range(5):
        r.shuffle(parts)
        out = parts[0]
        for p in parts[1:]:
            out = M.merged(out, p)
        assert out == (0, 0, ticks[0][2], max(v for *_, v in ticks), min(v for *_, v in ticks), 110, 11, ticks[-1][2], 12)


def test_stream_equals_batch(spark, tmp_path):
    """Late events correct open bars; the run is stopped halfway and goes on from its checkpoint."""
    r = random.Random(5)
    events = []
    for k, name in enumerate(("a", "b")):
        value = 100.0
        for hour in range(90):
            for minute in sorted(r.sample(range(60), r.randint(1, 4))) if hour % 11 else ():
                value += r.gauss(0, 2)
                events.append((len(events), name, START + timedelta(hours=hour, minutes=minute), value))
    arrival = sorted(events, key=lambda e: e[2] + timedelta(minutes=r.uniform(0, 100)))
    arrival.append((10**6, "end", START + timedelta(days=30), 0.0))  # closes all bars
    too_late = (10**6 + 1, "a", START, 1.0)
    size = len(arrival) // 4 + 1
    parts = [arrival[k * size : (k + 1) * size] for k in range(4)]
    schema = spark.createDataFrame([], SCHEMA).schema
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for run in (parts[:2], [*parts[2:], [too_late]]):
        for part in run:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        M.written(M.live(reader.read(spark, folder, schema)), out, mark)
    got = spark.read.parquet(out).where("event_type <> 'end'").collect()
    for name in ("a", "b"):
        ticks = pd.DataFrame([e for e in events if e[1] == name], columns=["id", "name", "ts", "value"]).sort_values(["ts", "id"])
        want = ticks.groupby(ticks["ts"].dt.floor("h"))["value"].agg(["first", "max", "min", "last", "size"])
        bars = sorted((x for x in got if x.event_type == name and x.kind == "BAR"), key=lambda x: x.i)
        assert [(x.i, x.hour, x.o, x.h, x.l, x.c, x.n) for x in bars] == [(k, t.to_pydatetime(), *row[:4], int(row[4])) for k, (t, row) in enumerate(zip(want.index, want.to_numpy().tolist()))]
        told = {(x.kind, x.i, x.what, x.direction, x.bar, None if x.price is None else round(x.price, 6)) for x in got if x.event_type == name and x.kind in ("SWING", "BREAK", "STATE", "ROLE")}
        assert told == batch(*(want[k].to_numpy() for k in ("max", "min", "last"))) and any(x[0] == "SWING" for x in told)
        forming = [x for x in got if x.event_type == name and x.kind == "FORMING"]
        assert len(forming) > len(bars)  # some bars are told again as they grow
        last = {}
        for x in forming:
            last[x.hour] = max(last.get(x.hour, 0), x.n)
        assert last == {x.hour: x.n for x in bars}
