"""Swing points: fractals by windows, reversals by an ordered scan of the series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import series as S
from plumbline.operators.indicators import atr
from plumbline.operators.passes import Stack, floats, keys, nullable, over_series, parted


def fractals(bars: DataFrame) -> DataFrame:
    """sid, sensitivity, kind, bar, known, price: extremes of k bars on both sides, known k bars later."""
    w = S.by_bar()
    out = None
    for name, k in C.FRACTAL.items():
        before, after = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
        whole = (F.count("*").over(before) == k) & (F.count("*").over(after) == k)
        high = whole & (F.col("h") > F.max("h").over(before)) & (F.col("h") >= F.max("h").over(after))
        low = whole & (F.col("l") < F.min("l").over(before)) & (F.col("l") <= F.min("l").over(after))
        found = bars.select("sid", "i", F.array(F.when(high, F.struct(F.lit("HIGH").alias("kind"), F.col("h").alias("price"))), F.when(low, F.struct(F.lit("LOW").alias("kind"), F.col("l").alias("price")))).alias("x"))
        found = found.select("sid", F.lit(name).alias("sensitivity"), "i", F.explode("x").alias("x")).where("x is not null").select("sid", "sensitivity", "x.kind", F.col("i").alias("bar"), (F.col("i") + k).alias("known"), "x.price")
        out = found if out is None else out.unionByName(found)
    return out


def reversals(high: np.ndarray, low: np.ndarray, up_by: np.ndarray, down_by: np.ndarray) -> list[tuple[str, int, int, float]]:
    """(kind, bar, known, price) of the reversals of a share.

    A leg's extreme becomes a swing when the price turns by the threshold of the extreme's own bar (down_by from a
    high, up_by from a low; null never turns). A reversal is tested before the leg is extended. Before the first swing
    both extremes are followed; if both turn at once the earlier one wins, the high on a tie.
    """
    place, known, is_high = turns(high, low, up_by, down_by, Stack([len(high)]))
    return [("HIGH" if top else "LOW", bar, t, (high if top else low)[bar]) for bar, t, top in zip(place.tolist(), known.tolist(), is_high.tolist())]


def turns(high: np.ndarray, low: np.ndarray, up_by: np.ndarray, down_by: np.ndarray, of: Stack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of the extreme, the bar from which it is known and whether it is a high, of the reversals of all series that the arrays are made `of`."""
    start = of.first[of.order]
    leg, top, bottom = np.zeros(len(of), np.int8), start.copy(), start.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for t, at in of.steps():
        if t == 0:
            continue
        m = len(at)
        way, above, below = leg[:m], top[:m], bottom[:m]  # views
        h, l = high[at], low[at]  # noqa: E741
        down, up = l <= high[above] - down_by[above], h >= low[below] + up_by[below]
        falls = (way >= 0) & down & ((way == 1) | ~up | (above <= below))
        rises = ~falls & (way <= 0) & up
        for turned, extreme, is_high in ((falls, above, True), (rises, below, False)):
            if turned.any():
                place = extreme[turned]
                found.append((place, np.full(len(place), t), np.full(len(place), is_high)))
        goes_on = ~(falls | rises)
        higher, lower = goes_on & (way >= 0) & (h > high[above]), goes_on & (way <= 0) & (l < low[below])
        way[falls], way[rises] = -1, 1
        below[falls | lower], above[rises | higher] = at[falls | lower], at[rises | higher]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else none  # type: ignore[return-value]


def _thresholds(method: str, size: float, h: np.ndarray, l: np.ndarray, c: np.ndarray, of: Stack) -> tuple[np.ndarray, ...]:  # noqa: E741
    if method == "ATR":
        a = size * atr(h, l, c, of=of)
        return h, l, a, a
    if method == "ZIGZAG":
        h = l = c  # noqa: E741
    return h, l, l * size / 100, h * size / 100


def scan(method: str, sizes: dict[str, float]) -> Callable[[pa.Table], pa.Table]:
    def run(bars: pa.Table) -> pa.Table:
        sid = keys(bars)
        first, lengths = parted(sid)
        of = Stack(lengths)
        h, l, c = (floats(bars, x) for x in "hlc")  # noqa: E741
        in_series = np.arange(len(sid)) - np.repeat(first, lengths)
        parts = []
        for name, size in sizes.items():
            high, low, *by = _thresholds(method, size, h, l, c, of)
            place, known, is_high = turns(high, low, *by, of)
            own = bars.column("sid").take(pa.array(place))
            kind, price = np.where(is_high, "HIGH", "LOW"), np.where(is_high, high[place], low[place])
            parts.append(pa.table({"sid": own, "method": pa.array([method] * len(place), pa.string()), "sensitivity": pa.array([name] * len(place), pa.string()), "kind": pa.array(kind.tolist(), pa.string()), "bar": in_series[place], "known": pa.array(known, pa.int64()), "price": nullable(price)}))
        return pa.concat_tables(parts)

    return run


def found(bars: DataFrame, method: str, sizes: dict[str, float]) -> DataFrame:
    """sid, method, sensitivity, kind, bar, known, price of the reversals by ATR multiples, percent or percent of closes."""
    own = bars.select(F.col("sid").cast("long").alias("sid"), "i", "h", "l", "c")
    return over_series(own, ["i"], scan(method, sizes), "sid long, method string, sensitivity string, kind string, bar long, known long, price double")


def primary(bars: DataFrame) -> DataFrame:
    """The swings of three ATR with the ATR of their bar (bars have atr), what they moved since the one before, and their label."""
    swings = found(bars, "ATR", {"INTERMEDIATE": C.ATR_MULTIPLE["INTERMEDIATE"]}).drop("method", "sensitivity")
    swings = swings.join(bars.select("sid", F.col("i").cast("long").alias("bar"), "atr"), ["sid", "bar"])
    by_known = Window.partitionBy("sid").orderBy("known", "bar", "kind")
    before = {x: F.lag(x).over(by_known) for x in ("price", "bar")}
    swings = swings.withColumn("move", F.col("price") - before["price"]).withColumn("bars", F.col("bar") - before["bar"]).withColumn("strength", F.abs("move") / F.when(F.col("atr") > 0, F.col("atr")))
    return labelled(swings)


def fine(bars: DataFrame) -> DataFrame:
    """The swings of one ATR with the ATR of their bar."""
    found_ = found(bars, "ATR", {"MICRO": C.ATR_MULTIPLE["MICRO"]}).drop("method", "sensitivity")
    return found_.join(bars.select("sid", F.col("i").cast("long").alias("bar"), "atr"), ["sid", "bar"])


def labelled(swings: DataFrame) -> DataFrame:
    """swings with label: each high and low against the one of its kind known before."""
    last = F.lag("price").over(Window.partitionBy("sid", "kind").orderBy("known", "bar"))
    d = F.col("price") - last
    band = C.EQUAL_ATR * F.coalesce("atr", F.lit(0.0))
    high = F.col("kind") == "HIGH"
    label = F.when(last.isNull(), None).when(F.abs(d) <= band, F.when(high, "EQH").otherwise("EQL")).when(d > 0, F.when(high, "HH").otherwise("HL")).otherwise(F.when(high, "LH").otherwise("LL"))
    return swings.withColumn("label", label)
