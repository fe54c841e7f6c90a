"""Trendlines through swings: when they are made, validated and broken, which are one line, and which stand at the end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.operators.passes import apart, beside, floats, keys, over_series, parted

SCHEMA = "sid long, kind string, a long, b long, value double, slope double, known long, broken long, touches long, last_touch long"
_FOUND = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (f.split() for f in SCHEMA.split(", "))])
NEVER = np.iinfo(np.int64).max


def _of_kind(bar: np.ndarray, price: np.ndarray, known: np.ndarray, then: np.ndarray, up: int, close: np.ndarray, buffer: np.ndarray) -> list[tuple]:
    """(a, b, value, slope, validated, broken, touched bars, their known bars) of the lines of one kind of swings, in order of bars."""
    least, most = C.TRENDLINE_BARS
    found = []
    for i in range(len(bar)):
        for j in range(i + 1, int(np.searchsorted(bar, bar[i] + most, "right"))):
            if bar[j] - bar[i] < least or (price[j] - price[i]) * up <= 0:
                continue
            slope = (price[j] - price[i]) / (bar[j] - bar[i])
            made = max(known[i], known[j])
            k = np.delete(np.arange(i + 1, len(bar)), j - i - 1)
            k = k[then[k] > 0]
            away = (price[k] - price[i] - slope * (bar[k] - bar[i])) / then[k] * up
            if ((bar[k] < bar[j]) & (known[k] <= made) & (away < -C.TRENDLINE_TOUCH)).any():
                continue  # a swing between the two lies beyond the line
            near = k[np.abs(away) <= C.TRENDLINE_TOUCH]
            if not (known[near] - bar[i] <= most).any():
                continue  # no third touch in time, whenever the line breaks
            beyond = np.flatnonzero((close[bar[i] :] - price[i] - slope * np.arange(len(close) - bar[i])) * up < -buffer[bar[i] :])
            broken = bar[i] + beyond[0] if len(beyond) else NEVER
            near = near[known[near] < broken]
            timely = near[known[near] - bar[i] <= most]
            if broken <= made or not len(timely):
                continue
            own = np.concatenate(([i, j], near))
            found.append((bar[i], bar[j], price[i], slope, max(made, known[timely].min()), broken, bar[own], known[own]))
    return found


def _distinct(found: list[tuple]) -> list[tuple]:
    """The lines in the order of their validation, without those that share two touches known by then with one that stood then."""
    kept: list[tuple] = []
    for line in sorted(found, key=lambda x: (x[4], x[0], x[1])):
        own = set(line[6][line[7] <= line[4]].tolist())
        if not any(o[5] > line[4] and len(own & set(o[6][o[7] <= line[4]].tolist())) >= 2 for o in kept):
            kept.append(line)
    return kept


def _many(table: pa.Table) -> pa.Table:
    """The lines of whole series; rows of passes.beside()."""
    bars, swings = apart(table)
    swings = swings.sort_by([(x, "ascending") for x in ("sid", "kind", "bar")])
    first, lengths = parted(keys(bars))
    sid = keys(bars)[first]
    close, buffer = floats(bars, "c"), C.BREAK_ATR * np.nan_to_num(floats(bars, "atr_i"))
    low = pc.equal(swings.column("kind"), "LOW").to_numpy()
    bar, price, known, then = swings.column("bar").to_numpy(), floats(swings, "price"), swings.column("known").to_numpy(), floats(swings, "atr")
    of_swing, rows = keys(swings), []
    at, n = parted(of_swing * 2 + low)  # the swings of one kind of a series
    for k, own in zip(at.tolist(), (slice(x, x + y) for x, y in zip(at, n))):
        of = np.searchsorted(sid, of_swing[k]) if len(sid) else 0
        its = slice(first[of], first[of] + lengths[of]) if of < len(sid) and sid[of] == of_swing[k] else slice(0, 0)
        found = _of_kind(bar[own], price[own], known[own], then[own], 1 if low[k] else -1, close[its], buffer[its])
        for a, b, value, slope, validated, broken, touched, seen in _distinct(found):
            rows.append((int(of_swing[k]), "LOW" if low[k] else "HIGH", a, b, value, slope, validated, None if broken == NEVER else broken, len(touched), seen.max()))
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)


def life(swings: DataFrame, bars: DataFrame) -> DataFrame:
    """SCHEMA: rising lines through lows and falling ones through highs.

    A line through two swings 4 to 104 bars apart, with no swing between beyond it, is validated by a third touch known
    within 104 bars of the first; a close beyond it by BREAK_ATR breaks it, and one broken before it was made is none. One ordered pass over the bars and
    swings of a series: whether a line stands depends on those before it.
    """
    types = {"kind": "string", "bar": "long", "known": "long", "price": "double", "atr": "double"}
    own = swings.select(F.col("sid").cast("long").alias("sid"), *[F.col(c).cast(t).alias(c) for c, t in types.items()])
    return over_series(beside(bars.withColumn("sid", F.col("sid").cast("long")), own), ["own", "i"], _many, SCHEMA)


def active(lines: DataFrame, bars: DataFrame) -> DataFrame:
    """sid, kind, a, b, value, distance, place: the unbroken lines of each side that were touched last, at the last bar and in its ATRs."""
    last = bars.groupBy("sid").agg(F.max(F.struct(F.col("i").alias("i"), F.col("c").cast("double").alias("c"), "atr")).alias("x")).where("x.atr > 0")
    order = Window.partitionBy("sid", "kind").orderBy(F.col("last_touch").desc(), F.col("known").desc(), "a", "b")
    live = lines.where("broken is null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= C.TRENDLINES_A_SIDE).join(last, "sid")
    now = F.col("value") + F.col("slope") * (F.col("x.i") - F.col("a"))
    return live.select("sid", "kind", "a", "b", now.alias("value"), (F.abs(F.col("x.c") - now) / F.col("x.atr")).alias("distance"), "place")


def breaks(lines: DataFrame) -> DataFrame:
    """sid, t, event, direction of broken lines, as evidence.break_volume takes them."""
    return lines.where("broken is not null").select("sid", F.col("broken").alias("t"), F.lit("TRENDLINE").alias("event"), F.when(F.col("kind") == "LOW", "DOWN").otherwise("UP").alias("direction"), "a", "b")
