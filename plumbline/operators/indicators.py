"""Indicators of every bar: window functions where they suffice, an ordered pass for recursive ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import series as S
from plumbline.operators.passes import Stack, floats, keys, nullable, over_series, parted


def windowed(bars: DataFrame) -> DataFrame:
    """bars with the indicators that are plain windows. Means of whole numbers are differences of running sums, which are exact: a frame of n rows would be
    summed anew at every bar."""
    c = F.col("c")
    w = S.by_bar()
    out = bars.withColumn("dc", c - F.lag("c").over(w))
    out = S.running(out, {"_c": c, "_cc": c * c, "_v": F.col("v")})
    out = out.withColumns({f"sma{n}": S.mean("_c", n) for n in C.SMA} | {"raw_k": S.raw_stochastic(), "roc": S.roc(), "tr": S.true_range(), "sd": S.deviation("_c", "_cc"), "volume_sma": S.mean("_v", C.VOLUME_SMA), "rvol": S.relative_to_mean(F.col("v"), "_v"), "obv": S.obv(), "volume_trend": S.volume_trend("_v")})
    out = out.withColumn("k", S.sma(F.col("raw_k"), C.STOCHASTIC_SMOOTHING)).withColumn("d", S.sma(F.col("k"), C.STOCHASTIC_D))
    mid = F.col(f"sma{C.BOLLINGER}")
    upper, lower = mid + C.BOLLINGER_K * F.col("sd"), mid - C.BOLLINGER_K * F.col("sd")
    out = out.withColumns({"upper": upper, "lower": lower, "bandwidth": F.when(mid != 0, (upper - lower) / mid), "volume_state": S.volume_state(F.col("rvol"))})
    return out.drop("dc", *(f"{x}_{y}" for x in ("_c", "_cc", "_v") for y in ("sum", "n")))


def emas(x: np.ndarray, periods: list[int], of: Stack | None = None) -> np.ndarray:
    """A row of exponential means of x for each period, all in one pass over the series that x is made `of` (by default one).

    A mean of n begins as the plain mean of the first n values and then moves 2 / (n + 1) of the way to each
    value. Nulls before the first value are no values; one after it is an error.
    """
    of = of or Stack([len(x)])
    n = np.array(periods, float)[:, None]
    means = np.full((len(n), len(x)), np.nan)
    now, total, seen = np.zeros((len(n), len(of))), np.zeros(len(of)), np.zeros(len(of))
    for _, at in of.steps():
        m, value = len(at), x[at]
        there = ~np.isnan(value)
        if (~there & (seen[:m] > 0)).any():
            raise ValueError("a series has a gap")
        seen[:m] += there
        total[:m] += np.where(there, value, 0.0)
        k = seen[:m]
        now[:, :m] = np.where(there, np.where(n == k, total[:m] / np.maximum(k, 1), now[:, :m] + 2 / (n + 1) * (value - now[:, :m])), now[:, :m])
        means[:, at] = np.where(n <= k, now[:, :m], np.nan)
    return means


def wilder(x: np.ndarray, n: int, first: int, of: Stack | None = None) -> np.ndarray:
    """Wilder's mean of each series' values from its `first` on, seeded with the mean of the first n of them."""
    of = of or Stack([len(x)])
    out = np.full(len(x), np.nan)
    value = np.zeros(len(of))
    for t, at in of.steps():
        if t < first:
            continue
        m = len(at)
        if t < first + n:
            value[:m] += x[at]
            if t < first + n - 1:
                continue
            value[:m] /= n
        else:
            value[:m] = (value[:m] * (n - 1) + x[at]) / n
        out[at] = value[:m]
    return out


def _before(x: np.ndarray, of: Stack | None) -> np.ndarray:
    """The value before each, NaN at the first of a series."""
    out = np.concatenate(([np.nan], x[:-1]))[: len(x)]
    if of is not None:
        out[of.first[of.first < len(x)]] = np.nan
    return out


def rsi(c: np.ndarray, n: int = C.RSI, of: Stack | None = None) -> np.ndarray:
    change = c - _before(c, of)
    up, down = wilder(np.maximum(change, 0), n, 1, of), wilder(np.maximum(-change, 0), n, 1, of)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + up / down)
    return np.where(np.isnan(up), np.nan, np.where(down == 0, np.where(up == 0, 50.0, 100.0), out))


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray, of: Stack | None = None) -> np.ndarray:  # noqa: E741
    before = _before(c, of)
    return np.maximum(h - l, np.maximum(np.abs(h - before), np.abs(l - before)))


def atr(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int = C.ATR, of: Stack | None = None) -> np.ndarray:  # noqa: E741
    return wilder(true_range(h, l, c, of), n, 1, of)


RECURSIVE = [*(f"ema{n}" for n in C.EMA), "macd", "macd_signal", "macd_histogram", "rsi", "atr", "atr_percent"]


def _many(bars: pa.Table) -> pa.Table:
    """The rows of whole series with RECURSIVE; the columns given stay as they are."""
    of = Stack(parted(keys(bars))[1])
    h, l, c = (floats(bars, x) for x in "hlc")  # noqa: E741
    fast, slow, *rest = emas(c, [C.MACD_FAST, C.MACD_SLOW, *C.EMA], of)
    got = {f"ema{n}": x for n, x in zip(C.EMA, rest)}
    line = fast - slow
    signal = emas(line, [C.MACD_SIGNAL], of)[0]
    a = atr(h, l, c, of=of)
    got |= {"macd": line, "macd_signal": signal, "macd_histogram": line - signal, "rsi": rsi(c, of=of), "atr": a, "atr_percent": 100 * a / c}
    for k in RECURSIVE:
        bars = bars.append_column(k, nullable(got[k]))
    return bars


def recursive(bars: DataFrame) -> DataFrame:
    """bars (sid, i, o, h, l, c, v, ...) with exponential means, MACD, RSI and ATR."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in bars.schema)}, {', '.join(f'{k} double' for k in RECURSIVE)}"
    return over_series(bars, ["i"], _many, schema)


def all_indicators(bars: DataFrame) -> DataFrame:
    """Both kinds."""
    return windowed(recursive(bars))
