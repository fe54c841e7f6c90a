"""Series functions over a window of bars: each takes and gives columns; a warm-up is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline import config as C


def by_bar() -> WindowSpec:
    """The bars of a share in order."""
    return Window.partitionBy("sid").orderBy("i")


def full(x: Column, n: int, value: Column, w: WindowSpec | None = None, until: int = 0) -> Column:
    """value, where the last n rows up to `until` all have an x."""
    w = w or by_bar()
    return F.when(F.count(x).over(w.rowsBetween(until - n + 1, until)) == n, value)


def sma(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    w = w or by_bar()
    return full(x, n, F.avg(x).over(w.rowsBetween(-n + 1, 0)), w)


def running(df: DataFrame, of: dict[str, Column]) -> DataFrame:
    """df with, for each name, `<name>_sum` and `<name>_n`: the sum and the count of a whole-number column up to each bar."""
    w = by_bar().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{k}_sum": F.coalesce(F.sum(x).over(w), F.lit(0)) for k, x in of.items()} | {f"{k}_n": F.count(x).over(w) for k, x in of.items()})


#: Sums up to each bar that moments() gives: of the closes, of them times the bar's number and its square, of their squares.
MOMENTS = ("z0", "z1", "z2", "zz")


def moment_terms() -> dict[str, Column]:
    """What a bar adds to each of MOMENTS."""
    t, close = F.col("i").cast("long"), F.col("c").cast("long")
    return {"z0": close, "z1": t * close, "z2": t * t * close, "zz": close * close}


def moments(bars: DataFrame) -> DataFrame:
    """bars with MOMENTS: least squares over any bars need these at both ends alone. Exact, as closes are whole numbers."""
    w = by_bar().rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumns({k: F.sum(v).over(w) for k, v in moment_terms().items()})


def _last(column: str, n: int, until: int = 0) -> Column:
    """What a running column grew by over the n rows up to `until`."""
    w = by_bar()
    now = F.lag(column, -until).over(w) if until else F.col(column)
    return now - F.coalesce(F.lag(column, n - until).over(w), F.lit(0))


def last_sum(name: str, n: int, until: int = 0) -> Column:
    """The sum of the last n values up to `until`, where all are there, by the columns of running()."""
    return F.when(_last(f"{name}_n", n, until) == n, _last(f"{name}_sum", n, until))


def mean(name: str, n: int) -> Column:
    return last_sum(name, n) / n


def true_range(w: WindowSpec | None = None) -> Column:
    """Null on the first bar: greatest() would skip the missing close."""
    w = w or by_bar()
    before = F.lag("c").over(w)
    return F.when(before.isNotNull(), F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before)))


def roc(n: int = C.ROC, w: WindowSpec | None = None) -> Column:
    w = w or by_bar()
    base = F.lag("c", n).over(w)
    return F.when(base != 0, 100 * (F.col("c") / base - 1))


def raw_stochastic(n: int = C.STOCHASTIC, w: WindowSpec | None = None) -> Column:
    w = w or by_bar()
    rows = w.rowsBetween(-n + 1, 0)
    low, high = F.min("l").over(rows), F.max("h").over(rows)
    return full(F.col("c"), n, F.when(high == low, F.lit(50.0)).otherwise(100 * (F.col("c") - low) / (high - low)), w)


def deviation(c: str, squares: str, n: int = C.BOLLINGER) -> Column:
    """Population deviation of whole-number closes, by running() columns of them and their squares; the sums are exact."""
    return F.sqrt((n * last_sum(squares, n) - last_sum(c, n) * last_sum(c, n)).cast("double")) / n


def relative_volume(n: int = C.RVOL_BASE, w: WindowSpec | None = None) -> Column:
    """Volume by the mean of the n bars before; the bar itself is left out."""
    w = w or by_bar()
    rows = w.rowsBetween(-n, -1)
    mean = F.avg("v").over(rows)
    return F.when((F.count("v").over(rows) == n) & (mean > 0), F.col("v") / mean)


def relative_to_mean(v: Column, name: str, n: int = C.RVOL_BASE) -> Column:
    """The same by running() columns of the volume."""
    before = last_sum(name, n, -1) / n
    return F.when(before > 0, v / before)


def obv(w: WindowSpec | None = None) -> Column:
    """On-balance volume needs the change as a column `dc`."""
    w = w or by_bar()
    return F.sum(F.coalesce(F.signum("dc"), F.lit(0.0)) * F.col("v")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")


def volume_trend(name: str) -> Column:
    """By running() columns of the volume."""
    short, long = mean(name, C.VOLUME_SHORT), mean(name, C.VOLUME_LONG)
    return F.when(long.isNull() | (long == 0), None).when(short >= long * (1 + C.VOLUME_BAND), "RISING").when(short <= long * (1 - C.VOLUME_BAND), "FALLING").otherwise("FLAT")


def volume_state(rvol: Column) -> Column:
    return F.when(rvol.isNull(), None).when(rvol >= C.RVOL_EXPANSION, "EXPANSION").when(rvol <= C.RVOL_CONTRACTION, "CONTRACTION").otherwise("NORMAL")


def starts(flag: Column, w: WindowSpec | None = None) -> Column:
    """The first bar of each run of a flag."""
    w = w or by_bar()
    return flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
