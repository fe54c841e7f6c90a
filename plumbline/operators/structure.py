"""Market structure: breaks, trend states, retracement legs, level roles, trendlines and zones of each share."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.operators.passes import Stack, apart, beside, floats, keys, over_series, parted


def _walk(sid: int, close: list[float], atr: list[float], swings: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """(breaks, states) of a share; swings (kind, bar, known, price, atr) come in order of known, bar and kind. On each bar breaks are judged first, then the
    swings known by it arrive, then the state is read."""
    arriving: dict[int, list] = {}
    for row in swings:
        arriving.setdefault(row[2], []).append(row)
    last: dict[str, tuple] = {}
    broken: set[tuple] = set()
    label: dict[str, str | None] = {"HIGH": None, "LOW": None}
    known: list[float] = []
    spread = None  # of the last RANGE_SWINGS prices
    regime = pending = state = None
    breaks, states = [], []
    for t, (c, a) in enumerate(zip(close, atr)):
        there = a == a  # noqa: PLR0124  a NaN is not itself
        if there:
            for side, kind in ((1, "HIGH"), (-1, "LOW")):
                swing = last.get(kind)
                if swing is None or (c - swing[1]) * side <= C.BREAK_ATR * a or swing in broken:
                    continue
                broken.add(swing)
                same = regime is None or regime == side or pending == side
                breaks.append((sid, t, "BOS" if same else "CHOCH", "UP" if side > 0 else "DOWN", swing[0], swing[1], state))
                regime, pending = (side, None) if same else (regime, side)
        for kind, bar, _, price, then in arriving.get(t, ()):
            before = last.get(kind)
            if before is not None:
                band = C.EQUAL_ATR * (then if then == then else 0.0)  # noqa: PLR0124
                d = price - before[1]
                high = kind == "HIGH"
                label[kind] = ("EQH" if high else "EQL") if abs(d) <= band else ("HH" if high else "HL") if d > 0 else ("LH" if high else "LL")
            last[kind] = (bar, price, kind)
            known.append(price)
            recent = known[-C.RANGE_SWINGS :]
            spread = max(recent) - min(recent) if len(recent) == C.RANGE_SWINGS else None
        flat = spread is not None and there and spread <= C.RANGE_ATR * a
        if regime is None or flat:
            now = "RANGE"
        elif pending is not None:
            now = "TRANSITION"
        elif regime > 0:
            now = "UPTREND_STRONG" if label["HIGH"] == "HH" and label["LOW"] == "HL" else "UPTREND_WEAKENING"
        else:
            now = "DOWNTREND_STRONG" if label["HIGH"] == "LH" and label["LOW"] == "LL" else "DOWNTREND_WEAKENING"
        if now != state:
            states.append((sid, t, now, {1: "UP", -1: "DOWN"}.get(regime), {1: "UP", -1: "DOWN"}.get(pending)))
            state = now
    return breaks, states


def _scan(sid: int, bars: pd.DataFrame, swings: pd.DataFrame) -> tuple[list[tuple], list[tuple]]:
    """_walk() over one series' frames; bars in order."""
    s = swings.sort_values(["known", "bar", "kind"])[["kind", "bar", "known", "price", "atr"]]
    return _walk(sid, bars["c"].astype(float).tolist(), bars["atr"].astype(float).tolist(), list(s.itertuples(index=False, name=None)))


_WALK = "sid long, t long, event string, direction string, swing_bar long, level double, prior_state string, state string, regime string, pending string"
_WALKED = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (f.split() for f in _WALK.split(", "))])


def _walk_many(table: pa.Table) -> pa.Table:
    bars, swings = apart(table)
    of_swings: dict[int, list] = {}
    own = swings.sort_by([(x, "ascending") for x in ("sid", "known", "bar", "kind")])
    for sid, *row in zip(keys(own).tolist(), *(own.column(x).to_pylist() for x in ("kind", "bar", "known")), floats(own, "price").tolist(), floats(own, "atr").tolist()):
        of_swings.setdefault(sid, []).append(tuple(row))
    sid = keys(bars)
    close, atr = floats(bars, "c").tolist(), floats(bars, "atr_i").tolist()
    rows: list[tuple] = []
    for first, n in zip(*(x.tolist() for x in parted(sid))):
        key = int(sid[first])
        breaks, states = _walk(key, close[first : first + n], atr[first : first + n], of_swings.get(key, []))
        rows += [(*b, None, None, None) for b in breaks]
        rows += [(key, t, None, None, None, None, None, *rest) for _, t, *rest in states]
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_WALKED)], schema=_WALKED)


def walked(bars: DataFrame, swings: DataFrame) -> DataFrame:
    """Breaks (`event` is not null) and changes of the trend state (`state` is not null) of one ordered pass, for found_breaks() and found_states()."""
    return over_series(beside(bars, swings.select("sid", "kind", "bar", "known", "price", "atr")), ["own", "i"], _walk_many, _WALK)


def found_breaks(walk: DataFrame) -> DataFrame:
    return walk.where("event is not null").select("sid", "t", "event", "direction", "swing_bar", "level", "prior_state")


def found_states(walk: DataFrame) -> DataFrame:
    return walk.where("state is not null").select("sid", F.col("t").alias("since"), "state", "regime", "pending")


def breaks(bars: DataFrame, swings: DataFrame) -> DataFrame:
    """sid, t, event (BOS, CHOCH), direction, swing_bar, level, prior_state: closes beyond the last unbroken swing."""
    return found_breaks(walked(bars, swings))


def trend_states(bars: DataFrame, swings: DataFrame) -> DataFrame:
    """sid, since, state, regime, pending: a row where the trend state of a share changes."""
    return found_states(walked(bars, swings))


def retracements(swings: DataFrame, bars: DataFrame) -> DataFrame:
    """Fibonacci legs between neighbouring swings of at least FIB_MIN_ATR: levels, and how the first close outside ended them."""
    w = Window.partitionBy("sid").orderBy("bar", "kind")
    legs = swings.withColumns({"anchor": F.lag("price").over(w), "anchor_bar": F.lag("bar").over(w), "anchor_known": F.lag("known").over(w)}).where(F.col("anchor").isNotNull() & (F.abs(F.col("price") - F.col("anchor")) >= C.FIB_MIN_ATR * F.col("atr")))
    legs = legs.select("sid", "anchor_bar", "anchor", "bar", "price", F.greatest("known", "anchor_known").alias("known"))
    closes = bars.select("sid", F.col("i").cast("long").alias("t"), F.col("c").cast("double").alias("c"))
    outside = legs.join(closes, "sid").where("t >= known and (c < least(anchor, price) or c > greatest(anchor, price))")
    first = outside.groupBy("sid", "anchor_bar", "bar").agg(F.min(F.struct("t", "c")).alias("x"))
    out = legs.join(first, ["sid", "anchor_bar", "bar"], "left")
    up = F.col("price") > F.col("anchor")
    low = F.col("x.c") < F.least("anchor", "price")
    status = F.when(F.col("x").isNull(), "ACTIVE").when(up == low, "BROKEN").otherwise("EXTENDED")
    height = F.col("price") - F.col("anchor")
    levels = {f"r{int(r * 1000)}": F.col("price") - r * height for r in C.RETRACEMENTS} | {f"e{int(e * 1000)}": F.col("anchor") + e * height for e in C.EXTENSIONS}
    return out.select("sid", "anchor_bar", "bar", "known", F.when(up, "UP").otherwise("DOWN").alias("direction"), status.alias("status"), F.col("x.t").alias("ended"), *[v.alias(k) for k, v in levels.items()])


def swing_levels(swings: DataFrame) -> DataFrame:
    """sid, source, price, known, role, bar: a level for each swing price."""
    return swings.select("sid", F.lit("SWING").alias("source"), "price", "known", F.when(F.col("kind") == "LOW", "SUPPORT").otherwise("RESISTANCE").alias("role"), F.col("bar"))


def level_sources(swings: DataFrame, found: DataFrame) -> DataFrame:
    """sid, source, price, known, role, bar: a level for each swing price and each break's level."""
    b = found.select("sid", F.col("event").alias("source"), F.col("level").alias("price"), F.col("t").alias("known"), F.when(F.col("direction") == "UP", "SUPPORT").otherwise("RESISTANCE").alias("role"), F.col("swing_bar").alias("bar"))
    return swing_levels(swings).unionByName(b)


def _turned(close: np.ndarray, buffer: np.ndarray, of: Stack, series: np.ndarray, price: np.ndarray, known: np.ndarray, support: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, bar, whether support from then on) of the changes of role, one pass over the bars of all series with all levels at once. `series` is the number of
    each level's series in `of`."""
    place = np.empty(len(of), np.int64)
    place[of.order] = np.arange(len(of))  # where a series stands in the order of steps
    level = np.argsort(place[series], kind="stable")
    at_series, price, known, support = place[series][level], price[level], known[level], support[level]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for t, at in of.steps():
        m = int(np.searchsorted(at_series, len(at)))  # levels of series that have this bar
        own = at[at_series[:m]]
        now, band = close[own], buffer[own]
        turned = (known[:m] < t) & np.where(support[:m], now < price[:m] - band, now > price[:m] + band)
        if turned.any():
            k = np.flatnonzero(turned)
            support[k] ^= True
            found.append((level[k], np.full(len(k), t), support[k]))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else none  # type: ignore[return-value]


def _flips(key: tuple, bars: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
    """The changes of role of one series' levels."""
    columns = ["sid", "source", "bar", "price", "known", "t", "role"]
    bars = bars.sort_values("i")
    close, buffer = bars["c"].to_numpy(float), C.BREAK_ATR * np.nan_to_num(bars["atr"].to_numpy(float))
    k, t, support = _turned(close, buffer, Stack([len(close)]), np.zeros(len(levels), np.int64), levels["price"].to_numpy(float), levels["known"].to_numpy(), (levels["role"] == "SUPPORT").to_numpy())
    return levels.iloc[k][columns[:5]].assign(t=t, role=np.where(support, "SUPPORT", "RESISTANCE")).reset_index(drop=True)


def _flips_many(table: pa.Table) -> pa.Table:
    bars, levels = apart(table)
    sid, of_level = keys(bars), keys(levels)
    first, lengths = parted(sid)
    there = np.isin(of_level, sid[first])
    levels, of_level = levels.filter(pa.array(there)), of_level[there]
    close, buffer = floats(bars, "c"), C.BREAK_ATR * np.nan_to_num(floats(bars, "atr_i"))
    known, support = levels.column("known").to_numpy(), pc.equal(levels.column("role"), "SUPPORT").to_numpy()
    k, t, is_support = _turned(close, buffer, Stack(lengths), np.searchsorted(sid[first], of_level), floats(levels, "price"), known, support)
    out = levels.select(["sid", "source", "bar", "price", "known"]).take(pa.array(k))
    return out.append_column("t", pa.array(t, pa.int64())).append_column("role", pa.array(np.where(is_support, "SUPPORT", "RESISTANCE").tolist(), pa.string()))


def role_changes(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """levels with every change of role: a close beyond the price by BREAK_ATR turns support into resistance and back."""
    types = {"bar": "long", "price": "double", "known": "long"}
    own = levels.select("sid", "source", *[F.col(c).cast(t).alias(c) for c, t in types.items()], "role").distinct()
    return over_series(beside(bars.withColumn("sid", F.col("sid").cast("long")), own.withColumn("sid", F.col("sid").cast("long"))), ["own", "i"], _flips_many, "sid long, source string, bar long, price double, known long, t long, role string")


def current_roles(levels: DataFrame, changes: DataFrame) -> DataFrame:
    """levels with their role after the last change and when it began."""
    last = changes.groupBy("sid", "source", "bar", "price", "known").agg(F.max(F.struct("t", "role")).alias("x"), F.count("*").alias("flips"))
    joined = levels.join(last, ["sid", "source", "bar", "price", "known"], "left")
    return joined.select("sid", "source", "bar", "price", "known", F.coalesce("x.role", "role").alias("role"), F.coalesce("x.t", "known").alias("since"), F.coalesce("flips", F.lit(0)).alias("flips"))


def trendline_pairs(swings: DataFrame, bars: DataFrame) -> DataFrame:
    """sid, kind, a, b, value, slope, known: rising lows and falling highs 4 to 104 bars apart whose line no swing between crosses, with a third touch."""
    least, most = C.TRENDLINE_BARS
    s = swings.select("sid", "kind", "bar", "known", "price", "atr")
    x, y = s.alias("x"), s.alias("y")
    up = F.when(F.col("x.kind") == "LOW", 1).otherwise(-1)
    pairs = x.join(y, (F.col("x.sid") == F.col("y.sid")) & (F.col("x.kind") == F.col("y.kind")) & F.col("y.bar").between(F.col("x.bar") + least, F.col("x.bar") + most))
    pairs = pairs.where((F.col("y.price") - F.col("x.price")) * up > 0)
    pairs = pairs.select(F.col("x.sid").alias("sid"), F.col("x.kind").alias("kind"), F.col("x.bar").alias("a"), F.col("y.bar").alias("b"), F.col("x.price").alias("value"), ((F.col("y.price") - F.col("x.price")) / (F.col("y.bar") - F.col("x.bar"))).alias("slope"), F.greatest("x.known", "y.known").alias("made"), up.alias("up"))
    z = s.select(F.col("sid").alias("s2"), F.col("kind").alias("k2"), F.col("bar").alias("z"), F.col("known").alias("zk"), F.col("price").alias("zp"), F.coalesce("atr", F.lit(0.0)).alias("za"))
    near = pairs.join(z, (F.col("sid") == F.col("s2")) & (F.col("kind") == F.col("k2")) & (F.col("z") > F.col("a")) & (F.col("z") != F.col("b")), "left")
    off = (F.col("zp") - F.col("value") - F.col("slope") * (F.col("z") - F.col("a"))) * F.col("up")
    crossed = F.max(((F.col("z") < F.col("b")) & (F.col("zk") <= F.col("made")) & (off < -C.TRENDLINE_TOUCH * F.col("za"))).cast("int"))
    touch = F.min(F.when((F.abs(off) <= C.TRENDLINE_TOUCH * F.col("za")) & (F.col("zk") - F.col("b") <= most), F.greatest("zk", "made")))
    lines = near.groupBy("sid", "kind", "a", "b", "value", "slope", "made").agg(crossed.alias("crossed"), touch.alias("known"), F.sum((F.abs(off) <= C.TRENDLINE_TOUCH * F.col("za")).cast("int")).alias("touches"))
    return lines.where("coalesce(crossed, 0) = 0 and known is not null").select("sid", "kind", "a", "b", "value", "slope", "known", "touches")


def zones(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """sid, low, high, side, members, distance, place: clusters of level prices near the running mean, the nearest four a side."""
    last = bars.groupBy("sid").agg(F.max(F.struct("i", "c", "atr")).alias("x")).select("sid", F.col("x.c").cast("double").alias("c"), F.col("x.atr").alias("atr")).where("atr is not null")
    both = levels.select("sid", "price", "known", "bar", "source").join(last, "sid")

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["price", "known", "bar", "source"])
        atr, close = df["atr"].iloc[0], df["c"].iloc[0]
        clusters: list[list[float]] = []
        for p in df["price"]:
            if clusters and abs(p - sum(clusters[-1]) / len(clusters[-1])) <= C.ZONE_TOLERANCE * atr:
                clusters[-1].append(p)
            else:
                clusters.append([p])
        rows = []
        for x in clusters:
            low, high = min(x), max(x)
            pad = max(0.0, C.ZONE_WIDTH * atr - (high - low)) / 2
            low, high = low - pad, high + pad
            rows.append((df["sid"].iloc[0], low, high, "SUPPORT" if (low + high) / 2 <= close else "RESISTANCE", len(x), max(0.0, low - close, close - high)))
        return pd.DataFrame(rows, columns=["sid", "low", "high", "side", "members", "distance"])

    found = both.groupBy("sid").applyInPandas(fold, "sid long, low double, high double, side string, members long, distance double")
    place = F.row_number().over(Window.partitionBy("sid", "side").orderBy("distance", "low"))
    return found.withColumn("place", place).where(F.col("place") <= C.ZONES_A_SIDE)


def overview(bars: DataFrame, states: DataFrame, swings: DataFrame, found: DataFrame) -> DataFrame:
    """share, segment, last, close, state, swings, breaks of each share's current segment, that of its last bar."""
    w = Window.partitionBy("share").orderBy(F.col("segment").desc())
    ends = bars.groupBy("share", "segment", "sid").agg(F.max(F.struct("i", "c")).alias("x")).withColumn("place", F.row_number().over(w)).where("place = 1")
    state = states.groupBy("sid").agg(F.max_by("state", "since").alias("state"))
    out = ends.join(state, "sid", "left").join(swings.groupBy("sid").agg(F.count("*").alias("swings")), "sid", "left").join(found.groupBy("sid").agg(F.count("*").alias("breaks")), "sid", "left")
    return out.select("share", "segment", F.col("x.i").alias("last"), F.col("x.c").alias("close"), "state", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("swings", "breaks")])
