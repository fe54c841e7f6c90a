"""Market structure of a stream: bars that late events still correct, and the machines that closed bars drive.

Events of a series are gathered into hourly bars. A bar is open until the watermark passes its end: until then each event, early or late,
changes it, and it is given again as FORMING. When it closes, it moves the machines one step: average true range, reversals,
breaks of structure and trend states, roles of levels. A forming bar confirms nothing. The state of a series is its open bars, one row of typed
values, and its levels; a run that ends goes on from its checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline import config as C

HOUR = 3_600_000
OPEN = "first_at long, first_id long, o double, h double, l double, last_at long, last_id long, c double, n long"
CORE = (
    "i long, close double, ranges long, total double, atr double, leg int, top_bar long, top double, top_atr double, bottom_bar long, bottom double, bottom_atr double, high_bar long, high double, high_broken boolean, high_label string, "
    "low_bar long, low double, low_broken boolean, low_label string, regime int, pending int, p1 double, p2 double, p3 double, p4 double, state string"
)
LEVEL = "source string, bar long, price double, known long, support boolean"
OUT = "event_type string, kind string, i long, hour timestamp, what string, direction string, bar long, price double, o double, h double, l double, c double, n long"
_FIELDS = [f.split()[0] for f in CORE.split(", ")]
_OUT = [f.split()[0] for f in OUT.split(", ")]


def _beyond(a: float | None, b: float) -> bool:
    return a is not None and not math.isnan(a) and a > b


class Machine:
    """One series after any number of closed bars; step() takes the next one."""

    def __init__(self, core: tuple | None, levels: list[tuple], multiple: float = C.ATR_MULTIPLE["INTERMEDIATE"]):
        self.v = dict(zip(_FIELDS, core)) if core else dict.fromkeys(_FIELDS) | {"i": -1, "ranges": 0, "total": 0.0, "leg": 0, "high_broken": False, "low_broken": False}
        self.levels = [list(x) for x in levels]
        self.multiple = multiple

    def core(self) -> tuple:
        return tuple(self.v[k] for k in _FIELDS)

    def step(self, h: float, l: float, c: float) -> list[tuple]:  # noqa: E741
        """(kind, what, direction, bar, price) of what the bar brings: SWING, BREAK, STATE, ROLE."""
        v = self.v
        v["i"] += 1
        t = v["i"]
        self._range(h, l, c)
        swing = self._turn(t, h, l)
        turned = self._roles(t, c)
        broken = self._breaks(t, c)
        if swing:
            self._arrive(*swing[1:])
            self.levels.append(["SWING", swing[3], swing[4], t, swing[1] == "LOW"])
        for _, event, direction, bar, price in broken:
            self.levels.append([event, bar, price, t, direction == "UP"])
        out = ([swing[:1] + (swing[1], None, swing[3], swing[4])] if swing else []) + broken + turned
        now = self._state()
        if now != v["state"]:
            out.append(("STATE", now, {1: "UP", -1: "DOWN"}.get(v["regime"]), None, None))
            v["state"] = now
        v["close"] = c
        return out

    def _range(self, h: float, l: float, c: float) -> None:  # noqa: E741
        v, before = self.v, self.v["close"]
        if before is None:
            return
        true = max(h - l, abs(h - before), abs(l - before))
        v["ranges"] += 1
        v["total"] += true
        if v["ranges"] == C.ATR:
            v["atr"] = v["total"] / C.ATR
        elif v["ranges"] > C.ATR:
            v["atr"] = (v["atr"] * (C.ATR - 1) + true) / C.ATR

    def _turn(self, t: int, h: float, l: float) -> tuple | None:  # noqa: E741
        """A reversal by the multiple of the ATR that the extreme's own bar had."""
        v = self.v
        here = v["atr"]
        if t == 0:
            v.update(top_bar=0, top=h, top_atr=here, bottom_bar=0, bottom=l, bottom_atr=here)
            return None
        down = v["top_atr"] is not None and l <= v["top"] - self.multiple * v["top_atr"]
        up = v["bottom_atr"] is not None and h >= v["bottom"] + self.multiple * v["bottom_atr"]
        if v["leg"] >= 0 and down and (v["leg"] == 1 or not up or v["top_bar"] <= v["bottom_bar"]):
            found = "SWING", "HIGH", v["top_atr"], v["top_bar"], v["top"]
            v.update(leg=-1, bottom_bar=t, bottom=l, bottom_atr=here)
            return found
        if v["leg"] <= 0 and up:
            found = "SWING", "LOW", v["bottom_atr"], v["bottom_bar"], v["bottom"]
            v.update(leg=1, top_bar=t, top=h, top_atr=here)
            return found
        if v["leg"] >= 0 and h > v["top"]:
            v.update(top_bar=t, top=h, top_atr=here)
        if v["leg"] <= 0 and l < v["bottom"]:
            v.update(bottom_bar=t, bottom=l, bottom_atr=here)
        return None

    def _breaks(self, t: int, c: float) -> list[tuple]:
        v, out = self.v, []
        for side, k in ((1, "high"), (-1, "low")):
            if v["atr"] is None or v[f"{k}_bar"] is None or v[f"{k}_broken"] or (c - v[k]) * side <= C.BREAK_ATR * v["atr"]:
                continue
            v[f"{k}_broken"] = True
            same = v["regime"] is None or v["regime"] == side or v["pending"] == side
            out.append(("BREAK", "BOS" if same else "CHOCH", "UP" if side > 0 else "DOWN", v[f"{k}_bar"], v[k]))
            v["regime"], v["pending"] = (side, None) if same else (v["regime"], side)
        return out

    def _arrive(self, kind: str, then: float | None, bar: int, price: float) -> None:
        v, k = self.v, kind.lower()
        if v[f"{k}_bar"] is not None:
            d, high = price - v[k], kind == "HIGH"
            equal = abs(d) <= C.EQUAL_ATR * (then or 0.0)
            v[f"{k}_label"] = ("EQH" if high else "EQL") if equal else ("HH" if high else "HL") if d > 0 else ("LH" if high else "LL")
        v.update({f"{k}_bar": bar, k: price, f"{k}_broken": False})
        v["p1"], v["p2"], v["p3"], v["p4"] = price, v["p1"], v["p2"], v["p3"]

    def _state(self) -> str:
        v = self.v
        recent = [v[f"p{k}"] for k in range(1, C.RANGE_SWINGS + 1)]
        flat = v["atr"] is not None and None not in recent and max(recent) - min(recent) <= C.RANGE_ATR * v["atr"]
        if v["regime"] is None or flat:
            return "RANGE"
        if v["pending"] is not None:
            return "TRANSITION"
        way, highs, lows = ("UPTREND", "HH", "HL") if v["regime"] > 0 else ("DOWNTREND", "LH", "LL")
        return f"{way}_STRONG" if (v["high_label"], v["low_label"]) == (highs, lows) else f"{way}_WEAKENING"

    def _roles(self, t: int, c: float) -> list[tuple]:
        buffer, out = C.BREAK_ATR * (self.v["atr"] or 0.0), []
        for x in self.levels:
            if x[3] < t and (c < x[2] - buffer if x[4] else c > x[2] + buffer):
                x[4] = not x[4]
                out.append(("ROLE", x[0], "SUPPORT" if x[4] else "RESISTANCE", x[1], x[2]))
        return out


class Live(StatefulProcessor):
    """Events of a series to FORMING and BAR rows and what its bars bring."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "hour long", OPEN)
        self.machine = handle.getValueState("machine", CORE)
        self.levels = handle.getListState("levels", LEVEL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        closed = timerValues.getCurrentWatermarkInMs()
        out = []
        for part in rows:
            part = part.dropna(subset=["at", "value"]).sort_values(["at", "event_id"])
            for hour, x in part.groupby(part["at"] // 1000 // HOUR * HOUR):
                if hour + HOUR <= closed:
                    continue  # later than the watermark allows
                first, last = x.iloc[0], x.iloc[-1]
                bar = (int(first["at"]), int(first["event_id"]), float(first["value"]), float(x["value"].max()), float(x["value"].min()), int(last["at"]), int(last["event_id"]), float(last["value"]), len(x))
                if self.open.containsKey((int(hour),)):
                    bar = merged(tuple(self.open.getValue((int(hour),))), bar)
                else:
                    self.handle.registerTimer(int(hour) + HOUR)
                self.open.updateValue((int(hour),), bar)
                out.append((key[0], "FORMING", None, pd.Timestamp(int(hour), unit="ms"), None, None, None, None, *(bar[k] for k in (2, 3, 4, 7, 8))))
        yield pd.DataFrame(out, columns=_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = []
        if self.open.containsKey((expiredTimerInfo.getExpiryTimeInMs() - HOUR,)):  # else an earlier timer of this batch closed it
            due = timerValues.getCurrentWatermarkInMs()
            hours = sorted(h for (h,), _ in self.open.iterator() if h + HOUR <= due)
            m = Machine(self.machine.get() if self.machine.exists() else None, list(self.levels.get()))
            for hour in hours:
                bar = self.open.getValue((hour,))
                self.open.removeKey((hour,))
                found = m.step(bar[3], bar[4], bar[7])
                at, i = pd.Timestamp(hour, unit="ms"), m.v["i"]
                out.append((key[0], "BAR", i, at, None, None, None, None, *(bar[k] for k in (2, 3, 4, 7, 8))))
                out += [(key[0], kind, i, at, what, direction, b, price, None, None, None, None, None) for kind, what, direction, b, price in found]
            self.machine.update(m.core())
            if m.levels:  # a store takes no empty list
                self.levels.put([tuple(x) for x in m.levels])
        yield pd.DataFrame(out, columns=_OUT)

    def close(self) -> None:
        pass


def merged(a: tuple, b: tuple) -> tuple:
    """Two parts of a bar as one: the first open, the last close."""
    first, last = min(a, b, key=lambda x: x[:2]), max(a, b, key=lambda x: x[5:7])
    return (*first[:3], max(a[3], b[3]), min(a[4], b[4]), *last[5:8], a[8] + b[8])


def live(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """OUT rows of a stream of events (event_type, ts, event_id, value)."""
    rows = events.withWatermark("ts", late).select("event_type", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("event_type").transformWithStateInPandas(statefulProcessor=Live(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def written(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there and write each batch's rows to its own folder, so that a batch that is run again replaces its rows."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the machines' state needs it
    try:
        run = stream.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{path}/batch={k}")).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(key, before)
