"""Which security each row of the daily files belongs to: an ordered, stateful pass over days.

A security is known by what files called it: spans of days in which it had an ISIN, a symbol, a series. Rows with an ISIN go, in this order,
to the security that has it; to that of an ISIN which a reviewed link names; to the one security of the same issuer
that had the symbol within GAP days, or another symbol that a change notice ties to it; else a security begins. Rows without an ISIN
wait for their anchor, the first later session with ISINs, with no expected session missing between; then they go, latest day first, to the one that
held the symbol within GAP days, else to one that a notice leads to, else a security of that symbol begins. What contradicts
itself is never settled silently: it is quarantined with a reason.

Rows that share no identifier, issuer, notice or link cannot affect each other. The pass therefore runs in parallel over the connected
components of these. A component's rows stream through one task in order; it holds the component's spans and one day's rows, never
all rows. As a row's place in the order is fixed by its day or its anchor alone, a run to a day and one from there
on give what a single run gives.

Null symbols are quarantined as NO_SYMBOL, null days as NO_DAY; blank ISINs count as none; repeated rows are the same instrument twice in a day.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.components import connected

GAP = 45
ISSUER = 9  # characters of an ISIN that name its issuer
NOTICE, LINK, SPAN, ECHO, ROW = range(5)  # what a record of the stream is; the first three come before all rows
PENDING = "UNRESOLVED_IDENTITY"

_FIELDS = "component string, kind int, at date, late int, back int, id long, day date, isin string, symbol string, series string, name string, sid string, what string, value string, since date, until date, evidence string, basis string"
RESULT = "kind int, id long, day date, sid string, outcome string, evidence string, what string, value string, since date, until date, basis string, name string"


def security_id(basis: str, key: str) -> str:
    return "SEC-" + hashlib.sha256(f"{basis}|{key}".encode()).hexdigest()[:20]


class Master:
    """The securities of one component, and what they were called when."""

    def __init__(self, gap: int = GAP, by_issuer: bool = True, without_isin: bool = True):
        self.gap, self.by_issuer, self.without_isin = dt.timedelta(gap), by_issuer, without_isin
        self.spans: dict[tuple[str, str, str], list[list]] = defaultdict(list)  # (security, what, value) -> [since, until, evidence]
        self.owners: dict[tuple[str, str], set[str]] = defaultdict(set)  # (what, value) -> securities
        self.symbols: dict[str, set[str]] = defaultdict(set)  # security -> symbols
        self.issuers: dict[str, set[str]] = defaultdict(set)
        self.securities: dict[str, list] = {}  # security -> [basis, first day, last day, name, day of the name]
        self.notices: list[tuple[dt.date, str, str]] = []
        self.same: dict[str, set[str]] = defaultdict(set)
        self.apart: set[str] = set()

    def enter(self, sid: str, what: str, value: str, since: dt.date, until: dt.date, evidence: str) -> None:
        self.spans[sid, what, value].append([since, until, evidence])
        self.owners[what, value].add(sid)
        if what == "SYMBOL":
            self.symbols[sid].add(value)
        elif what == "ISIN":
            self.issuers[value[:ISSUER]].add(sid)

    def link(self, a: str, b: str | None) -> None:
        """a and b are the same security; without b, a is nobody's successor."""
        if b is None:
            self.apart.add(a)
        else:
            self.same[a].add(b)
            self.same[b].add(a)

    def _had(self, sid: str, symbol: str, day: dt.date, slack: dt.timedelta) -> bool:
        return any(s - slack <= day <= u + slack for s, u, _ in self.spans.get((sid, "SYMBOL", symbol), ()))

    def holders(self, symbol: str, day: dt.date, slack: dt.timedelta = dt.timedelta(0)) -> set[str]:
        return {sid for sid in self.owners.get(("SYMBOL", symbol), ()) if self._had(sid, symbol, day, slack)}

    def _observe(self, sid: str, what: str, value: str, day: dt.date, evidence: str) -> None:
        """A day's identifier extends the spans of the same evidence that it is within the gap of, and makes them one; else one begins."""
        spans = self.spans.get((sid, what, value), [])
        if any(s <= day <= u for s, u, _ in spans):
            return
        near = [x for x in spans if x[2] == evidence and x[0] - self.gap <= day <= x[1] + self.gap]
        if not near:
            return self.enter(sid, what, value, day, day, evidence)
        one = [min(day, *(x[0] for x in near)), max(day, *(x[1] for x in near)), evidence]
        self.spans[sid, what, value] = [x for x in spans if x not in near] + [one]

    def _decide(self, row: dict) -> tuple[str, str, str | None, bool] | str:
        """(security, evidence, basis of a new one, whether it was linked), or why not."""
        return (self._with_isin if row["isin"] else self._by_symbol)(row)

    def _with_isin(self, row: dict) -> tuple | str:
        isin, symbol, day = row["isin"], row["symbol"], row["day"]
        own = self.owners.get(("ISIN", isin), set())
        told = set().union(*(self.owners.get(("ISIN", p), set()) for p in self.same.get(isin, ())))
        if len(own) > 1 or len(told) > 1 or (own and told and own != told):
            return "IDENTITY_CONFLICT"
        found: tuple = ()
        if own:
            found = (*own, "OBSERVED", None, False)
        elif told:
            found = (*told, "OVERRIDE", None, True)
        elif self.by_issuer and isin not in self.apart:
            fit = {sid for sid in self.issuers.get(isin[:ISSUER], ()) if self._connects(sid, symbol, day)}
            if len(fit) > 1:
                return "IDENTITY_CONFLICT"
            if fit:
                found = (*fit, "SAME_ISSUER_ISIN", None, True)
        found = found or (security_id("ISIN", isin), "OBSERVED", "ISIN", False)
        return "IDENTITY_CONFLICT" if self.holders(symbol, day) - {found[0]} else found

    def _connects(self, sid: str, symbol: str, day: dt.date) -> bool:
        near = {s for s in self.symbols[sid] if self._had(sid, s, day, self.gap)}
        return symbol in near or any(abs(when - day) <= self.gap and ((symbol == old and new in near) or (symbol == new and old in near)) for when, old, new in self.notices)

    def _by_symbol(self, row: dict) -> tuple | str:
        symbol, day = row["symbol"], row["day"]
        if not self.without_isin:
            return PENDING
        fit, evidence = self.holders(symbol, day, self.gap), "SYMBOL_CONTINUITY"
        if not fit:
            for when, old, new in self.notices:
                if symbol == old and day < when <= day + self.gap:
                    fit |= self.holders(new, when, self.gap)
                elif symbol == new and when <= day <= when + self.gap:
                    fit |= self.holders(old, when, self.gap)
            evidence = "SYMBOL_CHANGE_NOTICE" if fit else evidence
        if len(fit) > 1:
            return "AMBIGUOUS_IDENTITY"
        if fit:
            sid = min(fit)
            return "IDENTITY_CONFLICT" if self.holders(symbol, day) - {sid} else (sid, evidence, None, evidence != "SYMBOL_CONTINUITY")
        return security_id("SYMBOL_CONTINUITY", f"{symbol}:{day}"), evidence, "SYMBOL_CONTINUITY", False

    def day(self, rows: list[dict]) -> Iterator[tuple[dict, str | None, str, str | None]]:
        """(row, security, outcome, evidence) of one day's rows; echoes are decided to be checked against, and give nothing."""
        rows = sorted(rows, key=lambda r: (not r["isin"], r["isin"] or "", r["symbol"], r["series"] or "", r["id"]))
        made = [(r, self._decide(r)) for r in rows]
        good = [(r, d) for r, d in made if not isinstance(d, str)]
        of_security, of_symbol, of_isin = defaultdict(int), defaultdict(set), defaultdict(int)
        for r, d in good:
            of_security[d[0]] += 1
            of_symbol[r["symbol"]].add(d[0])
            of_isin[r["isin"]] += bool(r["isin"])
        for r, d in made:
            outcome = d if isinstance(d, str) else "DUPLICATE_SECURITY_DATE" if of_security[d[0]] > 1 or of_isin[r["isin"]] > 1 else "IDENTITY_CONFLICT" if len(of_symbol[r["symbol"]]) > 1 else "ASSIGNED"
            if r["kind"] == ECHO:
                continue
            if outcome != "ASSIGNED":
                yield r, None, outcome, None
                continue
            sid, evidence, basis, linked = d
            self._accept(r, sid, evidence, basis, linked)
            yield r, sid, outcome, evidence

    def _accept(self, r: dict, sid: str, evidence: str, basis: str | None, linked: bool) -> None:
        day = r["day"]
        about = self.securities.setdefault(sid, [basis, day, day, None, None])
        about[1], about[2] = min(about[1], day), max(about[2], day)
        if r["name"] and (about[4] is None or day >= about[4]):
            about[3], about[4] = r["name"], day
        if r["isin"]:
            self._observe(sid, "ISIN", r["isin"], day, evidence if linked else "OBSERVED")
        self._observe(sid, "SYMBOL", r["symbol"], day, "OBSERVED" if r["isin"] else evidence)
        if r["series"]:
            self._observe(sid, "SERIES", r["series"], day, "OBSERVED")


_OUT = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("day", pa.date32()), *((c, pa.string()) for c in ("sid", "outcome", "evidence", "what", "value")), ("since", pa.date32()), ("until", pa.date32()), ("basis", pa.string()), ("name", pa.string())])


def _pass(options: dict) -> Callable:
    """For mapInArrow over records by component and order: outcomes of rows, then each component's spans and securities."""

    def found(records: Iterator[dict]) -> Iterator[tuple]:
        for _, own in itertools.groupby(records, key=lambda r: r["component"]):
            m = Master(**options)
            for (kind, *_), rows in itertools.groupby(own, key=lambda r: (min(r["kind"], ECHO), r["at"], r["late"], r["back"])):
                if kind == ECHO:
                    for r, sid, outcome, evidence in m.day(list(rows)):
                        yield ROW, r["id"], r["day"], sid, outcome, evidence, None, None, None, None, None, r["name"]
                    continue
                for r in rows:
                    if kind == NOTICE:
                        m.notices.append((r["since"], r["what"], r["value"]))
                    elif kind == LINK:
                        m.link(r["what"], r["value"])
                    elif r["what"] == "SECURITY":
                        m.securities[r["sid"]] = [r["basis"], r["since"], r["until"], r["name"], r["day"]]
                    else:
                        m.enter(r["sid"], r["what"], r["value"], r["since"], r["until"], r["evidence"])
            for (sid, what, value), spans in m.spans.items():
                for since, until, evidence in spans:
                    yield SPAN, None, None, sid, None, evidence, what, value, since, until, None, None
            for sid, (basis, first, last, name, named) in m.securities.items():
                yield SPAN, None, named, sid, None, None, "SECURITY", sid, first, last, basis, name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = found(r for b in batches for r in b.to_pylist())
        while rows := list(itertools.islice(out, 10000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)

    return run


def anchors(rows: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """day, anchor: for each day of rows (day, isin) the first later day with ISINs, null if there is none or a day of calendar (day) is missing between."""
    days = rows.groupBy("day").agg(F.count("*").alias("n"), F.count("isin").alias("isins"))
    if calendar is not None:
        days = days.join(calendar.select("day").distinct(), "day", "full")
    later = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a day of the calendar
    next_isin = F.last(F.when(F.col("isins") > 0, F.col("day")), True).over(later)
    next_gap = F.last(F.when(F.col("n").isNull(), F.col("day")), True).over(later)
    days = days.withColumns({"next_isin": next_isin, "next_gap": next_gap})
    return days.where("n > 0").select("day", F.when(F.col("next_gap").isNull() | (F.col("next_gap") > F.col("next_isin")), F.col("next_isin")).alias("anchor"))



def _stream(rows: DataFrame, notices: DataFrame, links: DataFrame, master: DataFrame | None, again: DataFrame | None, calendar: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The records of the pass, and the rows that are not ready for it with their outcome."""
    plain = lambda x: x.select("id", "day", F.nullif(F.trim("isin"), F.lit("")).alias("isin"), "symbol", "series", "name")
    rows = plain(rows)
    rows = rows.join(F.broadcast(anchors(rows.where("day is not null"), calendar)), "day", "left")
    ready = F.col("symbol").isNotNull() & F.col("day").isNotNull() & (F.col("isin").isNotNull() | F.col("anchor").isNotNull())
    why = F.when(F.col("symbol").isNull(), "NO_SYMBOL").when(F.col("day").isNull(), "NO_DAY").otherwise(PENDING)
    refused = rows.where(~ready).select("id", "day", why.alias("outcome"))
    rows = rows.where(ready)
    node = lambda mark, c: F.concat(F.lit(mark), F.col(c))
    issuer = F.concat(F.lit("G"), F.substring("isin", 1, ISSUER))
    # an identifier is tied to its issuer even if it stands alone, so that all ISINs and symbols are nodes
    edges = [
        rows.where("isin is not null").select(node("I", "isin").alias("a"), node("S", "symbol").alias("b")), rows.where("isin is not null").select(node("I", "isin"), issuer), rows.select(node("S", "symbol"), node("S", "symbol")),
        notices.select(node("S", "old"), node("S", "new")), links.select(node("I", "isin"), node("I", "other")), links.select(node("I", "isin"), node("I", "isin")),
    ]
    if master is not None:
        edges.append(master.where("what in ('ISIN', 'SYMBOL')").select(node("X", "sid"), F.concat(F.substring("what", 1, 1), "value")))
        edges.append(master.where("what = 'ISIN'").select(F.concat(F.lit("I"), "value"), F.concat(F.lit("G"), F.substring("value", 1, ISSUER))))
    pairs = edges[0]
    for e in edges[1:]:
        pairs = pairs.union(e)
    of = connected(pairs.distinct())

    def placed(df: DataFrame, key) -> DataFrame:
        return df.withColumn("node", key).join(of, "node").drop("node")

    whole = [c.split()[0] for c in _FIELDS.split(", ")]
    empty = rows.sparkSession.createDataFrame([], _FIELDS)
    late = F.when(F.col("isin").isNull(), 1).otherwise(0)
    live = rows.withColumns({"late": late, "at": F.when(F.col("isin").isNull(), F.col("anchor")).otherwise(F.col("day")), "back": F.when(F.col("isin").isNull(), -F.datediff("day", F.lit("1970-01-01"))).otherwise(0), "kind": F.lit(ROW)})
    # rows with ISINs of days that also have rows without come once more when these are decided
    mixed = rows.where("isin is null").select("day", "anchor").distinct().withColumnRenamed("anchor", "again")
    before = rows if again is None else rows.unionByName(plain(again), allowMissingColumns=True)
    echo = before.where("isin is not null").join(F.broadcast(mixed), "day").withColumns({"late": F.lit(1), "at": F.col("again"), "back": -F.datediff("day", F.lit("1970-01-01")), "kind": F.lit(ECHO)})
    parts = [placed(x, node("S", "symbol")) for x in (live, echo)]
    parts.append(placed(notices.select(F.lit(NOTICE).alias("kind"), F.col("old").alias("what"), F.col("new").alias("value"), F.col("effective").alias("since")), node("S", "what")))
    parts.append(placed(links.select(F.lit(LINK).alias("kind"), F.col("isin").alias("what"), F.col("other").alias("value")), node("I", "what")))
    if master is not None:
        parts.append(placed(master.withColumn("kind", F.lit(SPAN)), node("X", "sid")))
    out = empty
    for p in parts:
        out = out.unionByName(p.select(*[c for c in whole if c in p.columns]), allowMissingColumns=True)
    return out, refused


def resolved(rows: DataFrame, notices: DataFrame, links: DataFrame, master: DataFrame | None = None, again: DataFrame | None = None, calendar: DataFrame | None = None, **options) -> DataFrame:
    """RESULT: a record of kind ROW for each row (its security, or the reason), then of kind SPAN the spans and securities as they stand.

    rows: id, day, isin, symbol, series, name; notices: old, new, effective; links: isin, other (null: the isin succeeds none).
    master: the records of kind SPAN of an earlier run; its pending rows are given again among rows, and in
    `again` the rows with an ISIN of their days, against which they are checked.
    """
    stream, refused = _stream(rows, notices, links, master, again, calendar)
    order = ["component", "kind_order", "at", "late", "back", "isin", "symbol", "series", "id"]
    parted = stream.withColumn("kind_order", F.least("kind", F.lit(ECHO))).repartition("component").sortWithinPartitions(*order).drop("kind_order")
    done = parted.mapInArrow(_pass(options), RESULT)
    return done.unionByName(refused.withColumn("kind", F.lit(ROW)), allowMissingColumns=True)
