"""As-of, interval and versioned joins, ranking and paging."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], forward: bool = False) -> DataFrame:
    """left with, from right, the values of the last row of its key at or before `at` (the first at or after, if forward).

    Both sides are put in one order and the values carried along it: one shuffle on the key, no range join.
    right must have one row for each (key, at).
    """
    packed = F.struct(F.col(at).alias("matched_at"), *values)
    a = left.select("*", F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_x"), F.lit(0 if forward else 1).alias("_side"))
    b = right.select(*[(F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns], packed.alias("_x"), F.lit(1 if forward else 0).alias("_side"))
    order = [F.col(at), F.col("_side")]
    w = Window.partitionBy(key).orderBy(*order)
    found = F.first("_x", True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_x", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = F.col("_side") == (0 if forward else 1)
    out = a.unionByName(b).withColumn("_f", found).where(own)
    return out.select(*left.columns, F.col("_f.matched_at").alias("matched_at"), *[F.col(f"_f.{v}").alias(v) for v in values])


def within(left: DataFrame, right: DataFrame, key: str, at: str, since: str, until: str, slack: int = 0) -> DataFrame:
    """left joined with right's rows of the same key whose span, widened by slack days, holds left's day."""
    r = right.withColumnRenamed(key, "_key")
    hold = F.col(at).between(F.date_sub(since, slack), F.date_add(until, slack))
    return left.join(r, (left[key] == r["_key"]) & hold).drop("_key")


def changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, change (ADDED, REMOVED, CHANGED), fields: how new differs from old."""
    a = old.select(*keys, F.struct(*values).alias("_a"))
    b = new.select(*keys, F.struct(*values).alias("_b"))
    j = a.join(b, keys, "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}")), F.lit(v)) for v in values]))
    j = j.withColumn("change", F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.size(fields) > 0, "CHANGED")).where("change is not null")
    return j.select(*keys, "change", F.when(F.col("change") == "CHANGED", F.array_join(fields, ",")).otherwise("").alias("fields"))


def search_score(text: str, symbol: Column, past: Column, name: Column) -> Column:
    """0 for the very symbol, 1 for a past one, 2 and 3 for those that start with the text, 4 for a name that holds it.

    Past symbols are an array. Names count from three characters on; null for no match.
    """
    q = text.upper()
    now = F.upper(symbol)
    return (
        F.when(now == q, 0)
        .when(F.exists(past, lambda x: F.upper(x) == q), 1)
        .when(now.startswith(q), 2)
        .when(F.exists(past, lambda x: F.upper(x).startswith(q)), 3)
        .when(F.upper(name).contains(q) & F.lit(len(q) >= 3), 4)
    )


def page(df: DataFrame, order: list[Column], number: int, size: int, within_key: str) -> DataFrame:
    """The number-th page (from 0) of `size` rows of every key in the order."""
    place = F.row_number().over(Window.partitionBy(within_key).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place").between(number * size + 1, (number + 1) * size))


def cursor(content: str, predicates: str, place: int) -> str:
    """A page's end, bound to the content's version and the predicates it was read with."""
    return f"{_bound(content, predicates)}:{place}"


def _bound(content: str, predicates: str) -> str:
    return hashlib.sha256(f"{predicates}|{content}".encode()).hexdigest()[:12]


def after(df: DataFrame, order: list[Column], since: str, content: str, predicates: str, size: int) -> DataFrame:
    """The page of `size` rows after a cursor, each with its place and own cursor; a cursor of other content or predicates is refused."""
    bound, place = since.split(":")
    if bound != _bound(content, predicates):
        raise ValueError("the cursor belongs to other content or predicates")
    first = df.orderBy(*order).limit(int(place) + size)  # Spark keeps that many rows of each partition, no more
    x = first.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > int(place))
    return x.withColumn("cursor", F.concat(F.lit(f"{bound}:"), F.col("place").cast("string")))
