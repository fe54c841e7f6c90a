"""Identities of securities: changes, issuers, successors, notices, instrument kinds and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(spans: DataFrame) -> DataFrame:
    """key, before, value, since: where a span (key, value, since) follows one of another value."""
    before = F.lag("value").over(Window.partitionBy("key").orderBy("since", "value"))
    return spans.withColumn("before", before).where("before is not null and before <> value").select("key", "before", "value", "since")


def same_issuer(codes: DataFrame) -> DataFrame:
    """id, linked_to: the codes (id, isin) whose first nine characters an earlier id has too."""
    of = F.substring("isin", 1, 9)
    first = codes.groupBy(of.alias("issuer")).agg(F.min("id").alias("linked_to"), F.count("*").alias("n")).where("n > 1")
    return codes.withColumn("issuer", of).join(first, "issuer").where("id <> linked_to").select("id", "linked_to")


def successors(old: DataFrame, new: DataFrame, reach: int) -> DataFrame:
    """id, successor, candidates: the ids of old (id, code) that new lacks, with the next ids of their code within reach."""
    gone = old.join(new.select("id"), "id", "left_anti")
    after = new.select(F.col("id").alias("next"), "code")
    j = gone.join(after, "code").where((F.col("next") > F.col("id")) & (F.col("next") <= F.col("id") + reach)).groupBy("id").agg(F.min("next").alias("successor"), F.count("*").alias("candidates"))
    return gone.select("id").join(j, "id", "left").select("id", "successor", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def by_notice(notices: DataFrame, spans: DataFrame, gap: int) -> DataFrame:
    """notices (key, old, effective) with the new value: the old span ends and another of the key begins within gap days of the notice."""
    a = spans.select("key", F.col("value").alias("old"), "until")
    b = spans.select("key", F.col("value").alias("new"), "since")
    j = notices.join(a, ["key", "old"]).where(F.abs(F.datediff("effective", "until")) <= gap).join(b, "key")
    return j.where((F.col("new") != F.col("old")) & (F.abs(F.datediff("since", "effective")) <= gap))


def instrument(isin: Column) -> Column:
    """What an ISIN stands for: units of a fund, shares, rights or something else, by its prefix and security type."""
    kind = F.substring(isin, 8, 2)
    return F.when(isin.startswith("INF"), "FUND_UNIT").when(kind == "01", "EQUITY_SHARE").when(kind == "20", "RIGHTS_ENTITLEMENT").otherwise("OTHER")


def coverage(expected: DataFrame, got: DataFrame) -> DataFrame:
    """side, n: how many ids are MISSING from got and EXTRA in it; both are 0 if the sets are equal."""
    miss, extra = expected.select("id").subtract(got.select("id")), got.select("id").subtract(expected.select("id"))
    return miss.agg(F.lit("MISSING").alias("side"), F.count("*").alias("n")).unionByName(extra.agg(F.lit("EXTRA").alias("side"), F.count("*").alias("n")))
