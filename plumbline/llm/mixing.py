"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document may be taken twice at most, so each has two slots. Of all rates whose tokens meet their
source's target, the one nearest in entropy to taking every document once has the form
2 * sigmoid(tilt * size): an exponential tilt. The tilt solves a convex dual; distributed Newton
steps, kept inside a bracket, find it. A rate depends on source and size alone, so all steps work on
counts of documents of a source and size, not on documents; nothing is gathered on the driver but scalars.

Rates become whole copies by rounding running sums from large documents to small ones, which leaves a
source within half its largest document of its target; repair steps then change the copies of one size at a time, as long as that brings the source nearer.

Nulls: a null text has size 0 and takes 0; a null source is a source of its own, ordered last; rows with
null or repeated doc_id count like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import partitions, stored

WORD = r"[^\x20\x09-\x0D]+"
SALT_ROWS = 50_000  # documents for each further salt of a (source, size) group
REPAIRS = 200
NEWTON_ROUNDS = 60
TOLERANCE = 1e-7


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column `name`: each row's 1-based place in the order over all rows.

    Rows are dealt by range, numbered in their partition and shifted by the counts before it.
    """
    parts = partitions(df.sparkSession)
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    count = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = count.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_place", place).join(before, "_part").withColumn(name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """sources (of, source, source_size) with target: share of all words by weight, no target above
    ceiling times its source, the excess shared again among the others."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = ranked(sources, [F.col("source").asc_nulls_last()], "place")
    s = stored(s.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(ceiling))), "sources")
    total, level = share * (s.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        used, left = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - (used or 0.0)) / left if left else math.inf
        if new <= level * (1 + 1e-12) or not left:
            break
        level = new
    target = F.col("cap") if level == math.inf else F.least(F.col("cap"), F.col("weight") * level)
    return s.select("of", "source_size", target.alias("target"), "cap")


def tilted(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """groups (of, size, m) with rate: Newton steps on each source's dual until tokens meet targets."""
    mean = groups.where("size > 0").groupBy("of").agg((F.sum(F.col("size") * F.col("m")) / F.sum("m")).alias("mean"))
    state = sources.where("source_size > 0").join(mean, "of").select("of", "target", "cap", "mean", F.lit(0.0).alias("tilt"), F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"))
    state = stored(state, "tilts")
    for _ in range(NEWTON_ROUNDS):
        x = F.col("size") / F.col("mean")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("tilt") * x))
        sums = groups.where("size > 0").join(state, "of").groupBy("of").agg(F.sum(2 * F.col("m") * p * F.col("size")).alias("words"), F.sum(2 * F.col("m") * p * (1 - p) * F.col("size") * x).alias("slope"))
        now = state.join(sums, "of").withColumn("miss", F.col("target") - F.col("words"))
        lo, hi = F.when(F.col("miss") > 0, F.col("tilt")).otherwise(F.col("lo")), F.when(F.col("miss") < 0, F.col("tilt")).otherwise(F.col("hi"))
        now = now.withColumn("lo", lo).withColumn("hi", hi)
        step = F.col("tilt") + F.col("miss") / F.greatest("slope", F.lit(1e-300))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        done = (F.abs("miss") <= F.col("target") * TOLERANCE) | (F.col("target") >= F.col("cap"))
        now = now.withColumn("tilt", F.when(done, F.col("tilt")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)).withColumn("open", ~done)
        state = stored(now.select("of", "target", "cap", "mean", "tilt", "lo", "hi", "open"), "tilts")
        if not state.where("open").limit(1).count():
            break
        state = state.drop("open")
    else:
        raise RuntimeError(f"tilts did not settle in {NEWTON_ROUNDS} rounds")
    rate = F.when(F.col("target") >= F.col("cap"), F.lit(2.0)).otherwise(F.lit(2.0) / (F.lit(1.0) + F.exp(-F.col("tilt") * F.col("size") / F.col("mean"))))
    return groups.where("size > 0").join(state.select("of", "target", "cap", "mean", "tilt"), "of").select("of", "size", "m", "target", rate.alias("rate"))


def rounded(groups: DataFrame) -> DataFrame:
    """groups (of, size, m, target, rate) with copies, whole, of each group together."""
    down = Window.partitionBy("of").orderBy(F.col("size").desc())
    run = F.sum(F.col("m") * F.col("rate")).over(down)
    g = groups.withColumn("run", F.floor(run + 0.5)).withColumn("copies", F.col("run") - F.coalesce(F.lag("run").over(down), F.lit(0)))
    g = stored(g.select("of", "size", "m", "target", "copies"), "copies")
    for _ in range(REPAIRS):
        miss = g.groupBy("of").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss"))
        more = F.col("miss") > 0
        room = F.when(more, 2 * F.col("m") - F.col("copies")).otherwise(F.col("copies"))
        k = F.least(room, F.greatest(F.round(F.abs("miss") / F.col("size")), F.lit(1)).cast("long"))
        off = F.abs(F.abs("miss") - k * F.col("size"))
        best = g.join(miss, "of").where((room > 0) & (off < F.abs("miss"))).groupBy("of").agg(F.min(F.struct(off.alias("off"), F.col("size").alias("size"), F.when(more, k).otherwise(-k).alias("by"))).alias("b"))
        best = stored(best, "repairs")
        if best.isEmpty():
            break
        g = g.join(best.select("of", F.col("b.size").alias("size"), F.col("b.by").alias("by")), ["of", "size"], "left")
        g = stored(g.select("of", "size", "m", "target", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies")), "copies")
    else:
        raise RuntimeError(f"copies did not settle in {REPAIRS} repairs")
    return g


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """doc_id, size, source, source_size, target, copies (0, 1 or 2) and taken words for every row of docs."""
    of = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = stored(docs.select("doc_id", "source", of.alias("of"), size.alias("size"), F.xxhash64("doc_id").alias("draw")), "sizes")
    sources = rows.groupBy("of").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = stored(targets(sources, weights, share, ceiling), "targets")
    groups = stored(rows.groupBy("of", "size").agg(F.count("*").alias("m")), "groups")
    g = rounded(stored(tilted(groups, sources), "rates"))

    salts = max(16, -(-rows.count() // SALT_ROWS))
    rows = rows.withColumn("salt", F.pmod(F.col("draw"), F.lit(salts)))
    some = g.withColumn("each", F.floor(F.col("copies") / F.col("m"))).withColumn("extra", F.col("copies") - F.col("each") * F.col("m")).select("of", "size", "each", "extra")
    sub = rows.where("size > 0").groupBy("of", "size", "salt").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("of", "size").orderBy("salt")) - F.col("k")
    sub = sub.withColumn("before", before).join(some, ["of", "size"]).select("of", "size", "salt", "each", F.greatest(F.col("extra") - F.col("before"), F.lit(0)).alias("extra"))
    own = F.row_number().over(Window.partitionBy("of", "size", "salt").orderBy(F.hash("draw"), "draw", "doc_id"))
    picked = rows.withColumn("own", own).join(sub, ["of", "size", "salt"], "left")
    copies = F.coalesce(F.col("each") + F.when(F.col("own") <= F.col("extra"), 1).otherwise(0), F.lit(0))
    out = picked.withColumn("copies", copies).join(sources, "of")
    return out.select("doc_id", "size", "source", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))
