"""Order MinHash fingerprints, in DataFrame operations only.

A text's tokens are its words, cut into pieces of PIECE characters; each token starts a k-mer of K tokens (fewer at
the end). Equal k-mers are numbered by occurrence, each numbered one gets a hash, and the hash's top bits
deal it to one of 32 bins. A bin keeps the two k-mers of smallest hash, in text order, and hashes them as a tuple:
exchanged passages change the tuple, so that likeness follows edit distance and not the bag of words. The fingerprint
is the bins' tuples; likeness comes from the share of bins with equal tuples among those that either text fills.

All work is inside a row; rows are never exploded. Null is the empty text; texts without a token have the empty
fingerprint, and two such are alike (1.0). Rows equal in doc_id and text are one document whose result is
repeated; rows with the same doc_id and other texts follow each other by hash; a null doc_id is last. A text may have
2**24 tokens. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.mixing import ranked
from plumbline.llm.shared import stored

PIECE = 8
K = 3
_PLACE = (1 << 24) - 1  # the low bits of a numbered k-mer hold its place in the text
_BIN = 59  # the top five bits are its bin


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a column `name`: the sorted bin tuples (longs) of the text column's Order MinHash."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    df = df.withColumn("_w", tokens)
    kmer = ", ".join(f"get(_w, i + {k})" for k in range(K))
    packed = F.expr(f"transform(if(size(_w) > 0, sequence(0, size(_w) - 1), array()), i -> (xxhash64({kmer}) & ~{_PLACE}L) | i)")
    df = df.withColumn("_s", F.sort_array(packed)).drop("_w")
    same = "shiftright(get(_s, {0}), 24) = shiftright(get(_s, {1}), 24)"
    again = F.expr(f"filter(_s, (x, i) -> i > 0 and {same.format('i - 1', 'i')})")
    df = df.withColumn("_d", F.size(again))
    starts = f"filter(sequence(0, size(_s) - 2), i -> {same.format('i', 'i + 1')} and (i = 0 or not {same.format('i - 1', 'i')}))"
    ends = f"filter(sequence(1, size(_s) - 1), i -> {same.format('i - 1', 'i')} and (i = size(_s) - 1 or not {same.format('i', 'i + 1')}))"
    df = df.withColumn("_r", F.expr(f"if(_d > 0, zip_with({starts}, {ends}, (a, z) -> named_struct('a', a, 'z', z)), null)"))
    firsts = f"filter(_s, (x, i) -> i = 0 or not {same.format('i - 1', 'i')})"
    later = f"flatten(transform(_r, r -> transform(sequence(r.a + 1, r.z), i -> (xxhash64(shiftright(get(_s, i), 24), i - r.a) & ~{_PLACE}L) | (get(_s, i) & {_PLACE}L))))"
    df = df.withColumn("_n", F.expr(f"if(_d > 0, sort_array(concat({firsts}, {later})), _s)")).drop("_s", "_d", "_r")
    bin_ = "shiftrightunsigned({0}, 59)"
    least = F.expr(f"filter(_n, (x, i) -> i < 2 or {bin_.format('get(_n, i - 2)')} <> {bin_.format('x')})")
    df = df.withColumn("_m", least).drop("_n")
    pair = f"if((x & {_PLACE}L) < (get(_m, i + 1) & {_PLACE}L), xxhash64(shiftright(x, 24), shiftright(get(_m, i + 1), 24)), xxhash64(shiftright(get(_m, i + 1), 24), shiftright(x, 24)))"
    after = f"i + 1 < size(_m) and {bin_.format('get(_m, i + 1)')} = {bin_.format('x')}"
    before = f"i > 0 and {bin_.format('get(_m, i - 1)')} = {bin_.format('x')}"
    own = f"case when {after} then {pair} when {before} then null else xxhash64(shiftright(x, 24)) end"
    tuples = F.expr(f"filter(transform(_m, (x, i) -> (x & ~576460752303423487L) | shiftrightunsigned({own}, 5)), t -> t is not null)")
    return df.withColumn(name, tuples).drop("_m")


def fingerprint(sketch: str) -> Column:
    """A sketch as a string of 16 hexadecimal digits for each filled bin."""
    return F.expr(f"array_join(transform({sketch}, x -> lpad(hex(x), 16, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """How much of two texts agrees, from the share p of equal tuples among the bins that either sketch fills.

    Both k-mers of a tuple agree with about the square of the texts' Jaccard similarity j, and 2j / (1 + j) is
    the part of a text that is kept. 1 if neither sketch fills a bin.
    """
    bins = f"size(array_union(transform({a}, x -> shiftrightunsigned(x, {_BIN})), transform({b}, x -> shiftrightunsigned(x, {_BIN}))))"
    j = F.expr(f"if({bins} = 0, 1.0D, sqrt(size(array_intersect({a}, {b})) / cast({bins} as double)))")
    return 2 * j / (1 + j)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter replaced by the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    keys = own.groupBy("doc_id", "h").agg(F.max(F.length("text")).alias("n"))
    keys = stored(ranked(keys, [F.col("doc_id").asc_nulls_last(), F.col("h")], "place"), "places")
    total = keys.count()
    quarter = F.floor(F.col("n") / 4)
    after = keys.select((F.when(F.col("place") == 1, total).otherwise(F.col("place") - 1)).alias("place"), F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"))
    before = keys.select((F.when(F.col("place") == total, 1).otherwise(F.col("place") + 1)).alias("place"), F.col("doc_id").alias("prev_id"), F.col("h").alias("prev_h"), quarter.alias("prev_quarter"))
    keys = stored(keys.join(after, "place").join(before, "place").withColumn("quarter", quarter).drop("place"), "neighbours")

    def match(a: DataFrame, b: DataFrame, key: str) -> Column:
        return a["doc_id"].eqNullSafe(b[f"{key}_id"]) & (a["h"] == b[f"{key}_h"])

    named = keys.withColumnsRenamed({"doc_id": "key_id", "h": "key_h"})
    rows = own.join(named, match(own, named, "key"))
    # each document gives its start to the one before it; copies of a row give the same start once
    start = rows.select("prev_id", "prev_h", F.expr("substring(text, 1, int(prev_quarter))").alias("start")).dropDuplicates(["prev_id", "prev_h"])
    laid = rows.select("doc_id", "h", "text", "quarter", "next_id", "next_h")
    laid = laid.join(start, match(laid, start, "prev"), "left")
    edited = F.concat(F.expr("substring(text, 1, int(length(text) - quarter))"), F.coalesce("start", F.lit("")))
    laid = laid.select("doc_id", "h", "next_id", "next_h", F.length("text").alias("n_chars"), "text", edited.alias("edited"))
    laid = with_sketch(with_sketch(laid.withColumn("edited_sha256", F.sha2("edited", 256)), "text", "sketch").drop("text"), "edited", "edited_sketch").drop("edited")
    laid = stored(laid, "sketches")
    other = laid.select(F.col("doc_id").alias("other_id"), F.col("h").alias("other_h"), F.col("sketch").alias("next_sketch")).dropDuplicates(["other_id", "other_h"])
    out = laid.join(other, laid["next_id"].eqNullSafe(other["other_id"]) & (laid["next_h"] == other["other_h"]))
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))
