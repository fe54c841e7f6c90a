"""How quality filters interact: what each removes, alone, after others and in every order.

Each filter has, for every part (language) of the corpus, a sorted posting list of the documents that fail it, kept in
blocks of id ranges. Blocks of neighbouring ranges are joined until they hold enough ids; unions of the lists are merged
(a sort that finds the sorted runs and gallops through them), and what a filter removes after others is
its list without their union, found by galloping through it. Sizes are summed over the ranges. No list of a whole part
ever meets in one task.

Filters of a text (null: empty): A under 200 words; B fewer different words than half its words; C more than 3 % capitals A-Z; D any
of #$%&*|; E the same text as a row of a smaller doc_id. Rows with a null doc_id count, fail E never and make no other row fail it; repeated
rows count each; a null language is the part "". Label rows of one doc_id count as one with any of their marks. Without documents
the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.hashing import CASED, buffers, slices, word_hashes
from plumbline.llm.shared import lean, small_batches, stored

LETTERS = "ABCDE"
MARKS = {"good": 5, "toxic": 6}  # lists beside the filters', and their bits in an entry
SALTS = 256  # parts of a group of equal texts
SPAN = 1 << 9  # ids of a block
TOGETHER = 1 << 16  # entries that are merged at once
ALL = (1 << len(LETTERS)) - 1


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CAPITAL, _SIGN = _table(bytes(range(0x41, 0x5B))), _table(b"#$%&*|")


def _per_row(marked: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(marked)))
    return total[at[1:]] - total[at[:-1]]


def text_failures(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 are set for the filters A to D that each row of bytes fails."""
    words, first = word_hashes(data, at, CASED)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, row))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (row[1:] != row[:-1])
    different = np.bincount(row[new], minlength=len(n))
    points = _per_row((data & 0xC0) != 0x80, at)
    fails = n < 200, 100 * different < 50 * n, 100 * _per_row(_CAPITAL[data], at) > 3 * points, _per_row(_SIGN[data], at) > 0
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = buffers(batch.column("text"))
        mask = np.zeros(batch.num_rows, np.int32)
        for lo, hi in slices(at):
            mask[lo:hi] = text_failures(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        key = [hashlib.sha256(data[a:z]).digest() for a, z in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask), pa.array(key, pa.binary())], ["doc_id", "part", "mask", "key"])


def failing(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row of docs (doc_id, text, lang): bit k of mask is filter k.

    Rows of equal texts find their least doc_id through the text's hash. A text's rows are dealt to SALTS parts, which
    are merged first and told the result afterwards, so that no task gets all rows of a text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text"))
    rows = stored(rows.mapInArrow(lean(_failures), "doc_id long, part string, mask int, key binary"), "failures").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = rows.groupBy("key", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = some.groupBy("key").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    told = least.select("key", F.explode("salts").alias("salt"), "least")  # at most SALTS rows a text, as many as it has parts
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return rows.join(told, ["key", "salt"], "left").select("doc_id", "part", (F.col("mask") + F.shiftleft(copy, 4)).alias("mask"))


def postings(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, span, list, entries: the sorted (entry, n) of each list in each range of SPAN ids.

    An entry is an id within its range, with the row's bits; n counts the rows that agree in these. A list is the number of a filter, or a
    number in MARKS for labelled rows that fail any.
    """
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    x = rows.where("mask > 0").join(marked.where("good or toxic"), "doc_id", "left")
    bits = F.col("mask") + sum(F.shiftleft(F.coalesce(m, F.lit(False)).cast("int"), b) for m, b in MARKS.items())
    x = x.groupBy("doc_id", "part", bits.alias("bits")).agg(F.count("*").alias("n"))
    entry = (F.coalesce(F.col("doc_id").bitwiseAND(F.lit(SPAN - 1)), F.lit(0)) * 128 + F.col("bits")).cast("int")
    lists = F.filter(F.array(*(F.lit(k) for k in (*range(len(LETTERS)), *MARKS.values()))), lambda k: F.getbit(F.col("bits"), k) == 1)
    x = x.select("part", F.shiftright("doc_id", SPAN.bit_length() - 1).alias("span"), F.explode(lists).alias("list"), F.struct(entry.alias("entry"), "n").alias("e"))
    return x.groupBy("part", "span", "list").agg(F.sort_array(F.collect_list("e")).alias("entries"))  # at most SPAN ids


def union(lists: list[np.ndarray]) -> np.ndarray:
    """The different values of sorted lists: the stable sort takes each list as a run and gallops where runs do not interleave."""
    x = np.sort(np.concatenate(lists), kind="stable")
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def within(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which values of the sorted x are in the sorted other; each search goes on from where the one before ended."""
    if not len(other):
        return np.zeros(len(x), bool)
    return other[np.minimum(np.searchsorted(other, x), len(other) - 1)] == x


def removals(lists: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[before, filter] -> removed rows, good ones and toxic ones, of one range's lists (entries, n)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    unions = [none[0]]
    for before in range(1, ALL + 1):
        top = before.bit_length() - 1
        unions.append(union([unions[before ^ (1 << top)], lists.get(top, none)[0]]))
    out = np.zeros((ALL + 1, len(LETTERS), 3), np.int64)
    for f in range(len(LETTERS)):
        entries, n = lists.get(f, none)
        counted = [n, *(np.where(within(entries, lists.get(m, none)[0]), n, 0) for m in MARKS.values())]
        for before in range(ALL + 1):
            if not before >> f & 1:
                left = ~within(entries, unions[before])
                out[before, f] = [c[left].sum() for c in counted]
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, before, letter, removed, good_lost, toxic_lost, summed over a task's ranges; rows come by part and span."""
    rows = (r for b in batches for r in zip(b.column("part").to_pylist(), b.column("span").to_pylist(), b.column("list").to_pylist(), b.column("entries")))
    for part, of_part in itertools.groupby(rows, key=lambda r: r[0]):
        total, held, size, place = np.zeros((ALL + 1, len(LETTERS), 3), np.int64), {}, 0, 0
        for _, of_span in itertools.groupby(of_part, key=lambda r: r[1]):
            for _, _, k, entries in of_span:
                e = entries.values
                held.setdefault(k, []).append((e.field(0).to_numpy().astype(np.int64) + place, e.field(1).to_numpy()))
                size += len(e)
            place += SPAN * 128
            if size >= TOGETHER:
                total += removals({k: tuple(map(np.concatenate, zip(*v))) for k, v in held.items()})
                held, size = {}, 0
        total += removals({k: tuple(map(np.concatenate, zip(*v))) for k, v in held.items()})
        before, letter = (v.ravel() for v in np.indices(total.shape[:2]))
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(before)), pa.array(before, pa.int32()), pa.array(letter, pa.int32()), *(pa.array(total[..., k].ravel()) for k in range(3))], ["part", "before", "letter", "removed", "good_lost", "toxic_lost"])


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each step of all orders.

    shapley is what the step's filter removes, summed over all orders.
    """
    spark = docs.sparkSession
    rows = stored(failing(docs), "failing")
    lists = stored(postings(rows, labels), "postings")
    tally = lists.repartition("part", "span").sortWithinPartitions("part", "span").mapInArrow(lean(_tally), "part string, before int, letter int, removed long, good_lost long, toxic_lost long")
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    cases = [(before, f) for f in range(len(LETTERS)) for before in range(ALL + 1) if not before >> f & 1]
    none = parts.select("part", F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("letter")) for b, f in cases))).alias("c")).select("part", "c.*", *(F.lit(0).cast("long").alias(c) for c in ("removed", "good_lost", "toxic_lost")))
    counts = tally.unionByName(none).where(~F.getbit(F.col("before"), F.col("letter")).cast("boolean")).groupBy("part", "before", "letter").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")))

    of_filter = Window.partitionBy("part", "letter")
    fact = [math.factorial(k) * math.factorial(len(LETTERS) - 1 - k) for k in range(len(LETTERS))]
    orders_with = F.element_at(F.array(*(F.lit(f) for f in fact)), F.bit_count("before") + 1)  # in how many orders just these filters come before
    counts = counts.withColumns({
        "fails": F.max(F.when(F.col("before") == 0, F.col("removed"))).over(of_filter),
        "unique_fails": F.max(F.when(F.col("before") == F.expr(f"{ALL} ^ shiftleft(1, letter)"), F.col("removed"))).over(of_filter),
        "shapley": F.sum(F.col("removed") * orders_with).over(of_filter),
    })
    steps = [("".join(LETTERS[f] for f in p), k + 1, sum(1 << f for f in p[:k]), p[k]) for p in itertools.permutations(range(len(LETTERS))) for k in range(len(LETTERS))]
    orders = spark.createDataFrame(steps, "filter_order string, step int, before int, letter int")  # 600 rows
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    x = counts.join(F.broadcast(orders), ["before", "letter"]).join(parts, "part")
    return x.select("part", "filter_order", "step", (F.col("n") - F.sum("removed").over(so_far)).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
