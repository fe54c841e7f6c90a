"""Helpers that the corpus operators share: durable tables, connected components, bitmaps."""

from __future__ import annotations

import ctypes
import itertools
import operator
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give this process's freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """run for mapInArrow, with release() when a task ends: Python workers outlive their tasks, and what they keep adds up."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


PIECES = 16  # parts of a partition, of which a task holds one at a time


def blocks(values: np.ndarray, where: np.ndarray, parts: int) -> tuple[pa.Array, list[np.ndarray]]:
    """(piece, which values are in it) of the pieces of partitions that the hashes `where` put values in."""
    to = (where % np.uint64(parts)).astype(np.int64) * PIECES + ((where >> np.uint64(32)) % np.uint64(PIECES)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True])))
    return pa.array(to[cuts[:-1]]), [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def packed(values: np.ndarray, where: np.ndarray, parts: int) -> pa.RecordBatch:
    """values packed into one binary row for each piece."""
    piece, rows = blocks(values, where, parts)
    return pa.RecordBatch.from_arrays([piece, pa.array([values[r].tobytes() for r in rows], pa.binary())], ["piece", "block"])


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Packed blocks in the partition of their `piece` (partition * PIECES + piece), sorted by it: Spark sorts and spills."""
    return rows.repartitionById(parts, F.expr(f"int(piece div {PIECES})")).sortWithinPartitions("piece")


def by_piece(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(piece, the values of columns in its rows) of batches that dealt() sorted: a task need not hold its whole partition."""
    rows = (x for b in batches for x in zip(b.column("piece").to_pylist(), *(b.column(c) for c in columns)))
    for piece, found in itertools.groupby(rows, key=operator.itemgetter(0)):
        yield piece, (r[1:] for r in found)


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle is dealt to; follows the cluster's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long, so Arrow batches of Spark's default row count would need much memory; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long): node, label, where label is the smallest node.

    Alternating large-star and small-star steps; every round is written to the shared folder.
    Empty edges give an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("x")).select("x.hi", "x.lo").where("hi <> lo").distinct()
        e, last = stored(small, "edges"), e
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = e.groupBy("hi").agg(F.min("lo").alias("label")).withColumnRenamed("hi", "node")
    return label.union(e.select("lo", "lo").distinct()).toDF("node", "label").groupBy("node").agg(F.min("label").alias("label"))


def bits_for(rows: int, most: int = 1 << 31) -> int:
    """Bits of a bitmap of so many keys, of which few others pass; of at most 256 MB, however many they are."""
    return min(most, max(1 << 23, 1 << (16 * rows).bit_length()))


def bitmap(keys: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """A bit array with one bit for every long in keys' column `key` set.

    It takes bits/8 bytes; a fuller one lets more through, never less.
    """
    slot = F.pmod(F.col("key").bitwiseAND(F.lit((1 << 62) - 1)), F.lit(bits))
    words = keys.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(s % 32)))").alias("v"))
    out = np.zeros(bits // 32, np.uint32)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().astype(np.uint32)
    del got
    release()
    return out


WORDS = 1 << 16  # 32-bit words of a block of a bitmap


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of WORDS words of words (block, w, v) that come in order of blocks."""
    block, own = -1, np.zeros(WORDS, np.uint32)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pa.compress(own.tobytes(), "zstd", asbytes=True)], pa.binary())], ["block", "bits"])

    for batch in batches:
        of, w, v = (batch.column(c).to_numpy() for c in ("block", "w", "v"))
        cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if of[a] != block:
                if block >= 0:
                    yield out()
                block = int(of[a])
                own[:] = 0
            np.bitwise_or.at(own, w[a:b] % WORDS, v[a:b].astype(np.uint32))
    if block >= 0:
        yield out()


def gathered(words: DataFrame, bits: int) -> np.ndarray:
    """A bit array of words (w, v: long), which may come more than once.

    Tasks put the words into blocks; the driver takes these from the shared folder, a file's part at a time. It holds the bits / 8 bytes of the array, at no time
    the words, of which each would take 16 bytes there and as many in the JVM.
    """
    parts = partitions(words.sparkSession)
    own = words.withColumn("block", F.expr(f"w div {WORDS}")).repartitionById(parts, F.expr(f"int(block % {parts})")).sortWithinPartitions("block")
    made = stored(own.select("block", "w", "v").mapInArrow(lean(_filled), "block long, bits binary"), "bits")
    out = np.zeros(bits // 32, np.uint32)
    for block, packed_bits in made.toLocalIterator():
        at = block * WORDS
        n = min(WORDS, len(out) - at)
        out[at : at + n] = np.frombuffer(pa.decompress(bytes(packed_bits), 4 * WORDS, "zstd", asbytes=True), np.uint32)[:n]
    discard(made)
    release()
    return out


def in_bitmap(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys (as the longs given to bitmap()) have their bit set."""
    slot = (keys & np.uint64((1 << 62) - 1)) % np.uint64(len(table) * 32)
    return (table[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
