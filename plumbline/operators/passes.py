"""Ordered passes over series, many at a time.

The rows of a task come in order of series and bar, in Arrow batches. A step of a pass takes the t-th bar of every series in hand that has one, so that a bar
costs some array operations' share and no call of its own, and no series is padded. A series that a batch cuts waits for the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 100_000  # of a table of many series
_NULL = np.iinfo(np.int64).min  # stands for a null key


class Stack:
    """Series laid end to end, by their lengths."""

    def __init__(self, lengths: np.ndarray | list[int]):
        lengths = np.asarray(lengths, np.int64)
        self.first = np.cumsum(lengths) - lengths  # where each series begins
        self.order = np.argsort(-lengths, kind="stable")  # longest first
        self._starts, self._lengths = self.first[self.order], lengths[self.order]

    def __len__(self) -> int:
        return len(self._lengths)

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        """(t, places): where the t-th values stand, of the series in `order` that are that long."""
        left = len(self)
        for t in range(int(self._lengths[0]) if left else 0):
            while self._lengths[left - 1] <= t:
                left -= 1
            yield t, self._starts[:left] + t


def keys(table: pa.Table | pa.RecordBatch, key: str = "sid") -> np.ndarray:
    column = table.column(key).cast(pa.int64()).fill_null(int(_NULL))
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def parted(sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and how long it is."""
    first = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1]))) if len(sid) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(sid)))


def floats(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, nulls as NaN."""
    return table.column(name).cast(pa.float64()).to_numpy()


def nullable(x: np.ndarray) -> pa.Array:
    """Doubles, NaN as null."""
    return pa.array(x, pa.float64(), from_pandas=True)


def whole(batches: Iterator[pa.RecordBatch], key: str = "sid", rows: int = ROWS) -> Iterator[pa.Table]:
    """Tables of whole series, of batches in order of the key: of about as many rows, or of one series that has more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sid = keys(batch, key)
        cut = int(np.searchsorted(sid, sid[-1]))  # rows of series that end here
        if held and size + cut >= rows and (cut or keys(held[-1], key)[-1] != sid[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def over_series(df: DataFrame, order: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run over tables of whole series (rows of one sid together, in order); it gives rows of the schema.

    Rows are dealt by a hash of the sid: by the sid itself Spark would leave out the exchange over a bucketed table, and then read the table without its buckets,
    as nothing above says that it needs them.
    """

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            yield from run(table).combine_chunks().to_batches()

    return df.repartition(F.xxhash64("sid")).sortWithinPartitions("sid", *order).mapInArrow(passed, schema)


def beside(bars: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of two tables for one pass, told apart by `own` (true for the bars): sid, i, c, atr of bars, and the others' columns."""
    b = bars.select("sid", F.lit(True).alias("own"), "i", "c", F.col("atr").alias("atr_i"))
    return b.unionByName(others.withColumn("own", F.lit(False)), allowMissingColumns=True)


def apart(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The bars and the other rows of beside()."""
    own = table.column("own")
    return table.filter(own), table.filter(pc.invert(own))


def ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of which range, place) of every place in the ranges that begin at `start` and hold n places, end to end."""
    n = np.maximum(n, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, start[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
