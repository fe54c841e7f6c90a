"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text is a bag of hashed terms of four kinds: its words (A-Z lower-cased), its characters' 3-grams, the 1- to 3-grams of its
characters' classes (letter, capital, digit, space, line break, mark), and for each word how often it and its four-word
shingle came before. Counts become log(1 + count) * idf, each kind is normalised by itself,
and the SVD of a bounded sample of labelled texts gives the latent space. The sample's vectors are broadcast (at
most SAMPLE of DIMENSIONS floats); every document takes exact cosines with all of them, in blocks, and its
NEIGHBOURS nearest vote with their similarity.

The sample: of each label at most SAMPLE / 2 training rows, those of the smallest doc_id hash; idf counts all rows
that are not held out, labelled or not.
Null or empty text, and text without a like neighbour, gets the training rows' share of label 1. Rows with a null
label teach nothing. Rows with null or repeated doc_id are scored like others; of training texts with one doc_id and label the
least is taken. Without training rows all scores are 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.hashing import U, buffers, mix, slices, word_hashes
from plumbline.llm.language import held_out
from plumbline.llm.shared import small_batches

SAMPLE = 2000
DIMENSIONS = 64
NEIGHBOURS = 25
THRESHOLD = 0.3
SALTS = 64  # parts in which the rows of a label are first ordered
_TIMES = 12  # classes of earlier occurrences of a word or shingle
#: Where each kind's terms begin and end.
KINDS = {"words": (0, 4096), "letters": (4096, 8192), "shapes": (8192, 8704), "repeats": (8704, 8704 + 2 * _TIMES)}
TERMS = KINDS["repeats"][1]


def _classes() -> np.ndarray:
    c = np.full(256, 6, np.uint16)
    c[0x80:] = c[ord("a") : ord("z") + 1] = 1
    c[ord("A") : ord("Z") + 1] = 2
    c[ord("0") : ord("9") + 1] = 3
    c[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
    c[0x0A] = 5
    return c


def _times(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each value the logarithm of how often it came before in its row."""
    order = np.lexsort((np.arange(len(x)), x, row))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (row[order][1:] != row[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    out = np.empty(len(x), np.int64)
    out[order] = np.minimum(np.ceil(np.log2(np.arange(len(x)) - first + 1)), _TIMES - 1)
    return out


def term_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of the terms of each row of bytes."""
    n = len(at) - 1
    out = np.zeros((n, TERMS), np.int32)
    classes = _classes()
    letters, shapes, repeats = (KINDS[k][0] for k in ("letters", "shapes", "repeats"))
    for r in range(n):
        for a in range(at[r], at[r + 1], 1 << 20):
            raw = data[max(at[r], a - 2) : min(at[r + 1], a + (1 << 20))]
            c = classes[raw]
            if len(raw) > 2:
                x = raw.astype(np.uint32)
                gram = ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(0x9E3779B1)
                out[r, letters:shapes] += np.bincount(gram >> np.uint32(20), minlength=4096).astype(np.int32)
            c = c[np.concatenate(([True], c[1:] != c[:-1]))].astype(np.int64)
            for width in (1, 2, 3):
                if len(c) >= width:
                    code = sum(c[k : len(c) - width + 1 + k] << (3 * k) for k in range(width))
                    out[r, shapes:repeats] += np.bincount(code, minlength=512).astype(np.int32)
    words, first = word_hashes(data, at)
    if len(words):
        row = np.repeat(np.arange(n), np.diff(first))
        np.add.at(out, (row, (words >> U(52)).astype(np.int64)), 1)
        np.add.at(out, (row, repeats + _times(words, row)), 1)
        if len(words) > 3:
            rolled = mix(words[:-3] * U(3) + words[1:-2] * U(5) + words[2:-1] * U(7) + words[3:])
            same = row[:-3] == row[3:]
            np.add.at(out, (row[:-3][same], repeats + _TIMES + _times(rolled[same], row[:-3][same])), 1)
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    for a, z in KINDS.values():
        x[:, a:z] /= np.maximum(np.linalg.norm(x[:, a:z], axis=1, keepdims=True), 1e-9)
    return x


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each term occurs; term -1 counts the texts."""
    df, n = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        data, at = buffers(batch.column("text"))
        for lo, hi in slices(at):
            for a in range(lo, hi, 128):
                z = min(hi, a + 128)
                df += (term_counts(data[at[a] : at[z]], at[a : z + 1] - at[a]) > 0).sum(0)
        n += batch.num_rows
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n), pa.int64())], ["term", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = buffers(batch.column("text"))
        for lo, hi in slices(at):
            for a in range(lo, hi, 128):
                z = min(hi, a + 128)
                counts = term_counts(data[at[a] : at[z]], at[a : z + 1] - at[a])
                rows = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, z - a), pa.array([r.astype(np.uint16).tobytes() for r in rows], pa.binary()), pa.array([c[r].tobytes() for c, r in zip(counts, rows)], pa.binary())], ["label", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of docs (doc_id, text) and labels (doc_id, label 0 or 1): idf, projection, sample vectors and labels."""
    taught = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("label").cast("int").alias("label"))
    shares = {r[0]: r[1] for r in taught.groupBy("label").count().collect()}
    share = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    some = taught.distinct().withColumn("draw", F.xxhash64("doc_id")).withColumn("salt", F.pmod(F.col("draw"), F.lit(SALTS)))
    for keys in (("label", "salt"), ("label",)):  # a common label is first cut to its salts' smallest hashes
        some = some.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("draw", "doc_id"))).where(F.col("place") <= SAMPLE // 2)
    # at most SAMPLE rows are broadcast, and of texts with one doc_id and label the least is taken
    few = docs.join(F.broadcast(some.select("doc_id", "label")), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    got = few.select("label", "text").mapInArrow(_sparse, "label int, terms binary, counts binary").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("label", "terms", "counts"))))
    if not rows:
        return {"share": share}
    # idf needs no label: no join, so that texts are counted where they are read
    got = docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df, n = np.zeros(TERMS), 1
    for term, count in zip(got.column("term").to_pylist(), got.column("n").to_pylist()):
        if term < 0:
            n = max(1, count)
        else:
            df[term] = count
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

    x = np.zeros((len(rows), TERMS), np.float32)
    for i, (_, terms, count) in enumerate(rows):
        x[i, np.frombuffer(terms, np.uint16)] = np.frombuffer(count, np.int32)
    x = _weighted(x, idf)
    value, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    keep = value[::-1][:DIMENSIONS] > 1e-6
    axes = ((x.T @ left[:, ::-1][:, :DIMENSIONS][:, keep].astype(np.float32)) / np.sqrt(value[::-1][:DIMENSIONS][keep])).astype(np.float32)
    return {"share": share, "idf": idf, "axes": axes, "vectors": _unit(x @ axes), "label": np.array([r[0] for r in rows], np.float32)}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def votes(x: np.ndarray, model: dict) -> np.ndarray:
    """The share of label 1 among the nearest neighbours of each row of counts, weighted by cosine."""
    cosine = _unit(_weighted(x, model["idf"]) @ model["axes"]) @ model["vectors"].T
    k = min(NEIGHBOURS, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 4
    total = weight.sum(1)
    return np.where(total > 1e-6, (weight * model["label"][near]).sum(1) / np.maximum(total, 1e-6), model["share"])


def _score(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, at = buffers(batch.column("text"))
            score = np.full(batch.num_rows, model["share"])
            if "vectors" in model:
                for lo, hi in slices(at):
                    for a in range(lo, hi, 128):
                        z = min(hi, a + 128)
                        score[a:z] = votes(term_counts(data[at[a] : at[z]], at[a : z + 1] - at[a]), model)
                score[np.diff(at) == 0] = model["share"]
            score = np.clip(score, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, label."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
