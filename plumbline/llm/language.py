"""Language identification by nearest centroid.

A text is the vector of its letters' 1- to 3-grams (lower case; runs of other characters are one space), hashed
to a fixed number of slots, weighted by log(1 + count) * idf and normalised. Each language has a few
centroids found by spherical k-means; a text takes the language of the centroid with the
largest cosine. It is rejected if that cosine is well below those of the language's own sample of its length:
below MARGIN of their QUANTILE, by the logarithm of the number of n-grams. Lengths with fewer than LEAST sample rows take the
bound of the next longer length that has them, scaled down to what short texts can reach.

idf counts all training rows. Centroids come from a bounded sample: SAMPLE rows a language, those of the
smallest hash of doc_id and text; equal rows count once. Null text and text without a letter get `und`, score 0 and are rejected.
Rows with null or repeated doc_id are kept. Other columns are ignored. Without training rows all is `und`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shared import lean, release, small_batches

SLOTS = 1 << 13
SAMPLE = 400  # training rows a language from which centroids are made
CLUSTERS = 3
QUANTILE, MARGIN = 0.02, 0.5  # a text is rejected below this part of this quantile of its language's cosines
LENGTHS, LEAST = 16, 20  # lengths are told apart by their logarithm; sample rows that a length needs for a bound of its own
SHORT = 0.75  # what half the length leaves of a bound
UNKNOWN = "und"
_U = np.uint64
_letter: np.ndarray | None = None


def held_out(doc_id: Column) -> Column:
    """The rows that no model learns from: crc32 of doc_id as text divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of a text's letters; None without a letter."""
    if not text:
        return None
    out = np.zeros(SLOTS, np.int64)
    some = False
    for a in range(0, len(text), 1 << 20):  # long texts in pieces that share two characters
        code = np.frombuffer(text[max(0, a - 2) : a + (1 << 20)].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        some = some or bool(letter.any())
        code = np.where(letter, code, np.uint32(32))
        keep = np.ones(len(code), bool)
        keep[1:] = letter[1:] | letter[:-1]
        c = np.concatenate(([32], code[keep], [32])).astype(_U)
        h = c * _U(0x9E3779B97F4A7C15)
        for width in (1, 2, 3):
            if width > 1:
                h = h[:-1] * _U(0xBF58476D1CE4E5B9) + c[width - 1 :] * _U(0x94D049BB133111EB)
            out += np.bincount((h >> _U(51)).astype(np.int64), minlength=SLOTS)
    return out if some else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as normalised tf-idf vectors."""
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each slot occurs; slot -1 counts the texts."""
    df, n = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            counts = gram_counts(text.as_py())
            if counts is not None:
                df += counts > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["slot", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, c) for lang, c in zip(batch.column("lang").to_pylist(), (gram_counts(t.as_py()) for t in batch.column("text"))) if c is not None]
        at = [np.flatnonzero(c) for _, c in rows]
        yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in rows], pa.string()), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([np.minimum(c[a], 1 << 30).astype(np.int32).tobytes() for a, (_, c) in zip(at, rows)], pa.binary())], ["lang", "slots", "counts"])


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from spread-out starts; the same rows give the same centroids."""
    start = [x.mean(0)]
    while len(start) < min(k, len(x)):
        start.append(x[np.argmin(np.max(x @ np.array(start).T, 1))])
    centre = np.array(start)
    for _ in range(12):
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        of = np.argmax(x @ centre.T, 1)
        centre = np.array([x[of == j].mean(0) if (of == j).any() else centre[j] for j in range(len(centre))])
    return centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)


def lengths(counts: np.ndarray) -> np.ndarray:
    """The logarithm of each row's number of n-grams."""
    return np.minimum(np.log2(np.maximum(counts.sum(-1), 1)).astype(np.int64), LENGTHS - 1)


def _bounds(cosine: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The least accepted cosine at each length, from the cosines and lengths of a language's sample."""
    out = np.full(LENGTHS, np.nan)
    for k in range(LENGTHS):
        own = cosine[length == k]
        if len(own) >= LEAST:
            out[k] = np.quantile(own, QUANTILE) * MARGIN
    if np.isnan(out).all():
        out[-1] = cosine.min() * MARGIN**2
    for k in range(LENGTHS - 2, -1, -1):
        if np.isnan(out[k]):
            out[k] = out[k + 1] * SHORT
        else:
            out[k] = min(out[k], out[k + 1]) if not np.isnan(out[k + 1]) else out[k]
    for k in range(1, LENGTHS):
        if np.isnan(out[k]):
            out[k] = out[k - 1]
    return out


def fit(docs: DataFrame) -> dict:
    """The model of docs (doc_id, text, lang): idf, centroids, their languages, the least accepted cosine of each at each length."""
    small_batches(docs.sparkSession)
    train = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang", F.xxhash64("doc_id", "text").alias("draw"))
    got = train.select("text").mapInArrow(lean(_frequencies), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df, n = np.zeros(SLOTS), 1
    for slot, count in zip(got.column("slot").to_pylist(), got.column("n").to_pylist()):
        if slot < 0:
            n = max(1, count)
        else:
            df[slot] = count
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
    few = train.select("lang", "draw", F.pmod(F.col("draw"), F.lit(64)).alias("salt"))
    for keys in (("lang", "salt"), ("lang",)):  # a common language is first cut to its salts' smallest hashes
        few = few.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("draw"))).where(F.col("place") <= SAMPLE)
    cut = few.groupBy("lang").agg(F.max("draw").alias("cut"))
    cuts = {r[0]: r[1] for r in cut.collect()}  # a row for each language
    if not cuts:
        return {"idf": idf, "centres": np.zeros((0, SLOTS), np.float32), "of": [], "least": np.zeros((0, LENGTHS))}
    within = F.lit(False)
    for lang, last in sorted(cuts.items()):
        within = within | ((F.col("lang") == lang) & (F.col("draw") <= last))
    sample = train.where(within).groupBy("lang", "draw").agg(F.first("text").alias("text")).select("lang", "text").mapInArrow(lean(_vectors), "lang string, slots binary, counts binary").toArrow()
    by: dict[str, list] = {}
    for lang, *row in sorted(zip(*(sample.column(c).to_pylist() for c in ("lang", "slots", "counts")))):
        by.setdefault(lang, []).append(row)
    del sample
    centres, of, least = [], [], []
    for lang, rows in sorted(by.items()):
        counts = np.zeros((len(rows), SLOTS), np.int32)
        for k, (slots, n) in enumerate(rows):
            counts[k, np.frombuffer(slots, np.uint16)] = np.frombuffer(n, np.int32)
        x = weighted(counts, idf)
        c = _clusters(x, CLUSTERS)
        least += [_bounds(np.max(x @ c.T, 1), lengths(counts))] * len(c)
        centres.append(c)
        of += [lang] * len(c)
    release()
    if not of:
        return {"idf": idf, "centres": np.zeros((0, SLOTS), np.float32), "of": [], "least": np.zeros((0, LENGTHS))}
    return {"idf": idf, "centres": np.concatenate(centres).astype(np.float32), "of": of, "least": np.array(least)}


def _predict(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m["of"], UNKNOWN], dtype=object)
        for batch in batches:
            pick = np.full(batch.num_rows, len(names) - 1)
            best = np.zeros(batch.num_rows)
            least = np.ones(batch.num_rows)
            texts = batch.column("text")
            for a in range(0, batch.num_rows, 64):
                rows = [(i, c) for i in range(a, min(a + 64, batch.num_rows)) if (c := gram_counts(texts[i].as_py())) is not None]
                if rows and m["of"]:
                    counts = np.array([c for _, c in rows])
                    cosine = weighted(counts, m["idf"]) @ m["centres"].T
                    at = [i for i, _ in rows]
                    pick[at] = np.argmax(cosine, 1)
                    best[at] = np.max(cosine, 1)
                    least[at] = m["least"][pick[at], lengths(counts)]
            lang = names[pick]
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(np.clip(best, 0, 1)), pa.array((lang == UNKNOWN) | (best < least))], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs (doc_id, text, lang)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lean(_predict(model)), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not rejected; lang is left as it is."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")
    schema = T.StructType([keyed.schema["row"]]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return keyed.mapInArrow(lean(_predict(model)), schema).where(~F.col("rejected")).select("row.*")
