"""Toxicity scores by non-negative positive-unlabelled learning.

A text's terms are the beginnings of its words (bytes, A-Z lower-cased): their first LEAST to MOST bytes, and short words as a whole.
Of the terms those stand that confirmed toxic texts hold most significantly more often than texts at large; a logistic model over
their presence is trained in numpy from confirmed toxic texts (P) and unlabelled ones (U) alone. With the class prior p the risk
of calling a toxic text clean is p * mean_P, and the risk of calling a clean one toxic is estimated as mean_U - p * mean_P; where that estimate
falls below zero, which no risk can, the step goes back up it instead of on.

The model learns from bounded samples: at most POSITIVES toxic and UNLABELLED other training rows, those of the smallest hash of doc_id; of texts
with one doc_id the least is taken. The prior is the toxic share of labelled training rows unless it is given.
Every text is scored whole. Null and empty texts have no terms and get the model's bias; rows with null or repeated doc_id are scored like others.
Null labels teach nothing. Without confirmed toxic training texts all scores are 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.hashing import U, _LOWER, buffers, mix, slices
from plumbline.llm.language import held_out
from plumbline.llm.shared import lean, small_batches, stored

POSITIVES, UNLABELLED = 2000, 6000
TERMS = 256
LEAST, MOST = 3, 10  # bytes of a word's beginning
FEWEST = 4  # toxic sample texts that a term must stand in
STEPS, RATE, RIDGE = 400, 0.05, 1e-3
PRIOR = 0.1  # where no labelled row is clean
PIECE = 1 << 20  # bytes of a long text that are looked at once
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _beginnings(raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which starts, terms) of the words that begin at starts; raw goes on with MOST + 1 spaces."""
    who, h = np.arange(len(starts)), np.zeros(len(starts), U)
    for k in range(MOST + 1):
        byte = raw[starts + k]
        ends = _SPACE[byte]
        if k and ends.any():
            yield who[ends], mix(h[ends] + U(k + 64))
            who, starts, h, byte = who[~ends], starts[~ends], h[~ends], byte[~ends]
        if k == MOST or not len(who):
            break
        h = (h ^ _LOWER[byte]) * U(0x9E3779B97F4A7C15 | 1)
        if k + 1 >= LEAST:
            yield who, mix(h + U(k + 1))


def terms(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, term) arrays over all texts of rows of bytes, repeats included; of a long text a piece at a time."""
    pad = np.full(MOST + 1, 0x20, np.uint8)
    for lo, hi in slices(at, PIECE):
        if hi == lo + 1:
            pieces = [(a, min(a + PIECE, at[hi])) for a in range(at[lo], at[hi], PIECE)]
        else:
            pieces = [(at[lo], at[hi])] if at[hi] > at[lo] else []
        for a, z in pieces:
            raw, where = data[a : min(z + MOST + 1, at[hi])], np.empty(0, np.int64)
            if hi > lo + 1:  # a space between rows keeps their words apart
                where = at[lo + 1 : hi] - at[lo]
                raw = np.insert(raw, where, 0x20)
                where = where + np.arange(1, len(where) + 1)
            raw = np.concatenate((raw, pad))
            space = _SPACE[raw]
            begins = ~space
            begins[1:] &= space[:-1]
            if a > at[lo]:
                begins[0] &= _SPACE[data[a - 1]]
            starts = np.flatnonzero(begins)
            starts = starts[starts < z - a + len(where)]
            row = lo + np.searchsorted(where, starts, side="right")
            for who, term in _beginnings(raw, starts):
                yield row[who], term


def presence(data: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (row, place in the sorted chosen) of the chosen terms in each text."""
    table = np.zeros(1 << 16, bool)
    table[(chosen >> U(48)).astype(np.int64)] = True
    found = []
    for row, term in terms(data, at):
        some = np.flatnonzero(table[(term >> U(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(chosen, term[some]), max(len(chosen) - 1, 0))
        hit = chosen[place] == term[some] if len(chosen) else np.zeros(0, bool)
        found.append(np.unique(row[some][hit] * TERMS + place[hit]))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // TERMS, keys % TERMS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, toxic, n: in how many texts, toxic and unlabelled ones, each term stands."""
    for batch in batches:
        data, at = buffers(batch.column("text"))
        toxic, plain = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "plain"))
        for lo, hi in slices(at):
            seen = [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for row, term in terms(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]):
                seen[0].append(row), seen[1].append(term)
            row, term = map(np.concatenate, seen)
            order = np.lexsort((row, term))
            row, term = row[order], term[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
            row, term = row[new] + lo, term[new]
            first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            counts = [np.add.reduceat(x[row].astype(np.int64), first) if len(first) else first for x in (toxic, plain)]
            yield pa.RecordBatch.from_arrays([pa.array(term[first].view(np.int64)), *map(pa.array, counts)], ["term", "toxic", "n"])


def _rows(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            held = np.zeros((batch.num_rows, TERMS), bool)
            held[presence(data, at, shared.value)] = True
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("plain"), pa.array([r.tobytes() for r in np.packbits(held, axis=1)], pa.binary())], ["toxic", "plain", "held"])

    return lean(run)


def risks(w: np.ndarray, b: float, toxic: np.ndarray, plain: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The logistic model's positive risk, its estimated negative risk, and the gradient (weights, bias last) of the non-negative estimator.

    Where the negative risk is negative the gradient is that of its opposite.
    """
    zp, zu = toxic @ w + b, plain @ w + b
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    positive, negative = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if negative >= 0:
        gp, gu = prior * (sp - 1 - sp) / len(zp), su / len(zu)
    else:
        gp, gu = prior * sp / len(zp), -su / len(zu)
    return positive, negative, np.append(toxic.T @ gp + plain.T @ gu, gp.sum() + gu.sum()).astype(np.float64)


def trained(toxic: np.ndarray, plain: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows at once, from zero: the same rows give the same model."""
    v, mean, square = np.zeros(toxic.shape[1] + 1, np.float32), 0.0, 0.0
    v[-1] = np.log(prior / (1 - prior))
    for t in range(1, STEPS + 1):
        g = risks(v[:-1], v[-1], toxic, plain, prior)[2]
        g[:-1] += RIDGE * v[:-1]
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        v = v - (RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return v[:-1], float(v[-1])


def _drawn(ids: DataFrame, n: int, most: int) -> DataFrame:
    """At most `most` different doc_ids of ids, those of the smallest hash; n: about how many there are."""
    draw = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1))
    few = ids.where(draw < F.lit(int((1 << 40) * min(1.0, 1.25 * most / max(n, 1))))).distinct()
    return few.withColumn("place", F.row_number().over(Window.orderBy(draw, "doc_id"))).where(F.col("place") <= most).select("doc_id")


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> dict:
    """The model of docs (doc_id, text) and labels (doc_id, label 0 or 1): prior, and terms, weights and bias if a toxic text taught them."""
    spark = docs.sparkSession
    taught = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = {r[0]: r[1] for r in taught.groupBy("label").count().collect()}
    if prior is None:
        prior = min(max(n.get(1, 0) / sum(n.values()), 0.001), 0.9) if n.get(0) else PRIOR
    if not n.get(1):
        return {"prior": prior}
    ours = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id")
    drawn = _drawn(taught.where("label = 1").select("doc_id"), n[1], POSITIVES).withColumn("toxic", F.lit(True)).join(_drawn(ours, ours.count(), UNLABELLED).withColumn("plain", F.lit(True)), "doc_id", "full")
    few = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), *(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("toxic", "plain")))
    few = stored(few, "toxicity_sample").select("text", "toxic", "plain")
    at_large = few.agg(*(F.sum(F.col(c).cast("int")) for c in ("toxic", "plain"))).first()
    if not at_large[0] or not at_large[1]:
        return {"prior": prior}
    share, toxic = (F.col("n") + 1) / (at_large[1] + 2), F.col("toxic") / at_large[0]
    z = (toxic - share) / F.sqrt(share * (1 - share))
    counts = few.mapInArrow(lean(_counted), "term long, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    best = counts.where((F.col("toxic") >= FEWEST) & (z > 0)).orderBy(z.desc(), "term").limit(TERMS).select("term").collect()
    chosen = np.sort(np.array([r.term for r in best], np.int64).view(U))
    rows = few.mapInArrow(_rows(spark.sparkContext.broadcast(chosen)), "toxic boolean, plain boolean, held binary").toArrow()  # bits of the bounded sample
    order = sorted(zip(rows.column("held").to_pylist(), rows.column("toxic").to_pylist(), rows.column("plain").to_pylist()))
    held = np.unpackbits(np.frombuffer(b"".join(r[0] for r in order), np.uint8).reshape(-1, TERMS // 8), axis=1).astype(np.float32)
    weights, bias = trained(*(held[np.array([r[k] for r in order], bool)] for k in (1, 2)), prior)
    return {"prior": prior, "terms": chosen, "weights": weights, "bias": bias}


def _score(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if "terms" in model:
                data, at = buffers(batch.column("text"))
                row, place = presence(data, at, model["terms"])
                z = model["bias"] + np.bincount(row, weights=model["weights"][place].astype(np.float64), minlength=batch.num_rows)
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return lean(run)


def scored(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, label."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels, prior))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
