"""Pivot-table clustering, positive-unlabelled toxicity and the filter audit against brute force, and their odd inputs."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_corpus_operators import SCHEMA, corpus, sentence

from plumbline.llm import filter_audit, pivot_clusters, toxicity
from plumbline.llm.hashing import U


def vectors(n: int, r: random.Random) -> list[tuple]:
    middles = [[r.uniform(-2, 2) for _ in range(64)] for _ in range(6)]
    rows = [(i, [m + r.gauss(0, 0.3) for m in middles[i % 6]]) for i in range(n)]
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (3, rows[3][1]), (5, rows[7][1]), (None, rows[1][1]), (None, rows[2][1])]
    return rows


ODD = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [float("nan")] + [1.0] * 63), (906, [float("-inf")] + [1.0] * 63), (None, None)]


def k_means(rows, clusters, rounds, seed=2):
    """The plain algorithm in Python integers: every distance, no pivots."""
    v = [(i, [math.floor(256 * e) for e in x]) for i, x in rows if x is not None and len(x) == 64 and all(e is not None and math.isfinite(e) for e in x)]
    order = sorted(v, key=lambda t: (t[0] is None, hashlib.sha256(f"{seed}:{t[0]}".encode()).hexdigest() if t[0] is not None else "", t[1]))
    cs = [x for _, x in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(cs)) for _, x in v]

    for _ in range(rounds):
        got = assign()
        for k in range(len(cs)):
            own = [x for (_, x), (_, c) in zip(v, got) if c == k]
            if own:
                cs[k] = [sum(col) // len(own) for col in zip(*own)]
    got = assign()
    inertia = Counter()
    for d, k in got:
        inertia[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for (i, _), (d, k) in zip(v, got))


@pytest.mark.parametrize("n,clusters", [(150, 12), (3, 12)])
def test_clusters_by_force(spark, n, clusters):
    rows = vectors(max(n, 8), random.Random(n))[-n if n < 8 else 0 :] + ODD
    df = spark.createDataFrame([(*r, 7, 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, n long, cluster string").repartition(3)
    exact = [(i, np.array(x, np.float32).astype(float).tolist() if x is not None and None not in x else x) for i, x in rows]
    assert Counter(map(tuple, pivot_clusters.clustered(df, clusters, 3).collect())) == k_means(exact, clusters, 3)


def test_clusters_odd_input(spark):
    schema = "vec_id long, embedding array<double>"
    assert pivot_clusters.clustered(spark.createDataFrame([], schema)).collect() == []
    assert pivot_clusters.clustered(spark.createDataFrame(ODD, schema)).collect() == []
    large = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [1e300] * 63 + [0.0])]  # held at the limit: distances still fit a long
    got = {r.vec_id: r for r in pivot_clusters.clustered(spark.createDataFrame(large, schema), 1, 0).collect()}
    assert sorted(got) == [1, 2, 3] and max(r.distance for r in got.values()) in (64 * (2 << 27) ** 2, 63 * (2 << 27) ** 2 + (1 << 54))


def test_bounds_lose_no_centroid():
    r = np.random.default_rng(3)
    x = r.integers(-300, 300, (6, 64))[r.integers(0, 6, 3000)] + r.integers(-40, 40, (3000, 64))
    centroids = np.concatenate([x[:37], x[:3]])  # three ties
    pivots = pivot_clusters.chosen_pivots(centroids)
    best, least, taken = pivot_clusters.nearest(x, pivot_clusters.distances(x, pivots), centroids, pivots)
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
    assert taken < 0.5 * every.size  # the pivots rule most of them out


def brute_terms(text: str) -> set[bytes]:
    out = set()
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        out |= {w[:k] for k in range(3, min(len(w), 10) + 1)}
        out |= {w + b"$"} if len(w) <= 10 else set()
    return out


def test_terms_by_force(monkeypatch):
    r = random.Random(1)
    texts = [sentence(r, 200), "", "Idiot idiot, IDIOTS", "x", "ab", " a  bc\tdef\n", "ä" * 9 + " z", "q" * 70, sentence(r, 3000), ""]
    raw = [t.encode() for t in texts]
    at, data = np.cumsum([0] + [len(t) for t in raw]), np.frombuffer(b"".join(raw), np.uint8)
    for piece in (1 << 20, 64):  # whole, and long texts in pieces
        monkeypatch.setattr(toxicity, "PIECE", piece)
        got = [set() for _ in texts]
        for row, term in toxicity.terms(data, at):
            for i, t in zip(row.tolist(), term.tolist()):
                got[i].add(t)
        assert [len(g) for g in got] == [len(brute_terms(t)) for t in texts]
        if piece == 64:
            assert got == whole
        whole = got
    one = lambda t: {x for _, term in toxicity.terms(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for x in term.tolist()}
    assert one(b"IDIOT") < one(b"idiot idiots") and one(b"idi") & one(b"idiot")


def test_risks():
    """The gradient is that of the estimator, also where the negative risk is below zero."""
    r = np.random.default_rng(2)
    toxic, plain = r.integers(0, 2, (30, 5)).astype(float), r.integers(0, 2, (80, 5)).astype(float)
    toxic[:, 0], plain[:, 0] = 1, 0
    signs = set()
    for w, b in ((np.zeros(5), -1.0), (np.array([3.0, 0, 0, 0, 0]), -9.0), (np.full(5, 2.0), -14.0)):
        p, n, g = toxicity.risks(w, b, toxic, plain, 0.4)
        value = lambda v, s=(1 if n >= 0 else 0): (lambda x: s * x[0] + x[1] if s else -x[1])(toxicity.risks(v[:-1], v[-1], toxic, plain, 0.4))
        v = np.append(w, b)
        for k in range(6):
            step = np.eye(6)[k] * 1e-5
            assert math.isclose(g[k], (value(v + step) - value(v - step)) / 2e-5, abs_tol=1e-5)
        signs.add(n >= 0)
        assert p >= 0
    assert signs == {True, False}
    w, b = toxicity.trained(np.tile([1.0, 0], (20, 1)).astype(np.float32), np.concatenate([np.tile([1.0, 0], (10, 1)), np.tile([0, 1.0], (90, 1))]).astype(np.float32), 0.1)
    assert w[0] + b > 0 > w[1] + b


def test_toxicity(spark):
    """Held-out texts with insults among clean ones of the same words."""
    r = random.Random(8)
    insults = ["grobo", "dumbar", "lousel"]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 8 == 0
        words = sentence(r, r.randint(20, 400)).split()
        for _ in range(r.randint(2, 4) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(insults) + r.choice(["", "en", ",", "!"]))
        rows.append((i, " ".join(words), "aa", None, 1))
        if i % 3:
            marks.append((i, int(toxic)))
    rows += [(None, None, None, None, 1), (5000, "", None, None, 1), (5001, None, None, None, 1), (7, rows[7][1], None, None, 1), (5002, sentence(r, 90000) + " Grobo, dumbar! lousel", None, None, 1), (5003, sentence(r, 90000), None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, term string, toxic int").repartition(4)
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (0, 1)], "doc_id long, label int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    of = {g.doc_id: g for g in got}
    test = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 900]
    assert len(test) > 100 and sum(g.predicted == int(g.doc_id % 8 == 0) for g in test) >= 0.97 * len(test)
    assert of[5000].score == of[5001].score < 0.5 and of[5002].score > of[5003].score
    assert {(g.doc_id, g.score) for g in toxicity.scored(docs.repartition(7), labels).collect()} == {(g.doc_id, g.score) for g in got}
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {g.score for g in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), labels).collect() == []


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.scored(docs, labels.selectExpr("doc_id", "toxic as label")).where("held_out").join(labels, "doc_id").selectExpr("toxic", "predicted").collect()
    right = sum(g.toxic == g.predicted for g in got) / len(got)
    caught = sum(g.predicted for g in got if g.toxic) / sum(g.toxic for g in got)
    assert right > 0.96 and caught > 0.88


def audit_by_force(rows, labels):
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    marked = {(c, i) for i, q, t in labels for c, v in (("good", q), ("toxic", t)) if v == 1 and i is not None}
    items = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), doc_id is not None and least[t] < doc_id]
        items.append((lang or "", {c for c, f in zip("ABCDE", fails) if f}, ("good", doc_id) in marked, ("toxic", doc_id) in marked))
    out = {}
    for part in {i[0] for i in items}:
        mine = [i for i in items if i[0] == part]
        shapley = Counter()
        for p in itertools.permutations("ABCDE"):
            left = mine
            for k, c in enumerate(p):
                gone = [i for i in left if c in i[1]]
                left = [i for i in left if c not in i[1]]
                shapley[c] += len(gone)
                out[part, "".join(p), k + 1] = [len(left), len(gone), sum(c in i[1] for i in mine) - len(gone), sum(i[1] == {c} for i in mine), sum(i[2] for i in gone), sum(i[3] for i in gone)]
        for (q, p, k), v in out.items():
            if q == part:
                v.append(shapley[p[k - 1]])
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("together", [1 << 16, 3])
def test_audit_by_force(spark, monkeypatch, together):
    monkeypatch.setattr(filter_audit, "TOGETHER", together)
    r = random.Random(4)
    rows = [*corpus(), (-5, "same # text", "aa", None, 1, 1, 2, 3, 4, "k"), (1 << 40, "same # text", "aa", None, 1, 1, 2, 3, 4, "k"), (700, sentence(r, 80000) + " |", "aa", None, 1, 1, 2, 3, 4, "k"), (701, "A B C", "", None, 1, 1, 2, 3, 4, "k")]
    rows += [(1000 + 97 * i, sentence(r, r.choice([50, 250])) + r.choice(["", " #", " ABCDEFGH" * 20, " la" * 300]), r.choice(["aa", "cc", None]), None, 1, 1, 2, 3, 4, "k") for i in range(60)]
    rows += [(9000 + i, "a copy", "aa", None, 1, 1, 2, 3, 4, "k") for i in range(40)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 9100, 3)] + [(6, 0, 0), (6, 1, 1), (None, 1, 1), (9, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {tuple(x) for x in filter_audit.audited(docs, marks).collect()} == audit_by_force(rows, labels)


def test_audit_odd_input(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(spark.createDataFrame([], SCHEMA), marks).collect() == []
    fine = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300)), None)], "doc_id long, text string, lang string")
    got = filter_audit.audited(fine, marks).collect()
    assert len(got) == 600 and {tuple(g)[3:] for g in got} == {(1, 0, 0, 0, 0, 0, 0)}  # no list at all, yet all rows


def test_lists():
    r = random.Random(6)
    for _ in range(50):
        lists = [np.array(sorted(r.sample(range(400), r.randint(0, 60))), np.int64) for _ in range(4)]
        assert filter_audit.union(lists).tolist() == sorted(set().union(*(x.tolist() for x in lists)))
        assert filter_audit.within(lists[0], lists[1]).tolist() == [x in set(lists[1].tolist()) for x in lists[0].tolist()]
    assert len(filter_audit.union([np.zeros(0, np.int64)] * 2)) == 0
    assert U is np.uint64
