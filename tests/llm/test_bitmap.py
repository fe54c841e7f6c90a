"""The bitmap of repeated minimizers: whole, and no word of it reaches the driver as a row."""

import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import shared, suffix_dedup


def test_gathered_words_are_the_bitmap(spark):
    r = np.random.default_rng(3)
    for bits, n in ((1 << 23, 20000), (1 << 20, 30000), (1 << 10, 5), (1 << 20, 0)):
        w, v = r.integers(0, bits // 32, n), 1 << r.integers(0, 32, n)
        want = np.zeros(bits // 32, np.uint32)
        np.bitwise_or.at(want, w, v.astype(np.uint32))
        rows = spark.createDataFrame([*zip(w.tolist(), v.tolist())], "w long, v long").repartition(7)
        np.testing.assert_array_equal(shared.gathered(rows, bits), want)


def test_the_driver_gets_no_words(spark, monkeypatch):
    r = random.Random(8)
    text = ["".join(r.choice("abcdefghij") for _ in range(4000)) for _ in range(30)]
    docs = spark.createDataFrame([(k, t + t2) for k, (t, t2) in enumerate(zip([*text, *text], [*text[::-1], *("z", "y") * 15]))], "doc_id long, text string")
    got = []
    kind = type(docs)
    collect = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: got.append(collect(self)) or got[-1])
    found = suffix_dedup.spans(docs).agg(F.sum("n_removed"), F.count("*")).first()
    assert found[1] == 60 and found[0] > 100_000
    assert sum(t.num_rows for t in got) <= 60  # at most a word a text, for the texts to cut; minimizers are thousands
