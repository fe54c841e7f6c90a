"""The pipeline's stages on the smallest table: what each keeps, and that run() is their chain."""

from collections import defaultdict

import corpus_pipeline
from plumbline.llm import language
from plumbline.llm.shared import stored


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert name and (k == 4 or out.columns == columns)
        docs = stored(out, name)
        texts.append({r.doc_id: r.text for r in docs.collect()} if k < 4 else docs.collect())
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(texts[0]) >= 0.99 * len(first) and all(first[d] == t for d, t in texts[0].items())

    sets = {d: shingles(t) for d, t in texts[0].items()}
    holders, parent = defaultdict(list), {d: d for d in sets}
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(x[i], x[j]) for x in holders.values() for j in range(len(x)) for i in range(j)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(texts[1]) == {d for d in sets if root(d) == d}

    seen, want = set(), {}
    for d in sorted(texts[1]):
        raw = (texts[1][d] or "").encode()
        gone, size = bytearray(len(raw)), corpus_pipeline.PASSAGE
        windows = [raw[i : i + size] for i in range(len(raw) - size + 1)]
        for i, w in enumerate(windows):
            if w in seen:
                gone[i : i + size] = b"\1" * size
        seen.update(windows)
        if not all(gone) or not raw:
            want[d] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    assert texts[2] == want

    items = [" ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, t in texts[2].items() if any(i in " ".join(t.lower().split()) for i in items)}
    assert leaked.isdisjoint(texts[3]) and len(texts[3]) >= len(texts[2]) - len(leaked) - 0.1 * len(first)

    assert len(texts[4]) == len(texts[3]) and all(r.taken in (0, r.size, 2 * r.size) for r in texts[4])


def test_rejection(spark):
    """A script that no training row has is rejected, and so is text without a letter; clean short text stays."""
    rows = [(k, ("the cat and the dog of " if k % 2 else "der hund und die katze ") * 5, "en" if k % 2 else "de") for k in range(60)]
    rows += [(100, "中文字符测试内容在此处出现", None), (101, "12 34 --", None), (102, "the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language.kept(docs).collect()}
    assert 102 in kept and 101 not in kept and 100 not in kept
