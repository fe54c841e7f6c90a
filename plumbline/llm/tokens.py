"""Token counts as the `tokenizers` library gives them, with overlap resynchronisation for huge documents.

A text of more than CHUNK characters is encoded in overlapping chunks with offsets. Two neighbouring chunks are
spliced at a boundary where a run of STABLE tokens has the same ids and offsets in both; when there is
none in the overlap, it is doubled and the chunk encoded again, at last joined with its left neighbour. Shorter texts
are one chunk. A chunk of a tokenizer that drops white space is counted by its words, each encoded by the library
once while a bounded memory holds it; whether the tokenizer does is read from its file, else chunks are
encoded whole.

Null is the empty text: 0 tokens. Special strings in a text are handled as the library does by default; none are added.
Rows with null or repeated doc_id are kept. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import buffers
from plumbline.llm.shared import small_batches

CHUNK = 1 << 15  # characters
OVERLAP = 256
STABLE = 8
REMEMBERED = 400_000  # words whose counts a task holds


def drops_space(path: str) -> bool:
    """Whether no token can reach over white space: the pre-tokenizer keeps matches of a pattern without space only,
    and no added token holds or takes up space."""
    spec = json.loads(open(path, encoding="utf-8").read())
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    parts = first.get("pattern", {}).get("Regex", "").split("|") if first.get("type") == "Split" else [""]
    closed = first.get("behavior") == "Removed" and first.get("invert") and all(p and (p[0] == "'" or p[:2] in ("[^",) and r"\s" in p or p.startswith(r"[\p{")) and " " not in p for p in parts)
    added = spec.get("added_tokens") or []
    free = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in added)
    inner = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:])
    normal = spec.get("normalizer") or {}
    plain = all(n.get("type") in ("NFC", "Lowercase") or n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in normal.get("normalizers", [normal] if normal else []))
    return bool(closed and free and inner and plain and spec.get("post_processor") is None)


class Counter:
    """Counts tokens; one a task."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_word = drops_space(path)
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}

    def encoded(self, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """(first, end, id) of the tokens of text[a:b]; places are in the text."""
        e = self.library.encode(text[a:b], add_special_tokens=False)
        return [(x + a, y + a, i) for (x, y), i in zip(e.offsets, e.ids)]

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of texts of one chunk each."""
        if not self.by_word:
            return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]  # white space to any reader
        new = list({w for ws in words for w in ws if w not in self.known})
        for k in range(0, len(new), 1024):  # one text of many words costs less than many texts
            some = new[k : k + 1024]
            starts = np.cumsum([0, *(len(w) + 1 for w in some)])
            e = self.library.encode(" ".join(some), add_special_tokens=False)
            first = np.fromiter((x for x, _ in e.offsets), np.int64, len(e.ids))
            self.known.update(zip(some, np.diff(np.searchsorted(first, starts)).tolist()))
        return [sum(map(self.known.__getitem__, ws)) for ws in words]

    def long_count(self, text: str) -> int:
        """The token count of a text of many chunks."""
        total, a, b = 0, 0, self.chunk
        left = self.encoded(text, a, b)
        while b < len(text):
            overlap, end = self.overlap, min(len(text), b + self.chunk - self.overlap)
            while True:
                start = b - overlap
                if start <= a:  # no boundary in the whole chunk: join it with the next
                    left = self.encoded(text, a, end)
                    break
                right = self.encoded(text, start, end)
                cut = common_boundary(left, right)
                if cut is not None:
                    total += cut[0]
                    left, a = right[cut[1] :], right[cut[1]][0]
                    break
                overlap *= 2
            b = end
        return total + len(left)


def common_boundary(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], run: int = STABLE) -> tuple[int, int] | None:
    """Where both token lists can be spliced: the middle of a run of equal tokens clear of both cut ends, if there is one."""
    place = {t: i for i, t in enumerate(right)}
    i = len(left) - 1
    while i >= run:
        j = place.get(left[i])
        if j is not None:
            n = 0
            while n <= j and n <= i and left[i - n] == right[j - n]:
                n += 1
            # the first and last tokens in common may touch a cut: they don't count
            if n >= run + 2:
                half = n // 2
                if left[i - half][0] >= left[i - half - 1][1]:
                    return i - half, j - half
            i -= max(1, n)
        else:
            i -= 1
        if left[i][1] <= right[0][0]:
            break
    return None


def _count(path: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = np.zeros(len(texts), np.int64)
            short = [i for i, t in enumerate(texts) if t and len(t) <= counter.chunk]
            for k in range(0, len(short), 256):
                n[short[k : k + 256]] = counter.counts([texts[i] for i in short[k : k + 256]])
            for i, t in enumerate(texts):
                if t and len(t) > counter.chunk:
                    n[i] = counter.long_count(t)
            _, at = buffers(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def counted(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text); vocabulary: a .json of `tokenizers`."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_count(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
