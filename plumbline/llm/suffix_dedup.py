"""Suffix-array dedup: cut every byte of a string of `size` bytes that also starts in a smaller doc_id.

Equal strings of `size` bytes have the same minimizer (their k-gram of smallest hash), so they meet when the
runs of windows with a common minimizer (at most 2 * size bytes each) are dealt by it. A first pass counts the
texts of every minimizer and leaves a bitmap of those in two texts or more; only their runs are dealt. In a piece of a
partition a run's string is kept once, with its smallest doc_id; it goes from all others, however many have it. Of the
different strings of a minimizer, windows whose hash one document alone has are left out, and the suffix array of the rest
is built by Lyndon grouping, in slices of whole minimizers:
previous-smaller pointers give every suffix its Lyndon prefix, suffixes with equal ones form a group, groups get
their slots in descending order, and one scan in ascending order puts each suffix of a group in place, without
renaming. Neighbours in the array with `size` common bytes are one class; its smallest doc_id decides.

Texts are UTF-8 bytes; null is empty. Whole copies are found by 128 bits of the text's hash: all but those of the
smallest doc_id lose all bytes if there are `size` of them. Elsewhere 64 bits of it stand for the text; should two texts share
these, all is done again with another salt. A null doc_id is larger than all others; rows of one
doc_id never cut each other. Texts under `size` bytes lose nothing. Empty tables give empty results. Other columns
are ignored by spans() and kept by cut().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.hashing import _BYTE, U, buffers, mix, powers, slices
from plumbline.llm.shared import PIECES, bitmap, bits_for, blocks, by_piece, dealt, discard, gathered, in_bitmap, lean, packed, partitions, release, small_batches, stored

LEAST_GRAM = 16
BITS = 1 << 27, 1 << 31  # least and most of the bitmap of repeated minimizers, else one for 8 bytes of text; a full one lets more through
_PIECE = 1 << 18  # window starts handled at once; places in a piece need 20 bits
_PLACE = U((1 << 20) - 1)
_FLUSH = 1 << 18
_ARRAY = 1 << 18  # bytes of one suffix array, unless a single minimizer has more
_LAST = (1 << 63) - 1  # stands for a null doc_id


def gram(size: int) -> int:
    """Bytes of the k-gram whose smallest hash deals a window: long, lest unrelated texts share it by chance."""
    return max(LEAST_GRAM, size // 2)


def suffix_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the strings in order: (place in the concatenation with one gap after each string, first places).

    Suffixes that agree up to their strings' ends follow in any order.
    """
    total = sum(map(len, strings)) + len(strings)
    end, prev, word = [-1] * total, [-1] * total, [0] * total
    groups: dict[bytes, list] = {}
    base, bases = 0, []
    for s in strings:
        bases.append(base)
        n = len(s)
        length = [1] * n
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n and s[i:j] < s[j : j + length[j]]:
                prev[base + j] = base + i  # the nearest smaller suffix on the left
                j += length[j]
            length[i] = j - i
            end[base + i] = base + j
            w = s[i:j]
            g = groups.get(w)
            if g is None:
                g = groups[w] = [0]
            g[0] += 1
            word[base + i] = g
        base += n + 1
    slot = total - len(strings)
    for w in sorted(groups, reverse=True):
        slot -= groups[w][0]
        groups[w][0] = slot
    order = [0] * (total - len(strings))

    def place(at: int) -> None:
        i = at - 1
        while i >= 0 and end[i] == at:
            g = word[i]
            order[g[0]] = i
            g[0] += 1
            i = prev[i]

    for b, s in zip(bases, strings):
        place(b + len(s))
    for k in range(len(order)):
        place(order[k])
    return np.array(order, np.int64), np.array(bases, np.int64)


def window_classes(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of every window of `size` bytes; equal windows have equal classes."""
    order, bases = suffix_order(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    of = np.searchsorted(bases, order, "right") - 1
    offset = order - bases[of]
    whole = offset + size <= lengths[of]
    order, of, offset = order[whole], of[whole], offset[whole]
    flat = np.frombuffer(b"\0".join(strings) + bytes(9), np.uint8).astype(U)
    eight = np.zeros(len(flat) - 8, U)
    for k in range(8):
        eight = (eight << U(8)) | flat[k : k + len(eight)]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, size - 8, 8), size - 8]:
        x = eight[order + k]
        same &= x[1:] == x[:-1]
    return of, offset, np.concatenate((np.zeros(min(1, len(order)), np.int64), np.cumsum(~same)))


def _runs(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of (row, first, last, key): the runs of windows with a common minimizer; places are in the row."""
    k = gram(size)
    wide = size - k + 1
    long = np.diff(at) > _PIECE
    if long.any() and len(at) > 2:
        for r in range(len(at) - 1):
            for row, first, last, key in _runs(data[at[r] : at[r + 1]], np.array([0, at[r + 1] - at[r]]), size):
                yield row + r, first, last, key
        return
    for lo in range(0, max(1, len(data) - size + 1), _PIECE) if len(at) == 2 else (0,):
        part = data[lo : lo + _PIECE + size - 1] if len(at) == 2 else data
        if len(part) < size:
            continue
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        h = mix((total[k:] - total[:-k]) * down[: len(part) - k + 1])
        h = (h & ~_PLACE) | np.arange(len(h), dtype=U)
        step, m = 1, h
        while step * 2 <= wide:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < wide:
            m = np.minimum(m[: len(h) - wide + 1], m[wide - step : wide - step + len(h) - wide + 1])
        start = np.arange(len(m))
        if len(at) == 2:
            row, place, ok = np.zeros(len(m), np.int64), start + lo, np.ones(len(m), bool)
        else:
            row = np.searchsorted(at, start, "right") - 1
            place, ok = start - at[row], start + size <= at[row + 1]
        change = np.ones(len(m), bool)
        change[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
        a = np.flatnonzero(change & ok)
        stop = np.flatnonzero(np.append((change | ~ok)[1:], True))  # last window of a run, or of what is no run
        b = stop[np.searchsorted(stop, a)]
        yield row[a], place[a], place[b], m[a] >> U(20)


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    yield from slices(at, _PIECE)


def text_keys(data: np.ndarray, at: np.ndarray, salt: int = 0) -> np.ndarray:
    """128 bits of a hash of each row's bytes, as two columns."""
    raw = b"".join(hashlib.blake2b(data[a:b], digest_size=16, salt=salt.to_bytes(8, "little")).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
    return np.frombuffer(raw, U).reshape(-1, 2)


def _slots(short: np.ndarray, part: np.ndarray | int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix((short << U(20)) + U(part) if np.isscalar(part) else (short << U(20)) + part.astype(U))
    return (x % U(bits)).astype(np.int64), ((x >> U(33)) * U(0x9E3779B1) % U(bits)).astype(np.int64)


_PAIR = np.dtype([("key", "<u4"), ("text", "<u4"), ("more", "<u2")])


def _minimizers(size: int, parts: int, salt: int) -> Callable:
    """(minimizer, text) pairs, 32 and 48 bits, dealt by minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, n = [], [], 0
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for lo, hi in _pieces(data, at):
                own, place = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                texts = text_keys(own, place, salt)[:, 0]
                for row, _, _, key in _runs(own, place, size):
                    order = np.lexsort((row, key))
                    key, row = key[order], row[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                    key, text = key[new], texts[row[new]]
                    x = np.empty(len(key), _PAIR)
                    x["key"], x["text"], x["more"] = key >> U(12), text & U(0xFFFFFFFF), text >> U(48)
                    held.append(x)
                    keys.append(key)
                    n += len(key)
                if n >= _FLUSH:
                    yield packed(np.concatenate(held), np.concatenate(keys), parts)
                    held, keys, n = [], [], 0
        if n:
            yield packed(np.concatenate(held), np.concatenate(keys), parts)

    return run


def _repeated(bits: int) -> Callable:
    """Words of the bitmap of the minimizers that two texts or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows in by_piece(batches, "block"):
            x = np.concatenate([np.frombuffer(b.as_buffer(), _PAIR) for (b,) in rows])
            pair = (x["key"].astype(U) << U(32)) | x["text"]
            order = np.argsort(pair, kind="stable")
            pair, more = pair[order], x["more"][order]
            at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            differ = np.minimum.reduceat(more, at) != np.maximum.reduceat(more, at)
            key = pair[at] >> U(32)
            of = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            many = (np.diff(np.append(of, len(key))) > 1) | np.logical_or.reduceat(differ, of)
            slot = np.unique(np.concatenate(_slots(key[of][many], piece // PIECES, bits)))
            if not len(slot):
                continue
            word = slot >> 5
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            value = np.bitwise_or.reduceat(np.left_shift(1, slot & 31), first)
            for a in range(0, len(first), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(word[first[a : a + (1 << 16)]], pa.int64()), pa.array(value[a : a + (1 << 16)], pa.int64())], ["w", "v"])

    return run


def _test(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) > 0


def _dealt_runs(size: int, parts: int, table, salt: int) -> Callable:
    """Runs of repeated minimizers, packed for their piece: heads (key, text, doc, place, length) and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        heads: list[np.ndarray] = []
        bodies: list[bytes] = []
        n = 0

        def flush() -> pa.RecordBatch:
            head = np.concatenate(heads)
            piece, rows = blocks(head, head[:, 0].astype(U), parts)
            out = [(head[r].tobytes(), b"".join([bodies[i] for i in r.tolist()])) for r in rows]
            heads.clear()
            bodies.clear()
            return pa.RecordBatch.from_arrays([piece, pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary())], ["piece", "heads", "bytes"])

        for batch in batches:
            data, at = buffers(batch.column("text"))
            docs = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
            for lo, hi in _pieces(data, at):
                own, place = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                texts = text_keys(own, place, salt)[:, 0]
                for row, first, last, key in _runs(own, place, size):
                    one, two = _slots(key >> U(12), key % U(parts), len(known) * 32)
                    hit = _test(known, one) & _test(known, two)
                    row, first, last, key = row[hit], first[hit], last[hit], key[hit]
                    if not len(row):
                        continue
                    heads.append(np.stack((key.astype(np.int64), texts[row].astype(np.int64), docs[lo + row], first, last - first + size), 1))
                    raw = own.tobytes()
                    a = (place[row] + first).tolist()
                    bodies += [raw[i : i + k] for i, k in zip(a, (last - first + size).tolist())]
                    n += len(row)
                if n >= _FLUSH // 4:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return run


def _cuts(size: int) -> Callable:
    """(text, doc, first, end): byte ranges to cut from a document's text, found in one partition's runs."""
    names = ["text", "doc", "first", "end"]

    def batch(gone: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*gone)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_piece(batches, "heads", "bytes"):
            own: dict[tuple[int, bytes], tuple[int, dict[int, set[int]]]] = {}  # a string: its smallest document, and the places of that by text
            gone: list[tuple] = []
            for head, body in rows:
                body, at = body.as_py(), 0
                for key, text, doc, place, length in np.frombuffer(head.as_buffer(), np.int64).reshape(-1, 5).tolist():
                    s = body[at : at + length]
                    at += length
                    least, where = own.get((key, s), (None, None))
                    if least is None or doc < least:
                        gone += [(t, least, p, p + length) for t, places in (where or {}).items() if t != text for p in places]
                        own[key, s] = doc, {text: {place}}
                    elif doc == least:
                        where.setdefault(text, set()).add(place)
                    elif text not in where:  # whole copies go elsewhere
                        gone.append((text, doc, place, place + length))
                if len(gone) >= 1 << 16:
                    yield batch(gone)
                    gone = []
            gone += [(t, doc, p + a, p + z) for doc, where, a, z in _least_cuts(own, size) for t, places in where.items() for p in places]
            for a in range(0, len(gone), 1 << 16):
                yield batch(gone[a : a + (1 << 16)])

    return run


def _least_cuts(own: dict[tuple[int, bytes], tuple[int, dict]], size: int) -> Iterator[tuple[int, dict, int, int]]:
    """(doc, where, first, end): parts of the strings' own documents that another string of the minimizer has of a smaller document."""
    items = sorted(own.items())
    keys = np.array([k for (k, _), _ in items], np.int64)
    new = np.concatenate(([True], keys[1:] != keys[:-1], [True])) if len(keys) else np.ones(1, bool)
    alone = new[:-1] & new[1:]
    rows = np.flatnonzero(~alone)  # one string: its windows differ, so that each is its own class and nothing needs an order
    if not len(rows):
        return
    head = np.array([(keys[i], items[i][1][0], i, 0, len(items[i][0][1])) for i in rows.tolist()], np.int64)
    head, bodies = _shared(head, [items[i][0][1] for i in rows.tolist()], size)
    cut = np.flatnonzero(np.concatenate(([True], head[1:, 0] != head[:-1, 0], [True]))).tolist() if len(head) else []
    ids: dict[bytes, int] = {}
    held: list[tuple[int, int]] = []
    amount = 0

    def decided() -> Iterator[tuple[int, dict, int, int]]:
        for i, a, z in _decided(head, held, list(ids), size).tolist():
            doc, where = items[i][1]
            yield doc, where, a, z

    for a, b in zip(cut[:-1], cut[1:]):
        for i in range(a, b):
            s = bodies[i]
            if s not in ids:
                ids[s] = len(ids)
                amount += len(s)
            held.append((i, ids[s]))
        if amount >= _ARRAY:
            yield from decided()
            held, ids, amount = [], {}, 0
    if held:
        yield from decided()


def _shared(head: np.ndarray, bodies: list[bytes], size: int) -> tuple[np.ndarray, list[bytes]]:
    """The parts of strings (head: key, document, string, offset, length) whose windows may be in another document too.

    Windows whose hash only one document has are left out. This spares the suffix arrays what cannot repeat; which
    windows are equal is theirs to say.
    """
    heads, kept = [], []
    # strings of one minimizer stay together, so that whole groups of them are looked at in turn
    step = np.flatnonzero(np.concatenate(([True], head[1:, 0] != head[:-1, 0], [True])))
    a = 0
    while a < len(head):
        b = int(step[min(len(step) - 1, np.searchsorted(step, a + 20_000))])
        part, data = head[a:b], np.frombuffer(b"".join(bodies[a:b]), np.uint8)
        at = np.concatenate(([0], np.cumsum(part[:, 4])))
        n = part[:, 4] - size + 1
        run = np.repeat(np.arange(len(part)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        first = at[run] + offset
        h = mix((total[first + size] - total[first]) * down[first])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], part[run[order], 1]
        group = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        many = np.minimum.reduceat(doc, group) != np.maximum.reduceat(doc, group)
        shared = np.empty(len(run), bool)
        shared[order] = np.repeat(many, np.diff(np.append(group, len(h))))
        rows = np.flatnonzero(shared)
        if len(rows):
            new = np.concatenate(([True], (rows[1:] != rows[:-1] + 1) | (run[rows[1:]] != run[rows[:-1]])))
            z = rows[np.append(np.flatnonzero(new)[1:], len(rows)) - 1]
            i = rows[new]
            h = part[run[i]].copy()
            h[:, 3] += offset[i]
            h[:, 4] = offset[z] - offset[i] + size
            heads.append(h)
            kept += [bodies[a + r][o : o + k] for r, o, k in zip(run[i].tolist(), offset[i].tolist(), h[:, 4].tolist())]
        a = b
    return (np.concatenate(heads) if heads else head[:0]), kept


def _decided(head: np.ndarray, held: list[tuple[int, int]], strings: list[bytes], size: int) -> np.ndarray:
    """(string, first, end): parts of the strings of head that a smaller document has too."""
    rows, of = np.array(held, np.int64).T
    least = np.full(len(strings), _LAST)
    np.minimum.at(least, of, head[rows, 1])
    string, offset, same = window_classes(strings, size)
    first = np.full(same[-1] + 1, _LAST)
    np.minimum.at(first, same, least[string])
    by = np.lexsort((offset, string))  # windows of a string are offsets 0, 1, ...
    owner = first[same[by]]
    at = np.searchsorted(string[by], np.arange(len(strings)))
    n = np.array([len(s) - size + 1 for s in strings])[of]
    run = np.repeat(np.arange(len(rows)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    gone = owner[at[of[run]] + step] < head[rows[run], 1]
    run, step = run[gone], step[gone]
    if not len(run):
        return np.zeros((0, 3), np.int64)
    a = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (step[1:] != step[:-1] + 1))))
    z = np.append(a[1:], len(run)) - 1
    h = head[rows[run[a]]]
    return np.stack((h[:, 2], h[:, 3] + step[a], h[:, 3] + step[z] + size), 1)


def _keyed(names: list[str], table, everything: bool, salt: int) -> Callable:
    """Each row with its text's key, size and sha256; the text itself only where something may be cut from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            data, at = buffers(batch.column("text"))
            keys = text_keys(data, at, salt)
            keep = np.ones(len(keys), bool) if everything else in_bitmap(known, keys[:, 0])
            digest = [None if k else hashlib.sha256(data[a:b].tobytes()).hexdigest() for k, a, b in zip(keep, at[:-1].tolist(), at[1:].tolist())]
            text = pc.if_else(pa.array(keep), batch.column("text"), pa.scalar(None, batch.column("text").type))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(keys[:, k].astype(np.int64)) for k in (0, 1)), pa.array(np.diff(at)), pa.array(digest, pa.string()), text], [*names, "_key", "_second", "_bytes", "_digest", "text"])

    return run


def _ranges(docs: DataFrame, size: int, salt: int) -> DataFrame:
    """_key, _doc, spans: what to cut from the texts that share strings with a smaller doc_id, unmerged."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") >= size)
    least, most = BITS
    amount = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(most, max(least, 1 << (amount // 8).bit_length()))
    pairs = dealt(texts.select("text").mapInArrow(lean(_minimizers(size, parts, salt)), "piece long, block binary"), parts)
    table = spark.sparkContext.broadcast(gathered(pairs.mapInArrow(lean(_repeated(bits)), "w long, v long"), bits))
    release()
    runs = dealt(texts.mapInArrow(lean(_dealt_runs(size, parts, table, salt)), "piece long, heads binary, bytes binary"), parts)
    found = runs.mapInArrow(lean(_cuts(size)), "text long, doc long, first long, end long")
    return stored(found.groupBy(F.col("text").alias("_key"), F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("first", "end")).alias("spans")), "spans")


def _merged(spans: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["first"], x["end"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def _left(names: list[str], size: int, whole: bool) -> Callable:
    """What is left of each row's text: its sha256, or the text itself."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            n_bytes = batch.column("_bytes").to_pylist()
            digest = batch.column("_digest").to_pylist()
            missing = batch.column("text").is_null().to_pylist()
            removed, spans, left = [], [], []
            for i, (n, copy, cut) in enumerate(zip(n_bytes, batch.column("_copy").to_pylist(), batch.column("spans").to_pylist())):
                gone = [(0, n)] if copy and n >= size else _merged(cut)
                if not gone and digest[i] is not None:
                    kept, out = n, digest[i]
                elif copy and n >= size:
                    kept, out = 0, "" if whole else empty
                else:
                    raw = data[at[i] : at[i + 1]].tobytes()
                    rest = b"".join(raw[a:b] for a, b in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), n]))
                    kept, out = len(rest), rest.decode("utf-8", "ignore") if whole else hashlib.sha256(rest).hexdigest()
                removed.append(n - kept)
                spans.append(len(gone))
                left.append(None if whole and missing[i] else out)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.string())], [*names, "n_bytes", "n_removed", "n_spans", "left"])

    return run


def _done(docs: DataFrame, size: int, whole: bool, salt: int = 0) -> DataFrame:
    """For every row of docs: `row` (its columns but text, if whole) or doc_id, n_bytes, n_removed, n_spans, left."""
    if size < LEAST_GRAM + 8:
        raise ValueError(f"size must be {LEAST_GRAM + 8} at least")
    spark = docs.sparkSession
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row") if whole else F.col("doc_id").cast("long").alias("doc_id")
    ranges = _ranges(docs, size, salt)
    rows = docs.select(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_doc"), "text")
    names = [rows.columns[0], "_doc"]
    keyed = "_key long, _second long, _bytes long, _digest string, text string"
    schema = T.StructType([*(rows.schema[c] for c in names), *T.StructType.fromDDL(keyed)])
    table = spark.sparkContext.broadcast(bitmap(ranges.select(F.col("_key").alias("key")), bits_for(ranges.count())))
    if whole:  # texts are too large to be written twice: their keys alone are
        keys = rows.select("_doc", "text").mapInArrow(lean(_keyed(["_doc"], table, False, salt)), f"_doc long, {keyed}").select("_doc", "_key", "_second")
        rows = rows.mapInArrow(lean(_keyed(names, table, True, salt)), schema)
    else:
        rows = stored(rows.mapInArrow(lean(_keyed(names, table, False, salt)), schema), "keyed")
        keys = rows
    first = keys.groupBy("_key").agg(F.min("_doc").alias("_first"), F.count("*").alias("_n"), F.min("_second").alias("_lo"), F.max("_second").alias("_hi")).where("_n > 1")
    first = stored(first.select("_key", "_first", "_lo", "_hi"), "first")
    if not first.where("_lo <> _hi").isEmpty():
        discard(ranges, first, *([] if whole else [rows]))
        return _done(docs, size, whole, salt + 1)
    rows = rows.drop("_second").join(first.select("_key", "_first"), "_key", "left").join(ranges, ["_key", "_doc"], "left").withColumn("_copy", F.coalesce(F.col("_doc") > F.col("_first"), F.lit(False)))
    out = T.StructType([rows.schema[names[0]]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("left", "string")
    return rows.mapInArrow(lean(_left(names[:1], size, whole)), out)


def spans(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text)."""
    return _done(docs, size, False).withColumnRenamed("left", "kept_sha256")


def cut(docs: DataFrame, size: int = 50) -> DataFrame:
    """docs with the repeated bytes cut from text (broken characters go) and n_chars, if there, counted again.

    Rows from which everything is cut are left out; rows that were empty or null stay as they are.
    """
    out = _done(docs, size, True).where("n_removed < n_bytes or n_bytes = 0")
    count = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("left")) if "n_chars" in docs.columns else None
    new = {"text": F.col("left"), "n_chars": count}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
