"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of word shingles. Shingles get a frequency level from how many different sets have them;
in a document they are ordered by (level, hash). Of two linked documents, each one's prefix keeps
at least one common signature: rare shingles (level 0) sign alone, frequent ones only in pairs
of the same subclass, for which the prefix is extended. Signatures are dealt in packed blocks,
groups of equal signatures give candidates, and exact set overlaps decide.

Links are found without listing all pairs of a group: each document is first compared with the hubs of its groups, the
documents of the fewest rare shingles; then the members of a group that
are not of its hub's component with those of others, within the sizes that a link allows. A pair is given out only if its
sets can be alike: two documents that share no rare shingle (else they meet in its group) have at most the frequent ones of each
in common, and the parity sketches of two sets (SKETCH bits, each the parity of the shingles that fall on it) differ in no more
bits than the sets do in shingles. Exact overlaps decide about the rest. The components are those of all links.

Nulls: null or blank text has no shingles and links with nothing. Rows with a null or repeated doc_id are
kept as they are; a component takes the smallest non-null doc_id of its rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import U, buffers, mix, shingle_sets, slices
from plumbline.llm.shared import PIECES, bitmap, bits_for, by_piece, components, dealt, discard, in_bitmap, lean, packed, partitions, release, small_batches, stored

#: From this count of different sets on, a shingle is frequent; its level is the count's logarithm.
FREQUENT = 8
#: Least and most slots of the level table, which has 16 for each frequent shingle: one byte each. A shared slot only raises a level.
LEVEL_SLOTS = 1 << 22, 1 << 28
SKETCH = 512  # bits of a set's parity sketch
_FLUSH = 1 << 18  # signatures or shingles that a task holds before it deals them out


def set_key(tokens: np.ndarray, seed: int = 0) -> np.uint64:
    """A hash of a whole set; equal sets have equal keys."""
    if not len(tokens):
        return np.uint64(0)
    total = np.array([(tokens ^ U(seed)).sum(), mix(tokens + U(seed)).sum(), len(tokens)], U) * np.array([1, 3, 1], U)
    return mix(total.sum(keepdims=True))[0]


def _counts(width: int, parts: int) -> Callable:
    """The shingles of each set beside 16 bits of its key, so that copies of a set count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, n = [], [], 0
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for lo, hi in slices(at):
                for tokens in shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], width):
                    held.append(tokens)
                    own.append(np.full(len(tokens), set_key(tokens) >> U(48), np.uint16))
                    n += len(tokens)
                if n >= _FLUSH:
                    yield _dealt(held, own, parts)
                    held, own, n = [], [], 0
        if n:
            yield _dealt(held, own, parts)

    return run


_SHORT = np.dtype([("short", "<u4"), ("own", "<u2")])


def _dealt(held: list[np.ndarray], own: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Shingles as the upper 32 bits beside their partition: enough for a count that only orders them."""
    tokens = np.concatenate(held)
    x = np.empty(len(tokens), _SHORT)
    x["short"], x["own"] = tokens >> U(32), np.concatenate(own)
    return packed(x, tokens, parts)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many sets the shingles of a partition are: the level of each frequent one."""
    for piece, blocks in by_piece(batches, "block"):
        x = np.concatenate([np.frombuffer(b.as_buffer(), _SHORT) for (b,) in blocks])
        x = np.sort((x["short"].astype(U) << U(16)) | x["own"])
        x = x[np.concatenate(([True], x[1:] != x[:-1]))] >> U(16)
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        n = np.diff(np.append(at, len(x)))
        at, n = at[n >= FREQUENT], n[n >= FREQUENT]
        if len(at):
            level = np.floor(np.log2(n)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(x[at].astype(np.int64)), pa.array(np.full(len(at), piece // PIECES, np.int32)), pa.array(level)], ["short", "part", "level"])


def _level_table(frequent: DataFrame, parts: int) -> np.ndarray:
    """The level of each slot, the highest of its shingles; other slots are rare."""
    least, most = LEVEL_SLOTS
    slots = min(most, max(least, 1 << (16 * frequent.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = _slot(b.column("short").to_numpy().astype(np.uint32), b.column("part").to_numpy().astype(np.uint32), slots)
            yield pa.RecordBatch.from_arrays([pa.array(slot), b.column("level")], ["slot", "level"])

    found = frequent.mapInArrow(lean(run), "slot int, level byte").groupBy("slot").agg(F.max("level").alias("level")).toArrow()
    table = np.zeros(slots, np.int8)
    table[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    del found
    release()
    return table


def _slot(short: np.ndarray, part: np.ndarray, slots: int) -> np.ndarray:
    return (mix((short.astype(U) << U(32)) | part.astype(U)) % U(slots)).astype(np.int32)


def _signatures(tokens: np.ndarray, level: np.ndarray, top: int, bottom: int) -> np.ndarray:
    """The signatures of one document's prefix, even ones of a rare shingle; bottom/top is the least similarity."""
    n = len(tokens)
    spare = n - -(-bottom * n // top)  # tokens that a linked document may lack
    if bottom * (n + 1) > top * n:
        return np.zeros(0, U)  # any other set is too far
    rare = tokens[level == 0]
    if len(rare) > spare:
        return mix(rare[: spare + 1]) & ~U(1)
    out = [mix(rare) & ~U(1)]
    often = np.flatnonzero(level)
    often = tokens[often[np.lexsort((tokens[often], level[often]))]]
    need = spare + 1 - len(rare)
    band = n.bit_length()
    for scale in (band, band + 1):  # the larger of the two documents has this band
        if scale > band and top * n < bottom << band:
            continue
        classes = max(1, int(0.15 * (1 << (scale - 1))) // 4)
        of = (often % U(classes)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        new = np.concatenate(([True], of[order][1:] != of[order][:-1]))
        pays = np.ones(len(often), np.int64)
        pays[order[new]] = 0  # the first of a subclass makes no pair
        end = int(np.searchsorted(np.cumsum(pays), need)) + 1
        order = order[order < end]
        cuts = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1], [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                own = np.sort(often[order[a:b]])
                i, j = np.triu_indices(b - a, 1)
                out.append(mix(own[i] * U(0x9E3779B97F4A7C15) + own[j] + U(scale)) | U(1))
    return np.concatenate(out)


_LONGS = [f"s{k}" for k in range(SKETCH // 64)]
DOCUMENT = f"doc_id long, key long, second long, n int, rare int, {', '.join(f'{c} long' for c in _LONGS)}"
_DOCUMENT = {"doc_id": pa.int64(), "key": pa.int64(), "second": pa.int64(), "n": pa.int32(), "rare": pa.int32(), **{c: pa.int64() for c in _LONGS}}


def sketch(tokens: np.ndarray) -> np.ndarray:
    """SKETCH bits as longs: a set's shingles fall on the bits by their hash, each bit is the parity of how many did."""
    return np.packbits((np.bincount((tokens >> U(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).astype(bool)).view(np.int64)


def _sign(width: int, parts: int, table, top: int, bottom: int, seed: int) -> Callable:
    """Blocks of (signature, set key) for the pieces, and a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = table.value
        names = ["piece", "block", *_DOCUMENT]
        sigs, keys, n, turn = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            pairs = np.stack((np.concatenate(sigs), np.concatenate(keys)), 1)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))]  # copies of a text sign once
            b = packed(pairs, mix(pairs[:, 0]), parts)
            sigs.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows, t) for t in _DOCUMENT.values())], names)

        for batch in batches:
            data, at = buffers(batch.column("text"))
            rows: list[tuple] = []
            for lo, hi in slices(at):
                sets = list(shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], width))
                every = np.concatenate(sets)
                level = levels[_slot((every >> U(32)).astype(np.uint32), (every % U(parts)).astype(np.uint32), len(levels))]
                a = 0
                for tokens in sets:
                    own = level[a : a + len(tokens)]
                    a += len(tokens)
                    key = set_key(tokens, seed)
                    rows.append((int(key.astype(np.int64)), int(set_key(tokens, seed + 1).astype(np.int64)), len(tokens), int((own == 0).sum()), *sketch(tokens).tolist()))
                    s = _signatures(tokens, own, top, bottom)
                    if len(s):
                        sigs.append(s)
                        keys.append(np.full(len(s), key, U))
                        n += len(s)
                if n >= _FLUSH:
                    yield flush()
                    n = 0
            m = len(rows)
            to = np.arange(turn, turn + m) % (parts * PIECES)
            turn += m
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(list(_DOCUMENT.values())[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.nulls(m, pa.binary()), batch.column("doc_id").cast(pa.int64()), *columns], names)
        if n:
            yield flush()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, key) of the groups of sets with a common signature; document rows pass.

    Groups of the same sets get the same id, a hash of them with the signature's last bit, and come once a partition. A piece of
    more than _FLUSH rows is read in parts: what is kept of one is a row for each signature, however many sets have it,
    and the signature is the group's id.
    """
    names = [*_DOCUMENT, "sig"]
    seen: set[int] = set()

    def many(x: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """(rows to give out, rows to keep) of x: signature, key, 1 if the row is out already."""
        x = x[np.lexsort((U(1) - x[:, 2], x[:, 1], x[:, 0]))]
        x = x[np.concatenate(([True], (x[1:, :2] != x[:-1, :2]).any(1)))]
        at = np.flatnonzero(np.concatenate(([True], x[1:, 0] != x[:-1, 0])))
        n = np.diff(np.append(at, len(x)))
        if whole:
            group = (mix(np.add.reduceat(mix(x[:, 1] + U(1)), at) + n.astype(U)) & ~U(1)) | (x[at, 0] & U(1))
            new = np.zeros(len(at), bool)
            for k in np.flatnonzero(n > 1).tolist():
                g = int(group[k])
                new[k] = g not in seen
                seen.add(g)
            x[:, 0] = np.repeat(group, n)
            return x[np.repeat(new, n)], x[:0]
        out = x[np.repeat(n > 1, n) & (x[:, 2] == 0)]
        x = x[at]
        x[n > 1, 2] = 1
        return out, x

    def found(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(x), 1 << 16):
            p = x[a : a + (1 << 16)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(p[:, 1]) if c == "key" else pa.nulls(len(p), t) for c, t in _DOCUMENT.items()), pa.array(p[:, 0])], names)

    kept, piece, held, n, parts = np.zeros((0, 3), U), None, [], 0, 0
    for batch in batches:
        docs = batch.filter(batch.column("block").is_null())
        if docs.num_rows:
            yield pa.RecordBatch.from_arrays([*(docs.column(c) for c in _DOCUMENT), pa.nulls(docs.num_rows, pa.int64())], names)
        blocks = batch.filter(batch.column("block").is_valid())
        for p, block in zip(blocks.column("piece").to_pylist(), blocks.column("block")):
            if held and (p != piece or n >= _FLUSH):
                out, kept = many(np.concatenate((kept, *held)), p != piece and not parts)
                yield from found(out)
                held, n, parts = [], 0, parts + 1
            if p != piece:
                kept, piece, parts = kept[:0], p, 0
            pairs = np.frombuffer(block.as_buffer(), U).reshape(-1, 2)
            held.append(np.concatenate((pairs, np.zeros((len(pairs), 1), U)), 1))
            n += len(pairs)
    if held:
        yield from found(many(np.concatenate((kept, *held)), not parts)[0])


def _sets(width: int, table, seed: int) -> Callable:
    """(key, set) of the documents whose key is in the bitmap, each key once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = table.value
        for batch in batches:
            data, at = buffers(batch.column("text"))
            seen = set()
            for lo, hi in slices(at):
                sets = list(shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], width))
                keys = np.array([set_key(x, seed) for x in sets], U)
                out = {}
                for i in np.flatnonzero(in_bitmap(wanted, keys) & (keys != 0)):
                    if keys[i] not in seen:
                        seen.add(keys[i])
                        out[keys[i]] = sets[i].tobytes()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(list(out), U).astype(np.int64)), pa.array(list(out.values()), pa.binary())], ["key", "tokens"])

    return run


def _overlaps(top: int, bottom: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate((p, q))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(top * same >= bottom * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def linked(docs: DataFrame, width: int = 5, percent: int = 80, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, classes) of the similarity join of docs (doc_id, text).

    documents: doc_id, key, n, one row for each row of docs; equal sets have equal keys. classes: key,
    label for each key that links with another one; equal labels are one component. Two sets link when
    100 * intersection >= percent * union. Should two different sets have one key, all is done again with another seed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    share = spark.sparkContext.broadcast
    texts = docs.select("doc_id", "text")

    shingles = dealt(texts.select("text").mapInArrow(lean(_counts(width, parts)), "piece long, block binary"), parts)
    frequent = stored(shingles.mapInArrow(lean(_levels), "short long, part int, level byte"), "frequent")
    levels = _level_table(frequent, parts)

    signed = dealt(texts.mapInArrow(lean(_sign(width, parts, share(levels), 100, percent, seed)), f"piece long, block binary, {DOCUMENT}"), parts)
    signed = stored(signed.mapInArrow(lean(_groups), f"{DOCUMENT}, sig long"), "signatures")
    documents = signed.where("sig is null").select("doc_id", "key", "n")
    own = ["n", "rare", *_LONGS]
    size = signed.where("sig is null and n > 0").groupBy("key").agg(*[F.first(c).alias(c) for c in own], F.min("second").alias("lo"), F.max("second").alias("hi"))
    size = stored(size, "sizes")
    if not size.where("lo <> hi").isEmpty():
        discard(frequent, signed, size)
        return linked(docs, width, percent, seed + 2)

    flat = signed.where("sig is not null").select("sig", "key").distinct()
    member = stored(flat.join(size.drop("lo", "hi"), "key").withColumn("often", F.expr("sig & 1")), "members")
    share_of = (F.col("rare") / F.col("n")).alias("share")
    hub = member.groupBy("sig").agg(F.min(F.struct(share_of, "key", *own)).alias("h"))
    star = member.join(hub, "sig").select("often", "key", *own, F.col("h.key").alias("hub"), *[F.col(f"h.{c}").alias(f"hub_{c}") for c in own])

    def near(other: str) -> Column:
        """Whether a set can link with the one in the columns named other + ...: by sizes, rare shingles and sketches."""
        n, m = F.col("n"), F.col(f"{other}n")
        same = F.least(n - F.col("often") * F.col("rare"), m - F.col("often") * F.col(f"{other}rare"))
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(other + c))) for c in _LONGS[1:]), F.bit_count(F.col("s0").bitwiseXOR(F.col(f"{other}s0"))))
        return ((100 + percent) * same >= percent * (n + m)) & ((100 + percent) * (n + m - apart) >= 2 * percent * (n + m))

    pair = F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")
    star = star.where(near("hub_") & (F.col("key") != F.col("hub"))).select(*pair).distinct()
    star, links = _verified(texts, star, width, percent, seed)
    label = components(links)

    member_of = member.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("x", F.coalesce("label", "key")).drop("label")
    apart = member_of.groupBy("sig").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min(F.struct(share_of, "key", "x")).alias("h")).where("lo <> hi").select("sig", F.col("h.x").alias("main"))
    band = F.floor(F.log("n") / (np.log(100 / percent) * (1 + 1e-9))).cast("int")  # sizes that can link are in one band or in neighbours
    near_by = stored(member_of.join(apart, "sig").withColumn("band", band), "apart")
    left = near_by.where("x <> main").select("sig", "often", "x", "key", *own, F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    right = near_by.select("sig", "band", F.col("x").alias("y"), F.col("key").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in own])
    cross = left.join(right, ["sig", "band"]).where((F.col("x") != F.col("y")) & near("hub_"))
    cross, more = _verified(texts, cross.select(*pair).distinct().join(star, ["a", "b"], "left_anti"), width, percent, seed)
    if not more.isEmpty():
        label = components(links.union(more))
    discard(frequent, size, member, near_by, star, cross, links, more)
    return documents, label.toDF("key", "label")


def _verified(texts: DataFrame, pairs: DataFrame, width: int, percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b) of keys, written down, and those of them whose sets are similar enough."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    table = texts.sparkSession.sparkContext.broadcast(bitmap(ends, bits_for(2 * pairs.count())))
    sets = texts.select("text").mapInArrow(lean(_sets(width, table, seed)), "key long, tokens binary").dropDuplicates(["key"])
    sets = stored(sets.join(ends, "key", "left_semi"), "sets")
    x = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    links = stored(x.select("a", "b", "x", "y").mapInArrow(lean(_overlaps(100, percent)), "a long, b long"), "links")
    discard(sets)
    return pairs, links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs: its class under the similarity join."""
    documents, classes = linked(docs, width, percent)
    key = F.coalesce("label", "key")
    own = documents.join(classes, "key", "left").select("doc_id", "n", F.when(F.col("n") > 0, key).alias("class"))
    least = own.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    return own.join(least, "class", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def kept(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each class stays: the one of the smallest doc_id.

    Rows without words and rows with a null doc_id stay; of rows with the same smallest doc_id all stay.
    """
    gone = near_duplicates(docs, width, percent).where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(stored(gone, "copies"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
