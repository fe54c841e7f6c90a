"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Words of documents and benchmark items become templates: a word with a digit is `0`, a capitalised
word inside a sentence `@`, a unit after a number `%`; other words are lower-cased and lose their marks.
Windows are hash-joined, those at every place of an item with those at every STRIDE-th place of a document: windows of
WINDOW plain words, so that WINDOW + STRIDE - 1 equal words in a row always meet, whatever their case and however many of
them are slots; and windows of template words, each drawn out from WINDOW words until it holds MIN_LITERALS words that
are no slots. Each hit gives a diagonal on which the whole item is laid over the document: template words must agree, and
the slots' values must map one to one, so that a question with other numbers or names is found and a mere likeness of
form, in which equal values meet different ones, is not, unless nearly all words are the item's own. Matches in runs of
RUN words on diagonals less than an item's length apart are added up, each word of the item and of the document once,
so that words put in or left out do not hide an item.

Result: a row for each document and item whose aligned share reaches `least`. An item of fewer words than always
meet is matched by a window of its own length at every place, from MIN_WORDS words on; shorter ones never match.
Null text matches nothing. Rows with a null doc_id are never reported; rows that share a doc_id are judged
together. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import stored

WINDOW = 5
STRIDE = 4
MIN_WORDS = 5
MIN_LITERALS = 3  # words of a template window that are no slots
RUN = 3  # matching words in a row that count when diagonals are added up
VERBATIM = 0.9  # from this share of equal words on, a single changed slot does not acquit
BROADCAST_ROWS = 1_000_000  # of at most 60 bytes; more rows are joined by shuffling
UNITS = "mm|cm|m|km|mg|g|kg|t|ml|l|s|ms|min|h|hz|khz|mhz|ghz|w|kw|v|a|j|kj|n|pa|k|c|f|mph|kph|km/h|m/s|%|usd|eur|gbp|dollars?|euros?|pounds?|cents?|metres?|meters?|kilometres?|kilometers?|miles?|feet|foot|inch(?:es)?|grams?|kilograms?|kilos?|litres?|liters?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|percent"
SPACE = "\t\n\x0b\x0c\r"
MARKS = ".,;:!?\"'()[]{}<>*_`~^\\/|-"


def plain(text: Column) -> Column:
    """The text in lower case, without marks, with spaces for all white space."""
    return F.translate(F.lower(text), SPACE + MARKS, " " * len(SPACE))


def split_words(text: Column) -> Column:
    """The words of a plain text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")


def template(text: Column) -> Column:
    """The plain text with typed placeholders; it has as many words as the plain text."""
    t = F.regexp_replace(text, r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})\p{L}*+(?=[\s,;.!?]|$)", "@")
    t = plain(t)
    numbers = F.regexp_replace(t, r"[^ 0-9]*+[0-9][^ ]*+", "0")
    units = F.regexp_replace(numbers, rf"(?<=(?<![^ ])0 )(?:{UNITS})(?![^ ])", "%")
    return F.when(text.rlike("[0-9]"), units).otherwise(t)


def _windows(rows: DataFrame, key: str, width: int, stride: int = 1) -> DataFrame:
    """key, at, hash of the windows of rows (key, raw, words): plain ones of width words, and template ones drawn out to MIN_LITERALS literals."""
    rows = rows.where(F.size("words") >= width).withColumn("literal", F.expr("filter(sequence(1, size(words)), i -> element_at(words, i) not in ('0', '@', '%'))"))
    plain_ones = f"transform(sequence(1, size(raw) - {width} + 1, {stride}), i -> struct(i as at, xxhash64('', slice(raw, i, {width})) as hash))"
    # the places whose next literal is the one at p: from behind the literal before it, at every stride-th place
    first = f"if(r = 0, 1, element_at(literal, greatest(r, 1)) + 1 + pmod(-element_at(literal, greatest(r, 1)), {stride}))"
    last = f"least(p, size(words) - {width} + 1)"
    window = f"i -> struct(i as at, xxhash64(slice(words, i, greatest({width}, element_at(literal, r + {MIN_LITERALS}) - i + 1))) as hash)"
    template_ones = f"flatten(transform(slice(literal, 1, greatest(0, size(literal) - {MIN_LITERALS - 1})), (p, r) -> if({first} > {last}, array(), transform(sequence({first}, {last}, {stride}), {window}))))"
    return rows.select(key, F.explode(F.expr(f"concat({plain_ones}, {template_ones})")).alias("x")).select(key, F.col("x.at").alias("at"), F.col("x.hash").alias("hash"))


def _hits(texts: DataFrame, items: DataFrame, width: int, stride: int) -> DataFrame:
    """doc_id, item_id, shift of the windows of one width that texts and items share."""
    of_items = stored(_windows(items, "item_id", width).withColumnRenamed("at", "item_at"), "windows")
    own = _windows(texts, "doc_id", width, stride)
    if of_items.count() <= BROADCAST_ROWS:
        of_items = F.broadcast(of_items)
    return own.join(of_items, "hash").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))


def _added(laid: DataFrame) -> DataFrame:
    """doc_id, item_id, n_words, same: the matches of neighbouring diagonals of laid (doc_id, item_id, copy, shift, n_words, same).

    Rows that share an id are told apart by copy, the hash of both texts, and count once if they are equal.
    Of the matches of an item's word the one in the longest run stays, then of those of a document's word likewise.
    """
    laid = laid.dropDuplicates(["doc_id", "item_id", "copy", "shift"])
    w = Window.partitionBy("doc_id", "item_id", "copy").orderBy("shift")
    apart = F.coalesce((F.col("shift") - F.lag("shift").over(w) >= F.col("n_words")).cast("int"), F.lit(0))
    groups = laid.withColumn("apart", apart).withColumn("part", F.sum("apart").over(w))
    several = groups.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "item_id", "copy", "part"))).where("n > 1")
    keys = ["doc_id", "item_id", "copy", "part", "n_words"]
    runs = F.expr("transform(same, (x, k) -> struct(x.pos as pos, x.pos - k as run, x as x))")
    one = several.select(*keys, "shift", F.explode(runs).alias("m")).select(*keys, "shift", "m.run", F.col("m.x").alias("x"))
    length = F.count("*").over(Window.partitionBy(*keys, "shift", "run"))
    one = one.withColumn("length", length).where(F.col("length") >= RUN).withColumn("at", F.col("x.pos") + F.col("shift"))
    best = F.max(F.struct("length", -F.col("shift"), "at", "x")).alias("b")
    one = one.groupBy(*keys, F.col("x.pos").alias("pos")).agg(best).select(*keys, "b.length", "b.at", "b.x")
    one = one.groupBy(*keys, "at").agg(F.max(F.struct("length", "x")).alias("b")).select(*keys, "b.x")
    return one.groupBy(*keys).agg(F.collect_list("x").alias("same")).select("doc_id", "item_id", "n_words", "same")


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, stride: int = STRIDE, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, n_words, n_matched, score, n_slots, exact: the items that documents hold.

    docs: doc_id, text. items: item_id, text. score is the share of the item's words that agree on the best
    diagonal or on neighbouring ones; exact tells whether all words agree on one diagonal without placeholders.
    """
    tests = items.where(F.col("item_id").isNotNull()).select("item_id", split_words(plain(F.col("text"))).alias("raw"), split_words(template(F.col("text"))).alias("words"))
    tests = stored(tests.where(F.size("words") >= MIN_WORDS), "items")
    meets = window + stride - 1
    widths = sorted(r[0] for r in tests.select(F.least(F.size("words"), F.lit(meets))).distinct().collect())  # at most `meets` numbers
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", split_words(plain(F.col("text"))).alias("raw"), split_words(template(F.col("text"))).alias("words"))
    hits = None
    for width in widths:
        own = tests.where(F.least(F.size("words"), F.lit(meets)) == width)
        found = _hits(texts, own, window, stride) if width == meets else _hits(texts, own, width, 1)
        hits = found if hits is None else hits.union(found)
    schema = "doc_id long, item_id long, n_words int, n_matched int, score double, n_slots int, exact boolean"
    if hits is None:
        return docs.sparkSession.createDataFrame([], schema)
    hits = stored(hits.distinct(), "hits")

    ids = hits.select("doc_id").distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    suspects = docs.join(ids, "doc_id", "left_semi").select("doc_id", split_words(plain(F.col("text"))).alias("doc_raw"), split_words(template(F.col("text"))).alias("doc_words"))
    laid = hits.join(suspects, "doc_id").join(tests, "item_id")
    at = F.greatest(F.col("shift"), F.lit(0))
    skip = F.greatest(-F.col("shift"), F.lit(0))
    laid = laid.select(
        "doc_id", "item_id", F.xxhash64("doc_words", "doc_raw", "words", "raw").alias("copy"), "shift", skip.alias("skip"), F.size("words").alias("n_words"),
        F.slice("doc_words", at + 1, F.size("words") - skip).alias("dw"), F.slice("doc_raw", at + 1, F.size("words") - skip).alias("dr"),
        F.slice("words", skip + 1, F.size("words")).alias("iw"), F.slice("raw", skip + 1, F.size("words")).alias("ir"),
    )
    both = F.expr("filter(transform(arrays_zip(dw, iw, dr, ir), (x, k) -> struct(skip + k as pos, x.dw as dw, x.iw as iw, x.dr as dr, x.ir as ir)), x -> x.dw = x.iw or x.dr = x.ir)")
    laid = stored(laid.select("doc_id", "item_id", "copy", "shift", "n_words", both.alias("same")), "laid")
    one = laid.select("doc_id", "item_id", "n_words", "same", F.lit(True).alias("one"))
    laid = one.union(_added(laid).withColumn("one", F.lit(False)))
    slot = F.expr("array_distinct(transform(filter(same, x -> x.dw = x.iw and x.iw in ('0', '@', '%')), x -> struct(x.iw as kind, x.ir as item, x.dr as doc)))")
    laid = laid.select("doc_id", "item_id", "n_words", F.size("same").alias("n_matched"), slot.alias("slots"), F.expr("size(filter(same, x -> x.ir = x.dr)) / n_words").alias("verbatim"), F.expr("one and size(same) = n_words and forall(same, x -> x.ir = x.dr)").alias("exact"))
    one_to_one = F.expr("size(slots) = size(array_distinct(transform(slots, x -> struct(x.kind, x.item)))) and size(slots) = size(array_distinct(transform(slots, x -> struct(x.kind, x.doc))))")
    score = F.col("n_matched") / F.col("n_words")
    found = laid.where((one_to_one & (score >= least)) | (F.col("verbatim") >= VERBATIM))
    best = F.max(F.struct(score.alias("score"), "n_matched", "exact", F.size("slots").alias("n_slots"), "n_words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_words", "b.n_matched", "b.score", "b.n_slots", "b.exact")


def kept(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that hold no item; rows with a null doc_id stay."""
    found = stored(leaks(docs, items, least=least).select("doc_id").distinct(), "leaks")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
