"""Main-text extraction by equivalence-class template deduction.

The tokens of a page are its tags with their path and class, opening and closing, and its text blocks. Pages of a host
with the same own blocks are copies and count as one page. Over these pages each token has an occurrence vector: how
often it occurs on every page. Tokens with equal vectors form an equivalence class; two independent sums of page hashes
stand for a vector, so that classes come from plain aggregates and no host is ever gathered. Tokens that leave the order
of their class on some page leave the class. A class is valid if it has MIN_CLASS tokens, tags included, on enough
pages, and nests: each two classes lie apart, or all occurrences of the one lie in the same slot of the other; of
two that don't, the one on fewer pages goes. Valid classes are the host's template: their text blocks are boilerplate,
and the slots they leave are the page's own. Of these, slots within navigation, headers, footers, asides, forms,
notices, adverts, scripts, styles and comments go; if the page has an article or main element with text, only slots
within it stay; if not, slots of links go. Copies that differ in an own block count as pages of their own.

White space inside a block becomes one space, blocks are trimmed and joined by a newline; nothing else is dropped.
Null html is empty and gives empty text; a null or odd url is a host of its own name; hosts with fewer than
MIN_PAGES pages that are no copies have no template. Rows with null or repeated page_id are kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import small_batches, stored

MIN_PAGES = 3
SUPPORT = 0.3  # least share of a host's pages that hold a template token
INNER = 0.8  # the same for a text block within an article, which copies of a page repeat too
MIN_CLASS = 3  # tokens of a valid class

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_END = re.compile(r"[>\"']")
_ASSIGNED = re.compile(r"=\s*\Z")
_RAW = {name: re.compile(rf"</{name}(?=[\s>/])[^>]*>?", re.I) for name in "script style noscript template textarea select svg iframe object".split()}
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BOILERPLATE = frozenset("head nav footer aside form button menu dialog title".split())
#: Words by which pages name what is not their article, and such that say nothing beside these. Fixed values.
_WORDS = frozenset(
    "ad ads advert adverts advertisement adbox banner promo sponsor sponsored menu nav navbar navigation sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended breadcrumb breadcrumbs comment comments commentlist disqus respond replies reply login signup widget toolbar pager pagination complementary contentinfo".split()
)
_OUTSIDE = frozenset("search copyright legal disclaimer alert".split())  # not within an article, where they name its parts
_NEUTRAL = frozenset("box list area container wrapper section block item bar site page main top bottom left right primary secondary slot unit links form inner text panel holder header row col group thread 0 1 2 3 4 5 6 7 8 9".split())
_PARTS = re.compile(r"[_-]+")
_PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figcaption".split())


@lru_cache(1 << 14)
def boilerplate_name(names: str, within: bool) -> bool:
    """Whether a class, id or role names boilerplate: one of its names consists of such words and of ones that say nothing."""
    bad = _WORDS if within else _WORDS | _OUTSIDE
    for name in names.lower().split():
        parts = [x for x in _PARTS.split(name) if x]
        if any(x in bad for x in parts) and all(x in bad or x in _NEUTRAL for x in parts):
            return True
    return False


_SPACE = re.compile(r"\s+")


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def scan(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """(name, closing, attributes) of the tags of a page and (None, False, text) between them, in one pass.

    Comments, declarations and elements without prose go. A > within a quoted value ends no tag; a quote that is
    never closed is a character like others.
    """
    at, lost = 0, set()  # lost: quotes that do not occur any more
    while m := _TAG.search(page, at):
        if m.start() > at:
            yield None, False, page[at : m.start()]
        comment, other, closing, name = m.groups()
        if comment or other:
            mark = "-->" if comment else ">"
            end = page.find(mark, m.end())
            at = len(page) if end < 0 else end + len(mark)
            continue
        end = m.end()
        while (q := _END.search(page, end)) and q.group() != ">":
            end = q.end()
            if q.group() not in lost and _ASSIGNED.search(page, max(m.end(), q.start() - 8), q.start()):
                close = page.find(q.group(), end)
                if close < 0:
                    lost.add(q.group())
                else:
                    end = close + 1
        at = q.end() if q else len(page)
        name = name.lower()
        if not closing and name in _RAW and not page[m.end() : at].rstrip(">").endswith("/"):
            raw = _RAW[name].search(page, at)
            at = raw.end() if raw else len(page)
            continue
        yield name, bool(closing), page[m.end() : at].rstrip(">")
    if at < len(page):
        yield None, False, page[at:]


def blocks(page: str) -> tuple[list[tuple[str, str, bool, bool, bool]], list[str | int]]:
    """(blocks, order) of a page. A block: text, path, within boilerplate, within article or main, a list or box of links alone.

    order: the page's tags, closing ones with >, and the places of its blocks between them.
    """
    out: list[tuple[str, str, bool, bool, bool]] = []
    order: list[str | int] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, path, boilerplate, article
    text: list[str] = []
    linked: list[bool] = []
    links = 0

    def flush() -> None:
        if text:
            block = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if block:
                _, path, bad, good = stack[-1] if stack else ("", "", False, False)
                order.append(len(out))
                out.append((block, path, bad, good, all(linked) and (stack[-1][0] if stack else "") not in _PROSE))
            text.clear()
            linked.clear()

    for name, closing, rest in scan(page):
        if name is None:
            text.append(rest)
            if not rest.isspace():
                linked.append(links > 0)
            continue
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        if name in _INLINE:
            if name == "br":
                text.append(" ")
            continue
        flush()
        if closing:
            closed = name
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    closed = stack[k][1]
                    del stack[k:]
                    break
            links = 0 if name in ("article", "body", "nav") else links
            order.append(">" + closed)
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack:
            like = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
            if stack[-1][0] in like or name == "p" and stack[-1][0] == "p":
                stack.pop()
        elif stack and stack[-1][0] == "p":
            stack.pop()  # a block closes an open paragraph
        own = " ".join(a or b or c for a, b, c in _NAMES.findall(rest or ""))
        path = (stack[-1][1] if stack else "") + "/" + name + ("." + own if own else "")
        above, within = (stack[-1][2], stack[-1][3]) if stack else (False, False)
        within = within or name in ("article", "main") or "articlebody" in own.lower() or own.lower() == "main"
        bad = above or name in _BOILERPLATE or (name == "header" and not within) or (name not in ("html", "body", "article", "main") and boilerplate_name(own, within))
        order.append(path)
        if name not in _VOID and not (rest or "").endswith("/"):
            stack.append((name, path, bad, within))
    flush()
    return out, order


def _hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def _tag_hash(tag: str) -> int:
    return _hash(tag)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, draw, tokens, kinds) of every page in page order; copies have equal draws."""
    for batch in batches:
        draws, sequences, types = [], [], []
        for page in batch.column("html").to_pylist():
            texts, order = blocks(page or "")
            own = sorted({t[0] for t in texts if not t[2]})
            draws.append(_hash("\0".join(own)) & (1 << 60) - 1)
            sequences.append(np.array([_tag_hash(t) if isinstance(t, str) else _hash(texts[t][1] + "\0" + texts[t][0]) for t in order], np.int64).tobytes())
            types.append(bytes(0 if isinstance(t, str) else 1 + texts[t][3] for t in order))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(draws, pa.int64()), pa.array(sequences, pa.binary()), pa.array(types, pa.binary())], ["host", "draw", "tokens", "kinds"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, kind, pages, two sums of page hashes, least draw, first place on its page), summed in the batch."""
    for batch in batches:
        found: dict[tuple[str, int, int], list[int]] = {}  # kind: 0 a tag, 1 a text block, 2 one within an article
        for name, draw, tokens, kinds in zip(*(batch.column(c).to_pylist() for c in ("host", "draw", "tokens", "kinds"))):
            counts: dict[tuple[int, int], list[int]] = {}
            for place, k in enumerate(zip(np.frombuffer(tokens, np.int64).tolist(), kinds)):
                counts.setdefault(k, [0, place])[0] += 1
            one, two = draw & 0x3FFFFFFF, (draw >> 30) & 0x3FFFFFFF
            for (token, kind), (n, place) in counts.items():
                s = found.setdefault((name, token, kind), [0, 0, 0, draw, place])
                s[0] += 1
                s[1] += n * one
                s[2] += n * two
                if draw < s[3]:
                    s[3:] = draw, place
        if found:
            keys, sums = list(zip(*found)), np.array(list(found.values()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int8()), *(pa.array(sums[:, k]) for k in range(5))], ["host", "token", "kind", "pages", "one", "two", "draw", "place"])


def _ranked(members: list[dict]) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """token: (class, place in it), and the classes' sizes, of a host's sorted members; classes of more pages come first."""
    of: dict[int, tuple[int, int]] = {}
    sizes: list[int] = []
    last = None
    for m in members:
        key = (m["p"], m["size"], m["one"], m["two"])
        if key != last:
            sizes.append(0)
            last = key
        of[m["token"]] = (len(sizes) - 1, sizes[-1])
        sizes[-1] += 1
    return of, sizes


def disordered(tokens: list[int], of: dict[int, tuple[int, int]], sizes: list[int]) -> set[int]:
    """The tokens outside a longest run of each class's occurrences in the class's order."""
    seen: dict[int, int] = {}
    by: dict[int, list[tuple[int, int]]] = {}
    for t in tokens:
        if t in of:
            c, rank = of[t]
            seen[t] = seen.get(t, 0) + 1
            by.setdefault(c, []).append((seen[t] * sizes[c] + rank, t))
    out: set[int] = set()
    for found in by.values():
        keys = [k for k, _ in found]
        if all(a < b for a, b in zip(keys, keys[1:])):
            continue
        tails: list[int] = []
        ends: list[int] = []
        before = []
        for i, k in enumerate(keys):
            j = bisect_left(tails, k)
            before.append(ends[j - 1] if j else -1)
            tails[j : j + 1] = [k]
            ends[j : j + 1] = [i]
        kept, i = set(), ends[-1]
        while i >= 0:
            kept.add(i)
            i = before[i]
        out |= {t for i, (_, t) in enumerate(found) if i not in kept}
    return out


def nesting(tokens: list[int], of: dict[int, tuple[int, int]], sizes: list[int]) -> dict[tuple[int, int], list[int]]:
    """(class, class around it): occurrences within it, least and last slot, whether they cross; (class, -1): all occurrences."""
    out: dict[tuple[int, int], list[int]] = {}
    opened: list[list[int]] = []  # class, place of its last token
    for t in tokens:
        if t not in of:
            continue
        c, rank = of[t]
        if rank == 0:
            out.setdefault((c, -1), [0, 0, 0, 0])[0] += 1
            for x, slot in opened:
                s = out.setdefault((c, x), [0, slot, slot, 0])
                s[0] += 1
                s[1], s[2] = min(s[1], slot), max(s[2], slot)
            opened.append([c, 0])
            continue
        at = next((k for k in range(len(opened) - 1, -1, -1) if opened[k] == [c, rank - 1]), None)
        if at is None:
            out.setdefault((c, c), [0, 0, 0, 0])[3] = 1
            continue
        for x, slot in opened[at + 1 :]:
            out.setdefault((x, c), [0, slot, slot, 0])[3] = 1
        opened[at][1] = rank
        if rank == sizes[c] - 1:
            del opened[at]
    return out


def _disordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token) of the tokens that leave the order of their class."""
    last: tuple = (None, ({}, []))
    for batch in batches:
        found: set[tuple[str, int]] = set()
        for name, tokens, members in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), batch.column("members")):
            if last[0] != name:
                last = (name, _ranked(members.as_py()))
            found |= {(name, t) for t in disordered(np.frombuffer(tokens, np.int64).tolist(), *last[1])}
        if found:
            names, tokens = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(tokens, pa.int64())], ["host", "token"])


def _nesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, class, around, n, least, most, crosses), summed in the batch."""
    last: tuple = (None, ({}, []))
    for batch in batches:
        found: dict[tuple[str, int, int], list[int]] = {}
        for name, tokens, members in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), batch.column("members")):
            if last[0] != name:
                last = (name, _ranked(members.as_py()))
            for (c, x), (n, lo, hi, cross) in nesting(np.frombuffer(tokens, np.int64).tolist(), *last[1]).items():
                s = found.setdefault((name, c, x), [0, lo, hi, 0])
                s[:] = s[0] + n, min(s[1], lo), max(s[2], hi), s[3] | cross
        if found:
            keys, sums = list(zip(*found)), np.array(list(found.values()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), *(pa.array(keys[k], pa.int32()) for k in (1, 2)), *(pa.array(sums[:, k]) for k in range(4))], ["host", "class", "around", "n", "least", "most", "crosses"])


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, boilerplate: text blocks of the classes that do not clash with a valid class of a lower number."""
    for batch in batches:
        out = []
        for members, clashes in zip(batch.column("members"), batch.column("clashes")):
            members = members.as_py()
            of, _ = _ranked(members)
            lost: set[int] = set()
            for high, low in sorted((max(x["class"], x["around"]), min(x["class"], x["around"])) for x in clashes.as_py() or ()):
                if low == high or low not in lost:
                    lost.add(high)
            out.append(sorted({m["token"] for m in members if m["kind"] > 0 and of[m["token"]][0] not in lost}))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(pa.int64()))], ["host", "boilerplate"])


def _members(tokens: DataFrame) -> DataFrame:
    """host, members: the tokens (host, token, kind, pages, one, two, draw, place) of classes of MIN_CLASS tokens, in order."""
    classes = tokens.groupBy("host", "one", "two").agg(F.count("*").alias("size"), F.max("pages").alias("p")).where(F.col("size") >= MIN_CLASS)
    of = tokens.join(classes, ["host", "one", "two"])
    return of.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("p"), (-F.col("size")).alias("size"), "one", "two", "place", "token", "kind"))).alias("members"))


def templates(pages: DataFrame) -> DataFrame:
    """host, boilerplate: hashes of the text blocks in valid equivalence classes of each host's pages (host, html)."""
    read = pages.select("host", "html").mapInArrow(_sequences, "host string, draw long, tokens binary, kinds binary")
    rows = stored(read.groupBy("host", "draw").agg(F.min(F.struct("tokens", "kinds")).alias("x")).select("host", "draw", "x.tokens", "x.kinds"), "sequences")
    found = rows.mapInArrow(_tokens, "host string, token long, kind byte, pages long, one long, two long, draw long, place long")
    found = found.groupBy("host", "token", "kind").agg(F.sum("pages").alias("pages"), F.sum("one").alias("one"), F.sum("two").alias("two"), F.min(F.struct("draw", "place")).alias("x"))
    found = found.select("host", "token", "kind", "pages", "one", "two", "x.draw", "x.place")
    n = rows.groupBy("host").agg(F.count("*").alias("n"))
    often = found.where(F.col("pages") >= MIN_PAGES).join(n, "host").where(F.col("pages") >= F.when(F.col("kind") == 2, INNER).otherwise(SUPPORT) * F.col("n"))
    often = stored(often.drop("n"), "tokens")
    first = stored(_members(often), "members")
    out = rows.join(first, "host").select("host", "tokens", "members").mapInArrow(_disordered, "host string, token long").distinct()
    members = stored(_members(often.join(stored(out, "disordered"), ["host", "token"], "left_anti")), "members")
    nests = rows.join(members, "host").select("host", "tokens", "members").mapInArrow(_nesting, "host string, class int, around int, n long, least long, most long, crosses long")
    nests = stored(nests.groupBy("host", "class", "around").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("crosses").alias("crosses")), "nests")
    total = nests.where("around = -1").select("host", "class", F.col("n").alias("total"))
    clash = nests.where("around <> -1").join(total, ["host", "class"]).where("crosses > 0 or least <> most or n < total")
    clash = clash.groupBy("host").agg(F.collect_set(F.struct("class", "around")).alias("clashes"))
    return members.join(clash, "host", "left").select("host", "members", "clashes").mapInArrow(_valid, "host string, boilerplate array<long>")


def main_text(page: str, boilerplate: set[int]) -> str:
    """The page's own slots, joined by newlines."""
    texts, _ = blocks(page)
    own = [b for b in texts if not b[2] and (not boilerplate or _hash(b[1] + "\0" + b[0]) not in boilerplate)]
    body = [b for b in own if b[3]]
    return "\n".join(b[0] for b in (body or [b for b in own if not b[4]]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = ("", frozenset())
    for batch in batches:
        out = []
        for name, page, known in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("boilerplate")):
            if last[0] != name:
                last = (name, frozenset(known.as_py() or ()))
            out.append(main_text(page or "", last[1]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), "html")
    known = stored(templates(rows), "templates")
    return rows.join(known, "host", "left").select("page_id", "url", "host", "html", "boilerplate").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
