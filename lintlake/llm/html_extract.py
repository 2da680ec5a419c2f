"""Operator 1, HTML extraction by differencing pages with the nearest URL of their host."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Pages in a bucket of neighbouring URLs, about, and buckets at most: what the driver holds and broadcasts is bounded by them.
PAGES, BUCKETS = 1000, 8192
#: A partner is a copy if its unshared text has more of the page's unshared three-word runs than this; nothing is learned from it.
COPY = 0.2

#: Comments, declarations, tags, and tags whose quotes don't close, which end at the next bracket.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""", re.DOTALL
)
_CUES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)

#: Elements whose content isn't even markup, up to their end tag.
RAW = frozenset("script style textarea iframe".split())
#: Elements inside a paragraph whose content is no text of it.
SILENT = frozenset("noscript template object svg math canvas audio video map select datalist".split()) | RAW
#: Elements that are never the article: menus, footers, sidebars, forms, notices, the head.
OUTSIDE = frozenset("head nav footer aside form button dialog menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role that say that an element is a menu, header, footer, sidebar, notice, advert, form or reader comment.
CUES = frozenset(
    "nav navbar navigation menu header banner footer contentinfo sidebar aside complementary notice cookie cookies consent ad ads advert adverts "
    "advertisement advertisements sponsor sponsored promo newsletter form search comment comments commentlist respond".split()
)
#: Whole class words that say so of an element inside a paragraph.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't start a block of their own.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small "
    "span strike strong sub sup td th time tt u var wbr".split()
)


def _outside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of the article, by its name and attributes.

    Words of class, id or role count by their parts (``site-nav``), but for elements inside a paragraph, where
    they tell of what a word is rather than of a place: only a whole word for adverts counts there. An article's
    headings and headers are its own.
    """
    if name in OUTSIDE or name in SILENT or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    if not (in_article and name in HEADINGS):
        for m in _CUES.finditer(attributes):
            given = (m[1] or m[2] or m[3] or "").lower()
            found = set(given.split()) & ADVERTS if name in INLINE else set(re.split(r"[^a-z0-9]+", given)) & CUES
            if found - ({"header"} if in_article else set()):
                return True
    return bool(_HIDDEN.search(attributes))


class _Reader:
    """Text lines and what the markup says of them, from tags and texts in order. Every tag costs the same, however deep."""

    def __init__(self) -> None:
        self.out: list[tuple[str, int]] = []
        self.buffer: list[str] = []
        self.outside = self.article = self.silent = False
        self.stack: list[tuple[str, bool, bool, bool]] = []  # name, and the three states before it
        self.places: dict[str, list[int]] = {}  # of each name in the stack

    def text(self, text: str) -> None:
        if not self.silent:
            self.buffer.append(text)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(html.unescape("".join(self.buffer)).split())
            if text:
                self.out.append((text, 0 if self.outside else 2 if self.article else 1))
            self.buffer.clear()

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, self.outside, self.article, self.silent))

    def pop(self, name: str) -> bool:
        """Closes the innermost element of that name and all in it; not if there is none."""
        at = self.places.get(name)
        if not at:
            return False
        for closed, *_ in reversed(self.stack[at[-1] :]):
            depth = self.places[closed].pop()
        _, self.outside, self.article, self.silent = self.stack[depth]
        del self.stack[depth:]
        return True

    def start(self, name: str, attributes: str) -> None:
        if name in INLINE or name in SILENT:
            if name in ("br", "td", "th", "img"):
                self.text(" ")
            if name not in VOID and (self.silent or _outside(name, attributes, self.article)):
                self.push(name)
                self.silent = True
            return
        self.flush()
        if name not in VOID:
            self.push(name)
            self.outside = self.outside or _outside(name, attributes, self.article)
            self.article = self.article or (name in ("article", "main") and not self.outside)

    def end(self, name: str) -> None:
        if name in INLINE or name in SILENT:
            self.pop(name)  # others aren't in the stack
        elif name in self.places and self.places[name]:
            self.flush()
            self.pop(name)


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The page's text lines in order, one for each block, white space folded, character references decoded.

    Each with what the markup says: 2, it stands in an article or main element; 0, it is a menu,
    header, footer, sidebar, notice, advert, form or comment; 1, nothing is known. Tags without an end
    are closed by the end of an element around them, scripts and the like too. An advert inside a paragraph goes
    and leaves the paragraph whole.
    """
    page = page or ""
    reader = _Reader()
    at, end = 0, len(page)
    unclosed: set[str] = set()
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            reader.text(page[at:])
            break
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        name = (name or "").lower()
        if not name:
            continue
        if slash:
            reader.end(name)
        elif name in SILENT and attributes.endswith("/"):
            continue
        elif name in RAW and name not in unclosed:
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if close:
                at = close.end()
                reader.text(" ")
            else:
                unclosed.add(name)  # none further on either
                reader.start(name, attributes)
        else:
            reader.start(name, attributes)
    reader.flush()
    return reader.out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski 1977).

    Runs of equal lines count as one line, so that pages of one repeated line stay cheap.
    """
    one = [i for i in range(len(a)) if i == 0 or a[i] != a[i - 1]]
    two = [b[i] for i in range(len(b)) if i == 0 or b[i] != b[i - 1]]
    places: dict[str, list[int]] = {}
    for j, line in enumerate(two):
        places.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in one:
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    found, link = set(), links[-1] if links else None
    while link is not None:
        i, link = link
        found.add(i)
    for i in sorted(found):  # the rest of each run
        k = i + 1
        while k < len(a) and a[k] == a[i]:
            found.add(k)
            k += 1
    return found


def _runs(lines: list[str]) -> set[tuple[str, ...]]:
    words = " ".join(lines).split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def shared_lines(lines: list[tuple[str, int]], partner: list[tuple[str, int]] | None) -> set[int] | None:
    """Places of lines that the partner page has too, by longest common subsequence. None: no partner, or a copy.

    A copy has nothing of its own besides what is shared, or what it has is much the same: an edited
    copy. What a page shares with its copy is its story, not boilerplate.
    """
    if not partner:
        return None
    a, b = [t for t, _ in lines], [t for t, _ in partner]
    found = common_lines(a, b)
    if not found:
        return found
    own = _runs([a[i] for i in range(len(a)) if i not in found and lines[i][1]])
    if not own:
        return None
    both = {a[i] for i in found}
    theirs = _runs([t for t in b if t not in both])
    return None if len(own & theirs) > COPY * len(own) else found


def main_text(lines: list[tuple[str, int]], *partners: list[tuple[str, int]] | None) -> tuple[str, int]:
    """The article, and how many lines go because a partner page has them. The nearest partner comes first.

    A shared line is boilerplate and goes, whatever its markup, but in an article or main element. There
    a neighbour may by chance have the same short line, so a shared line goes only in a run of lines at
    the article's start or end that both neighbours have. Besides, lines that the markup calls menus and
    the like go; and if the page has an article, what stands outside of it, shared or not, since adverts
    and menus often differ from page to page.
    """
    found = [shared_lines(lines, p) for p in partners]
    learned = [f for f in found if f is not None]
    gone = set(i for i in (learned[0] if learned else ()) if lines[i][1] < 2)
    inside = [i for i, (_, kind) in enumerate(lines) if kind == 2]
    if len(learned) == 2:
        both = learned[0] & learned[1]
        for order in (inside, inside[::-1]):
            for i in order:
                if i not in both:
                    break
                gone.add(i)
    kept = [t for i, (t, kind) in enumerate(lines) if i not in gone and (kind == 2 or (kind == 1 and not inside))]
    return "\n".join(kept), len(gone)


def _ahead(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


RESULT = StructType([
    StructField("page_id", LongType()), StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType()),
    StructField("pair_page_id", LongType()), StructField("n_shared", LongType()),
])


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages in the order of bucket, host and path; each meets the neighbours of its host, the one with the nearest path first."""

    def rows():
        """Each row once, with how often it stands there: repeated rows are one page to their neighbours."""
        last, times = None, 0
        for batch in batches:
            for row in zip(*[batch[c] for c in ("__id", "url", "html", "__host", "__path", "__to", "__own")], strict=True):
                if row == last:
                    times += 1
                    continue
                if last is not None:
                    yield opened(last), times
                last, times = row, 1
        if last is not None:
            yield opened(last), times

    def opened(row):
        page_id, url, page, host, path, to, own = row
        return (None if page_id is None else int(page_id)), url, lines_of(page), host, path, to, own

    def judged(before, now, after):
        near = [x for x in (after, before) if x is not None and now[3] and x[3] == now[3] and x[5] == now[5]]
        near.sort(key=lambda x: -_ahead(x[4], now[4]))
        text, n = main_text(now[2], *[x[2] for x in near])
        return now[0], now[1], text, len(text), near[0][0] if near else None, n

    def results():
        before, now, times = None, None, 0
        for after, n in rows():
            if now is not None and now[6]:
                yield from repeat(judged(before, now, after), times)
            before, now, times = now, after, n
        if now is not None and now[6]:
            yield from repeat(judged(before, now, None), times)

    def frame(part):
        exact = {"page_id", "pair_page_id"}  # may hold nulls, and ids that a double can't
        return pd.DataFrame({c: pd.array(x, dtype="Int64") if c in exact else list(x) for c, x in zip(RESULT.names, zip(*part, strict=True), strict=True)})

    part, size = [], 0
    for x in results():
        part.append(x)
        size += len(x[2])
        if size > 8_000_000:
            yield frame(part)
            part, size = [], 0
    if part:
        yield frame(part)


#: The place of a null id, before all others.
NULL_ID = -(1 << 63)


def _buckets(keys: DataFrame):
    """A function from (host, path, id) to buckets of neighbouring URLs, cut at places of a bounded sample of the keys; how many."""
    n = keys.count()
    buckets = min(BUCKETS, -(-n // PAGES))
    cuts: list[tuple[str, str, int]] = []
    if buckets > 1:
        sample = keys.where(F.pmod(F.xxhash64("__host", "__path", "page_id"), F.lit(n)) < 8 * buckets)
        found = sorted({(r["__host"], r["__path"], NULL_ID if r["page_id"] is None else r["page_id"]) for r in sample.limit(16 * buckets).collect()})
        cuts = [found[i * len(found) // buckets] for i in range(1, buckets)] if found else []

    @F.pandas_udf(IntegerType())
    def bucket(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths, ids in parts:
            yield pd.Series([bisect_right(cuts, x) for x in zip(hosts, paths, ids, strict=True)], dtype="int32")

    return bucket, max(buckets, 1)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, pair_page_id, n_shared for every row of ``pages`` (page_id, url, html).

    Pages are dealt to buckets of neighbouring URLs, in the order of host, path and id, so that a host of
    any size goes to many tasks. The last page of a bucket is copied to the next one and the first to the
    one before: every page meets the pages before and after it in that order, whatever the buckets. Null
    or empty html has an empty text; a page alone on its host, or without one, has no partner. Repeated
    rows give repeated results, with the neighbours that one row would have; an empty table gives none. Other columns of
    ``pages`` are left out. A task holds three pages at a time.
    """
    from .url_filter import host_of, path_of

    named = [host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path")]
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), *named)
    bucket, buckets = _buckets(keys)
    bucket = bucket("__host", "__path", F.coalesce("page_id", F.lit(NULL_ID)))
    key = F.struct("__host", "__path", "page_id")
    edges = keys.withColumn("__b", bucket).groupBy("__b").agg(F.min(key).alias("__first"), F.max(key).alias("__last"))
    order = Window.orderBy("__b")  # one row for each bucket
    edges = edges.select("__b", "__first", "__last", F.lag("__b").over(order).alias("__before"), F.lead("__b").over(order).alias("__after"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *named).withColumn("__b", bucket)
    p = p.join(F.broadcast(edges), "__b")  # BUCKETS rows at most
    to = F.array(F.col("__b"), F.when(key == F.col("__last"), F.col("__after")), F.when(key == F.col("__first"), F.col("__before")))
    p = p.select("page_id", "url", "html", "__host", "__path", "__b", F.explode(F.array_compact(to)).alias("__to"))
    p = p.select("page_id", "url", "html", "__host", "__path", "__to", (F.col("__b") == F.col("__to")).alias("__own"), F.col("page_id").cast("string").alias("__id"))
    # as many parts as buckets, so that tasks don't grow with the table; ties by content, so that reruns agree
    p = p.repartition(buckets, "__to").sortWithinPartitions("__to", "__host", "__path", "page_id", F.xxhash64("url", "html"))
    return p.mapInPandas(_pairs, RESULT)
