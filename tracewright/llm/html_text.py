"""HTML extraction: marked structure and a suffix array of each host decide together.

A linear tag scanner cuts a page into blocks and puts each into a zone: *main* (inside ``article``
or ``main``), *chrome* (menus, headers, footers, sidebars, notices, adverts, forms, comments of
readers: by element, role, class or id of any element; and hidden parts), or *loose*.  Inside ``article`` and
``main`` a class or id is chrome by its whole tokens only; a token that has such a word in it ("search-results")
makes a *doubtful* block, which goes if the array finds half of it, or all of it in short runs, on other pages too.  Scripts,
styles and markup are no text.  A page with main blocks consists of them, any other page of its
loose ones.

All blocks of all pages of a host, chrome too, are its token streams.  Pages are dealt by
(host, section); a task concatenates a section's distinct streams and sorts their suffixes by
prefix doubling, as deep as ``run`` tokens.  Neighbours in this array that agree to that depth
are a substring of ``run`` tokens, and its distinct pages are counted there.  A token's count is that of the best of
the substrings that cover it.  (A longer repeat lies on no more pages than each of its parts, so what repeats of any
greater length cover is covered by these.)

* A loose page's own text begins with the first block that has ``anchor`` tokens of count 1, and ends with the last.  Before and
  after it tokens on two pages are boilerplate, by substrings of ``edge`` tokens already, as menus are short; inside, only those on
  ``sure`` pages.
* A page without such blocks and with ``copy_tokens`` repeated ones is a copy: its text is what has the median of its
  tokens' counts, or less, and inside it only what more than twice as many pages hold is boilerplate.  With fewer repeated ones
  it is a copy if ``anchor`` tokens of a block stand on less than ``sure`` pages; the median is then that of such tokens.
* A loose block loses its boilerplate if this makes up ``block_share`` of its tokens or more; so
  a phrase stays in the prose around it.
* A main block goes as a whole (a notice or an advert that the article does not mark) if that
  share of it stands on ``main_share`` of the pages, and on ``sure`` at least; unless that would
  take half of the page's main tokens: then pages are copies, and copies keep their text.

Hosts of more than ``section_bytes`` of html have as many sections as they need, of about
``section_pages`` pages at least, and their pages are dealt by their streams, so that copies meet.  Counts are of the whole host,
into however many sections it is cut; sections only send each other what can change a block:

* A section asks for the substrings over loose text of its unmarked pages and over doubtful blocks, and, over main blocks, for those on ``main_share`` of its
  own pages (what stands on that share of a host's pages does so in one of its sections at least).  Asked substrings are bits of one filter for each host.
* Every section counts its own pages for what passes its host's filter.  These counts are summed by Spark, and the sums go back to the sections that count on them.

So no host is too large for a task: pages move once, by (host, section), and of substrings those that are asked for.  On a large host without any
marks all are, and each distinct one of a section is then a row.  Substrings are compared by 64-bit hashes between sections.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one newline.

Defined results: null or empty html gives the empty text; an empty table gives none; repeated rows
come back as often as they came; a null url is a host of its own; copies of a page count as one;
stray and unclosed tags are tolerated, a comment, a script or a tag that is never closed hides the
rest of its page; a page of any length is worked on whole, in time in proportion to it; columns
other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import bounded_batches
from ._text import gram_hashes, signed, span_hashes, spans, text_slices
from ._work import Work

CHROME, LOOSE, MAIN, DOUBT = 0, 1, 2, 3

#: Bits of a host's filter, as a power of two, and of one of its rows (4 kB).  A full filter lets everything pass.
_FILTER, _ROW = 19, 15

#: Elements whose content is no text of the page; it ends at the first end tag of that name.
_RAW = frozenset("script style noscript template svg iframe object canvas math title textarea select button audio video".split())
_RAW_END = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in _RAW}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANK = re.compile(r"\s*")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are followed to their end; of the others only those that are chrome.
_HOLDERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header html main menu nav ol section table td tr ul".split())
#: Elements whose end tag may be left out, and what opens in their place.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
_CHROME = frozenset("nav footer aside form head menu dialog".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CHROME_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promoted promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: "has-sidebar" and the like describe a layout around the article.
_LAYOUT = frozenset("has no with without".split())


def _is_chrome(name: str, attrs: str, in_main: bool) -> int:
    """2: chrome; 1: inside the main text, a part of a class or id says so."""
    found = 0
    for k, a, b, c in _ATTR.findall(attrs):
        k, v = k.lower(), (a or b or c).lower()
        if k in ("class", "id") and name not in ("html", "body", "main"):
            for token in v.split():
                words = re.split(r"[^a-z]+", token)
                if any(w in _CHROME_WORDS and (i == 0 or words[i - 1] not in _LAYOUT) for i, w in enumerate(words)) and (name != "article" or "comment" in token):
                    found = max(found, 2 if not in_main or token in _CHROME_WORDS else 1)
        elif k == "role" and v in _CHROME_ROLES or k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v):
            return 2
    return found


class _Tags:
    """Ends of tags in one page; every search moves on only, or is not made again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.no_more: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.no_more:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.no_more.add(what)
        return found

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag; quotes count after ``=`` only."""
        page, n = self.page, len(self.page)
        while at < n:
            stop = self.find(">", at)
            if stop < 0:
                return -1
            equals = page.find("=", at, stop)
            if equals < 0:
                return stop
            at = _BLANK.match(page, equals + 1).end()
            if at < n and page[at] in "\"'":
                close = self.find(page[at], at + 1)
                at = at + 1 if close < 0 else close + 1
            else:  # a bare value ends at a blank
                while at < n and not page[at].isspace() and page[at] != ">":
                    at += 1
        return -1


def zones(page: str) -> list[tuple[int, str]]:
    """The page's blocks in order: (zone, text)."""
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, is chrome, is main, is doubtful
    held: Counter = Counter()  # elements of the stack by name
    parts: list[str] = []
    chrome = main = doubt = 0
    tags = _Tags(page)

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append((CHROME if chrome else LOOSE if not main else DOUBT if doubt else MAIN, text))

    def pop_to(size: int) -> None:
        nonlocal chrome, main, doubt
        if any(c or d for _, c, _, d in stack[size:]):
            close()
        for name, c, m, d in stack[size:]:
            held[name] -= 1
            chrome -= c
            main -= m
            doubt -= d
        del stack[size:]

    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            parts.append(page[at:])
            break
        parts.append(page[at:tag])
        if page.startswith("<!--", tag) or page.startswith("<![CDATA[", tag):
            ends = "-->" if page[tag + 2] == "-" else "]]>"
            stop = tags.find(ends, tag + 4)
            at = n if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), tag):
            stop = tags.find(">", tag)
            at = n if stop < 0 else stop + 1
            continue
        is_end = page.startswith("</", tag)
        m = _NAME.match(page, tag + 1 + is_end)
        if m is None:  # no tag: a sign of the text
            parts.append("<")
            at = tag + 1
            continue
        stop = tags.end(m.end())
        if stop < 0:
            break
        name, attrs = m.group().lower(), page[m.end() : stop]
        at = stop + 1
        if name in _RAW and not is_end:
            if name not in ("svg", "math") or not attrs.endswith("/"):
                found = _RAW_END[name].search(page, at)
                at = n if found is None else found.start()
            continue
        if name not in _INLINE:
            close()
        elif name == "br":
            parts.append(" ")
        if is_end:
            if held[name]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in _VOID or attrs.endswith("/") and name in ("svg", "math"):
            continue
        while stack and (stack[-1][0] == "p" and name not in _INLINE or name in _ENDS.get(stack[-1][0], ())):
            pop_to(len(stack) - 1)
        said = 2 if name in _CHROME or (name == "header" and not main) else _is_chrome(name, attrs, main > 0) if attrs and not attrs.isspace() else 0
        if said or name in _HOLDERS or held[name]:
            if said:
                close()
            is_main = name in ("article", "main")
            stack.append((name, said == 2, is_main, said == 1))
            held[name] += 1
            chrome += said == 2
            main += is_main
            doubt += said == 1
    close()
    return blocks


@dataclass(frozen=True)
class HtmlParams:
    """``run``, ``edge``: the least tokens of a repeated substring, and of one before or after the text; ``anchor``: tokens of its own that a block of the page's text
    has; ``block_share``: of a block's tokens, those that are boilerplate; ``sure``, ``main_share``: pages, and share of the
    section's distinct ones, that boilerplate inside the text stands on; ``small``: the most large hosts whose sizes are broadcast."""

    run: int = 8
    edge: int = 3
    anchor: int = 20
    block_share: float = 0.5
    main_share: float = 0.5
    sure: int = 5
    copy_tokens: int = 100
    section_bytes: int = 4 << 20
    section_pages: int = 256
    small: int = 500_000


def host_of(url: str):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def prefix_ranks(tokens: np.ndarray, depth: int, known: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """The rank of the ``depth`` tokens from each place on, by prefix doubling from the ranks of fewer that are ``known``."""
    rank, have = known or (np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1)
    n = len(tokens)
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def suffix_array(tokens: np.ndarray, ends: np.ndarray, depth: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``depth`` tokens or more, in order of their first ``depth`` tokens, and the
    rank of each place (equal for equal ones, -1 for shorter suffixes).

    ``tokens`` are all streams one after the other, ``ends`` the end of each token's own stream; what
    goes over a stream's end is never used.  ``ranks`` are those of ``prefix_ranks``, if they are known.
    """
    n = len(tokens)
    whole = np.arange(n) + depth <= ends
    rank = np.where(whole, prefix_ranks(tokens, depth) if ranks is None else ranks, -1)
    order = np.argsort(rank, kind="stable")
    return order[n - int(whole.sum()) :], rank


def pages_with(rank: np.ndarray, order: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each place, the number of distinct pages with the substring that starts there."""
    out = np.zeros(len(rank), np.int64)
    if len(order):
        r, g = rank[order], page[order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])  # places are in page order where ranks are equal
        out[order] = np.bincount(r[new], minlength=int(r[-1]) + 1)[r]
    return out


def counts_of(on: np.ndarray, run: int) -> np.ndarray:
    """For each token, the most pages that hold one of the substrings that cover it; 1 if none is whole."""
    out = np.maximum(on, 1)
    for k in range(1, min(run, len(on))):
        np.maximum(out[k:], on[:-k], out=out[k:])
    return out


@dataclass(frozen=True)
class Streams:
    """A section's distinct pages one after the other: ``tokens`` with their ``block`` and ``page``, ``zone`` of each block, ``starts`` of each page and the last one's end."""

    rows: list[int]  # the stream of each row
    pages: list[tuple[str, bytes]]
    tokens: np.ndarray
    block: np.ndarray
    page: np.ndarray
    zone: np.ndarray
    starts: np.ndarray

    @property
    def distinct(self) -> int:
        return int((np.diff(self.starts) > 0).sum())

    def marked(self) -> np.ndarray:
        """For each page, whether it has main or doubtful blocks."""
        return np.bincount(self.page, np.isin(self.zone[self.block], (MAIN, DOUBT)), len(self.pages)) > 0


def streams_of(bodies: list[str], marks: list[bytes]) -> Streams:
    """``bodies`` are the pages' blocks, one in a line, ``marks`` their zones."""
    first: dict[tuple[str, bytes], int] = {}
    which = [first.setdefault(x, len(first)) for x in zip(bodies, marks, strict=True)]
    streams = list(first)
    words, sizes, blocks = [], [], []
    ends_word = np.zeros(256, bool)
    ends_word[[10, 32]] = True
    k = 0
    for s in text_slices(pa.array([b for b, _ in streams], pa.large_string())):
        w = spans(s, ends_word)
        words.append(span_hashes(s.data, w.start, w.end))
        sizes.append(w.counts())
        breaks = s.data == 10
        breaks[s.offsets[:-1][np.diff(s.offsets) > 0][1:]] = True  # the first block of a page with text
        count = np.cumsum(breaks)
        blocks.append(k + count[w.start] if len(w.start) else np.zeros(0, np.int64))
        k += sum(len(m) for _, m in streams[s.first : s.first + len(s)])
    tokens, size = np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate([*sizes, np.zeros(0, np.int64)])
    block = np.concatenate([*blocks, np.zeros(0, np.int64)])
    page = np.repeat(np.arange(len(streams)), size)
    zone = np.frombuffer(b"".join(m for _, m in streams), np.uint8)
    return Streams(which, streams, tokens, block, page, zone, np.concatenate([[0], np.cumsum(size)]))


def grams_of(s: Streams, depth: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, place, pages)`` of the section's substrings of ``depth`` tokens, or of ``only`` those with this bit of the filter."""
    h, at = gram_hashes(s.tokens, s.starts, depth)
    if only is not None:
        met = only[h >> np.uint64(64 - _FILTER)]
        h, at = h[met], at[met]
    rank = np.full(len(s.tokens), -1)
    rank[at] = np.unique(h, return_inverse=True)[1]
    return h, at, pages_with(rank, at[np.argsort(rank[at], kind="stable")], s.page)[at]


def asked(s: Streams, p: HtmlParams) -> np.ndarray:
    """Hashes of the substrings whose pages in other sections can change one of these blocks."""
    kind = s.zone[s.block]
    unsure, main = (kind == DOUBT) | (kind == LOOSE) & ~s.marked()[s.page], kind == MAIN
    out = [np.zeros(0, np.uint64)]
    unsure, main = (np.concatenate([[0], np.cumsum(x)]) for x in (unsure, main))
    for depth in {p.run, p.edge} if unsure[-1] else {p.run}:
        h, at, on = grams_of(s, depth)
        need = unsure[at + depth] > unsure[at]
        if depth == p.run:
            need |= (main[at + depth] > main[at]) & (on + 1e-6 >= p.main_share * s.distinct)
        else:  # whether they stand on two pages is all that counts
            need &= on < 2
        out.append(h[need])
    return np.concatenate(out)


def section_texts(bodies: list[str], marks: list[bytes], p: HtmlParams, sums: tuple[np.ndarray, np.ndarray, int] | None = None) -> list[str]:
    """The main text of each page of a section; ``bodies`` are its blocks, one in a line, ``marks`` their zones.

    ``sums``, of a host with several sections: hashes in order, their pages in all sections, and the host's distinct pages.
    """
    s = streams_of(bodies, marks)
    which, streams, tokens, block, page, zone, starts = s.rows, s.pages, s.tokens, s.block, s.page, s.zone, s.starts
    size, kind, length = np.diff(starts), zone[block], np.bincount(block, minlength=len(zone))
    counts, ends, known = {}, np.repeat(starts[1:], size), None
    for depth in sorted({p.run, p.edge}):
        known = prefix_ranks(tokens, depth, known), depth
        order, rank = suffix_array(tokens, ends, *known[::-1])
        on = pages_with(rank, order, page)
        if sums is not None and len(sums[0]):
            h, at = gram_hashes(tokens, starts, depth)
            k = np.minimum(np.searchsorted(sums[0], h), len(sums[0]) - 1)
            met = sums[0][k] == h
            on[at[met]] = sums[1][k[met]]
        counts[depth] = counts_of(on, depth)
    count, at_edge = counts[p.run], counts[p.edge]
    distinct = s.distinct if sums is None else sums[2]

    per_page = lambda mask: np.bincount(page, mask, len(streams))
    per_block = lambda mask: np.bincount(block, mask, len(zone))
    enough = lambda mask: per_block(mask) >= np.maximum(1, p.block_share * length)
    of_page = np.repeat(np.arange(len(streams)), [len(m) for _, m in streams])  # of blocks

    marked = s.marked()
    loose = (kind == LOOSE) & ~marked[page]
    usual = np.ones(len(streams), np.int64)  # the count of a page's own text
    anchors = per_block(loose & (count <= 1)) >= p.anchor
    long, few = per_page(loose & (count > 1)) >= p.copy_tokens, loose & (count > 1) & (count < p.sure)
    short = np.bincount(of_page, per_block(few) >= p.anchor, len(streams)) > 0
    for i in np.flatnonzero((long | short) & (np.bincount(of_page, anchors, len(streams)) == 0)):
        own = slice(starts[i], starts[i + 1])
        usual[i] = np.median(count[own][(loose if long[i] else few)[own]])
    anchors = per_block(loose & (count <= usual[page])) >= p.anchor
    at = np.arange(len(zone))
    first, last = np.full(len(streams), len(zone)), np.full(len(streams), -1)
    np.minimum.at(first, of_page[anchors], at[anchors])
    np.maximum.at(last, of_page[anchors], at[anchors])
    inside = (block >= first[page]) & (block <= last[page])
    gone = loose & np.where(inside, count >= np.maximum(p.sure, 2 * usual[page] + 1), at_edge >= 2)
    cut = enough(gone)
    notice = (kind == MAIN) & (count >= max(p.sure, p.main_share * distinct))
    dropped = enough(notice) & (zone == MAIN)
    spared = 2 * per_page(dropped[block]) >= np.maximum(1, per_page(kind == MAIN))
    unsure = (enough((kind == DOUBT) & (count > 1)) | (per_block(at_edge >= 2) >= length)) & (zone == DOUBT)

    texts, bounds = [], np.concatenate([[0], np.cumsum([len(m) for _, m in streams])])
    at = np.concatenate([[0], np.cumsum(length)])
    for i, (body, _) in enumerate(streams):
        out = []
        for b, text in zip(range(bounds[i], bounds[i + 1]), body.split("\n"), strict=False):
            if (zone[b] not in (MAIN, DOUBT) if marked[i] else zone[b] != LOOSE) or unsure[b] or (dropped[b] and not spared[i]):
                continue
            if zone[b] == LOOSE and cut[b]:
                text = " ".join(t for t, g in zip(text.split(" "), gone[at[b] : at[b + 1]], strict=True) if not g)
            if text:
                out.append(text)
        texts.append("\n".join(out))
    return [texts[i] for i in which]


def _parsed(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, section, body, marks)``: every page is scanned here, once; ``parts`` are the sections of its host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                found = [zones(page.as_py() or "") for page in b.column("html")]
                body = pa.array(["\n".join(t for _, t in f) for f in found], pa.string())
                marks = pa.array([bytes(z for z, _ in f) for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host", "parts")), body, marks], names=["page_id", "url", "host", "parts", "body", "marks"])

    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", "host", "parts", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, host long, parts int, body string, marks binary")
    section = F.pmod(F.xxhash64("body", "marks", F.lit(5)), F.col("parts")).cast("int")
    return rows.select("page_id", "url", "host", section.alias("section"), "body", "marks")


def _hosts(pages: DataFrame, p: HtmlParams) -> tuple[DataFrame, DataFrame]:
    """The pages with their host, and ``(host, parts)`` of the hosts that have several sections."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", F.xxhash64(host_of("url")))
    size = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("_b"), F.count("*").alias("_p"))
    return rows, size.select("host", F.least(F.ceil(F.col("_b") / p.section_bytes), F.floor(F.col("_p") / p.section_pages)).cast("int").alias("parts")).where("parts > 1")


def _small(large: DataFrame, p: HtmlParams) -> DataFrame:
    return F.broadcast(large) if large.count() <= p.small else large


def sections(pages: DataFrame, p: HtmlParams) -> DataFrame:
    """``(page_id, url, host, section, body, marks)``; most hosts have one section."""
    rows, large = _hosts(pages, p)
    return _parsed(rows.join(_small(large, p), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1))))


def _sums(pages: DataFrame, large: DataFrame, p: HtmlParams) -> DataFrame:
    """``(host, section, gram, total)``: a host's pages with each gram that it asks for, for the sections that have it; gram null: its distinct pages."""

    def streams(table: pa.Table) -> Streams:
        return streams_of(table.column("body").to_pylist(), table.column("marks").to_pylist())

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _FILTER, bool)
        bits[asked(streams(table), p) >> np.uint64(64 - _FILTER)] = True
        rows = bits.reshape(-1, 1 << _ROW)
        some = np.flatnonzero(rows.any(1))
        return pa.table({"host": pa.array([key[0].as_py()] * len(some), pa.int64()), "k": pa.array(some, pa.int32()), "bits": pa.array([np.packbits(rows[k]).tobytes() for k in some], pa.binary())})

    def count(key: tuple, table: pa.Table, filters: pa.Table) -> pa.Table:
        grams, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if table.num_rows:
            s = streams(table)
            grams, n = [np.zeros(1, np.int64)], [np.array([s.distinct])]  # the first gram is null
            bits = np.zeros((1 << (_FILTER - _ROW), 1 << _ROW), bool)
            for k, row in zip(filters.column("k").to_pylist(), filters.column("bits").to_pylist(), strict=True):
                bits[k] = np.unpackbits(np.frombuffer(row, np.uint8))
            for depth in {p.run, p.edge} if bits.any() else ():
                h, _, on = grams_of(s, depth, bits.ravel())
                h, first = np.unique(h, return_index=True)
                grams.append(signed(h))
                n.append(on[first])
        gram, n = np.concatenate(grams), np.concatenate(n)
        host, section = (pa.array(np.full(len(n), k.as_py()), kind) for k, kind in zip(key, (pa.int64(), pa.int32()), strict=True))
        return pa.table({"host": host, "section": section, "gram": pa.array(gram, mask=np.arange(len(n)) == 0), "n": pa.array(n)})

    filters = pages.groupBy("host", "section").applyInArrow(ask, "host long, k int, bits binary").groupBy("host", "k").agg(F.bitmap_or_agg("bits").alias("bits"))
    filters = filters.join(large, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("section"), "k", "bits")
    own = pages.groupBy("host", "section").cogroup(filters.groupBy("host", "section")).applyInArrow(count, "host long, section int, gram long, n long")
    total = F.sum("n").over(Window.partitionBy("host", "gram"))
    return own.withColumn("total", total).where("gram IS NULL OR total > n").select("host", "section", "gram", "total")


def extract(pages: DataFrame, params: HtmlParams = HtmlParams()) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages(page_id, url, html)``."""
    p = params
    bounded_batches(pages.sparkSession)
    out = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string"

    def texts(table: pa.Table, sums: tuple[np.ndarray, np.ndarray, int] | None = None) -> pa.Table:
        found = section_texts(table.column("body").to_pylist(), table.column("marks").to_pylist(), p, sums)
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(found, pa.string())})

    def summed(table: pa.Table, sums: pa.Table) -> pa.Table:
        gram, total = sums.column("gram"), sums.column("total").to_numpy()
        known = gram.is_valid().to_numpy()
        h = gram.filter(gram.is_valid()).to_numpy().view(np.uint64)
        order = np.argsort(h)
        return texts(table, (h[order], total[known][order], int(total[~known][0])))

    rows, large = _hosts(pages, p)
    work = Work(pages.sparkSession, "html")
    large = work.table(large, "large")
    if large.isEmpty():  # each host is one group
        work.clear()
        return _parsed(rows.withColumn("parts", F.lit(1))).groupBy("host", "section").applyInArrow(lambda table: texts(table), out)
    large = _small(large, p)
    one = _parsed(rows.join(large, "host", "left_anti").withColumn("parts", F.lit(1)))
    several = _parsed(rows.join(large, "host"))
    sums = _sums(several, large, p).groupBy("host", "section")
    return one.groupBy("host", "section").applyInArrow(lambda table: texts(table), out).unionByName(several.groupBy("host", "section").cogroup(sums).applyInArrow(summed, out))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
