"""Main text of web pages: page structure, and a host suffix array for what the structure leaves open.

A page is cut into blocks. Blocks inside the article are its text; blocks in
menus, headers, footers, side bars, notices, adverts, forms and comments are
not. An article inside such a wrapper is text again, unless the wrapper is
navigation, a footer, comments or hidden. Blocks in none of these are open,
with or without an article beside them, and the host decides: the token
streams of a host's pages outside articles form one text, and its suffixes are
grouped by their first GRAM tokens, which is the host's suffix array cut at
that depth. A position is covered if its suffix starts like one of another
page with other contents; the union of such stretches is what substrings of at
least GRAM tokens repeated across distinct pages cover. Covered tokens go,
unique runs stay; copies of a page count as one page, so they do not cover
each other. The array is never in one place: its groups are rows keyed by
(host, prefix), pre-aggregated in each task, so no host is too large.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

#: Tokens of the shortest repeated substring: longer than the phrases that texts of one host share by chance.
GRAM = 20
#: WRAP: in a form or in an element that is chrome by its names only. CLOSED: chrome in which no article opens.
MAIN, OPEN, WRAP, CHROME, CLOSED = range(5)

#: What a ``<`` can open: a comment, CDATA, a declaration, a tag. Any other ``<`` is text.
_OPENING = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
#: Attributes up to the closing ``>``, where no ``<`` stands in them; it stops at the next ``<``, so it never reads far in vain.
_ATTRS = re.compile(r"""((?>[^<>=]++|=\s*+(?:"[^"<]*+"|'[^'<]*+'|(?!["'])))*+)>""")
#: The same without regard to quotes, for a value whose quote is never closed.
_BARE = re.compile(r"([^<>]*+)>")
#: What changes the state of a scan through attributes that hold a ``<``.
_QUOTES = re.compile(r"""=\s*+["']|["'<>]""")
#: Elements whose content is no markup; without an end tag they run to the page's end.
_RAW = frozenset("script style iframe textarea title".split())
#: Elements left out whole; one without an end tag is ignored.
_SKIPPED = frozenset("template noscript svg math select object".split())
#: Elements that begin and end a block.
_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
search section summary table tbody tfoot thead tr ul""".split())
#: Elements with end tags that may carry a region.
_HOLDERS = frozenset("""article aside blockquote center details dialog div dl fieldset figure footer form header main
menu nav ol section table ul search button""".split())
_NOT_TEXT = frozenset("nav header footer aside form menu dialog search button fieldset".split())
_ROLE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Words of class, id and role names that mark what is not the article's text.
_CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
cookie cookies consent dialog disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice
notices overlay pagination paywall popup popups promo promos promotion recommended related replies reply respond search share
sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets alert
complementary contentinfo""".split())
#: Of these, the words of names in whose elements no article opens, and words that make such a name tell of the page instead.
_CLOSED_WORDS = frozenset("nav navbar navigation footer contentinfo comment comments disqus replies reply respond".split())
_STATE_WORDS = frozenset("has with without no is open opened closed fixed sticky layout enabled disabled".split())
_MAIN_WORDS = ("main", "article")


def _region(tag: str, attrs: str) -> int | None:
    """The region that an element opens, None if it changes nothing."""
    if tag in ("nav", "footer") or (attrs and _HIDDEN.search(attrs)):
        return CLOSED
    if tag in _MAIN_WORDS:
        return MAIN
    own = WRAP if tag == "form" else CHROME if tag in _NOT_TEXT else None
    if attrs:
        for m in _ROLE.finditer(attrs):
            for name in m[1].split():
                words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
                if words & _CLOSED_WORDS and not words & _STATE_WORDS:
                    return CLOSED
                if words & _CHROME_WORDS:
                    own = own or WRAP
    return own


class _Scanner:
    """Tags of a page in linear time.

    A tag ends at the first ``>`` outside quoted attribute values, or, if a
    quote is never closed, at the first one. One that meets a ``<`` outside
    quotes, or no ``>``, is no tag, and its ``<`` is text. A scan through quotes that ends in vain remembers where it was
    outside quotes and inside which; a later scan that comes to the same state
    ends there, so that all of them together read the page three times at most.
    """

    def __init__(self, page: str) -> None:
        self.page, self.end = page, page.rfind(">") + 1
        self.vain: set[tuple[int, str]] = set()
        self.absent: set[str] = set()

    def attrs(self, at: int) -> tuple[str, int] | None:
        """(attributes, end of the tag) of a tag whose name ends at ``at``."""
        m = _ATTRS.match(self.page, at, self.end)
        if m:
            return m[1], m.end()
        state, path, pos = "", [(at, "")], at
        while path[-1] not in self.vain:
            m = _QUOTES.search(self.page, pos, self.end)
            if m is None:
                break
            mark = m[0][-1]
            if state:
                state = "" if mark == state else state
            elif mark == ">":
                return self.page[at:m.start()], m.end()
            elif mark == "<":
                return None
            elif len(m[0]) > 1:
                state = mark
            pos = m.end()
            path.append((pos, state))
        self.vain.update(path)
        m = _BARE.match(self.page, at, self.end)
        return (m[1], m.end()) if m else None

    def skip(self, name: str, at: int) -> int | None:
        """Where the element ``name`` that opens before ``at`` is over; None if it has no end tag."""
        if name in self.absent:
            return None
        m = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(self.page, at)
        if m is None:
            self.absent.add(name)
            return None
        return m.end()

    def tags(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(start, end, is an end tag, name, attributes); comments and the like have no name, skipped elements end behind their end tag."""
        pos, page = 0, self.page
        while m := _OPENING.search(page, pos, self.end):
            pos = m.end()
            comment, cdata, other, slash, name = m.groups()
            if comment or cdata:
                close = page.find("-->" if comment else "]]>", pos)
                pos = len(page) if close < 0 else close + 3
                yield m.start(), pos, False, "", ""
                continue
            if other:
                pos = page.index(">", pos) + 1
                yield m.start(), pos, False, "", ""
                continue
            found = self.attrs(pos)
            if found is None:
                continue
            attrs, pos = found
            name = name.lower()
            if not slash and (name in _RAW or name in _SKIPPED and not attrs.endswith("/")):
                over = self.skip(name, pos)
                if over is not None or name in _RAW:
                    pos = len(page) if over is None else over
                    yield m.start(), pos, False, name, ""
                    continue
            yield m.start(), pos, bool(slash), name, attrs


def blocks(page: str) -> list[tuple[int, str]]:
    """(region, text) of the page's blocks in page order; text decoded, white space joined, never empty.

    A ``<`` that opens no tag is text, as is all that follows the last tag but an unclosed comment.
    """
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    region = OPEN
    quiet = False  # inside a paragraph or heading that is itself chrome

    def close() -> None:
        if held:
            text = "".join(held)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((max(region, CHROME) if quiet else region, text))
            held.clear()

    last = 0
    depth: dict[str, int] = {}  # open elements by name
    for start, end, is_end, tag, attrs in _Scanner(page).tags():
        if start > last:
            held.append(page[last:start])
        last = end
        if tag in ("textarea", "select", "title"):
            close()
        if tag in ("br", "td", "th", "img", "option"):
            held.append(" ")
        if tag not in _BLOCKS and tag not in _HOLDERS:
            continue
        close()
        if is_end:
            quiet = False if tag not in _HOLDERS else quiet
            if depth.get(tag):
                while True:
                    name = stack.pop()[0]
                    depth[name] -= 1
                    if name == tag:
                        break
                region = stack[-1][1] if stack else OPEN
            continue
        own = _region(tag, attrs)
        if tag in _HOLDERS:
            quiet = False
            if not attrs.endswith("/"):
                # inside chrome only an article is text again
                region = region if region == CLOSED or own is None else MAIN if own == MAIN else max(region, own)
                stack.append((tag, region))
                depth[tag] = depth.get(tag, 0) + 1
        else:
            quiet = own is not None and own >= WRAP
    if last < len(page):
        held.append(page[last:].split("<!--")[0])
    close()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def grams(tokens: list[str]) -> list[int]:
    """64-bit hashes of the GRAM tokens from each position on; none if there are fewer."""
    return [xxhash.xxh64_intdigest(" ".join(tokens[i:i + GRAM])) - (1 << 63) for i in range(len(tokens) - GRAM + 1)]


def candidates(found: list[tuple[int, str]]) -> tuple[list[str], list[tuple[bool, str]] | None]:
    """The article's blocks if nothing else is open, else none and the blocks (is open, text) of which the host decides the open ones.

    An article is text in any case; what a page has open beside it may be its
    continuation, and stays where the host's other pages do not have it too. A
    page that is all inside wrappers that only a name or a form makes chrome
    has these for its open blocks.
    """
    regions = {r for r, _ in found}
    if MAIN in regions and OPEN not in regions:
        return [t for r, t in found if r == MAIN], None
    rest = OPEN if OPEN in regions else WRAP
    return [], [(r == rest, t) for r, t in found if r in (MAIN, rest)]


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, text (of the article), open and sure (blocks of a page on which no article decides, and which of them are an article's), grams (outside articles), content (hash of what counts as the page)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                cut = b.slice(lo, 500)
                text, other, sure, seen, content = [], [], [], [], []
                for h in cut.column(2):
                    found = blocks(h.as_py() or "")
                    main, rest = candidates(found)
                    text.append("\n".join(main))
                    other.append(None if rest is None else [t for _, t in rest])
                    sure.append(None if rest is None else [not o for o, _ in rest])
                    stream = [w for o, t in rest or [] if o for w in t.split(" ")]
                    # page order; of an open page, what is neither its open blocks nor its article
                    ours = {MAIN} if main else {MAIN, OPEN} if any(r <= OPEN for r, _ in found) else {WRAP}
                    chrome = [w for r, t in found if r not in ours for w in t.split(" ")]
                    seen.append([grams(stream), sorted(set(grams(chrome)))])
                    # chrome may differ between copies of an open page
                    content.append(xxhash.xxh64_intdigest("\n".join([text[-1], *chrome] if main else [t for _, t in rest or []])) - (1 << 63))
                yield pa.RecordBatch.from_arrays([
                    cut.column(0), cut.column(1), pa.array([host_of(u.as_py()) for u in cut.column(1)], pa.string()), pa.array(text, pa.string()),
                    pa.array(other, pa.list_(pa.string())), pa.array(sure, pa.list_(pa.bool_())), pa.array([s[0] for s in seen], pa.list_(pa.int64())), pa.array([s[1] for s in seen], pa.list_(pa.int64())),
                    pa.array(content, pa.int64())],
                    names=["page_id", "url", "host", "text", "open", "sure", "stream", "chrome", "content"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string"))
            .mapInArrow(run, "page_id long, url string, host string, text string, open array<string>, sure array<boolean>, stream array<long>, chrome array<long>, content long"))


def uncovered(texts: list[str], sure: list[bool], covered: list[int]) -> str:
    """The blocks without the tokens that repeated substrings cover; empty blocks go, ``sure`` ones stay whole and have no positions."""
    tokens = [t.split(" ") for t in texts]
    n = sum(len(words) for words, whole in zip(tokens, sure) if not whole)
    gone = np.zeros(n + GRAM + 1, np.int64)
    at = np.array(covered, np.int64)
    np.add.at(gone, at, 1)
    np.add.at(gone, np.minimum(at + GRAM, n), -1)
    keep = np.cumsum(gone)[:n] == 0
    out, i = [], 0
    for words, whole in zip(tokens, sure):
        if whole:
            out.append(" ".join(words))
            continue
        left = [w for w, k in zip(words, keep[i:i + len(words)]) if k]
        i += len(words)
        if left:
            out.append(" ".join(left))
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``: the main text of the whole html.

    Null and empty html give an empty text; a null url is a host of its own.
    Rows that repeat are kept; they count as one page for the host, as do
    pages with the same page_id (unless it is null) or the same contents. An
    empty table gives an empty one.
    """
    parsed = C.materialise(parse(pages).withColumn("_row", F.monotonically_increasing_id()), "html-blocks")
    page = F.coalesce("page_id", "content")
    every = parsed.select("host", page.alias("_page"), "content", F.explode(F.concat("stream", "chrome")).alias("_gram"))
    twice = (every.groupBy("host", "_gram").agg(F.min("_page").alias("_a"), F.max("_page").alias("_b"), F.min("content").alias("_c"), F.max("content").alias("_d"))
             .where("_a <> _b and _c <> _d").select("host", "_gram"))
    asked = parsed.where(F.col("open").isNotNull()).select("_row", "host", F.posexplode("stream").alias("_pos", "_gram"))
    hits = asked.join(twice, ["host", "_gram"]).groupBy("_row").agg(F.collect_list("_pos").alias("_covered"))
    bare = parsed.where(F.col("open").isNotNull()).select("_row", "page_id", "url", "open", "sure").join(hits, "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [uncovered(o, s, c or []) if o else "" for o, s, c in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(text, pa.string())], names=["page_id", "url", "text"])

    rest = bare.select("page_id", "url", "open", "sure", "_covered").mapInArrow(run, "page_id long, url string, text string")
    whole = parsed.where(F.col("open").isNull()).select("page_id", "url", "text")
    return whole.unionAll(rest).withColumn("n_chars", F.char_length("text").cast("long"))
