"""Main text of web pages by removal of site templates.

Element subtrees are hashed while a page is parsed; Spark counts in how many different pages of a host each hash stands,
and subtrees that recur across many of them are deleted, as are elements whose tag, role or class names them as
furniture; a role, class or form deletes nothing that is or holds an article, a main element or most of the text. Inside
an article (or main element) containers are counted too, by the different bodies around them; single paragraphs,
headings and list items stay there however often they recur.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from fluvia.lineage import cut

#: A subtree is a template of its host from so many different pages on, whatever the host's size.
LEAST_PAGES = 5
#: Templates up to which they are broadcast (8 bytes each); beyond, those of each page are found by salted shuffles.
BROADCAST_HASHES = 1_000_000
#: Parts into which a template that stands in many pages, or a page that stands in many rows, is dealt there.
SALTS = 16

# Element names and words of class names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
_GONE = frozenset("head script style noscript template title iframe object embed svg canvas audio video nav footer aside button select textarea input menu dialog search xmp noembed noframes map".split())
#: Elements of running text: inside an article they are never templates by themselves.
_PROSE = frozenset("blockquote body caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr html legend li p pre summary tbody tfoot thead tr".split())
#: What tells a hash inside an article from the same one outside.
_INSIDE = 0x5851F42D4C957F2D
_GONE_OUTSIDE = frozenset(["header"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = r"(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|popups?|modals?|overlay|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|widgets?|comments?|disqus|respond|replies|share|sharing|social|newsletters?|subscribe|subscription|related|recommended|footer|masthead|pagination|pager|toolbar|login|signup)"
#: A class or id of which one whole token is a listed word, or is made of nothing else (cookie-notice, not has-comments).
_FURNITURE = re.compile(rf"(?:^|\s)(?:{_WORDS}(?:[_-]+{_WORDS})*|skip-link)(?:$|\s)")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl menu select div section article main body html td th li dd blockquote aside nav header footer form figure fieldset".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</?([A-Za-z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|</?([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _signed(name: int) -> int:
    return name - (1 << 64) if name >> 63 else name


class _Element:
    __slots__ = ("tag", "seen", "gone", "named", "content", "first", "holds")

    def __init__(self, tag: str, gone: bool, content: bool, first: int, named: bool = False):
        self.tag, self.gone, self.content, self.first, self.named = tag, gone, content, first, named
        self.seen: list[str] = []
        self.holds = False


def _gone(tag: str, attributes: str, content: bool) -> bool:
    """Whether an element is deleted whatever it holds."""
    if tag in _GONE or (not content and tag in _GONE_OUTSIDE):
        return True
    return "hidden" in attributes.lower() and tag not in ("html", "body") and any(name.lower() == "hidden" for name, *_ in _ATTRIBUTE.findall(attributes))


def _furniture(tag: str, attributes: str) -> bool:
    """Whether an element is deleted unless it is or holds what the page is about."""
    if tag == "form":
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if (name == "role" and value in _ROLES) or (name in ("class", "id") and _FURNITURE.search(value)):
            return True
    return False


class Page:
    """A parsed page: text runs with their block, what is gone, and the hashes of removable subtrees."""

    def __init__(self, source: str):
        #: (text, in an article, in a main element) of each run; a None text ends a block
        self.runs: list[tuple[str | None, bool, bool]] = []
        #: (hash, first run, run after the last, body around it or None outside articles) of every removable subtree
        self.subtrees: list[tuple[int, int, int, int | None]] = []
        #: (first run, run after the last, in an article or main element) of what a class, id, role or form names as furniture
        self.named: list[tuple[int, int, bool]] = []
        #: subtrees of the article or main element that is open
        self._inner: list[tuple[int, int, int]] = []
        self._stack: list[_Element] = [_Element("#root", False, False, 0)]
        #: where on the stack elements of each tag stand, and those that hold paragraphs and list items in
        self._places: dict[str, list[int]] = {}
        self._scopes: list[int] = []
        self._articles = self._mains = 0
        at = 0
        while at < len(source):
            found = _TOKEN.search(source, at)
            if not found:
                break
            self._text(source[at : found.start()])
            at = found.end()
            tag, attributes = found[1] or found[3], found[2] or found[4] or ""
            if not tag:
                continue
            tag = tag.lower()
            if source[found.start() + 1] == "/":
                self._end(tag)
            else:
                self._start(tag, attributes)
                if tag in _RAW and not attributes.endswith("/"):
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = close.end() if close else len(source)
                    self._end(tag)
        self._text(source[at:])
        while len(self._stack) > 1:
            self._close()

    def _text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            top = self._stack[-1]
            top.seen.append(text)
            if not top.gone:
                self.runs.append((text, self._articles > 0, self._mains > 0))

    def _break(self) -> None:
        self.runs.append((None, False, False))

    def _start(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag in _BLOCK and tag not in ("html", "body"):
            k = self._last("p")
            if k > (self._scopes[-1] if self._scopes else 0):  # a block ends an open paragraph
                while len(stack) > k:
                    self._close()
        if tag in _CLOSES:
            k = max(map(self._last, _CLOSES[tag]))
            if k > next((s for s in reversed(self._scopes) if stack[s].tag not in _CLOSES[tag]), 0):
                while stack[k].tag in _CLOSES[tag]:
                    while len(stack) > k:
                        self._close()
                    k = len(stack) - 1
        top = stack[-1]
        if tag in _BLOCK:
            self._break()
        elif tag in ("br", "td", "th", "img"):
            self._text(" ")
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK and tag not in _RAW:
            top.seen.append(f"<{tag}>")
            return
        gone = top.gone or _gone(tag, attributes, top.content)
        content = not gone and (top.content or tag in ("article", "main"))
        self._places.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            self._scopes.append(len(stack))
        stack.append(_Element(tag, gone, content, len(self.runs), not gone and _furniture(tag, attributes)))
        if not gone:
            self._articles += tag == "article"
            self._mains += tag == "main"

    def _last(self, tag: str) -> int:
        """Where the innermost open element of the tag stands on the stack, or 0."""
        places = self._places.get(tag)
        return places[-1] if places else 0

    def _end(self, tag: str) -> None:
        if k := self._last(tag):
            while len(self._stack) > k:
                self._close()

    def _close(self) -> None:
        e = self._stack.pop()
        self._places[e.tag].pop()
        if e.tag in _SCOPE:
            self._scopes.pop()
        above = self._stack[-1]
        if not e.gone:
            self._articles -= e.tag == "article"
            self._mains -= e.tag == "main"
        name = xxhash.xxh64(f"<{e.tag}>{' '.join(' '.join(e.seen).split())}").intdigest()
        above.seen.append(f"<{name}>")
        # an article in another one is a comment or a card, which its class may delete
        holds = e.holds or e.tag in ("main", "body", "html") or (e.tag == "article" and self._articles == 0)
        if e.named and not holds:
            self.named.append((e.first, len(self.runs), e.content))
        above.holds |= holds
        if e.tag in _BLOCK:
            if not holds and any(not x.isspace() for x in e.seen):
                if not e.content:
                    self.subtrees.append((_signed(name), e.first, len(self.runs), None))
                elif e.tag not in _PROSE:
                    self._inner.append((_signed(name ^ _INSIDE), e.first, len(self.runs)))
            self._break()
        if e.content and not above.content and self._inner:
            self._settle(e.first)

    def _settle(self, first: int) -> None:
        """Gives the subtrees of a closed article the body around them: its longest block outside the subtree, so that copies
        of a text that differ elsewhere are one body. A subtree that is all of the article has the body 0."""
        blocks, start, block = [], first, []
        for k in range(first, len(self.runs)):
            if self.runs[k][0] is not None:
                block.append(self.runs[k][0])
            if self.runs[k][0] is None or k == len(self.runs) - 1:
                text = " ".join("".join(block).split())
                if text:
                    blocks.append((-len(text), text, start))
                start, block = k + 1, []
        # the best block before, and after, each place in the order of the page
        at = [x[2] for x in blocks]
        keys = [x[:2] for x in blocks]
        none = (0, "")
        before, after = [none, *accumulate(keys, min)], [*accumulate(reversed(keys), min)][::-1] + [none]
        for name, a, b in self._inner:
            body = min(before[bisect_left(at, a)], after[bisect_left(at, b)])[1]
            self.subtrees.append((name, a, b, _signed(xxhash.xxh64(body).intdigest()) if body else 0))
        self._inner = []

    def main_text(self, templates: frozenset[int]) -> str:
        """Blocks left without template subtrees: those of the articles if they hold most of that text, else those of the main
        elements if they do, else all."""
        sizes = [0, *accumulate(len(r[0].strip()) if r[0] else 0 for r in self.runs)]
        removed = [(a, b) for name, a, b, _ in self.subtrees if name in templates]
        # beside an article with text, furniture goes whatever its size
        told = any(text is not None and (article or main) and not text.isspace() for text, article, main in self.runs)
        removed += [(a, b) for a, b, inside in self.named if (told and not inside) or 2 * (sizes[b] - sizes[a]) <= sizes[-1]]
        depth = [0] * (len(self.runs) + 1)
        for a, b in removed:
            depth[a] += 1
            depth[b] -= 1
        cut = [*accumulate(depth)]
        left = [0, 0, 0]
        for k, (text, article, main) in enumerate(self.runs):
            if text is not None and not cut[k]:
                n = len(text.strip())
                left[0] += n
                left[1] += n * article
                left[2] += n * main
        which = next((k for k in (1, 2) if 2 * left[k] > left[0]), 0)
        blocks, block = [], []
        for k, run in enumerate(self.runs):
            if run[0] is None:
                if block:
                    blocks.append(" ".join("".join(block).split()))
                    block = []
            elif not cut[k] and (not which or run[which]):
                block.append(run[0])
        if block:
            blocks.append(" ".join("".join(block).split()))
        return "\n\n".join(b for b in blocks if b)


def _of_host(host: str, names: list[int]) -> np.ndarray:
    """Hashes of subtrees as those of one host."""
    return np.array(names, np.int64) ^ np.int64(_signed(xxhash.xxh64(host).intdigest()))


def site_templates(pages: DataFrame) -> DataFrame:
    """(hash) of subtrees, each with its host, that recur across pages of the host. pages: host, html. Equal pages, and equal
    bodies around what stands in an article, count once."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hashes = [], [np.zeros(0, np.int64)]
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = _signed(xxhash.xxh64(source).intdigest())
                found = {(h, name if body is None else body) for h, _, _, body in Page(source).subtrees}
                names += [body for _, body in found]
                hashes.append(_of_host(host, [h for h, _ in found]))
            yield pa.RecordBatch.from_pydict({"page": pa.array(names, pa.int64()), "hash": pa.array(np.concatenate(hashes))})

    seen = pages.select("host", "html").mapInArrow(hashed, "page bigint, hash bigint").distinct().groupBy("hash").count()
    return seen.where(f"count >= {LEAST_PAGES}").select("hash")


def _templates_by_page(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(page, templates) of the pages that hold templates: no list is longer than its page has subtrees. pages: page, host, html."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hashes = [], [np.zeros(0, np.int64)]
            for page, host, source in zip(*(c.to_pylist() for c in batch.columns)):
                found = {h for h, _, _, _ in Page(source).subtrees}
                names += [page] * len(found)
                hashes.append(_of_host(host, list(found)))
            yield pa.RecordBatch.from_pydict({"page": pa.array(names, pa.int64()), "hash": pa.array(np.concatenate(hashes))})

    found = pages.select("page", "host", "html").mapInArrow(hashed, "page bigint, hash bigint").distinct()
    dealt = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = found.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(dealt, ["hash", "salt"])
    return held.groupBy("page").agg(F.collect_list("hash").alias("templates"))


def extract_main_text(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """Adds text (empty if none) and n_chars (code points) to every page.

    A null html counts as empty, a null or odd url as the host ''. Repeated rows are extracted alike. Existing columns
    named text or n_chars are replaced; an empty table gives an empty table.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))
    hosted = pages.drop("text", "n_chars").withColumns({"__host": host, "__html": F.coalesce(F.col(source), F.lit(""))})
    templates = cut(site_templates(hosted.select(F.col("__host").alias("host"), F.col("__html").alias("html"))))

    def texts(hosts: pa.Array, sources: pa.Array, known: Iterator[np.ndarray]) -> pa.Array:
        out = []
        for host_, text, sorted_ in zip(hosts.to_pylist(), sources.to_pylist(), known):
            page = Page(text)
            names = [x[0] for x in page.subtrees]
            hashes = _of_host(host_, names)
            at = np.searchsorted(sorted_, hashes)
            held = sorted_[np.minimum(at, len(sorted_) - 1)] == hashes if len(sorted_) else np.zeros(len(names), bool)
            out.append(page.main_text(frozenset(compress(names, held))))
        return pa.array(out, pa.string())

    if templates.count() <= BROADCAST_HASHES:
        all_ = pages.sparkSession.sparkContext.broadcast(np.sort(templates.toArrow()["hash"].to_numpy()))

        @arrow_udf("string")
        def extracted(hosts: pa.Array, sources: pa.Array) -> pa.Array:
            return texts(hosts, sources, repeat(all_.value))

        return hosted.withColumn("text", extracted("__host", "__html")).withColumn("n_chars", F.char_length("text").cast("long")).drop("__host", "__html")

    @arrow_udf("string")
    def extracted_with(hosts: pa.Array, sources: pa.Array, lists: pa.Array) -> pa.Array:
        return texts(hosts, sources, (np.sort(np.array(x or [], np.int64)) for x in lists.to_pylist()))

    named = hosted.withColumn("__page", F.xxhash64("__host", "__html"))
    lists = _templates_by_page(named.select(F.col("__page").alias("page"), F.col("__host").alias("host"), F.col("__html").alias("html")), templates)
    dealt = lists.select(F.col("page").alias("__page"), F.col("templates").alias("__templates"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    joined = named.withColumn("__salt", F.floor(F.rand(7) * SALTS).cast("int")).join(dealt, ["__page", "__salt"], "left")
    return joined.withColumn("text", extracted_with("__host", "__html", "__templates")).select(*pages.drop("text", "n_chars").columns, "text", F.char_length("text").cast("long").alias("n_chars"))
