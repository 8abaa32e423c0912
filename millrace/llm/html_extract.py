"""HTML extraction by equivalence-class template deduction.

Each page is parsed once into markup tokens (an element's start and end, under the elements around it)
and text tokens (a block's text under its elements). Over the pages of a host a token has an occurrence
vector: how often it occurs on each page. Tokens with equal vectors form an equivalence class; a class is
valid if it has several tokens and occurs on enough of the host's pages. Valid classes nest: where an
element's class is valid, so are those of all elements around it, so the classes' markup makes a tree,
each class in a slot of the class above it. That tree is the host's template. A vector is kept as one
number, the exclusive or of a hash of (page, count) over the pages, so that classes come from grouped
aggregation and a host of any size is never in one task. Pages of a host with the same text count once.

Text in valid classes that occur on most pages belongs to the template and goes, in every slot. What is
left fills the slots between the template's markup; a slot is judged as a whole, over all pages of its
host: one that the same few texts fill again and again holds adverts or notices, one outside articles
that is mostly links is a menu, and both go. The rest of a page's main slots, those in articles, else in a
main element, else in the body, is its text. Containers that their own markup names as menus, headers,
footers, sidebars, notices, adverts, forms or comments are left out everywhere; such a name on a
paragraph, heading, cell or list item says nothing.

Occurrence vectors say nothing where there is nothing to compare with: hosts with fewer than LEAST_PAGES
different pages have a template without text, and their slots are judged by what there is.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated
rows give equal results; an empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import spread_join, written

#: A class is valid if it has so many tokens and occurs on so many pages and so large a share of its host's; and with text, on so large a one.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE, TEXT_SHARE = 2, 3, 0.1, 0.5
#: A slot goes that is filled so often, by different texts in at most this share; or whose letters are in links by more than this.
LEAST_FILLED, VARIETY, LINKED = 8, 0.25, 0.6
#: Containers below so many others bound no slots of their own.
DEEPEST = 64

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")

_words = lambda text: frozenset(text.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title")
#: Elements of other namespaces, in which '/>' closes; and those whose content isn't shown as text.
FOREIGN = _words("svg math")
UNSEEN = _words("noscript template iframe svg canvas audio video")
#: What is opened inside these ends nothing outside them, and their closing tag ends all in them.
SCOPES = _words("noscript template iframe canvas audio video object")
BLOCKS = _words("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul")
OUT = _words("nav header footer aside form head menu select button dialog datalist")
ROLES = _words("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar")
#: Words of class and id that name what isn't the article; those of the second set only outside an article; and words that go with them.
NAMED = _words(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup sidebar widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation "
    "footer comment comments disqus respond replies pagination pager login paywall skip"
)
NAMED_OUTSIDE = _words("header masthead topbar toolbar search alert alerts aside meta byline copyright legal")
BESIDE = _words("area bar block body box bottom button buttons column container content form global group icons inner items left link links list main module outer page panel post posts primary right row secondary section site sticky thread top wrap wrapper")
_LAYOUT = _words("has with no without")
_KEPT = _words("html body main article")
#: Elements that hold a line of text, not a slot; their names don't count.
LINES = _words("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot pre blockquote figcaption summary legend address center hr")


def _named(value: str, names: frozenset) -> bool:
    """Whether a class or identifier is a name, alone or with words that go with one."""
    for own in value.lower().split():
        parts = _WORD.findall(own)
        if own in names or any(x in names for x in parts) and all(x in names or x in BESIDE or x.isdigit() for x in parts):
            return True
    return False


def _left_out(tag: str, named: dict[str, str], inside: bool) -> bool:
    if tag in UNSEEN:
        return True
    if tag in OUT:
        return not (inside and tag == "header")
    if not named or tag in _KEPT:
        return False
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").replace(" ", "").lower():
        return True
    if named.get("role", "").lower() in ROLES:
        return True
    if tag in LINES:
        return False
    value = f"{named.get('class', '')} {named.get('id', '')}"
    if _LAYOUT & {*_WORD.findall(value.lower())}:
        return False
    return _named(value, NAMED) or not inside and _named(value, NAMED_OUTSIDE)


@lru_cache(maxsize=1 << 15)
def element(path: int, tag: str, attrs: str, inside: bool) -> tuple[int, bool, bool]:
    """The path of an element (its tag, class, identifier and role, under a path), whether it is left out, and whether it is a main element."""
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    role = named.get("role", "").lower()
    return token(path, f"{tag} {named.get('class', '')} {named.get('id', '')} {role}"), _left_out(tag, named, inside), tag == "main" or role == "main"


class Page:
    """A parsed page.

    blocks: (slots, where, text, letters in links) in page order; slots: the paths of the containers around it, from the outermost;
    where: article, main or body; the path of the block itself comes last. markup: the paths of all elements.
    """

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[tuple[int, ...], str, str, int]] = []
        self.markup: Counter[int] = Counter()
        self._parts: list[str] = []
        self._stack: list[tuple[str, bool, str, int, tuple[int, ...]]] = []  # tag, left out, where, path, slots
        self._opened: dict[str, int] = {}
        self._linked = 0
        self._read(source)

    def _end_block(self) -> None:
        if self._parts:
            text = " ".join(entities.unescape("".join(self._parts)).split())
            if text:
                _, _, where, path, slots = self._stack[-1] if self._stack else ("", False, "body", 0, ())
                self.blocks.append(((*slots, path), where, text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _pop_to(self, i: int) -> None:
        if any(t in BLOCKS and not out for t, out, *_ in self._stack[i:]):
            self._end_block()
        for t, *_ in self._stack[i:]:
            self._opened[t] -= 1
        del self._stack[i:]

    def _open(self, tag: str, attrs: str) -> None:
        stack = self._stack
        if tag in BLOCKS:
            if not (stack and stack[-1][1]):
                self._end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == tag == "li":
                    self._pop_to(i)
                    break
                if stack[i][0] in BLOCKS or stack[i][0] in SCOPES:
                    break
        _, out, where, path, slots = stack[-1] if stack else ("", False, "body", 0, ())
        if tag in VOID:
            if tag == "br" and not out:
                self._parts.append(" ")
            return
        if attrs.endswith("/") and (tag in FOREIGN or self._opened.get("svg") or self._opened.get("math")):
            return
        if not out:
            own, out, main = element(path, tag, attrs, where == "article")
            if tag == "article" and not out:
                where = "article"
            elif where == "body" and main:
                where = "main"
            if tag in BLOCKS:
                path = own
                self.markup[own] += 1
                if tag not in LINES and len(slots) < DEEPEST:
                    slots = (*slots, own)
        self._opened[tag] = self._opened.get(tag, 0) + 1
        stack.append((tag, out, where, path, slots))

    def _close(self, tag: str) -> None:
        stack = self._stack
        for i in range(len(stack) - 1, -1, -1) if self._opened.get(tag) else ():
            if stack[i][0] == tag:
                self._pop_to(i)
                return
            if tag not in BLOCKS and tag not in SCOPES and tag not in FOREIGN and stack[i][0] in BLOCKS:
                return
        if tag == "p":
            self._end_block()

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            end = m.start() if m else n
            if end > at and not (self._stack and self._stack[-1][1]):
                text = source[at:end]
                self._parts.append(text)
                if self._opened.get("a") and any(t[0] == "a" for t in self._stack[-3:]):
                    self._linked += len(text)
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._close(tag)
            elif tag in RAW:
                close = _closing(tag).search(source, at)
                at = close.end() if close else n
            else:
                self._open(tag, m[3] or m[6] or "")
        self._end_block()

    def main(self) -> list[tuple[tuple[int, ...], str, str, int]]:
        """The blocks of the articles, else of the main element, else of the body."""
        for where in ("article", "main"):
            if own := [b for b in self.blocks if b[1] == where or where == "main" and b[1] == "article"]:
                return own
        return self.blocks


@lru_cache(maxsize=8)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE)


def token(path: int, text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(f"{path}\0{text}"), "big", signed=True)


def _keyed(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return own.select("page_id", "url", "html", host.alias("host"), F.xxhash64("url", "html").alias("page"))


_PARSED = "host string, alike long, tokens array<long>, is_text array<boolean>, counts array<int>, own array<long>, slots array<array<long>>, article array<boolean>, links array<int>, letters array<int>, shown array<string>"


def _lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, alike (a hash of the main slots' text); tokens, is_text and counts (how often the page has each); and of the blocks of the main slots their own token, slots, whether in an article, letters in links, letters and text."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike, tokens, texts, counts, sizes = [], [], [], [], []
            own, slots, article, links, shown, depths, blocks = [], [], [], [], [], [], []
            for source in batch.column("html").to_pylist():
                page = Page(source)
                main = page.main()
                found = Counter(token(b[0][-1], b[2]) for b in page.blocks)
                tokens += [*page.markup, *found]
                texts += [False] * len(page.markup) + [True] * len(found)
                counts += [*page.markup.values(), *found.values()]
                sizes.append(len(page.markup) + len(found))
                alike.append(token(0, "\n".join(b[2] for b in main)))
                blocks.append(len(main))
                for around, where, text, linked in main:
                    own.append(token(around[-1], text))
                    slots += around[:-1]
                    depths.append(len(around) - 1)
                    article.append(where == "article")
                    links.append(linked)
                    shown.append(text)
            letters = [len(x) for x in shown]
            cols = [pa.array(alike, pa.int64()), _lists(tokens, sizes, pa.int64()), _lists(texts, sizes, pa.bool_()), _lists(counts, sizes, pa.int32())]
            cols += [_lists(x, blocks, k) for x, k in ((own, pa.int64()), (_lists(slots, depths, pa.int64()), None), (article, pa.bool_()), (links, pa.int32()), (letters, pa.int32()), (shown, pa.string()))]
            names = ["page_id", "url", "host", "alike", "tokens", "is_text", "counts", "own", "slots", "article", "links", "letters", "shown"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("page_id", "url", "host")), *cols], names=names)

    return pages.select("page_id", "url", "host", "html").mapInArrow(each, f"page_id {kind}, url string, {_PARSED}")


def tokens(read: DataFrame) -> DataFrame:
    """host, alike, token, is_text, n: the markup and the text blocks of each different page of a host."""
    once = read.select("host", "alike", F.explode(F.arrays_zip("tokens", "is_text", "counts")).alias("t"))
    return once.groupBy("host", F.col("t.tokens").alias("token"), F.col("t.is_text").alias("is_text"), "alike").agg(F.max("t.counts").alias("n"))


def templates(read: DataFrame) -> DataFrame:
    """A row for each host: host, rows, markup (the elements in its valid classes) and boilerplate (the texts in those on most pages).

    Each token of a class on a share of the pages takes as much of these as pages have on average, so
    that both are no longer than some pages of the host.
    """
    found = tokens(read)
    vectors = found.groupBy("host", "token", "is_text").agg(F.count("*").alias("support"), F.bit_xor(F.xxhash64("alike", "n")).alias("vector"))
    vectors = written(vectors.where(F.col("support") >= LEAST_PAGES), "vectors")
    hosts = read.groupBy("host", "alike").agg(F.count("*").alias("n")).groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").alias("rows"))
    # an element's start and end are two tokens
    classes = vectors.groupBy("host", "support", "vector").agg(F.sum(F.when(F.col("is_text"), 1).otherwise(2)).alias("size"))
    share = F.when(F.col("is_text"), TEXT_SHARE).otherwise(LEAST_SHARE)
    valid = vectors.join(classes.where(F.col("size") >= LEAST_TOKENS), ["host", "support", "vector"]).join(hosts, "host").where(F.col("support") >= F.col("pages") * share)
    own = valid.groupBy("host").agg(F.collect_set(F.when(~F.col("is_text"), F.col("token"))).alias("markup"), F.collect_set(F.when(F.col("is_text"), F.col("token"))).alias("boilerplate"))
    none = F.array().cast("array<long>")
    return hosts.join(own, "host", "left").select("host", "rows", F.coalesce("markup", none).alias("markup"), F.coalesce("boilerplate", none).alias("boilerplate"))


def _slot(block: Column) -> Column:
    """The innermost slot around a block that the template's markup bounds; of a host without one, the innermost container."""
    inner = F.filter(block["slots"], lambda x: F.array_contains("markup", x))
    return F.coalesce(F.try_element_at(inner, F.lit(-1)), F.try_element_at(block["slots"], F.lit(-1)), F.lit(0).cast("long"))


def _left(*columns: str) -> Column:
    """The blocks that aren't the template's own text, with the given columns."""
    return F.filter(F.arrays_zip("own", "slots", *columns), lambda b: ~F.array_contains("boilerplate", b["own"]))


def _emptied(read: DataFrame, hosts: DataFrame) -> DataFrame:
    """hosts with gone, the slots that go, judged by what fills them on the different pages of the host; the texts themselves aren't read."""
    both = spread_join(read.select("host", "alike", "own", "slots", "article", "links", "letters"), hosts, ["host"], "rows")
    blocks = F.transform(_left("article", "links", "letters"), lambda b: F.struct(_slot(b).alias("slot"), b["article"].alias("article"), b["own"].alias("own"), b["links"].alias("links"), b["letters"].alias("letters")))
    each = both.select("host", "alike", F.explode(blocks).alias("b")).select("host", "alike", "b.*")
    texts = each.groupBy("host", "slot", "article", "own").agg(F.count_distinct("alike").alias("n"), F.max("letters").alias("letters"), F.max("links").alias("links"))
    slots = texts.groupBy("host", "slot", "article").agg(F.sum("n").alias("filled"), F.count("*").alias("texts"), F.sum(F.col("letters") * F.col("n")).alias("letters"), F.sum(F.col("links") * F.col("n")).alias("links"))
    again = (F.col("filled") >= LEAST_FILLED) & (F.col("texts") <= VARIETY * F.col("filled"))
    menu = ~F.col("article") & (F.col("links") > LINKED * F.col("letters"))
    gone = slots.where(again | menu).groupBy("host").agg(F.collect_set("slot").alias("gone"))
    return hosts.join(gone, "host", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))


def extract(pages: DataFrame) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""
    read = written(parsed(_keyed(pages)), "parsed")
    hosts = written(_emptied(read, written(templates(read), "templates")), "hosts")
    both = spread_join(read.select("page_id", "url", "host", "own", "slots", "shown"), hosts, ["host"], "rows")
    left = F.filter(_left("shown"), lambda b: ~F.array_contains("gone", _slot(b)))
    return both.select("page_id", "url", F.array_join(F.transform(left, lambda b: b["shown"]), "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
