"""Main text of HTML pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Every token has a weight: words mostly positive, tags
mostly negative. A linear scan (Kadane) finds the contiguous region with the greatest sum; blocks
inside it that are not content (menus, adverts, notices, forms, comments) are left out. A class, id or
role says so only if it names the element, not what the element has or lacks, and not if the elements
of that name hold most of the page's text (of its article's, if it marks one); nor if the page's only
marked article is inside and they hold more than stands outside all chrome. Inside a marked article the
whole name must say so. Of several marked articles the one with most words counts, and of an article in
a `main` element that holds less than half of its words, the `main` element.

Weights are learned from labelled pages: those that mark their article themselves (an `article`
or `main` element). Per token kind (tag, or word within an element of some kind) the counts inside
and outside the marked region give a smoothed log ratio. The weights of all pages are one row per
kind, with a fixed list of kinds.

Defined results: null, empty and tagless html: no markup means no blocks to tell apart, so plain
text is the text, and null is empty; pages without any positive token have empty text; cut-off
tags at the end of a page are dropped; repeated rows are extracted one by one; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel.llm.textkit import map_arrow, table

#: Elements by what HTML says of them.
RAW = ("script", "style", "template", "noscript", "textarea", "title", "svg", "iframe", "select", "canvas", "annotation",
       "annotation-xml")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "object", "math", "mfrac", "mi", "mn", "mo", "mover", "mroot",
          "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics")
CHROME = ("nav", "aside", "footer", "header", "form", "menu", "dialog", "button", "head")
ARTICLE = ("article", "main")
#: Parts of class, id and role names that sites use for what is not the article.
CHROME_NAMES = (
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "overlay", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies",
    "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar",
    "widget", "complementary", "contentinfo", "search", "login",
)
#: Parts of names that say nothing about an element beside those.
PLAIN_NAMES = (
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "group", "holder",
    "inner", "item", "items", "left", "link", "links", "list", "module", "outer", "panel", "posts", "right", "row",
    "section", "slot", "stories", "top", "unit", "wrap", "wrapper", "articles",
)
#: A block element opened inside one of these closes it (what HTML's optional end tags mean).
_P_ENDS = frozenset((
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))
KINDS = ("block", "inline", "list", "link", "chrome", "article", "head", "table", "other")
WORDS = ("word", "word_link", "word_list", "word_chrome", "word_heading")
DEFAULT = {  # used where no page is labelled
    "block": -0.5, "inline": -0.2, "list": -0.3, "link": -0.5, "chrome": -1.0, "article": 4.0, "head": -4.0,
    "table": -1.5, "other": -1.0, "word": 1.0, "word_link": -0.5, "word_list": 0.8, "word_chrome": -0.5,
    "word_heading": 1.0,
}
#: Bounds of learned weights. What is chrome is left out anyway: it must not part an article.
BOUNDS = {"word": (0.2, 3.0), "word_heading": (0.2, 3.0), "word_list": (-0.5, 3.0), "word_link": (-1.0, 3.0),
          "word_chrome": (-0.5, -0.1), "chrome": (-1.0, -0.1), "article": (0.5, 6.0)}
TAG_BOUNDS = (-3.0, -0.05)
OUTSIDE = -3.0  # weight of a word outside the article of a page that marks one

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote only opens a value right after an equals sign; elsewhere it is a character like others.
    r"|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>=]++|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*/?>", re.I) for t in RAW}
_CHROME_SET = frozenset(CHROME_NAMES)
_WHOLE_SET = _CHROME_SET.union(PLAIN_NAMES)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_BORDERS = frozenset(_P_ENDS | {"li", "td"})  # an inline end tag does not reach out of these
_CHROME_TAGS = frozenset(CHROME)


#: Names that begin so tell what an element has or lacks; a header of these is its headline.
_MODIFIERS = frozenset(("with", "without", "has", "have", "no", "not", "non", "hide", "show"))
_HEADED = frozenset(("entry", "post", "article", "story", "content"))


def _is_chrome(tag: str, attributes: str, inside_article: bool) -> bool:
    """By the element itself; names are judged by `_names`."""
    return (tag in _CHROME_TAGS and not (tag == "header" and inside_article)) or bool(attributes and _HIDDEN.search(attributes))


def _names(tag: str, attributes: str, inside_article: bool) -> list[tuple[str, bool]]:
    """Names (class, id, role) that mean chrome, and whether the name is the word alone."""
    if not attributes or tag in ("body", "html", "main"):
        return []
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [p.lower() for p in _NAME_PART.findall(name)]
            if not _MODIFIERS.isdisjoint(parts[:-1]):
                continue
            found = _CHROME_SET.intersection(parts)
            if inside_article and not _WHOLE_SET.issuperset(parts):
                continue
            if found and not (found == {"header"} and (inside_article or not _HEADED.isdisjoint(parts))):
                out.append((name, len(parts) == 1))
    return out


def kind_of(tag: str, chrome: bool) -> str:
    if chrome:
        return "chrome"
    if tag in ARTICLE:
        return "article"
    if tag == "a":
        return "link"
    if tag in INLINE:
        return "inline"
    if tag in ("ul", "ol", "li", "dl", "dt", "dd"):
        return "list"
    if tag in ("html", "head", "body", "meta", "link", *RAW):
        return "head"
    if tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot"):
        return "table"
    if tag in _P_ENDS or tag in ("section", "figcaption", "summary"):
        return "block"
    return "other"


class _Names:
    """How many words stand below each chrome name: of the page, and of its marked article."""

    def __init__(self):
        self.total, self.held = [0, 0], ({}, {})
        self.plain = 0  # words of the page outside all chrome
        self.alone: dict[str, bool] = {}
        self.around: set[str] = set()  # names with a marked article below them
        self.marked = False  # an article stands outside all chrome

    def wrong(self) -> set[str]:
        of = int(self.marked)
        return {name for name, n in self.held[of].items() if (2 * n > self.total[of] and not self.alone[name])
                or (not self.marked and name in self.around and n > self.plain)}


def tokens_of(page: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, text, inside a marked article, text is chrome) in page order; a tag has text "".

    Kinds of text are WORDS. A tag that does not end its block has kind inline or link."""
    not_chrome: set[str] = set()
    while True:
        out, names, where = _scan(page, not_chrome)
        wrong = names.wrong() - not_chrome
        if not wrong:
            break
        not_chrome |= wrong  # each turn adds a name of the page
    chosen = _one_article(out, where)
    return [(kind, text, inside and at in chosen, chrome) for (kind, text, inside, chrome), at in zip(out, where)]


def _one_article(out: list, where: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """The places (main element, article; 0 for none) that belong to the page's article."""
    mains, articles = {}, {}
    for (kind, text, inside, chrome), (main, article) in zip(out, where):
        if inside and not chrome and kind in WORDS:
            n = len(text.split())
            mains[main] = mains.get(main, 0) + n
            if article:
                articles[main, article] = articles.get((main, article), 0) + n
    places = set(where)
    best = max(articles, key=lambda k: (articles[k], -k[1]), default=None)
    main = max((m for m in mains if m), key=lambda m: (mains[m], -m), default=0)
    if best is not None and 2 * articles[best] >= mains.get(main, 0):
        return {best}
    return {p for p in places if p[0] == main} if main else places


class _Stack:
    """Open elements, with the places of each tag, so that no question walks through all of them."""

    def __init__(self):
        self.tags: list[tuple[str, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.borders: list[int] = []

    def push(self, tag: str, chrome: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in _BORDERS:
            self.borders.append(len(self.tags))
        self.tags.append((tag, chrome))

    def pop(self) -> tuple[str, bool]:
        tag, chrome = self.tags.pop()
        self.places[tag].pop()
        if tag in _BORDERS:
            self.borders.pop()
        return tag, chrome

    def top(self, *tags: str) -> int:
        """Place of the innermost open element of `tags`, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


def _scan(page: str, not_chrome: set[str]):
    """(tokens, what stands below names, and for every token the main element and article it is in)."""
    out: list[tuple[str, str, bool, bool]] = []
    where: list[tuple[int, int]] = []
    main = article = counted = 0  # numbers of the outermost open ones, and how many there were
    stack = _Stack()
    below: list[tuple[int, list[str], bool]] = []  # elements with chrome names: depth, names, in an article
    tally = _Names()
    chrome = articles = sure = 0  # sure: chrome by the element itself
    by_itself: list[int] = []

    def text(raw: str) -> None:
        if raw:
            if not sure:
                n = len(raw.split())
                tally.plain += 0 if chrome else n
                for of in ((0, 1) if articles else (0,)):
                    tally.total[of] += n
                    for name in {x for _, names, inside in below if inside or not of for x in names}:
                        tally.held[of][name] = tally.held[of].get(name, 0) + n
            if chrome:
                kind = "word_chrome"
            elif stack.top("a") >= 0:
                kind = "word_link"
            elif stack.top(*_HEADINGS) >= 0:
                kind = "word_heading"
            else:
                kind = "word_list" if stack.top("li") >= 0 else "word"
            add(kind, entities.unescape(raw), articles > 0, chrome > 0)

    def add(*token) -> None:
        out.append(token)
        where.append((main, article))

    def pop_to(depth: int) -> None:
        nonlocal chrome, articles, sure, main, article
        while len(stack.tags) > depth:
            tag, was = stack.pop()
            if below and below[-1][0] == len(stack.tags):
                below.pop()
            if by_itself and by_itself[-1] == len(stack.tags):
                by_itself.pop()
                sure -= 1
            chrome -= was
            articles -= tag in ARTICLE and not was
            if tag == "main" and not stack.places["main"]:
                main = 0
            if tag == "article" and not stack.places["article"]:
                article = 0

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue  # comment, doctype or processing instruction
        tag, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            depth = stack.top(tag)
            # An inline end tag does not reach out of its block.
            if depth >= 0 and not (tag in INLINE and stack.borders and stack.borders[-1] > depth):
                was, inside, at_end = chrome > 0, articles > 0, (main, article)
                pop_to(depth)
                out.append((kind_of(tag, was), "", inside, was))
                where.append(at_end)
            continue
        if tag in _P_ENDS:
            depth = stack.top("p")
            if depth >= 0 and stack.top("table", "td", "button") < depth:
                pop_to(depth)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            depth = stack.top(*same)
            if depth >= 0 and stack.top("ul", "ol", "dl", "table") < depth:
                pop_to(depth)
        itself = _is_chrome(tag, attributes, articles > 0)
        names = [(x, alone) for x, alone in _names(tag, attributes, articles > 0) if x not in not_chrome]
        was = itself or bool(names)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            add(kind_of(tag, chrome > 0), "", articles > 0, chrome > 0)
            continue
        if tag not in VOID and not attributes.endswith("/"):
            if itself:
                by_itself.append(len(stack.tags))
                sure += 1
            elif names:
                below.append((len(stack.tags), [x for x, _ in names], articles > 0))
                tally.alone |= names
            if tag in ARTICLE and not sure:
                tally.marked |= not (chrome or was)
                tally.around.update(x for _, open_names, _ in below for x in open_names)
            if tag in ARTICLE and stack.top(tag) < 0:
                counted += 1
                main, article = (counted, article) if tag == "main" else (main, counted)
            stack.push(tag, was)
            chrome += was
            articles += tag in ARTICLE and not was
        if tag == "br":
            text(" ")  # white space within its block
        else:
            add(kind_of(tag, was or chrome > 0), "", articles > 0, was or chrome > 0)
    return out, tally, where


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """[first, last) of the contiguous run with the greatest sum; empty if nothing is positive."""
    if len(scores) == 0:
        return 0, 0
    total = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(total[:-1])
    gain = total[1:] - low
    last = len(gain) - 1 - int(np.argmax(gain[::-1]))
    if gain[last] <= 0:
        return 0, 0
    # Ties go to the longest run.
    first = int(np.flatnonzero(total[:last + 1] == low[last])[0])
    return first, last + 1


def scores_of(tokens, weights: dict[str, float]) -> np.ndarray:
    marked = any(inside for _, _, inside, _ in tokens)
    return np.array([
        (len(t.split()) * (OUTSIDE if marked and not inside and not chrome else weights[k])) if k in WORDS
        # Tags of the marked article hardly count: its tables and lists belong to it.
        else max(weights[k], TAG_BOUNDS[1]) if inside else weights[k]
        for k, t, inside, chrome in tokens])


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    tokens = tokens_of(page)
    first, last = best_region(scores_of(tokens, weights))
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        line = " ".join("".join(held).split())
        if line:
            blocks.append(line)
        held.clear()

    for kind, text, _, chrome in tokens[first:last]:
        if kind in WORDS:
            if not chrome:
                held.append(text)
        elif kind == "inline":
            continue
        elif kind != "link":
            close()
    close()
    return "\n".join(blocks)


def _count_kinds(batches):
    counts = {k: [0, 0] for k in (*KINDS, *WORDS)}
    for batch in batches:
        for page in batch.column(0).to_pylist():
            tokens = tokens_of(page or "")
            if any(inside for _, _, inside, _ in tokens):
                for kind, text, inside, _ in tokens:
                    counts[kind][inside] += len(text.split()) if kind in WORDS else 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts)), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (1, 0))],
        names=["kind", "inside", "outside"])


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Weights from all pages that mark their article; one row per kind comes to the driver."""
    rows = (
        map_arrow(pages.select("html"), _count_kinds, "kind string, inside long, outside long")
        .groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    )
    total = [sum(r[c] for r in rows) for c in ("inside", "outside")]
    if not all(total):
        return dict(DEFAULT)
    weights = dict(DEFAULT)
    for r in rows:
        if r["inside"] + r["outside"] < 50:
            continue
        ratio = np.log((r["inside"] + 1) / (total[0] + 1)) - np.log((r["outside"] + 1) / (total[1] + 1))
        # Words score positive and tags negative; how much, the labelled pages say.
        weights[r["kind"]] = float(np.clip(ratio, *BOUNDS.get(r["kind"], TAG_BOUNDS)))
    return weights


def _extract_rows(batches, weights):
    for batch in batches:
        texts = [extract(page, weights) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page (page_id, url, html)."""
    weights = weights or learn_weights(pages)
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return map_arrow(
        narrow, lambda it: _extract_rows(it, weights), "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
