"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; the weight
of a word depends on the element that it stands in, the weight of a tag on its name. A
linear scan finds the contiguous region with the greatest sum, and the words of the region
that stand in an element of the page's frame are left out. A frame element inside an element
that is content by weight or name counts nothing, words and tags, so it does not break the
region around it.

Weights come from labelled pages: pages that mark their article themselves (``article``,
``main`` or ``role=main``) label each of their words as content or frame. On a bounded
sample of ``SAMPLE_PAGES`` pages, those with the smallest hash of their id, words are
counted by element, with the names in ``FRAME_NAMES`` and ``CONTENT_NAMES`` as a prior for
elements that the sample lacks; inside a marked article only a whole name of the frame counts.
An element's class and id count, its kind where it has neither, and an element without any
weight takes that of its parent. Scoring is local to a page.

Text of a region: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by a line feed in page order, empty blocks are left
out. Defined results: NULL and empty pages, and pages without content, have the empty
text; markup that is not closed ends with its parent or the page; repeated rows are read
one by one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 2000
#: Most elements and tags that have a weight of their own.
MOST_WEIGHTS = 4096
#: Words that the prior counts for.
PRIOR = 50
LARGEST_WEIGHT = 4.0

#: Elements whose text is never shown as text.
HIDDEN = ("script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "head", "title", "select", "button", "textarea", "audio", "video", "map", "datalist")
#: Elements whose content is raw text up to their end tag.
RAW = ("script", "style", "textarea", "title", "iframe", "noscript")
#: Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Elements that may stand in a head; any other begins the body.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Elements that decide whether their words are content.
CONTAINERS = frozenset("article aside body details dialog div figure footer form header main menu nav search section span table td ul ol dl".split())
#: Names of elements, classes, ids and roles of a page's frame.
FRAME_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer aside sidebar ad ads adv advert advertisement sponsor sponsored banner promo "
    "cookie cookies consent notice gdpr form search login signup subscribe newsletter comment comments respond disqus reply replies "
    "related commentlist recommended share sharing social breadcrumb breadcrumbs pagination pager popup modal overlay widget toolbar copyright "
    "complementary contentinfo tags dialog".split()
)
#: Words that say where or in what form something stands, not what it is.
LAYOUT_NAMES = frozenset(
    "area bar block bottom box button buttons container content group header icons inline item items left link links list main page "
    "panel right row section site slot top unit wrap wrapper".split()
)
#: Names that mark an article.
CONTENT_NAMES = frozenset("article main content post entry story".split())

RESULT = "string"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECES = re.compile(r"[A-Za-z]+")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def names_of(name: str, more: str) -> list[str]:
    """The name of an element, then its roles, classes and ids as ``name.word``."""
    names = [name]
    if "=" in more:
        for _, *values in _ATTRIBUTE.findall(more):
            names += [f"{name}.{v.lower()}" for v in "".join(values).split()]
    return names


def named(names: list[str], among: frozenset[str]) -> bool:
    """Whether the name or a word of a class, role or id is in the list."""
    if names[0] in among:
        return True
    return any(p.lower() in among for n in names[1:] for p in _PIECES.findall(n.partition(".")[2]))


def framed(names: list[str]) -> bool:
    """Whether the element, or a class, role or id of it as a whole, is named as a part of the frame.

    A class like ``share-price-report`` holds a word of the list but says something else.
    """
    if names[0] in FRAME_NAMES:
        return True
    for name in names[1:]:
        words = {p.lower() for p in _PIECES.findall(name.partition(".")[2])}
        if words & FRAME_NAMES and words <= FRAME_NAMES | LAYOUT_NAMES:
            return True
    return False


class Element:
    __slots__ = ("name", "names", "hidden", "weight", "article", "container", "content", "inset")

    def __init__(self, name: str, names: list[str], parent: Element | None, weights: dict[str, float]):
        self.name, self.names = name, names
        self.hidden = (parent is not None and parent.hidden) or name in HIDDEN
        self.container = name in CONTAINERS or (len(names) > 1 and framed(names))
        marks = named(names, frozenset(("article", "main"))) and name in CONTAINERS
        self.article = marks or (parent is not None and parent.article)
        self.weight = parent.weight if parent else 1.0
        # whether an element around says that it is content, and whether a frame element lies between
        self.content = parent is not None and parent.content
        self.inset = parent is not None and parent.inset
        if self.container:
            own = [weights[n] for n in names if n in weights]
            if name == "header" and parent is not None and parent.article:
                return  # the heading of an article
            # inside an article a word of the list is not enough
            if framed(names) if self.article else named(names, FRAME_NAMES):
                own.append(-1.0)
            elif named(names, CONTENT_NAMES) and not any(n in weights for n in names[1:]):
                own = [1.0]  # a name for content says more than the weight of all elements of its kind
            if own:
                low, high = min(own), max(own)
                self.weight = low if low < 0 else high
                self.inset |= self.content and self.weight <= 0
                # body holds the frame as well, so it says nothing about what stands in it
                self.content |= self.weight > 0 and name != "body"


def tokens(page: str, weights: dict[str, float]) -> Iterator[tuple[str, str, Element]]:
    """``("text", decoded, element)`` and ``("tag", name, element)`` in page order."""
    root = Element("html", ["html"], None, weights)
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and stack[-1].name == "head" and not text.isspace():
            stack.pop()  # text begins the body
        if text:
            yield "text", html.unescape(text), stack[-1]
        if not m:
            return
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            yield "tag", name, stack[-1]
            continue
        if name not in IN_HEAD and stack[-1].name == "head":
            stack.pop()  # the end of head may be left out
        if name not in VOID and not m["more"].endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack[-1].name == name:
                stack.pop()
            stack.append(Element(name, names_of(name, m["more"]), stack[-1], weights))
            if name in RAW:
                close = _RAW_ENDS[name].search(page, at)
                at = close.start() if close else end
        yield "tag", name, stack[-1]


def observed(page: str) -> Counter:
    """Words by ``(element name, is content)`` of a page that marks its article, else nothing."""
    counts: Counter = Counter()
    marked = False
    for kind, value, element in tokens(page, {}):
        if element.hidden:
            continue
        marked |= element.article
        if kind == "tag":
            counts["</" + value, element.article] += 1
            continue
        size = len(value.split())
        if size and element.container:
            # what stands in an element with a class of its own says nothing about its kind
            for name in element.names[1:] or element.names:
                counts[name, element.article] += size
        elif size:
            counts["<" + element.name, element.article] += size
    return counts if marked else Counter()


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Logarithmic odds of content for words by element, and penalties of tags."""
    weights = {}
    for name in {n for n, _ in counts}:
        inside, outside = counts.get((name, True), 0), counts.get((name, False), 0)
        if name.startswith("</"):
            # a tag costs more the more of its kind stand in the frame
            weights[name] = -0.1 - (outside + 1) / (inside + outside + 2)
            continue
        odds = math.log((inside + 1) / (outside + 1))
        support = (inside + outside) / (inside + outside + PRIOR)
        weights[name] = max(-LARGEST_WEIGHT, min(LARGEST_WEIGHT, odds * support))
    return weights


def main_text(page: str, weights: dict[str, float]) -> str:
    """Text of the region with the greatest score."""
    best, best_span, total, start = 0.0, (0, 0), 0.0, 0
    parts: list[tuple[str, bool]] = []  # text or a block's end, and whether it is content
    for kind, value, element in tokens(page, weights):
        if kind == "tag":
            score = 0.0 if element.hidden else weights.get("</" + value, -0.5)
            # inside an article tags cost next to nothing
            score = max(score, -0.05) if element.article else 0.0 if element.inset else score
            text, keep = ("\n" if value in BLOCKS else " " if value == "br" else ""), True
        else:
            if element.hidden:
                continue
            keep = element.weight > 0
            score = len(value.split()) * element.weight
            if element.article or element.inset:
                score = max(score, 0.0)
            text = " ".join(value.split())
            if text:
                text = (" " if value[:1].isspace() else "") + text + (" " if value[-1:].isspace() else "")
            else:
                text = " " if value else ""
        if total <= 0:
            total, start = 0.0, len(parts)
        total += score
        parts.append((text, keep))
        if total > best:
            best, best_span = total, (start, len(parts))
    chosen = "".join(t if k else "\n" for t, k in parts[slice(*best_span)])
    blocks = (" ".join(b.split()) for b in chosen.split("\n"))
    return "\n".join(b for b in blocks if b)


def learned(pages: DataFrame, rows: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from a bounded sample of the pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(observed(page or ""))
        names = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in names], pa.string()), pa.array([i for _, i in names], pa.bool_()), pa.array([total[n] for n in names], pa.int64())],
            names=["name", "inside", "n"],
        )

    # at most ``rows`` ids, chosen before any page is read
    chosen = pages.select("page_id").where(F.col("page_id").isNotNull()).distinct()
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("page_id"), "page_id").limit(rows))
    drawn = pages.join(chosen, "page_id", "left_semi").select(F.col("html").cast("string").alias("html"))
    counts = drawn.mapInArrow(count, "name string, inside boolean, n bigint").groupBy("name", "inside").agg(F.sum("n").alias("n"))
    # whole names are kept or left out, never one of the two counts of a name
    sides = (F.sum(F.when(F.col("inside") == side, F.col("n")).otherwise(0)) for side in (True, False))
    both = counts.groupBy("name").agg(*(n.alias(x) for n, x in zip(sides, ("within", "without"), strict=True)))
    rows_ = both.orderBy(F.desc(F.col("within") + F.col("without")), "name").limit(MOST_WEIGHTS).collect()
    return weights_from({(r["name"], side): r[x] for r in rows_ for side, x in ((True, "within"), (False, "without"))})


def text_column(page: Column, broadcast) -> Column:
    @F.arrow_udf(RESULT)
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = broadcast.value
        for batch in batches:
            yield pa.array([main_text(p, weights) if p else "" for p in batch.to_pylist()], pa.string())

    return extracted(page)


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""
    broadcast = pages.sparkSession.sparkContext.broadcast(learned(pages))
    return pages.select("page_id", "url", text_column(F.col("html").cast("string"), broadcast).alias("text"))
