"""Main text of web pages from flat text blocks and a small decision tree.

A page is cut at block-level tags into flat blocks of text. Each has a few numbers:
its words and link density, those of the block before and after it, and what its
surroundings say (article, boilerplate element, heading, item). A decision tree
trained on a small labelled table, LABELLED, tells content from the rest.

A class, id or role speaks for an element only if that holds at most half of the
page's words: names on what wraps the whole text are about layout.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements whose content is raw or not text, void elements, and those that don't break a block.
RAW = "script style noscript template textarea title iframe xmp noembed noframes svg"
#: Raw elements whose content is code: without an end tag they reach to the page's end, as in a page cut short.
CODE = "script style"
VOID = "area base br col embed hr img input link meta param source track wbr"
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mspace msub msup msubsup munder mover munderover mmultiscripts mprescripts semantics annotation annotation-xml"
#: Elements and words in class, id and role that mark what isn't the article.
BOILER = "nav footer aside form header menu dialog button select"
BOILER_NAME = "ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu menubar footer header masthead sidebar aside widget breadcrumb breadcrumbs comment comments reply replies discussion disqus cookie cookies consent gdpr notice notices popup modal overlay share sharing social related recommended newsletter subscribe signup login search pagination pager copyright legal disclaimer toolbar tags complementary contentinfo"
ARTICLE_NAME = "article content post entry story main body text"

_RAW, _CODE, _VOID, _INLINE, _BOILER = (frozenset(x.split()) for x in (RAW, CODE, VOID, INLINE, BOILER))
_BOILER_NAME, _ARTICLE_NAME = frozenset(BOILER_NAME.split()), frozenset(ARTICLE_NAME.split())
_HEADINGS, _ITEMS = frozenset(f"h{i}" for i in range(1, 7)), frozenset(("li", "dt", "dd", "td", "th", "option"))
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)""", re.S)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
_TELLS = re.compile(r"class|id|role|hidden|style", re.I)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>][^\s>]*)))?""")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_END_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    boiler: bool
    heading: bool
    item: bool


def _said(attrs: str) -> tuple[set[str], bool]:
    """(words of class, id and role, whether hidden): hidden is the attribute, aria-hidden=true, or the style."""
    names: set[str] = set()
    hidden = False
    if attrs and _TELLS.search(attrs):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                names |= {w.lower() for w in _WORDS.findall(value)}
            elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDING.search(value):
                hidden = True
    return names, hidden


@dataclass
class Element:
    """``article``: 3 an article element, 2 the main one, 1 named like one. ``named``: named like boilerplate."""

    tag: str
    parent: int
    article: int = 0
    boiler: bool = False
    named: bool = False
    hidden: bool = False
    words: int = 0


def _element(tag: str, attrs: str, parent: int, up: Element) -> Element:
    names, hidden = _said(attrs)
    named = bool(names & _BOILER_NAME)
    kind = 3 if tag == "article" else 2 if tag == "main" or "main" in names and not named else int(bool(names & _ARTICLE_NAME) and not named)
    return Element(tag, parent, kind, tag in _BOILER, named, up.hidden or hidden)


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order; character references decoded, white space runs one space."""
    found: list[tuple[str, int, int, int]] = []  # text, words, linked words, element
    elements = [Element("", 0)]
    stack = [0]
    text: list[str] = []
    linked = link_depth = 0
    endless: set[str] = set()
    opened: Counter[str] = Counter()  # elements on the stack by tag

    def flush() -> None:
        nonlocal text, linked
        if text:
            t = _SPACE.sub(" ", "".join(text)).strip()
            at = stack[-1]
            if t and not elements[at].hidden:
                n = len(t.split())
                found.append((t, n, min(n, linked), at))
                elements[at].words += n
        text, linked = [], 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            piece = html.unescape(piece)
            text.append(piece)
            if link_depth:
                linked += len(piece.split())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            if tag in _INLINE:
                continue
            flush()
            if opened[tag]:  # else nothing to close, which a look through the whole stack would find too
                while elements[stack[-1]].tag != tag:
                    opened[elements[stack.pop()].tag] -= 1
                opened[elements[stack.pop()].tag] -= 1
        else:
            if tag in _RAW:
                if tag == "svg" and m[3].rstrip().endswith("/"):
                    continue
                end = _END_RAW[tag].search(page, at) if tag not in endless else None
                if end:
                    at = end.end()
                elif tag in _CODE:
                    at = n
                else:
                    endless.add(tag)  # only its start tag is skipped; later ones have no end either
                continue
            if tag == "br":
                text.append(" ")
            if tag == "a":
                link_depth += 1
            if tag in _INLINE:
                continue
            flush()
            if tag in _VOID:
                continue
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and elements[stack[-1]].tag == tag:
                opened[elements[stack.pop()].tag] -= 1  # its end tag was left out
            elements.append(_element(tag, m[3], stack[-1], elements[stack[-1]]))
            stack.append(len(elements) - 1)
            opened[tag] += 1
            link_depth = 0
    flush()
    return _placed(found, elements)


def _placed(found: list[tuple[str, int, int, int]], elements: list[Element]) -> list[Block]:
    """Blocks with what their elements say, from the outermost in."""
    for e in reversed(elements[1:]):
        elements[e.parent].words += e.words
    total = elements[0].words
    best = max((e.article for e in elements if e.words), default=0)
    article, boiler = [False], [False]
    for e in elements[1:]:
        article.append(article[e.parent] or best > 0 and e.article == best)
        own = e.boiler or e.named and 2 * e.words <= total
        boiler.append(boiler[e.parent] or own and not (e.tag == "header" and article[e.parent]))  # an article's own header stays part of it
    return [Block(t, n, linked, article[at], boiler[at], elements[at].tag in _HEADINGS, elements[at].tag in _ITEMS) for t, n, linked, at in found]


FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "article", "boiler", "heading", "item", "outside"]


def features(bs: list[Block]) -> np.ndarray:
    """A row for each block; ``outside`` says that the page has an article and the block isn't in it."""
    w = np.array([0, *(b.words for b in bs), 0], float)
    d = np.array([0, *(b.linked / b.words for b in bs), 0], float)
    has = any(b.article and not b.boiler for b in bs)
    flags = np.array([[b.article, b.boiler, b.heading, b.item, has and not b.article] for b in bs], float).reshape(-1, 5)
    return np.column_stack([w[1:-1], d[1:-1], w[:-2], d[:-2], w[2:], d[2:], flags]) if bs else np.zeros((0, len(FEATURES)))


@dataclass
class Node:
    """A leaf if ``feature`` is negative; else rows above ``cut`` go to ``above``."""

    feature: int
    cut: float
    content: bool
    below: Node | None = None
    above: Node | None = None


def train(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 2) -> Node:
    """CART by Gini impurity; ties go to the first feature and the least cut."""
    leaf = Node(-1, 0.0, bool(y.mean() >= 0.5) if len(y) else False)
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return leaf
    best, best_cost = None, 2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            up = x[:, f] > cut
            if least <= up.sum() <= len(y) - least:
                cost = sum(2 * s.mean() * (1 - s.mean()) * len(s) for s in (y[up], y[~up]))
                if cost < best_cost - 1e-12:
                    best, best_cost = (f, cut), cost
    if best is None:
        return leaf
    up = x[:, best[0]] > best[1]
    return Node(best[0], float(best[1]), leaf.content, train(x[~up], y[~up], depth - 1, least), train(x[up], y[up], depth - 1, least))


def decide(node: Node, row: np.ndarray) -> bool:
    while node.feature >= 0:
        node = node.above if row[node.feature] > node.cut else node.below
    return node.content


#: The labelled table: a page in each line, its blocks in order. A block is a letter (p paragraph, h heading, i item), its
#: words / those in links, and + (content) or -; before it A if it lies in the article, B if in boilerplate.
LABELLED = """
Bi1/1- Bi1/1- Bi2/2- p14/0- Ah6/0+ Ap48/0+ Ap2/0+ Ap61/1+ p11/0-
Bi1/1- Bi3/3- Ah4/0+ Ap1/0+ Ap37/0+ Ap1/0+ Ap4/0+ Bp12/0-
Bp18/0- Ah9/0+ Ap55/0+ Ap70/4+ ABp22/0- Ap31/0+ ABi2/2- p44/0- p29/0-
Ah5/0+ Ap3/0+ Ai2/0+ Ai3/0+ Ai1/0+ Ap26/0+ Bp30/0- Bp41/0-
Ah3/0+ Ap28/2+ Ap4/4+ Ap33/0+ Ap52/0+ Ai1/1- Ai1/1- Ai2/2-
Ap44/0+ Ap5/5+ Ap39/1+ Ap3/3+ Ap25/0+ Ap6/6- Ap7/7- Ap5/5-
Ah7/0+ Ap60/0+ Ap8/8+ Ap47/3+ Ap4/4- Ap3/3- p33/0- i9/9-
Ah8/0+ Ai4/3- Ai5/4- Ap35/0+ Ap2/2+ Ap58/0+ ABp19/0- Bp2/0-
i1/1- i1/1- i1/1- h5/0+ p34/0+ p46/1+ p8/0+ p51/0+ i2/2- i1/1- p4/0-
p3/3- h7/0+ p41/0+ p5/0+ p38/2+ p44/0+ p3/0- i2/2- i3/3-
i2/2- i1/1- p29/0+ p35/3+ p6/0+ p57/0+ p2/2- p2/0-
i1/1- i2/2- h4/0- i1/1- h6/0+ p24/0+ p62/0+ h3/0+ p48/0+ h2/0- i4/4- i5/5-
p6/5- p7/6- h8/0+ p3/0+ p71/0+ p33/1+ h3/0- i6/6- i7/7- i5/5-
i1/1- i1/1- h9/0+ p66/5+ p27/0+ i5/0+ i4/0+ i7/1+ p39/0+ i1/1- p8/0-
p22/20- p24/21- h4/0+ p30/4+ p45/6+ p37/2+ p19/17- p26/25-
p2/0- i1/1- i1/1- h6/0+ p49/0+ p10/0+ p36/0+ p7/0- i2/2- i1/1-
Bp40/0- Bp26/0- h5/0+ p33/0+ p58/2+ Bp48/0- Bp35/0- Bp51/3-
Bi2/2- Bp20/0- p63/0+ p2/0+ p44/0+ Bp37/0- Bp6/0- Bp9/9-
Bh3/0- Bi4/4- h6/0+ p47/1+ Bp15/0- p32/0+ Bh2/0- Bp28/0- Bp53/0-
i1/1- i1/1- h2/0+ p17/0+ p20/0+ i1/1- i2/2- p2/0-
h2/0+ p13/0+ p16/2+ p19/0+
p17/0+
Ap17/0+
Ap2/0+ Ap1/0+
Ah2/0+ Ap17/0+ Ap18/0+ p19/0-
Ap40/0+ p26/0- p31/0- p12/0-
Ah6/0+ Ap50/0+ Ap5/0+ Ap6/6- Ap7/7-
Ap70/0+ Ap20/0+ Ap5/5- p30/0-
Ah5/0+ Ap61/3+ Ap3/0+ p6/0-
Ap64/0+ Ap9/0+ Ai2/2- Ai2/2- p40/0-
Ap48/5+ Ap24/0+ Ai2/0+ Ap5/5- Bp20/0-
Ah8/0+ Ap8/1+ Ap11/0+ Ai1/1- Ai3/3-
Ap17/0+ Ap7/7+ Ap20/0+
Ap18/0+ Ap19/0+ Ap7/7- Ap6/6- Ap7/7-
"""
_MARK = re.compile(r"(A?)(B?)([phi])(\d+)/(\d+)([+-])")


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and marks of LABELLED's blocks; each page also without what stands before its content, after it, and both."""
    xs, ys = [], []
    for line in LABELLED.strip().split("\n"):
        marks = _MARK.findall(line)
        page = [Block("", int(n), int(linked), bool(a), bool(b), kind == "h", kind == "i") for a, b, kind, n, linked, _ in marks]
        content = np.array([m[5] == "+" for m in marks])
        first, last = int(np.argmax(content)), len(page) - int(np.argmax(content[::-1]))
        for part in sorted({(a, b) for a in (0, first) for b in (last, len(page))}):
            xs.append(features(page[slice(*part)]))
            ys.append(content[slice(*part)])
    return np.concatenate(xs), np.concatenate(ys)


def trained() -> Node:
    return train(*labelled_table())


def main_blocks(page: str | None, tree: Node) -> list[str]:
    bs = blocks(page or "")
    return [b.text for b, row in zip(bs, features(bs)) if decide(tree, row)]


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row: content blocks in page order, joined by a blank line.

    Null and empty pages, and pages without content, give an empty text. Broken
    markup is read as far as it goes. Repeated rows and other columns do no harm.
    """
    tree = tree or trained()
    kind, url = pages.schema["page_id"].dataType.simpleString(), pages.schema["url"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = ["\n\n".join(main_blocks(p.as_py(), tree)) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url {url}, text string, n_chars bigint")
