"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 11).

A page is parsed into block elements, each with the text that stands directly in it. Every node gets features
of its tag, its attribute tokens, its depth, the density of text, links and marks in its subtree, what its nearest telling
ancestor is, and how it stands among its siblings; they are computed for all nodes of a batch at once, level by level. The trees
(those of the quality operator) give each node the odds that its subtree is main text.

Decoding is hierarchical: a node's subtree is kept whole, dropped whole, or split, and then its children decide. From the leaves
up, the best of the three by summed log-odds is found (a split costs something), and from the root down it is
taken. So nothing inside a kept or dropped subtree can contradict it, and one doubtful paragraph doesn't break an article.

There are no labelled pages. The trees learn from a bounded sample of pages (`max_pages`, those with the smallest hash of their id): in each, the
article or main element, or else the element with most running text, is taken as main text, without parts whose tag or
attributes say otherwise; and from each, two pages of another layout are put together from its sentences, with
other containers and with menus, headers, sidebars, notices, adverts, forms and reader comments, whose labels are known.

Defined results: a null or empty page, or one without main text, gives an empty text; character references are decoded as
browsers do; any run of white space in a block, `br` too, is one space; blocks stand in page order with an empty line between them; repeated
pages give equal texts; an unclosed comment or script goes to the end of the page, and so does a tag that never ends;
nesting of any depth is walked without recursion; a very long page needs memory in proportion; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, in_arrow
from .quality import Forest, fit

#: Pages are worked on together up to this many characters.
GROUP_CHARS = 1 << 20
#: Log-odds that a split of a subtree costs.
SPLIT_COST = 1.5
MOST_ODDS = 4.0

# Classes of elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never part of a text: what isn't shown, controls, and what stands in for scripts.
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes svg math select option button textarea datalist object canvas audio video map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl li dt dd".split())
TABLES = frozenset("table thead tbody tfoot tr td th caption".split())
MAIN_TAGS = frozenset("article main".split())
SIDE_TAGS = frozenset("nav aside footer header form dialog menu fieldset".split())
#: A start tag of the key ends an open element of the value, up to the nearest of the scope.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "body": ({"head"}, set())}
P_SCOPE = frozenset("table td th caption button object template".split())

# Words of class, id and role that tell parts of a page apart.
SIDE_WORDS = frozenset("ad ads adv nav menu header masthead footer foot sidebar aside rail form login search notice gdpr cookie cookies consent popup modal overlay banner promo sponsor share social related recommended comment comments disqus respond reply replies discussion breadcrumb breadcrumbs pager pagination widget toolbar newsletter subscribe signup skip navigation complementary contentinfo hidden".split())
SIDE_STARTS = ("advert", "sponsor", "navbar", "navig", "comment", "cookie", "footer", "sidebar", "subscri", "promo", "banner", "breadcrumb", "recommend", "newsletter", "disclaim", "toolbar", "widget")
MAIN_WORDS = frozenset("article content main post entry story body text prose blog news document".split())

FEATURES = (
    "paragraph", "heading", "list", "table", "side_tag", "main_tag", "side_words", "main_words", "nearest", "nearest_gap", "side_above", "main_above", "depth", "chars", "own_chars", "link_share", "chars_a_tag",
    "marks_a_char", "word_length", "elements", "children", "share_of_page", "share_of_parent", "siblings", "place", "same_tag", "before_chars", "after_chars", "parent_link_share", "paragraph_chars", "controls",
)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+|=)*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|aria-label|itemprop|hidden|data-y)\b(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]*+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_MARK = re.compile(r"[.,!?;:。，]")


@dataclass
class Page:
    """Elements in order of their start tags, without inline ones, and blocks of text with the element they stand in."""

    tags: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    side: list[int] = field(default_factory=list)
    main: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)  # 0 or 1 where the page says so, else -1
    controls: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links


def attribute_words(attributes: str) -> tuple[int, int, int]:
    """How many words speak for a side part and for main text, and the label if there is one."""
    side = main = 0
    label = -1
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "data-y":
            label = int(value)
            continue
        for word in {w.lower() for w in _WORDS.findall(value if name != "hidden" else "hidden")}:
            if word in SIDE_WORDS or word.startswith(SIDE_STARTS):
                side += 1
            elif word in MAIN_WORDS:
                main += 1
    return side, main, label


def parse(html: str) -> Page:
    page = Page()
    page.tags.append("#page"), page.parent.append(-1), page.depth.append(0), page.side.append(0), page.main.append(0), page.label.append(-1), page.controls.append(0)
    stack: list[tuple[str, int]] = [("#page", 0)]  # tag and element; inline and hidden tags stand for the element around them
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    shut = links = in_links = 0  # hidden and link elements that are open; characters of links in the open block
    held: list[str] = []

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else 0

    def flush() -> None:
        nonlocal in_links
        if held:
            text = " ".join("".join(held).split())
            if text:
                page.blocks.append((stack[-1][1], text, in_links))
            held.clear()
            in_links = 0

    def add(text: str) -> None:
        nonlocal in_links
        if shut or not text:
            return
        if "&" in text:
            text = entities.unescape(text)
        held.append(text)
        if links:
            in_links += len(text)

    def close(down_to: int) -> None:
        """Pop the stack to a length."""
        nonlocal shut, links
        while len(stack) > down_to:
            tag = stack[-1][0]
            if tag not in INLINE and tag not in HIDDEN:
                flush()
            stack.pop()
            places[tag].pop()
            shut -= tag in HIDDEN
            links -= tag == "a"

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        found = _TAG.match(html, start)
        if found is None:
            after = html[start + 1 : start + 3]
            if html.startswith("<!--", start):
                add(html[at:start])
                end = html.find("-->", start + 2)
                at = size if end < 0 else end + 3
            elif after[:1] in ("!", "?") or after[:1] == "/" and len(after) > 1:
                add(html[at:start])
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            elif after[:1].isascii() and after[:1].isalpha():  # no tag ends from here on
                add(html[at:start])
                break
            else:
                add(html[at : start + 1])
                at = start + 1
            continue
        add(html[at:start])
        at = found.end()
        ends, tag, attributes = found[1], found[2].lower(), found[3]
        if ends:
            if tag == "br":
                held.append(" ")
            elif place := last(tag):
                if tag not in INLINE or place > max((last(t) for t in P_SCOPE), default=0):
                    close(place)
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                held.append(" ")
            elif tag == "input":
                page.controls[stack[-1][1]] += 1
            continue
        if tag in IMPLIED:
            open_tags, scope = IMPLIED[tag]
            place = max(map(last, open_tags))
            if place > max(map(last, scope), default=0):
                close(place)
        if tag not in INLINE and tag not in HIDDEN and (place := last("p")) and place > max(map(last, P_SCOPE)):
            close(place)
        node = stack[-1][1]
        if tag in HIDDEN:
            page.controls[node] += tag in ("select", "button", "textarea")
            shut += 1
        elif tag in INLINE:
            links += tag == "a"
        elif not shut:
            flush()
            side, main, label = attribute_words(attributes) if attributes else (0, 0, -1)
            page.tags.append(tag), page.parent.append(node), page.depth.append(page.depth[node] + 1), page.side.append(side), page.main.append(main)
            page.label.append(label if label >= 0 else page.label[node]), page.controls.append(0)
            node = len(page.tags) - 1
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else size
    close(1)
    flush()
    return page


@dataclass
class Nodes:
    """Elements of several pages one after the other, each page's first being its root."""

    page: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]  # elements by depth
    own: np.ndarray  # characters directly in each
    has: np.ndarray  # whether there is text in the subtree
    x: np.ndarray
    label: np.ndarray


def down(levels: list[np.ndarray], parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over subtrees."""
    out = values.astype(float)
    for level in reversed(levels[1:]):
        np.add.at(out, parent[level], out[level])
    return out


def describe(pages: list[Page]) -> Nodes:
    """Features of all elements; the root of a page is its own parent."""
    sizes = np.array([len(p.tags) for p in pages])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    page = np.repeat(np.arange(len(pages)), sizes)
    joined = lambda name: np.array([v for p in pages for v in getattr(p, name)])
    parent = np.maximum(joined("parent"), 0) + first[page]
    depth, tags, n = joined("depth"), [t for p in pages for t in p.tags], len(page)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
    _, code = np.unique(np.array(tags), return_inverse=True)
    is_in = lambda group: np.fromiter((t in group for t in tags), float, n)
    at = np.array([first[k] + b[0] for k, p in enumerate(pages) for b in p.blocks], np.int64)
    texts = [b[1] for p in pages for b in p.blocks]
    sums = lambda values: np.bincount(at, np.fromiter(values, float, len(texts)), n) if len(texts) else np.zeros(n)
    own, own_link = sums(map(len, texts)), sums(b[2] for p in pages for b in p.blocks)
    own_words, own_marks = sums(t.count(" ") + 1 for t in texts), sums(len(_MARK.findall(t)) for t in texts)
    chars, linked, words, marks, elements = (down(levels, parent, v) for v in (own, own_link, own_words, own_marks, np.ones(n)))
    side_tag, main_tag, side, main = is_in(SIDE_TAGS), is_in(MAIN_TAGS), joined("side"), joined("main")
    para = (code == code[tags.index("p")]).astype(float) if "p" in tags else np.zeros(n)
    para_chars, controls = down(levels, parent, np.where(para > 0, own, 0)), down(levels, parent, joined("controls"))
    telling = np.where((side_tag > 0) | (side > 0), -1, np.where((main_tag > 0) | (main > 0), 1, 0))
    nearest, gap, side_above, main_above = telling.copy(), np.zeros(n), (telling < 0).astype(float), (telling > 0).astype(float)
    for level in levels[1:]:
        up, silent = parent[level], telling[level] == 0
        nearest[level] = np.where(silent, nearest[up], telling[level])
        gap[level] = np.where(silent, gap[up] + 1, 0)
        side_above[level] += side_above[up]
        main_above[level] += main_above[up]
    inner = np.flatnonzero(parent != np.arange(n))
    children = np.bincount(parent[inner], minlength=n).astype(float)
    by_parent = inner[np.lexsort((inner, parent[inner]))]  # siblings in order
    starts = np.searchsorted(parent[by_parent], parent[by_parent])
    place, before, after = np.zeros(n), np.zeros(n), np.zeros(n)
    place[by_parent] = np.arange(len(by_parent)) - starts
    same = parent[by_parent][1:] == parent[by_parent][:-1]
    before[by_parent[1:]] = np.where(same, chars[by_parent[:-1]], 0)
    after[by_parent[:-1]] = np.where(same, chars[by_parent[1:]], 0)
    kinds, kind = np.unique(parent * (code.max() + 1) + code, return_inverse=True)
    alike = np.bincount(kind, minlength=len(kinds))[kind].astype(float)
    share = lambda a, b: a / np.maximum(1, b)
    x = np.column_stack(
        (
            para, is_in(HEADINGS), is_in(LISTS), is_in(TABLES), side_tag, main_tag, side, main, nearest, gap, side_above, main_above, depth, np.log1p(chars), np.log1p(own), share(linked, chars), np.log1p(share(chars, elements)),
            share(marks, chars), share(chars, words), np.log1p(elements), children, share(chars, chars[first[page]]), share(chars, chars[parent]), children[parent], share(place, children[parent]), share(alike, children[parent]), np.log1p(before), np.log1p(after),
            share(linked, chars)[parent], share(para_chars, chars), share(controls, elements),
        )
    )
    return Nodes(page, parent, levels, own, chars > 0, x, joined("label"))


def decode(nodes: Nodes, probability: np.ndarray) -> np.ndarray:
    """Which elements' own text is kept: subtrees whole, or split where that is worth its cost."""
    p = np.clip(probability, 1e-9, 1 - 1e-9)
    odds = np.where(nodes.has, np.clip(np.log(p / (1 - p)), -MOST_ODDS, MOST_ODDS), 0.0)
    whole = down(nodes.levels, nodes.parent, odds)
    split = np.where(nodes.own > 0, np.maximum(odds, 0), 0.0) - SPLIT_COST
    best = np.zeros(len(p))
    for k, level in reversed(list(enumerate(nodes.levels))):
        best[level] = np.maximum(np.maximum(whole[level], 0), split[level])
        if k:
            np.add.at(split, nodes.parent[level], best[level])
    keep, open_, kept = whole >= np.maximum(split, 0), split > np.maximum(whole, 0), np.zeros(len(p), bool)
    state = np.where(open_, 0, np.where(keep, 1, -1))  # split, kept, dropped
    for k, level in enumerate(nodes.levels):
        if k:
            above = state[nodes.parent[level]]
            state[level] = np.where(above == 0, state[level], above)
        kept[level] = (state[level] == 1) | ((state[level] == 0) & (odds[level] > 0))
    return kept


def texts(pages: list[Page], forest: Forest) -> list[str]:
    nodes = describe(pages)
    kept, first = decode(nodes, forest.score(nodes.x)), np.concatenate(([0], np.cumsum([len(p.tags) for p in pages])))
    return ["\n\n".join(text for node, text, _ in p.blocks if kept[first[k] + node]) for k, p in enumerate(pages)]


def settle(page: Page, inside: list[bool]) -> None:
    """Label elements by whether the text in their subtree is main text; those that hold both kinds, or none, stay without."""
    nodes = describe([page])
    chars, good = (down(nodes.levels, nodes.parent, v) for v in (nodes.own, np.where(inside, nodes.own, 0)))
    page.label = [1 if c and g == c else 0 if c and not g else -1 for c, g in zip(chars, good, strict=True)]


def teach(page: Page) -> None:
    """Label a page's elements by its article or main element, or by the one with most running text."""
    if not page.blocks:
        return
    nodes = describe([page])
    spoken = [bool(page.side[k]) or page.tags[k] in SIDE_TAGS for k in range(len(page.tags))]
    hidden = spoken[:]
    for k in range(1, len(hidden)):
        hidden[k] = hidden[k] or hidden[page.parent[k]]
    tops = [k for k, t in enumerate(page.tags) if t in MAIN_TAGS and not hidden[k]]
    if not tops:
        run = np.zeros(len(page.tags))
        for node, text, links in page.blocks:
            if not hidden[node] and page.tags[node] in ("p", "div", "section", "td", "#page", "body"):
                run[page.parent[node] if page.tags[node] == "p" else node] += len(text) - links
        tops = [int(run.argmax())]
    chars = down(nodes.levels, nodes.parent, nodes.own)
    top = max(tops, key=lambda k: chars[k])
    inside = [False] * len(page.tags)
    for k in range(len(page.tags)):
        inside[k] = not spoken[k] and (k == top or k > top and inside[page.parent[k]])
    settle(page, inside)


_WRAPS = ("article", "main", "article class='post'", "div class='content'", "div id='main-content'", "div class='entry-body'", "section class='story'", "div class='articleText'", "div", "section", "div role='main'")
_SIDES = {
    "menu": ("nav", "ul class='menu'", "div id='navigation'", "div class='nav-links'", "div role='navigation'"),
    "header": ("header", "div class='site-header'", "div id='masthead'"),
    "footer": ("footer", "div class='footer'", "div id='page-footer'", "div role='contentinfo'"),
    "sidebar": ("aside", "div class='sidebar'", "div id='right-rail'", "aside class='related'", "div class='widget'"),
    "notice": ("div class='cookie-notice'", "div id='gdpr-consent'", "dialog", "div class='notice'", "section class='banner'"),
    "advert": ("div class='ad'", "div class='advert'", "div class='sponsored'", "aside class='ads'", "div id='ad-top'", "p class='promo'"),
    "form": ("form", "form class='search'", "div class='newsletter-form'", "fieldset"),
    "comments": ("section id='comments'", "div class='comments'", "ol class='commentlist'", "div class='reader-comments'", "section class='discussion'"),
}


def relaid(sentences: list[str], seed: int) -> str:
    """A page of another layout from given sentences; data-y marks main text (1) and side parts (0)."""
    rnd = random.Random(seed)
    pick = lambda: entities.escape(rnd.choice(sentences))
    prose = lambda most: " ".join(pick() for _ in range(rnd.randint(1, most)))
    brief = lambda: " ".join(pick().split()[: rnd.randint(1, 4)])

    def side(kind: str) -> str:
        opening = rnd.choice(_SIDES[kind])
        if kind == "menu" or kind in ("footer", "header", "sidebar") and rnd.random() < 0.5:
            inner = "".join(f"<li><a href='#'>{brief()}</a></li>" for _ in range(rnd.randint(2, 8)))
            inner = inner if opening.startswith("ul") else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f"<label>{brief()}</label><input name='q'><p>{brief()}</p><button>{brief()}</button>"
        elif kind == "comments":
            item = "li" if opening.startswith("ol") else "div class='comment'" if rnd.random() < 0.5 else "div"
            inner = ("" if opening.startswith("ol") else f"<h2>{brief()}</h2>") + "".join(f"<{item}><b>{brief()}</b><p>{prose(5)}</p></{item.split()[0]}>" for _ in range(rnd.randint(1, 6)))
        else:
            inner = rnd.choice((lambda: f"<p>{prose(3)}</p>", lambda: prose(2), lambda: f"<h3>{brief()}</h3><p>{prose(2)}</p>", lambda: f"{brief()} <a href='#'>{brief()}</a>"))() if not opening.startswith("p") else prose(2)
        name, _, more = opening.partition(" ")
        return f"<{name} data-y=0 {more}>{inner}</{name}>"

    def block() -> str:
        roll = rnd.random()
        if roll < 0.72:
            return f"<p>{prose(6)}" + ("</p>" if rnd.random() < 0.7 else "")
        if roll < 0.8:
            return f"<h2>{brief()}</h2>"
        if roll < 0.87:
            return "<ul>" + "".join(f"<li>{prose(2)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>"
        if roll < 0.92:
            return f"<blockquote><p>{prose(3)}</p></blockquote>"
        if roll < 0.96:
            return "<table>" + "".join(f"<tr><td>{brief()}</td><td>{brief()}</td></tr>" for _ in range(rnd.randint(2, 4))) + "</table>"
        return f"<figure><img src='x'><figcaption>{brief()}</figcaption></figure>" if roll < 0.98 else f"<p>{brief()} <a href='#'>{pick()}</a> {prose(2)}</p>"

    parts = [f"<h1 data-y=1>{brief()}</h1>"] if rnd.random() < 0.8 else []
    parts += [block() for _ in range(rnd.randint(1, 14))]
    for kind in ("advert", "comments", "form", "sidebar", "notice"):
        if rnd.random() < 0.2:
            parts.insert(len(parts) if kind == "comments" else rnd.randint(1, len(parts)), side(kind))
    wrap = rnd.choice(_WRAPS)
    body = "".join(parts)
    body = f"<{wrap} data-y=1>{body}</{wrap.split()[0]}>"
    around = ["header", "menu", "notice", "advert", "sidebar"]
    before, after = [side(k) for k in around if rnd.random() < 0.4], [side(k) for k in (*around[2:], "comments", "form", "footer") if rnd.random() < 0.35]
    if rnd.random() < 0.3:
        body = f"<div class='{rnd.choice(('container', 'row', 'wrapper', 'page'))}'>{body}{after.pop() if after else ''}</div>"
    if rnd.random() < 0.1:
        body = ""  # a page without main text
    elif rnd.random() < 0.1:
        before, after = [], []
    return f"<!doctype html><html><head><title>{brief()}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def examples(html: str, seed: int, relaid_pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page's elements and of those of pages put together from it."""
    page = parse(html)
    teach(page)
    pages = [page]
    sentences = [s for node, text, _ in page.blocks if page.label[node] == 1 for s in re.split(r"(?<=[.!?]) ", text)]
    for k in range(relaid_pages if sentences else 0):
        made = parse(relaid(sentences, seed * 31 + k))
        settle(made, [y == 1 for y in made.label])
        pages.append(made)
    nodes = describe(pages)
    known = nodes.has & (nodes.label >= 0)
    return nodes.x[known], nodes.label[known]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, max_pages: int = 300, relaid_pages: int = 2, **options) -> Forest:
    """Fit on elements of at most max_pages pages and of relaid_pages put together from each; the driver gets their features only."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"), F.lit(0).alias("all")).where("id IS NOT NULL AND length(html) > 0")
    keys = bounded_sample(rows.select("id", "all"), "id", ["all"], max_pages).select("id").distinct()
    sample = rows.join(F.broadcast(keys), "id").groupBy("id").agg(F.min("html").alias("html")).select(F.xxhash64("id").alias("key"), "html")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = examples(html, key, relaid_pages)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(y), pa.int64()), pa.array(y.astype(np.int32)), *(pa.array(x[:, j].astype(float)) for j in range(len(FEATURES)))], ["key", "label", *FEATURES])

    schema = "key long, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    made = in_arrow(sample, run, schema).toArrow()
    columns = [made.column(k).to_numpy() for k in range(made.num_columns)]
    table = np.column_stack(columns).astype(float) if made.num_rows else np.zeros((0, len(columns)))
    table = table[np.lexsort(table.T[::-1])]  # one order on every run
    return fit(table[:, 2:], table[:, 1], **({"trees": 40, "depth": 5, "rate": 0.2} | options))


def extract(pages: DataFrame, forest: Forest, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The id, the columns of `keep`, text and n_chars of every page."""
    kept = [id_col, *(keep or [])]
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        html, at = batch.column(len(kept)).to_pylist(), 0
        while at < len(html):
            end, size = at, 0
            while end < len(html) and (end == at or size < GROUP_CHARS):
                size += len(html[end] or "")
                end += 1
            found = texts([parse(h or "") for h in html[at:end]], shared.value)
            part = batch.slice(at, end - at)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(kept))), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*(f"c{k}" for k in range(len(kept))), "text", "n_chars"])
            at = end

    schema = ", ".join(f"c{k} {pages.schema[c].dataType.simpleString()}" for k, c in enumerate(kept)) + ", text string, n_chars long"
    made = in_arrow(pages.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], F.col(f"`{html_col}`").cast("string").alias("html")), run, schema)
    return made.withColumnsRenamed({f"c{k}": c for k, c in enumerate(kept)})
