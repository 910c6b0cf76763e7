"""Main-text extraction from HTML by tree scoring.

A tolerant reader turns a page into a tree of elements (void elements, optional end tags, raw-text elements, stray end tags).
Elements that are navigation, scripts, forms and the like by their tag, or hidden, are left out.
Every paragraph then gives points for its length and its commas to its parent and, halved from one to the next, to all higher
ancestors; an element's points are discounted by the share of its text that stands in links.  The element with the most points
is the container, or the article or main element that it is a part of; its siblings that score like it, or are paragraphs of running
text, are kept with it.  What stands there is written out block by block.

Names are weighed against text.  A class, id or role that names an unwanted part (sidebar-content, footer-text) takes nine tenths of an
element's points, and what of it does not hold the container is left out.  The name of an element says nothing where the element holds most of
the page's text outside of links (class="legal-opinion" around the article), where another of its names is one of wanted parts alone
("content sidebar-right"), or where it says what stands beside ("with-sidebar").  On a page whose article or main element has a tenth of the text
or more, names decide for what is in it and beside it.  Readers' comments may hold most of a page: they go
all the same, with the article elements in them, unless the page has hardly any other text.  A form or header that holds most of the text is the
page's frame.  A header goes outside of articles and stays, with their headline, inside.  Reading takes time in proportion to the page, whatever it
holds.

Defined cases: a null or empty page gives an empty text; a page without any paragraph gives the text of its body; equal pages get
equal texts; an empty table gives an empty result; further columns are not looked at.  A page's memory is a
few times its size; pages are read one at a time.
"""

from __future__ import annotations

import bisect
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
#: Elements whose content is never main text.
DROPPED = frozenset("script style noscript iframe template svg math canvas object embed audio video form button select "
    "option input textarea label fieldset nav footer aside head title menu dialog map applet noembed noframes".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
#: A start tag on the left ends an open element on the right.
CLOSES_P = BLOCK - frozenset("body html tbody td tfoot th thead tr caption li dd dt".split())
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": (
    "td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th",
    "tbody", "thead"), "thead": ("tr", "td", "th")}
#: Where looking for an open element to end stops.
SCOPE = {"li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
    "tbody": ("table",), "tfoot": ("table",), "thead": ("table",), "option": ("select",)}
#: Parts of class, id and role names of what is not main text.
UNWANTED = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|menus|breadcrumb\w*|sidebar|side|rail|aside|widget\w*|footer|foot|topbar|comment|comments|commentlist|disqus|respond|replies|reply|discussion|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|toolbar|pagination|pager|search|hidden|skip|legal|copyright|disclaimer|tags?|toc|contentinfo|complementary|alert)(?=$|[-_\s])", re.I)
#: Of these, those of readers' comments.
REMARK = re.compile(r"(?:^|[-_\s])(?:comment|comments|commentlist|disqus|respond|replies|reply|discussion)(?=$|[-_\s])", re.I)
WANTED = re.compile(r"(?:^|[-_\s])(?:article|body|content|entry|main|post|story|text|hentry)(?=$|[-_\s])", re.I)
#: A name of wanted parts alone.
ONLY_WANTED = re.compile(r"(?:^|\s)(?:article|body|content|entry|main|post|story|text|hentry)(?:[-_](?:article|body|content|entry|main|post|story|text|hentry|area|wrapper|inner|page|single))*(?=$|\s)", re.I)
#: Tags that are left out unless they are the frame of a page.
FRAME = frozenset("form header fieldset".split())
#: What is left of the points of an element with an unwanted name.
DOUBT = 0.1
#: Names that say what an element has beside its content, not what it is.
ABOUT = re.compile(r"(?:^|\s)(?:has|with|without|no|is|show|hide)[-_]\S*", re.I)
HEADER = re.compile(r"(?:^|[-_\s])(?:header|masthead)(?=$|[-_\s])", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true",
    re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: What may begin at a "<"; and a run within a tag, up to its end, a value or the end of the page.
OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: A slash that ends a tag, not one of an unquoted value.
CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
INSIDE = re.compile(r"""[^>=]*(?:(>)|=\s*(["']?)|\Z)""")


class Element:
    __slots__ = ("tag", "parent", "children", "skip", "named", "remark", "frame", "inside", "names", "points", "rank")

    def __init__(self, tag: str, parent: Element | None, skip: bool = False, named: bool = False, names: str = ""):
        self.tag, self.parent, self.names = tag, parent, names
        #: Left out; named like an unwanted part, or like readers' comments; left out unless it is the page's frame.
        self.skip, self.named, self.remark, self.frame = skip, named, named and bool(REMARK.search(names)), False
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main") and not parent.named)
        self.children: list[Element | str] = []
        self.points = self.rank = 0.0


def unwanted(tag: str, attributes: str, within_article: bool) -> tuple[bool, bool, str]:
    """Whether an element is left out, whether its names are those of an unwanted part, and its class, id and role."""
    if tag in DROPPED and tag not in FRAME:
        return True, False, ""
    out = tag in FRAME and not (tag == "header" and within_article)
    if not attributes or tag in ("html", "body"):
        return out, False, ""
    names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes))
    if HIDDEN.search(attributes):
        return True, False, names
    what = ABOUT.sub(" ", names) if names else ""
    if what and REMARK.search(what):
        return out, True, names
    named = tag not in ("article", "main") and (UNWANTED.search(what) or not within_article and HEADER.search(what)) and not ONLY_WANTED.search(what)
    return out, bool(what and named), names


class Tags:
    """The comments, declarations and tags of a page from left to right, each place looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.open_quotes = page, set()

    def end(self, at: int) -> int:
        """Where the tag whose name ends at `at` ends; -1 if it doesn't.  A quoted value that never ends is taken as it is."""
        page = self.page
        while True:
            m = INSIDE.match(page, at)
            at = m.end()
            if m[1]:
                return at
            if m[2] is None:
                return -1
            if m[2] and m[2] not in self.open_quotes:
                close = page.find(m[2], at)
                if close >= 0:
                    at = close + 1
                else:
                    self.open_quotes.add(m[2])

    def next(self, at: int) -> tuple[int, int, str, str | None, str]:
        """The next one from `at` on: where it starts and ends, "/" for an end tag, its name (None if it is no tag), its attributes."""
        page = self.page
        m = OPENING.search(page, at)
        if not m:
            return len(page), len(page), "", None, ""
        if m[1]:
            close = page.find("-->", m.end() - 2)
            return m.start(), close + 3 if close >= 0 else len(page), "", None, ""
        if m[2]:
            close = page.find(">", m.end())
            return m.start(), close + 1 if close >= 0 else len(page), "", None, ""
        end = self.end(m.end())
        if end < 0:  # no tag ends from here on
            return len(page), len(page), "", None, ""
        return m.start(), end, m[3], m[4].lower(), page[m.end() : end - 1]


def parse(page: str) -> Element:
    """The tree of a page."""
    root = Element("html", None)
    path = [root]  # the open elements
    places: dict[str, list[int]] = {}  # where in path each tag is open
    walls: list[int] = []  # where blocks other than p are open
    tags, at, low = Tags(page), 0, None
    if "<" not in page:
        root.children.append(page)
        return root

    def enter(e: Element) -> None:
        places.setdefault(e.tag, []).append(len(path))
        if e.tag in BLOCK and e.tag != "p":
            walls.append(len(path))
        path.append(e)

    def leave(place: int) -> None:
        """Ends the open elements from a place on."""
        while len(path) > place:
            e = path.pop()
            places[e.tag].pop()
            if walls and walls[-1] == len(path):
                walls.pop()

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def first_above(tag: str, place: int) -> int:
        own = places.get(tag) or ()
        i = bisect.bisect_right(own, place)
        return own[i] if i < len(own) else len(path)

    while at < len(page):
        start, end, closing, tag, attributes = tags.next(at)
        if start > at:
            path[-1].children.append(page[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            place = last(tag)
            wall = walls[-1] if walls else 0
            if tag not in BLOCK and (place < wall or place < last("p")):  # a stray inline end tag ends no block
                place = 0
            if place:
                leave(place)
            elif tag in ("br", "p"):
                path[-1].children.append(Element(tag, path[-1]))
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS:
            scope = max((last(t) for t in SCOPE.get(tag, ())), default=0)
            leave(min(first_above(t, scope) for t in ENDS[tag]))
        if tag in CLOSES_P and tag not in ENDS:
            leave(first_above("p", walls[-1] if walls else 0))
        here = path[-1]
        skip, named, names = unwanted(tag, attributes, here.inside or here.tag in ("article", "main") and not here.named)
        new = Element(tag, here, skip, named, names)
        new.frame = skip and tag in FRAME and not HIDDEN.search(attributes)
        here.children.append(new)
        if tag in VOID or CLOSED.search(attributes) and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            low = page.lower() if low is None else low
            close = low.find(f"</{tag}", at)
            if not new.skip:
                new.children.append(page[at : close if close >= 0 else len(page)])
            close = page.find(">", close) if close >= 0 else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        enter(new)
    return root


def elements(root: Element, frames: bool = False) -> list[Element]:
    """Those that are not left out, parents first; with frames: what may turn out to be a frame too."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        if e.skip and not (frames and e.frame):
            continue
        order.append(e)
        stack += [c for c in reversed(e.children) if isinstance(c, Element)]
    return order


def texts_of(order: list[Element]) -> dict[int, tuple[int, int, int]]:
    """Of each element, by id: characters, of these in links, and commas.  The order has parents first."""
    texts: dict[int, tuple[int, int, int]] = {}
    for e in reversed(order):
        chars = linked = commas = 0
        for c in e.children:
            if isinstance(c, str):
                n = len(c) if not c.isspace() else 0
                chars, commas = chars + n, commas + c.count(",")
            elif id(c) in texts:
                a, b, n = texts[id(c)]
                chars, linked, commas = chars + a, linked + b, commas + n
        texts[id(e)] = (chars, chars if e.tag == "a" else linked, commas)
    return texts


def settle(root: Element) -> None:
    """Weighs names and frames against the text that elements hold."""
    order = elements(root, frames=True)
    texts = texts_of(order)
    free = {k: chars - linked for k, (chars, linked, _) in texts.items()}
    whole = free[id(root)]
    within: set[int] = set()  # comments and what is in them
    remarks, main = 0, 0
    for e in order:
        if e.parent is not None and id(e.parent) in within:
            within.add(id(e))
        elif e.remark:
            within.add(id(e))
            remarks += free[id(e)]
    if remarks > 50 * (whole - remarks):  # a page of comments alone
        for e in order:
            e.named = e.named and not e.remark
            e.remark = False
        within, remarks = set(), 0
    for e in order:
        if e.tag in ("article", "main") and id(e) not in within and not e.inside:
            main = max(main, free[id(e)])
    for e in order:
        if id(e) in within:
            e.skip = e.skip or e.remark
            continue
        most = 2 * free[id(e)] > whole - remarks
        if e.frame and most:
            e.skip = e.frame = False
        # a part of an article, or beside one, is what its name says
        semantic = 10 * main >= whole - remarks
        if e.named and (most and not e.inside and not semantic or any_main(e, free, whole - remarks)):
            e.named = False
        e.skip = e.skip or e.named and semantic


def any_main(e: Element, free: dict[int, int], total: int) -> bool:
    """Whether an article or main element with most of the text stands in e."""
    if 2 * free[id(e)] <= total:
        return False
    stack = [e]
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, Element) and 2 * free.get(id(c), 0) > total:
                if c.tag in ("article", "main") and not c.named:
                    return True
                stack.append(c)
    return False


def measure(root: Element) -> list[Element]:
    """Gives every paragraph's points to its ancestors, half as many to the next and half of that on; returns the elements with points, best first."""
    order = elements(root)
    texts = texts_of(order)
    given: dict[int, float] = {}  # points that an element gets, by element; its parent gets half of them
    for e in order:
        inner = any(isinstance(c, Element) and not c.skip and c.tag in BLOCK for c in e.children)
        paragraph = e.tag in PARAGRAPH and not (inner and e.tag != "p")
        if paragraph or e.tag in ("div", "article", "section", "main", "center") and not inner:
            chars, linked, commas = texts[id(e)]
            if chars:
                up = e.parent if paragraph and e.parent is not None else e
                doubt = DOUBT if e.named and up is not e else 1.0
                given[id(up)] = given.get(id(up), 0.0) + doubt * (commas + chars / 100) * (1 - linked / chars)
    scored = []
    for e in reversed(order):  # children before parents
        if (n := given.get(id(e), 0.0)) > 0:
            e.points = n = n * (DOUBT if e.named else 1.0)
            chars, linked, _ = texts[id(e)]
            e.rank = n * (1 - linked / chars) if chars else 0.0
            if e.names and WANTED.search(e.names):
                e.rank *= 1.25
            scored.append(e)
            if e.parent is not None:
                given[id(e.parent)] = given.get(id(e.parent), 0.0) + n / 2
    return sorted(reversed(scored), key=lambda e: -e.rank)


def blocks(e: Element, out: list[list[str]]) -> None:
    """Appends the text of e to out, a list a block; the last list is open."""
    stack: list = [(e, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0:
            if node.skip:
                continue
            if node.tag in BLOCK:
                out.append([])
            elif node.tag == "br":
                out[-1].append(" ")
        children = node.children
        while i < len(children):
            c = children[i]
            i += 1
            if isinstance(c, str):
                out[-1].append(c)
            else:
                stack.append((node, i))
                stack.append((c, 0))
                break
        else:
            if node.tag in BLOCK:
                out.append([])


def tidy(found: list[list[str]]) -> str:
    texts = (" ".join(html.unescape("".join(b)).split()) for b in found if b)
    return "\n".join(t for t in texts if t)


def written(e: Element) -> str:
    out: list[list[str]] = [[]]
    blocks(e, out)
    return tidy(out)


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    settle(root)
    ranked = measure(root)
    top = ranked[0] if ranked else root
    while top.inside:  # the parts of an article belong to it, the best of them as the others
        top = top.parent
    up = top
    while up is not None:  # what holds the container is not unwanted
        up.named = False
        up = up.parent
    for e in elements(root):
        e.skip = e.named
    if top.parent is None:
        return written(top)
    least, ranks = 0.2 * top.points, {id(e): e.rank for e in ranked}
    out: list[list[str]] = [[]]
    for c in top.parent.children:
        if isinstance(c, str) or c.skip:
            continue
        if c is top or ranks.get(id(c), 0.0) >= least and c.tag != "header":
            keep = True
        elif c.tag in ("p", "blockquote", "pre"):
            text = written(c)
            links = sum(len(written(x)) for x in c.children if isinstance(x, Element) and x.tag == "a")
            keep = links < 0.25 * len(text)
        else:
            keep = c.tag in ("h1", "h2") and top.tag not in ("article", "main")
        if keep:
            blocks(c, out)
            out.append([])
    return tidy(out)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def work(part: pa.RecordBatch):
        texts = [main_text(x) for x in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
            pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return mapped(pages, work, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long", "html")
