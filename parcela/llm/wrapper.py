"""Main text of pages by wrapper induction.

Pages of one host are aligned by simple tree matching: the trees of two pages
are matched top down so that most nodes of equal label pair up in order. The
page whose elements most pages have is the one the others are aligned with.
Over all aligned pages, text that stays the same belongs to the host's
template. So do recurring lists of links, and short recurring blocks beside the
element that holds most of the running text: their texts differ from page to
page, their place and shape do not. What is left are the slots of the content.

Marks that authors give (an article element, a region named after a menu or an
advert) settle what structure leaves open, such as hosts of few pages. A host
with many pages is dealt into slices of bounded size, each of which induces its
wrapper from all of its pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, small_or_stored

# Pages aligned together.
SLICE_PAGES = 32
# Text is taken for a template if so many different pages have it at one place.
TEMPLATE_PAGES = 4
# A child with this share of the running text leads on to the content; recurring
# blocks beside it with less than the other share are template.
LEADING, BESIDE = 0.6, 0.1
# A block is a list of links if this share of its text is linked.
LINKED = 0.6
# Blocks that may be template by structure. Paragraphs and headings never are.
REGIONS = frozenset("div section ul ol nav aside footer header form table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Up to so many pairs of children are weighed against each other; longer lists
# pair up in order, each child with the next one of equal shape.
MOST_PAIRS = 250_000
# Deeper elements become children of this depth, so that matching stays shallow.
MAX_DEPTH = 60

# Fixed values of HTML: elements without content, with raw content, and those
# that end a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title math object canvas select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
                   "strike strong sub sup time tt u var wbr nobr acronym".split())
# An opening tag of the key's kind ends an open element of the value's kinds.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
ENDS |= {t: {"p"} for t in ("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                            "nav ol pre section table ul").split()}
# Elements in which an implied end stops looking.
SCOPE = frozenset("html body div article section main aside nav header footer table ul ol dl td th form blockquote".split())

BOILERPLATE_TAGS = frozenset("head nav header footer aside form button dialog menu input".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
# Parts of class and id names that mark regions beside the article.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar side aside header masthead footer foot comment comments reply replies respond disqus share sharing social "
    "related recommended recommendations widget toolbar pagination pager search copyright legal disclaimer tags skip".split())

# A quote opens a value only behind an equals sign.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)"
                    r"((?:[^>=]++|=\s*+\"[^\"]*+(?:\"|$)|=\s*+'[^']*+(?:'|$)|=)*+)(?:>|$)", re.S)
_MARK = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_MARKS = frozenset("class id role hidden aria-hidden".split())
_PART = re.compile(r"[a-z]+|\d+")
# Names such as has-sidebar tell what an element holds, not what it is.
_STATE = re.compile(r"(?:has|with|without|no)[-_]")
# Parts of names that tell of content, beside such as tell of something else.
CONTENT_NAMES = frozenset("article body content entry main page post story text".split())
# Running text that makes a region marked by its name the content, if nothing else is.
RESCUE_CHARS = 200
# A slash that belongs to an unquoted value closes nothing.
_VALUE_SLASH = re.compile(r"=\s*[^\s\"'=]+/$")
_SPACE = re.compile(r"\s+")


class Node:
    """An element, or a text if ``text`` is set. ``named`` elements are skipped
    for a part of their class or id alone; ``mixed`` ones have a name of content
    too. A text below MAX_DEPTH has the tag of the article or main element that
    it lost as a parent. ``chars`` and ``linked`` count text."""

    __slots__ = ("label", "tag", "kids", "text", "skip", "named", "mixed", "shape", "chars", "linked", "links")

    def __init__(self, label: str, tag: str = "", text: str | None = None, skip: bool = False):
        self.label, self.tag, self.text, self.skip = label, tag, text, skip
        self.named = self.mixed = False
        self.kids: list[Node] = []
        self.shape = self.chars = self.linked = self.links = 0


def _beside(tag: str, marks: dict[str, str]) -> bool:
    """Whether an element is marked, other than by name, as no part of the article."""
    if tag in BOILERPLATE_TAGS or marks.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    if "hidden" in marks or marks.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("html", "body", "main", "article"):
        # A page's own frame may be named after what it holds; a comment may be an article.
        return tag == "article" and "comment" in _PART.findall(marks.get("class", "").lower())
    return False


def _named_beside(tag: str, marks: dict[str, str]) -> bool:
    """Whether a part of its class or id marks an element as beside the article."""
    if tag in ("html", "body", "main", "article"):
        return False
    names = f"{marks.get('class', '')} {marks.get('id', '')}".lower().split()
    return any(not BOILERPLATE_NAMES.isdisjoint(_PART.findall(n)) for n in names if not _STATE.match(n))


def _mixed(marks: dict[str, str]) -> bool:
    """Whether a class or id has a part that tells of content."""
    return not CONTENT_NAMES.isdisjoint(_PART.findall(f"{marks.get('class', '')} {marks.get('id', '')}".lower()))


def parse(page: str, marked: bool = True) -> Node:
    """Tree of a page. Raw elements and comments are left out; ends that HTML
    lets authors omit are implied. Elements below MAX_DEPTH become childless
    children of that depth; they stay open until their end, and what is in them
    keeps their marks. Not ``marked``: nothing is taken from marks of authors
    but which elements browsers do not show."""
    root = Node("#root", "#root")
    stack = [root]
    # What each open element below MAX_DEPTH passes on: skipped, by name, frame.
    passed: list[tuple[bool, bool, str]] = [(False, False, "")]
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:], passed[i:]

    def add(node: Node) -> None:
        node.skip, node.named = node.skip or passed[-1][0], node.named or passed[-1][1]
        stack[min(len(stack), MAX_DEPTH) - 1].kids.append(node)

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        start = found.start() if found else size
        if start > at:
            add(Node("#text", passed[-1][2], text=page[at:start]))
        if not found:
            break
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            for i in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                # The end of an inline element closes no block around it.
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        closed = found.group(3).endswith("/") and not _VALUE_SLASH.search(found.group(3))
        if tag in RAW:
            if closed and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        ends = ENDS.get(tag)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        marks: dict[str, str] = {}
        for m in _MARK.finditer(found.group(3)) if found.group(3) else ():
            if (name := m[1].lower()) in _MARKS:
                marks.setdefault(name, m[2] or m[3] or m[4] or "")
        node = Node(f"{tag}.{marks['class']}" if marks.get("class") else tag, tag, skip=_beside(tag, marks) if marked else tag == "head")
        node.named = marked and not node.skip and _named_beside(tag, marks)
        node.mixed = node.named and _mixed(marks)
        add(node)
        if tag not in VOID and not found.group(3).endswith("/"):
            deep = len(stack) >= MAX_DEPTH
            frame = "article" if "article" in (tag, passed[-1][2]) else tag if tag == "main" else passed[-1][2]
            passed.append((node.skip, node.named, frame) if deep else (False, False, ""))
            stack.append(node)
            opened[tag] += 1
    return root


class Matcher:
    """Simple tree matching. Sizes of matches depend on the shapes of two trees
    only, so they are remembered by shape."""

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.sizes: dict[tuple[int, int], int] = {}

    def name_shapes(self, node: Node) -> None:
        for kid in node.kids:
            self.name_shapes(kid)
        key = (node.label, *[k.shape for k in node.kids])
        node.shape = self.shapes.setdefault(key, len(self.shapes) + 1)

    def size(self, a: Node, b: Node) -> int:
        """Pairs in the largest match of two trees whose roots pair up."""
        if a.label != b.label:
            return 0
        key = (a.shape, b.shape)
        if key not in self.sizes:
            self.sizes[key] = 1 + sum(self.size(x, y) for x, y in self._aligned(a.kids, b.kids))
        return self.sizes[key]

    def _aligned(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        """Pairs of children, in order, of the largest match."""
        out = []
        # Equal shapes at either end pair up in some largest match.
        i, n, m = 0, len(xs), len(ys)
        while i < n and i < m and xs[i].shape == ys[i].shape:
            out.append((xs[i], ys[i]))
            i += 1
        while n > i and m > i and xs[n - 1].shape == ys[m - 1].shape:
            n, m = n - 1, m - 1
            out.append((xs[n], ys[m]))
        xs, ys = xs[i:n], ys[i:m]
        if len(xs) * len(ys) > MOST_PAIRS:
            return out + _in_order(xs, ys)
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            above, row = rows[-1], [0]
            for j, y in enumerate(ys):
                best = row[j] if row[j] > above[j + 1] else above[j + 1]
                if x.label == y.label:
                    with_both = above[j] + self.size(x, y)
                    best = with_both if with_both > best else best
                row.append(best)
            rows.append(row)
        p, q = len(xs), len(ys)
        while p and q:
            if rows[p][q] == rows[p - 1][q]:
                p -= 1
            elif rows[p][q] == rows[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                out.append((xs[p], ys[q]))
        return out

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Nodes that the largest match of two trees pairs up, parents first."""
        out, waiting = [], [(a, b)]
        while waiting:
            pair = waiting.pop()
            out.append(pair)
            if pair[0].text is None:
                waiting += self._aligned(pair[0].kids, pair[1].kids)
        return out


def _in_order(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    places: dict[int, list[int]] = {}
    for j in range(len(ys) - 1, -1, -1):
        places.setdefault(ys[j].shape, []).append(j)
    out, after = [], -1
    for x in xs:
        later = places.get(x.shape, [])
        while later and later[-1] <= after:
            later.pop()
        if later:
            after = later.pop()
            out.append((x, ys[after]))
    return out


def _clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def _measure(node: Node, in_link: bool = False) -> None:
    """Count the text, linked text and links of every node."""
    if node.text is not None:
        node.chars = len(_clean(node.text))
        node.linked = node.chars if in_link else 0
        return
    for kid in node.kids:
        _measure(kid, in_link or node.tag == "a")
    node.chars = sum(k.chars for k in node.kids)
    node.linked = sum(k.linked for k in node.kids)
    node.links = sum(k.links for k in node.kids) + (node.tag == "a")


def _typical(trees: list[Node]) -> int:
    """The page whose elements most pages have, the first one of several."""
    paths = []
    for tree in trees:
        own, waiting = set(), [(tree, "", 0)]
        while waiting:
            x, path, depth = waiting.pop()
            for kid in x.kids if depth < 6 else ():
                if kid.text is None:
                    own.add(at := f"{path}/{kid.label}")
                    waiting.append((kid, at, depth + 1))
        paths.append(own)
    held = Counter(p for own in paths for p in own)
    # An element that few pages have counts against a page.
    worth = [sum(2 * held[p] - len(trees) for p in own) for own in paths]
    return worth.index(max(worth))


def _beside_content(root: Node, counts: dict[int, list[int]]) -> set[int]:
    """Ids of the elements of the typical page that structure shows to be
    template. ``counts``: pages, text, linked text and links of each element,
    summed over its places on all pages."""
    running = lambda x: counts[id(x)][1] - counts[id(x)][2] if id(x) in counts else 0
    recurs = lambda x: x.tag in REGIONS and id(x) in counts and counts[id(x)][0] >= TEMPLATE_PAGES
    out: set[int] = set()
    waiting = [root]
    while waiting:
        x = waiting.pop()
        if recurs(x):
            pages, chars, linked, links = counts[id(x)]
            if links >= 3 * pages and linked >= LINKED * chars:
                out.add(id(x))
                continue
        waiting += [k for k in x.kids if k.text is None]
    content: Node | None = root
    while content is not None:
        whole = running(content)
        lead = next((k for k in content.kids if k.text is None and whole and running(k) >= LEADING * whole), None)
        if lead is not None:
            out |= {id(k) for k in content.kids if k is not lead and recurs(k) and running(k) < BESIDE * whole and not _headings(k)}
        content = lead
    return out


def template_nodes(trees: list[Node], contents: list[str]) -> tuple[set[int], set[int]]:
    """Ids of the text nodes that are the same on all aligned pages, and of the
    elements that are template by structure.

    A text is template if at least TEMPLATE_PAGES different pages have text at
    its place and all of it is the same; copies of one page count once.
    """
    if len(set(contents)) < TEMPLATE_PAGES:
        return set(), set()
    matcher = Matcher()
    for tree in trees:
        matcher.name_shapes(tree)
        _measure(tree)
    typical = trees[_typical(trees)]
    texts: dict[int, set[str]] = {}
    places: dict[int, list[Node]] = {}
    pages: dict[int, set[str]] = {}
    counts: dict[int, list[int]] = {}
    seen: set[str] = set()
    for tree, content in zip(trees, contents):
        again = content in seen
        seen.add(content)
        for own, other in matcher.pairs(typical, tree):
            key = id(own)
            places.setdefault(key, []).append(other)
            if own.text is not None:
                texts.setdefault(key, set()).add(_clean(other.text))
                pages.setdefault(key, set()).add(content)
            elif not again:
                sums = counts.setdefault(key, [0, 0, 0, 0])
                for i, more in enumerate((1, other.chars, other.linked, other.links)):
                    sums[i] += more
    fixed = [k for k, t in texts.items() if len(t) == 1 and len(pages[k]) >= TEMPLATE_PAGES]
    beside = _beside_content(typical, counts)
    return {id(node) for k in fixed for node in places[k]}, {id(node) for k in beside for node in places[k]}


def _headings(node: Node) -> list[Node]:
    """The headings in a tree, in page order."""
    out, waiting = [], [node]
    while waiting:
        x = waiting.pop()
        if x.tag in HEADINGS:
            out.append(x)
        else:
            waiting += reversed(x.kids)
    return out


def _has_frame(node: Node, tag: str, named: bool) -> bool:
    """Whether a tree holds a ``tag`` that is not skipped; ``named``: by other than names."""
    waiting = [node]
    while waiting:
        x = waiting.pop()
        if x.skip or x.named and not named:
            continue
        if x.tag == tag:
            return True
        waiting += x.kids
    return False


def _holders(tree: Node) -> set[int]:
    """Ids of the elements marked by name that hold an article or main element."""
    out: set[int] = set()
    # (node, its marked ancestors as a linked list)
    waiting: list[tuple[Node, tuple | None]] = [(tree, None)]
    while waiting:
        x, above = waiting.pop()
        if x.skip:
            continue
        if x.tag in ("article", "main"):
            if x.named:
                out.add(id(x))  # below MAX_DEPTH, the mark of a former parent
            up = above
            while up and up[0] not in out:
                out.add(up[0])
                up = up[1]
        if x.named:
            above = (id(x), above)
        waiting += [(kid, above) for kid in x.kids]
    return out


def _texts(tree: Node, template: set[int], beside: set[int], frame: str, kept: set[int]) -> list[tuple[bool, str]]:
    """Blocks outside marked regions, and whether they are inside a ``frame``
    element. Inside it, no text is template: articles may share passages."""
    blocks: list[tuple[bool, list[str]]] = []
    # (node, whether it is inside the frame); None ends a block.
    waiting: list[tuple[Node | None, bool]] = [(tree, False)]
    while waiting:
        node, inside = waiting.pop()
        if node is None:
            blocks.append((inside, []))
        elif node.skip and node.tag == "header" and inside and frame:
            # An article's header holds its title.
            for heading in reversed(_headings(node)):
                heading.skip = False
                waiting += [(None, inside), (heading, inside)]
        elif node.skip or node.named and id(node) not in kept or not inside and id(node) in beside:
            continue
        elif node.text is not None:
            inside = inside or bool(frame) and node.tag == frame
            if inside or id(node) not in template:
                if not blocks or blocks[-1][0] != inside:
                    blocks.append((inside, []))
                blocks[-1][1].append(node.text)
        else:
            inside = inside or bool(frame) and node.tag == frame
            if node.tag not in INLINE:
                blocks.append((inside, []))
                waiting.append((None, inside))
            waiting += [(kid, inside) for kid in reversed(node.kids)]
    return [(inside, t) for inside, t in ((i, _clean("".join(b))) for i, b in blocks) if t]


def _frames(tree: Node, frame: str) -> int:
    """Outermost elements ``frame`` that are not skipped."""
    found, waiting = 0, [tree]
    while waiting:
        x = waiting.pop()
        if x.tag == frame and x.text is None and not (x.skip or x.named):
            found += 1
        elif not x.skip:
            waiting += x.kids
    return found


def _rescued(tree: Node) -> set[int]:
    """Regions marked by name that are the content for want of any other: with
    a name of content besides, or with much running text."""
    _measure(tree)
    out, waiting = set(), [tree]
    while waiting:
        x = waiting.pop()
        if x.skip or x.text is not None and x.named:
            continue
        if x.named:
            if not (x.mixed or x.chars - x.linked >= RESCUE_CHARS):
                continue
            out.add(id(x))
        waiting += x.kids
    return out


def main_text(tree: Node, template: set[int], beside: set[int] = frozenset(), marked: bool = True) -> str:
    """Texts outside the template and outside marked regions, block by block: of
    the page's articles if it has any, else of its main element, else of all.
    Several articles that hold less than a third of the text around them are
    teasers, and the text around them counts. If no article lies outside regions
    that are marked by name, such regions are kept if they hold an article or
    main element: a page's wrapper may be named after what it holds besides.
    If nothing is left, regions marked by name alone may be the content."""
    frame, kept = "", set()
    if marked:
        frame = next((t for t in ("article", "main") if _has_frame(tree, t, False)), "")
        kept = _holders(tree) if frame != "article" else set()
        frame = frame or next((t for t in ("article", "main") if _has_frame(tree, t, True)), "")
    found = _texts(tree, template, beside, frame, kept)
    if frame:
        inner, outer = ([t for i, t in found if i == side] for side in (True, False))
        teasers = frame == "article" and 3 * sum(map(len, inner)) < sum(map(len, outer)) and _frames(tree, frame) > 1
        found = [(False, t) for t in (outer if teasers else inner)]
    elif not found and marked and (kept := _rescued(tree)):
        found = _texts(tree, template, beside, "", kept)
    return " ".join(t for _, t in found)


def _extract(page_id: str, marked: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def extract(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_id", "url", "html"], na_position="last")
        contents = group["html"].fillna("").tolist()
        trees = [parse(page, marked) for page in contents]
        template, beside = template_nodes(trees, contents)
        texts = [main_text(tree, template, beside, marked) for tree in trees]
        ids = group["_id"].astype("Int64")
        return pd.DataFrame({page_id: ids, "url": group["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return extract


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, page_id: str = "page_id", slice_pages: int = SLICE_PAGES, marked: bool = True) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for every row of ``pages``
    (page_id, url, html).

    A null html gives the empty text. Rows without url, or with one that has no
    host, form a host of their own. Repeated rows give repeated results. The page
    that the others of a slice are aligned with is the most typical one, of
    several the one of least id. Not ``marked``: the wrapper decides by the
    aligned pages alone, without the marks that authors give.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("_id"), "url", "html", _host(F.col("url")).alias("_host"))
    # A host's number of slices follows from its number of pages.
    counts = rows.groupBy("_host").agg(F.count("*").alias("n")).filter(F.col("n") > slice_pages)
    slices = counts.select(F.col("_host").alias("_large"), F.ceil(F.col("n") / slice_pages).alias("_slices"))
    slices = small_or_stored(materialize(slices, "hosts"))
    placed = rows.join(slices, F.col("_host") == F.col("_large"), "left")
    number = F.pmod(F.xxhash64("_id", "url"), F.coalesce("_slices", F.lit(1)))
    dealt = placed.select("_id", "url", "html", "_host", number.alias("_slice"))
    return dealt.groupBy("_host", "_slice").applyInPandas(
        _extract(page_id, marked), f"{page_id} bigint, url string, text string, n_chars bigint")
