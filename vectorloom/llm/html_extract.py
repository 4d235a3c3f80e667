"""Operator 8: main text of web pages by inferring a union-free wrapper for each host.

A page becomes a tree of elements and text. Pages of one host are aligned one after another: child lists are matched
by tag and attribute signature; neighbours that repeat become one repeated group, children that some page lacks
become optional, and text that differs between pages becomes a slot, while text that never differs stays a constant
of the template. The result is a regular expression without unions: a tree whose nodes are single, optional or
repeated. The main region is where the wrapper's slots hold most text. Extraction walks a page along its host's wrapper,
keeps the text of the slots in that region and leaves out the constants of the template. Menus, forms and the like are
left out by element and attribute names, which also tell the region where a host has too few pages for a wrapper.

Pages are read by a linear scan, and every tree walk keeps its own stack, so neither depth nor open quotes matter.
"""

from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import Scratch

#: Pages and characters of a share of a host, about; hosts over one share in a broadcast.
SHARE_PAGES, SHARE_CHARS, MOST_BROADCAST = 240, 8_000_000, 200_000
#: Pages that must agree on a text before it is a constant; share of three-word shingles that makes a page a copy.
FIRM, COPY = 3, 0.8
#: Share of an element's slot text that one child must hold for the main region to lie in it; cells of an alignment table.
REGION, CELLS = 0.6, 250_000

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("script style textarea title xmp noembed noframes iframe head template noscript svg math canvas object audio video map select option button input datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
ASIDE = frozenset("nav header footer aside form menu dialog search fieldset".split())
#: Elements that the main region may be.
CONTAINERS = frozenset("html body div main article section center table tbody tr td blockquote figure dl details".split())
#: Element names that an opening tag closes implicitly, with the elements that stop the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
#: Words in class, id or role attributes that name what is no article text.
NAMED_OUT = frozenset(
    "ad ads advert adverts advertisement advertising adslot adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc header masthead topbar footer foot colophon sidebar sidebars aside widget widgets complementary contentinfo "
    "comment comments commentlist discussion disqus replies reply respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search form toolbar skip".split()
)
#: Elements whose attributes may name them out.
NAMEABLE = frozenset("div section span p ul ol li dl table tr td article main ins figure center details blockquote".split())
NAMED_MAIN = frozenset("article content main post entry story body articlebody maincontent postcontent entrycontent articlecontent text".split())

_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: name, attribute signature, children (nodes, or strings for text)."""

    __slots__ = ("children", "name", "sig")

    def __init__(self, name: str, sig: str):
        self.name, self.sig, self.children = name, sig, []


@lru_cache(1 << 14)
def _signature(name: str, attributes: str) -> str:
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return name
    words: list[str] = []
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("hidden", "aria-hidden", "style"):
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                words.append("~hidden")
        else:
            words += _NAME.findall(_CAMEL.sub(" ", value).lower())
    return f"{name} {' '.join(sorted(set(words)))}".rstrip()


class _Open:
    """The stack of open elements, with the places of each name, so that no lookup walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], defaultdict(list), []

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self.stack))
        if node.name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            name = self.stack.pop().name
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)


_KEEPERS = ("article", "main", "body", "table", "td")


def parse(page: str) -> Node:
    """The tree of a page, in time linear in its length. Unclosed elements end with their parent; an unclosed paragraph
    ends where a block begins; end tags without a start are ignored; raw-text elements keep no children. A quote opens
    a value behind an equals sign if it is closed somewhere, else it is a character of the tag."""
    root = Node("", "")
    open_ = _Open(root)
    last_quote = {q: page.rfind(q) for q in "\"'"}
    at, size, text_from = 0, len(page), 0

    def tag_end(at: int) -> tuple[int, int]:
        """End of the attributes and of the tag."""
        while m := _TAG_STOP.search(page, at):
            if m[0] == ">":
                return m.start(), m.end()
            at = m.end()
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and last_quote[m[0]] >= at:
                at = page.index(m[0], at) + 1
        return size, size

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            break
        follow = page[mark + 1 : mark + 2]
        if not (follow.isascii() and follow.isalpha() or follow in ("!", "?", "/")) or not follow:
            at = mark + 1
            continue
        closing = _TAG_NAME.match(page, mark + 2) if follow == "/" else None
        if follow == "/" and not closing and page[mark + 2 : mark + 3].isspace():
            closing = re.compile(r"\s+([a-zA-Z][^\s/>]*)").match(page, mark + 2)
        if mark > text_from:
            open_.stack[-1].children.append(page[text_from:mark])
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
        elif page.startswith("<![CDATA[", mark):
            end = page.find("]]>", mark + 9)
            open_.stack[-1].children.append(_html.escape(page[mark + 9 : size if end < 0 else end], quote=False))
            at = size if end < 0 else end + 3
        elif not follow.isalpha():
            end = page.find(">", mark + 1)
            at = size if end < 0 else end + 1
            if closing:
                name = closing[0].strip().lower()
                place = open_.last((name,))
                # a stray end tag does not reach beyond these
                if place and (name in ("article", "main", "body", "html", "table") or open_.last(_KEEPERS) <= place):
                    open_.cut(place)
        else:
            name = _TAG_NAME.match(page, mark + 1)
            end, at = tag_end(name.end())
            attributes, name = page[name.end() : end], name[0].lower()
            if name in BLOCKS and name != "body" and open_.blocks and open_.stack[open_.blocks[-1]].name == "p":
                open_.cut(open_.blocks[-1])
            if name in CLOSES:
                closed, stop = CLOSES[name]
                while (place := open_.last(closed)) > open_.last(stop):
                    open_.cut(place)
                    if name not in ("tr", "thead", "tbody", "tfoot", "dt", "dd"):
                        break
                    stop = stop | {"dl"}
            node = Node(name, _signature(name, attributes))
            open_.stack[-1].children.append(node)
            if name in RAW:
                m = _raw_end(name).search(page, at)
                end = page.find(">", m.end()) if m else -1
                at = size if end < 0 else end + 1
            elif name not in VOID and not (attributes.endswith("/") and name in ("svg", "path")):
                open_.push(node)
        text_from = at
    if text_from < size:
        open_.stack[-1].children.append(page[text_from:])
    return root


@lru_cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</\s*{name}(?![^\s/>])", re.I)


# --- wrappers -------------------------------------------------------------------------------------------------------

#: A wrapper node is [signature, kind, pages that have it, children]; kind is "" (single), "?" or "+". Text is
#: ["#", kind, pages, constant or None for a slot, characters].


def _squash(text: str) -> str:
    return " ".join(_html.unescape(text).split())


def _of_page(root: Node) -> list:
    """The wrapper of a single element: its children with repeats folded into groups."""
    order, made = [root], {}
    for node in order:  # parents come before their children
        order += [c for c in node.children if not isinstance(c, str) and c.name not in HIDDEN and c.name not in VOID]
    for node in reversed(order):
        children: list[list] = []
        for child in node.children:
            if isinstance(child, str):
                if text := _squash(child):
                    children.append(["#", "", 1, text, len(text)])
            elif child.name not in HIDDEN and child.name not in VOID:
                children.append([child.sig, "", 1, made.pop(id(child))])
        made[id(node)] = _fold(children)
    return made[id(root)]


def _fold(children: list[list]) -> list[list]:
    """Neighbours that repeat become one repeated group; a pair that alternates becomes two."""
    out: list[list] = []
    for child in children:
        if out and out[-1][0] == child[0]:
            out[-1] = _merge(out[-1], child, same_page=True)
        elif len(out) >= 2 and out[-2][0] == child[0] and out[-2][1] == out[-1][1] == "+":
            out[-2] = _merge(out[-2], child, same_page=True)
        elif len(out) >= 3 and out[-2][0] == child[0] and out[-3][0] == out[-1][0]:
            out[-3:] = [_merge(out[-3], out[-1], same_page=True), _merge(out[-2], child, same_page=True)]
        else:
            out.append(child)
    return out


def _top(a: list, b: list, same_page: bool) -> list:
    """Two wrapper nodes of one signature made one, without their children."""
    kind = "+" if same_page or "+" in (a[1], b[1]) else "?" if "?" in (a[1], b[1]) else ""
    pages = max(a[2], b[2]) if same_page else a[2] + b[2]
    return ["#", kind, pages, a[3] if a[3] == b[3] else None, a[4] + b[4]] if a[0] == "#" else [a[0], kind, pages, []]


def _merge(a: list, b: list, same_page: bool = False) -> list:
    out = _top(a, b, same_page)
    if a[0] != "#":
        out[3] = align(a[3], b[3])
    return out


def _matches(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Places that match in two lists of signatures: a longest common subsequence, or, where the table for it would be
    too large, each of b with the next of its kind in a."""
    head = 0
    while head < min(len(a), len(b)) and a[head][0] == b[head][0]:
        head += 1
    out = [(k, k) for k in range(head)]
    rows, cols = len(a) - head, len(b) - head
    if rows * cols > CELLS:
        places = defaultdict(list)
        for i in range(head, len(a)):
            places[a[i][0]].append(i)
        at = head
        for j in range(head, len(b)):
            own = places.get(b[j][0], ())
            if (k := bisect_left(own, at)) < len(own):
                out.append((own[k], j))
                at = own[k] + 1
        return out
    table = [[0] * (cols + 1) for _ in range(rows + 1)]
    for i in range(rows - 1, -1, -1):
        row, below = table[i], table[i + 1]
        for j in range(cols - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[head + i][0] == b[head + j][0] else max(below[j], row[j + 1])
    i = j = 0
    while i < rows and j < cols:
        if a[head + i][0] == b[head + j][0]:
            out.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """Two child lists made one: what matches in order is merged, the rest becomes optional."""
    result: list[list] = []
    todo = [(result, a, b)]
    while todo:
        out, a, b = todo.pop()
        i = j = 0
        for x, y in [*_matches(a, b), (len(a), len(b))]:
            out += [_optional(n) for n in a[i:x]]
            out += [_optional(n) for n in b[j:y]]
            if x < len(a):
                out.append(_top(a[x], b[y], False))
                if a[x][0] != "#":
                    todo.append((out[-1][3], a[x][3], b[y][3]))
            i, j = x + 1, y + 1
    return result


def _optional(x: list) -> list:
    return [x[0], x[1] or "?", *x[2:]]


class _Copies:
    """Tells copies and near copies of earlier pages: what copies agree on is no template. Sets of three-word shingles that
    overlap by ``COPY`` share one of the first in one order, so only pages that do are compared."""

    def __init__(self):
        self.sets, self.holders = [], defaultdict(list)

    def fresh(self, text: str) -> bool:
        words = text.split()
        own = set(map(hash, zip(words, words[1:], words[2:], strict=False))) or {hash(tuple(words))}
        first = sorted(own)[: len(own) - math.ceil(COPY * len(own) - 1e-9) + 1]
        if any(len(own & self.sets[k]) >= COPY * len(own | self.sets[k]) for k in {k for h in first for k in self.holders.get(h, ())}):
            return False
        for h in first:
            self.holders[h].append(len(self.sets))
        self.sets.append(own)
        return True


def infer(pages: list[str]) -> dict:
    """The wrapper of pages of one host: {"pages": n, "root": children, "region": children of the main region, or None};
    n counts pages that are no copies."""
    root: list[list] | None = None
    copies, count = _Copies(), 0
    for page in pages:
        tree = parse(page)
        if copies.fresh(_read(tree, None, _main_level(tree)) if page else ""):
            own = _of_page(tree)
            root, count = own if root is None else align(root, own), count + 1
    root = root or []
    return {"pages": count, "root": root, "region": _region(root, count) if count >= FIRM else None, "index": {}}


def _region(root: list[list], pages: int) -> list | None:
    """The children of the wrapper's element that holds the text of its slots: from the root down, as long as one
    container, single or optional, holds the share ``REGION`` of what is there. Links, constants and what is named out
    do not count. Of a wrapper without slots, None."""
    order, volume = [("", root, False)], {}
    for _, children, link in order:
        order += [(c[0], c[3], link or c[0].split()[0] == "a") for c in children if c[0] != "#" and _role(c[0], False, 0) != "out"]
    for _, children, link in reversed(order):
        volume[id(children)] = sum((0 if link or c[3] is not None and c[2] >= FIRM else c[4]) if c[0] == "#" else volume.get(id(c[3]), 0) for c in children)
    at = root
    if not volume[id(root)]:
        return None
    while True:
        inner = [c for c in at if c[0] != "#" and c[1] != "+" and c[0].split()[0] in CONTAINERS and volume.get(id(c[3]), 0) >= REGION * volume[id(at)]]
        if not inner:
            return at
        at = inner[0][3]


# --- extraction -----------------------------------------------------------------------------------------------------


@lru_cache(1 << 14)
def _role(sig: str, inside: bool, level: int) -> str:
    """out, main or neutral (empty), from an element's signature. A header inside the article belongs to it. ``level``
    says what counts as main: 1 article, 2 main, 3 elements named as content, 0 nothing."""
    name, *words = sig.split()
    if "~hidden" in words:
        return "out"
    if name in ASIDE and not (name == "header" and inside):
        return "out"
    if name in NAMEABLE:
        named = NAMED_OUT.intersection(words)
        if named and not (inside and named == {"header"}) and not (name in ("article", "main") and named <= {"header", "form", "search", "toc", "nav", "menu", "sidebar", "aside", "widget"}):
            return "out"
    found = 1 if name == "article" else 2 if name == "main" or "main" in words and name in ("div", "section") else 3 if name in ("div", "section", "td") and NAMED_MAIN.intersection(words) else 0
    return "main" if found and found == level else ""


def _main_level(root: Node) -> int:
    """The strongest kind of main region outside what is named out; 0: none."""
    best, todo = 0, [root]
    while todo and best != 1:
        for child in todo.pop().children:
            if not isinstance(child, str) and child.name not in HIDDEN and child.name not in VOID and _role(child.sig, False, 0) != "out":
                best = next((level for level in (1, 2, 3) if (not best or level < best) and _role(child.sig, False, level) == "main"), best)
                todo.append(child)
    return best


def _link_lists(root: Node) -> set[int]:
    """Lists and tables (by id) whose text is in links, but for a tenth."""
    order, sums, found = [(root, False)], {}, set()
    for node, link in order:
        order += [(c, link or c.name == "a") for c in node.children if not isinstance(c, str) and c.name not in HIDDEN]
    for node, link in reversed(order):
        linked = free = 0
        for c in node.children:
            if isinstance(c, str):
                linked, free = (linked + len(c.strip()), free) if link else (linked, free + len(c.strip()))
            elif id(c) in sums:
                linked, free = linked + sums[id(c)][0], free + sums[id(c)][1]
        sums[id(node)] = linked, free
        if node.name in ("ul", "ol", "dl", "table") and linked and free * 10 <= linked:
            found.add(id(node))
    return found


class _Lookup:
    """Where a wrapper's child list has a signature or a constant, at a place or behind it."""

    def __init__(self, pattern: list[list]):
        self.pattern, self.elements, self.texts = pattern, defaultdict(list), defaultdict(list)
        for k, node in enumerate(pattern):
            if node[0] != "#":
                self.elements[node[0]].append(k)
            elif node[3] is not None and node[2] >= FIRM:
                self.texts[node[3]].append(k)

    def element(self, sig: str, spot: int) -> int | None:
        own = self.elements.get(sig)
        return None if not own else own[k] if (k := bisect_left(own, spot)) < len(own) else own[0]

    def text(self, text: str, spot: int) -> int | None:
        own = self.texts.get(text, ())
        return own[k] if (k := bisect_left(own, spot)) < len(own) else None


def extract(page: str | None, wrapper: dict | None) -> str:
    """The main text of a page along its host's wrapper (or alone, without one).

    Text counts if it lies in the main region. With a wrapper of three pages or more that is its region of slots, where
    the page has text there; else article, main or an element named as content, where the page has one; else the body
    without lists of links. Elements that are menus, headers, footers, sidebars, notices, adverts, forms or comments by
    name never count. Constants of the wrapper are left out: text that is the same on all of its pages, and text of
    optional elements that is the same on three pages or more, unless it stands in one block with text that is no
    constant. A wrapper of fewer than three pages has no constants.
    """
    if not page:
        return ""
    root = parse(page)
    if wrapper and wrapper["pages"] >= FIRM:
        if wrapper["region"] is not None and (text := _read(root, wrapper, 4)):
            return text
        return _read(root, wrapper, _main_level(root))
    return _read(root, None, _main_level(root))


def _read(root: Node, wrapper: dict | None, level: int) -> str:
    """The text of the region that ``level`` says: 1 to 3 see ``_role``, 4 the wrapper's region, 0 the body."""
    lists = _link_lists(root) if not level else ()
    region = wrapper["region"] if level == 4 else None
    blocks: list[str] = []
    buffer: list[tuple[str, bool]] = []  # text, and whether it is an optional constant

    def flush() -> None:
        if buffer:
            if any(text.strip() and not optional for text, optional in buffer) and (text := " ".join(_html.unescape("".join(t for t, _ in buffer)).split())):
                blocks.append(text)
            buffer.clear()

    def lookup(pattern: list | None) -> _Lookup | None:
        if pattern is None:
            return None
        if id(pattern) not in wrapper["index"]:
            wrapper["index"][id(pattern)] = _Lookup(pattern)
        return wrapper["index"][id(pattern)]

    # children still to read, where the wrapper is, its place there, whether inside the region, whether a block
    stack = [[iter(root.children), lookup(wrapper["root"] if wrapper else None), 0, not level or wrapper is not None and region is wrapper["root"], False]]
    while stack:
        frame = stack[-1]
        children, known, spot, inside, block = frame
        child = next(children, None)
        if child is None:
            if block:
                flush()
            stack.pop()
        elif isinstance(child, str):
            if inside:
                text, sometimes = child if buffer else child.lstrip(), False
                if known and known.texts and text.strip() and (k := known.text(_squash(text), spot)) is not None:
                    frame[2], sometimes = k, known.pattern[k][2] < wrapper["pages"]
                    text = text if sometimes else " "
                if text:
                    buffer.append((text, sometimes))
        elif child.name == "br":
            buffer.append((" ", False))
        elif child.name in HIDDEN or child.name in VOID:
            if child.name in BLOCKS:
                flush()
        else:
            below = None
            if known and (k := known.element(child.sig, spot)) is not None:
                below, frame[2] = known.pattern[k][3], k
            role = _role(child.sig, bool(level) and inside, level)
            if child.name in BLOCKS:
                flush()
            if role != "out" and id(child) not in lists:
                stack.append([iter(child.children), lookup(below), 0, inside or role == "main" or region is not None and below is region, child.name in BLOCKS])
    flush()
    return "\n\n".join(blocks)


# --- distribution ---------------------------------------------------------------------------------------------------

_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
OUT_DDL = "page_id long, url string, text string, n_chars long"


def _map_extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and part: all pages of each make the wrapper, and are then read with it."""
    key, waiting = None, []
    out: list[tuple] = []

    def settle() -> Iterator[pa.RecordBatch]:
        wrapper = infer([r[2] for r in waiting if r[2]])
        for row in waiting:
            text = extract(row[2], wrapper)
            out.append((row[0], row[1], text, len(text)))
            if len(out) >= 500:
                yield whole()
        waiting.clear()

    def whole() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
        out.clear()
        return batch

    for batch in batches:
        for host, part, *row in zip(*(batch.column(c) for c in ("host", "part", "page_id", "url", "html")), strict=True):
            host, part, row = host.as_py(), part.as_py(), tuple(x.as_py() for x in row)
            if (host, part) != key:
                yield from settle()
                key = (host, part)
            waiting.append(row)
    yield from settle()
    if out:
        yield whole()


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    The host is the authority part of the url, without user and port, in lower case; a null or strange url gives the
    empty host. A host with more than ``SHARE_PAGES`` pages or ``SHARE_CHARS`` characters is dealt in as many shares by the
    hash of the page id. All pages of a share make its wrapper, and every page is then extracted whole, so a task holds a
    share at once. Null, empty and blank pages have the empty text; n_chars counts code
    points. Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@|:\d*$", ""))
    rows = pages.select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parts = F.greatest(F.ceil(F.count("*") / SHARE_PAGES), F.ceil(F.coalesce(F.sum(F.length("html")), F.lit(0)) / SHARE_CHARS)).cast("int")
    hot = Scratch(pages.sparkSession, "hosts").keep(rows.groupBy("host").agg(parts.alias("parts")).where("parts > 1"))
    hot = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot
    dealt = rows.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    # several partitions for each of a usual shuffle, since whole pages travel
    many = 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = dealt.repartition(many, "host", "part").sortWithinPartitions("host", "part", F.xxhash64("page_id"), "page_id")
    return order.mapInArrow(_map_extract, OUT_DDL)
