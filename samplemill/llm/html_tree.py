"""Pages as trees of blocks: a forgiving HTML reader, and alignment of trees by simple tree matching.

Only elements that make blocks become nodes; inline markup is passed over. A node's shape is its label (tag,
class, id) and its children, in which neighbours that match each other well are folded into one, so that a
list of ten links and one of three have the same shape.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

#: Fixed values of HTML: what is inline, has no end tag, holds raw text, or ends another element by starting.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select", "datalist"))}
#: Blocks of running text; without class or id their order and kind is no part of a page's shape.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption address".split())
#: Never the main text, by tag, by role and by a word of class or id.
DROPPED_TAGS = frozenset("head script style noscript template svg math iframe object canvas audio video button select datalist textarea option nav footer aside form dialog menu noframes noembed xmp title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
LAYOUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense announcement banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion search share sharing sidebar signup sitemap skip social sponsor sponsored subnav subscribe subscription tagcloud toolbar topbar widget widgets".split())
#: Parts of longer words that say the same.
LAYOUT_PART = re.compile(r"sidebar|navbar|sidenav|topnav|subnav|cookie|newsletter|breadcrumb|masthead|footer|^ads?(box|slot|unit|space|block|wrap)$|banner$|popup|modal$")
COMMENT_PART = re.compile(r"^comments?(box|form|section|area|wrap)$|comments$")
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus feedback outbrain recommended related replies reply respond responses taboola teaser teasers".split())

DEPTH = 40
#: Elements that are open at once.
OPEN = 512
#: Neighbours of one label are folded where so large a part of their nodes matches.
FOLDED = 0.5

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element. flag: 0, or why it isn't main text: 1 layout words, 2 for good; main: article, main or nothing."""

    __slots__ = ("tag", "parent", "flag", "main", "label", "children", "plain")

    def __init__(self, tag: str, parent: Node | None, label: str, flag: int, main: str, plain: bool):
        self.tag, self.parent, self.label, self.flag, self.main, self.plain = tag, parent, label, flag, main, plain
        self.children: list[Node | int] = []


class Block:
    """A run of text directly in a node; text: its parts with single spaces."""

    __slots__ = ("node", "parts", "linked", "text")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.text = node, [], 0, ""


def attributes(given: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in reversed(list(_ATTRIBUTE.finditer(given)))} if "=" in given else {}


def words_of_name(name: str) -> set[str]:
    return set(_WORD.findall(_CAMEL.sub("-", name).lower()))


def _flag_of(words: set[str]) -> int:
    if words & COMMENT_WORDS or any(map(COMMENT_PART.search, words)):
        return 2
    return int(bool(words & LAYOUT_WORDS) or any(map(LAYOUT_PART.search, words)))


def label_and_flag(tag: str, own: dict[str, str]) -> tuple[str, int, str]:
    """(label, flag, article or main or nothing)."""
    named = f"{own.get('class', '')} {own.get('id', '')}"
    words, role = words_of_name(named) if named != " " else set(), own.get("role", "").lower()
    flag = 2 if tag in DROPPED_TAGS or role in DROPPED_ROLES else _flag_of(words)
    if tag in ("html", "body"):
        flag = 0
    main = next((m for m in ("article", "main") if m in (tag, role)), "article" if own.get("itemprop", "").lower() == "articlebody" else "")
    label = tag if named == " " else f"{tag}.{re.sub(r'[0-9]+', '#', ' '.join(sorted(named.split())))}"
    return label, flag, main


def read_page(page: str) -> tuple[Node, list[Block]]:
    """(root, blocks in page order) of a page; elements that aren't closed, or closed twice, are borne."""
    root = Node("html", None, "html", 0, "", False)
    stack, blocks, at, size = [root], [], 0, len(page)
    block, in_link, hidden, depth = Block(root), False, None, 0
    beyond: dict[str, int] = {}

    def flush() -> None:
        nonlocal block
        if block.parts:
            text = _SPACE.sub(" ", "".join(block.parts)).strip()
            if text:
                block.text = text
                block.node.children.append(len(blocks))
                blocks.append(block)
        block = Block(stack[-1])

    def close_to(k: int) -> None:
        nonlocal hidden
        flush()
        del stack[k:]
        hidden = None
        block.node = stack[-1]

    def innermost(tags: tuple[str, ...], until: tuple[str, ...]) -> int | None:
        """Place in the stack of the outermost of the tags above the innermost of until."""
        found = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in until:
                break
            if stack[k].tag in tags:
                found = k
        return found

    def add(text: str) -> None:
        if text and hidden is None:
            text = html.unescape(text) if "&" in text else text
            block.parts.append(text)
            if in_link:
                block.linked += len(text)

    while at < size:
        found = page.find("<", at)
        if found < 0:
            add(page[at:])
            break
        if found > at:
            add(page[at:found])
        at = found
        mark = page[at + 1 : at + 2]
        if mark == "!" or mark == "?":
            last = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            end = page.find(last, at + 2)
            at = size if end < 0 else end + len(last)
            continue
        m = _TAG.match(page, at) or _OPEN_TAG.match(page, at)
        if m is None:
            if mark.isalpha() or mark == "/":  # a tag that never ends
                close = page.find(">", at)
                if close < 0:
                    break
                at = close + 1
                continue
            add("<")
            at += 1
            continue
        at, closing, tag = m.end(), bool(m[1]), m[2].lower()
        if tag in INLINE:
            if hidden is not None:
                if tag == hidden:
                    depth += -1 if closing else 1
                    if not depth:
                        hidden = None
            elif not closing and "=" in m[3] and label_and_flag(tag, attributes(m[3]))[1] and not m[3].endswith("/"):
                hidden, depth = tag, 1
            if tag == "a" and hidden is None:
                in_link = not closing
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "img":
                add("")
            continue
        if closing:
            if beyond.get(tag):
                beyond[tag] -= 1
                flush()
                continue
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), None)
            if k is not None:
                close_to(k)
            else:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in ("html", "body") and len(stack) < 3 and any(n.tag == tag for n in stack[1:] or [root]):
            continue
        if tag == "html":
            continue
        if tag in ENDS_P:
            k = innermost(("p",), ("button", "td", "th", "caption", "object", "template"))
            if k is not None:
                close_to(k)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                close_to(len(stack) - 1)
        if tag in ENDS:
            k = innermost(*ENDS[tag])
            if k is not None:
                close_to(k)
        if tag == "body":  # ends a head that was left open
            k = next((k for k in range(1, len(stack)) if stack[k].tag == "head"), None)
            if k is not None:
                close_to(k)
        own = attributes(m[3])
        label, flag, main = label_and_flag(tag, own)
        flush()
        node = Node(tag, stack[-1], label, flag, main, label == tag)
        stack[-1].children.append(node)
        if not (m[3].endswith("/") and tag not in ENDS_P and tag not in ENDS):
            if len(stack) < OPEN:
                stack.append(node)
            else:  # its text stands in the one around it
                beyond[tag] = beyond.get(tag, 0) + 1
        block.node = stack[-1]
        hidden = None
    flush()
    return root, blocks


def lines_of(node: Node) -> Iterator[Node]:
    """The node and those around it."""
    while node is not None:
        yield node
        node = node.parent


def wanted_blocks(blocks: list[Block]) -> tuple[list[int], bool]:
    """Blocks that their own and the surrounding elements don't rule out; whether the page has an article.

    With articles, only what stands in one counts; an article inside another is a reader's comment. A header
    counts inside an article only. Layout words (a body or column "with-sidebar") don't rule out the one article there is.
    """
    around: dict[int, tuple[int, bool, bool, bool]] = {}

    def judged(node: Node | None) -> tuple[int, bool, bool, bool]:
        """(flag, in an article, in a main element, in an article inside an article) of a node with what is around it."""
        if node is None:
            return 0, False, False, False
        path = []
        while node is not None and id(node) not in around:
            path.append(node)
            node = node.parent
        got = around[id(node)] if node is not None else (0, False, False, False)
        for n in reversed(path):
            flag, article, main, nested = got
            if n.tag == "header" and not (article or main):
                flag = max(flag, 2)
            got = around[id(n)] = (max(flag, n.flag), article or n.main == "article", main or n.main == "main", nested or (article and n.tag == "article"))
        return got

    said = [judged(b.node) for b in blocks]
    for limit in (0, 1):
        for place in (1, 2):
            found = [k for k, s in enumerate(said) if s[0] <= limit and s[place] and not s[3]]
            if found:
                return found, True
    return [k for k, s in enumerate(said) if not s[0]], False


class Shape:
    """A folded node: label, children, pages it was seen on; into: the shape that it was merged into."""

    __slots__ = ("label", "children", "pages", "into", "number")

    def __init__(self, label: str, children: list[Shape] | None = None, pages: int = 1):
        self.label, self.children, self.pages, self.into, self.number = label, children or [], pages, None, -1

    def found(self) -> Shape:
        shape = self
        while shape.into is not None:
            shape = shape.into
        return shape

    def nodes(self) -> Iterator[Shape]:
        """In page order, parents first."""
        stack = [self]
        while stack:
            shape = stack.pop()
            yield shape
            stack += reversed(shape.children)


def matched(a: Shape, b: Shape, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two shapes of one label: most pairs of nodes that keep label, parent and order, and which children are paired."""
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    left, right = a.children, b.children
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(right):
            top = max(row[j], above[j + 1])
            if x.label == y.label:
                top = max(top, above[j] + matched(x, y, memo)[0])
            row[j + 1] = top
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    memo[key] = 1 + best[-1][-1], pairs[::-1]
    return memo[key]


def merge(a: Shape, b: Shape, memo: dict | None = None) -> None:
    """Merge b into a, of the same label: paired children are merged, others of b put between a's in order."""
    memo = {} if memo is None else memo
    work = [(a, b)]
    while work:
        a, b = work.pop()
        pairs = dict((j, i) for i, j in matched(a, b, memo)[1])
        a.pages, b.into = a.pages + b.pages, a
        children, upto = [], 0
        for j, y in enumerate(b.children):
            if j in pairs:
                children += a.children[upto : pairs[j] + 1]
                upto = pairs[j] + 1
                work.append((a.children[pairs[j]], y))
            else:
                children.append(y)
        a.children = children + a.children[upto:]
        memo.pop((id(a), id(b)), None)


def size_of(shape: Shape) -> int:
    return sum(1 for _ in shape.nodes())


def fold(children: list[Shape]) -> list[Shape]:
    """Neighbours of one label that match well, merged into the first of them."""
    out: list[Shape] = []
    for shape in children:
        if out and out[-1].label == shape.label:
            last = out[-1]
            if not last.children and not shape.children:
                shape.into = last
                continue
            if (last.children or shape.children) and matched(last, shape, {})[0] >= FOLDED * max(size_of(last), size_of(shape)):
                pages = last.pages
                merge(last, shape)
                last.pages = pages
                continue
        out.append(shape)
    return out


def shape_of(root: Node) -> tuple[Shape, dict[int, Shape]]:
    """(the page's shape, shape by id of a node). What lies deeper than DEPTH belongs to the shape there."""
    order, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        order.append((node, depth))
        stack += [(c, depth + 1) for c in reversed(node.children) if isinstance(c, Node)]
    made: dict[int, Shape] = {}
    held: dict[int, list[Shape]] = {}
    for node, depth in reversed(order):
        if depth > DEPTH:
            continue
        below = held.pop(id(node), [])[::-1]
        flow = node.plain and node.tag in FLOW and not below
        own = made[id(node)] = Shape("flow" if flow else node.label, fold(below))
        if node.parent is not None:
            held.setdefault(id(node.parent), []).append(own)
    for node, depth in order:
        if depth > DEPTH:
            made[id(node)] = made[id(node.parent)]
    return made[id(root)], made


def written_shape(shape: Shape, counted: bool = False) -> str:
    """As JSON: [label, children], or [label, pages, children]."""

    def plain(s: Shape) -> list:
        return [s.label, s.pages, [plain(c) for c in s.children]] if counted else [s.label, [plain(c) for c in s.children]]

    return json.dumps(plain(shape), separators=(",", ":"), ensure_ascii=False)


def read_shape(text: str, pages: int = 1) -> Shape:
    def shape(x: list) -> Shape:
        return Shape(x[0], [shape(c) for c in x[-1]], x[1] if len(x) == 3 else pages)

    return shape(json.loads(text))


def numbered(shape: Shape) -> Shape:
    for k, s in enumerate(shape.nodes()):
        s.number = k
    return shape


def aligned(wrapper: Shape, shape: Shape) -> list[int]:
    """For each node of shape, in its order, the number of the wrapper's node that it matches; -1 for none."""
    place = {id(s): k for k, s in enumerate(shape.nodes())}
    out, work, memo = [-1] * len(place), [(wrapper, shape)], {}
    while work:
        a, b = work.pop()
        out[place[id(b)]] = a.number
        work += [(a.children[i], b.children[j]) for i, j in matched(a, b, memo)[1]]
    return out
