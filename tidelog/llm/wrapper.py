"""Main text of web pages by wrapper induction.

Pages of a host share a wrapper. The block trees of a host's pages, menus and all, are aligned by simple tree matching with the
host's skeleton (the trees of all of its pages put together). Every page votes for the texts of its aligned nodes; a text that
stands at a node in nearly all distinct pages that have the node's parent is template, what varies there is a slot. A page's text
is the slots of its main region: the articles or main elements that it names, else the slot that holds nearly all of the host's varying
text. Tags, roles and names of boilerplate decide only about what varies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A host's pages are put together in so many parts by their trees' hashes, then these.
PARTS_OF_HOST = 64
#: A text is template if it is the same at the aligned node of this share of the host's distinct pages, and of at least so many.
SHARE, LEAST = 0.75, 4
#: Share of a host's varying text that the subtree of its main slot has.
SLOT = 0.8
#: Skeletons and templates are broadcast up to this many bytes together; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 8_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike
    strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup mstyle""".split()
)
#: Elements that show no text of their own, or that of a control.
UNSEEN = frozenset(
    "script style noscript template iframe object embed svg canvas audio video map head title link meta annotation button select option datalist input textarea".split()
)
DROP = UNSEEN | frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
#: Words of a class or id that tell of boilerplate outside articles, and parts of a word that do.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion banner
    nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar rail widget widgets footer foot masthead topbar siteheader
    cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay lightbox newsletter subscribe
    subscription signup share sharing social comment comments commentlist disqus reply replies respond discussion related
    recommended recommendations recirculation pagination pager login signin search searchbox toolbar skip paywall copyright
    disclaimer secondary""".split()
)
PARTS = ("sidebar", "cookie", "comments", "advert", "newsletter", "breadcrumb", "footer", "sponsor")
#: Within an article, where a name may as well be a subject: words that tell, if the rest of the name is of the second kind. Those of
#: the third tell only beside another.
WITHIN = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsored comments commentlist disqus newsletter cookie cookies share sharing social".split()
)
BESIDE = frozenset(
    "box wrapper wrap container list block area slot unit inner outer top bottom left right button buttons icon icons link links bar tools toolbar widget".split()
)
SHARING = frozenset("share sharing social".split())
#: Start tags that end an open element of the first kind, as far as a border of the second kind.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
P_BORDER = frozenset("button caption html marquee object table td th template body article section div".split())

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']|"[^"]*"|'[^']*')*)>|[^>]*>)|<[!?/][^>]*>""", re.S)
_open_end = re.compile(r"<[a-zA-Z!?/][^>]*\Z")
_attr = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_names = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "holds")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.holds = tag, attrs, [], False  # kids: nodes and strings; holds: a region is below


def parse(html: str) -> Node:
    """A tree for any input: unknown end tags are skipped, open elements end where HTML ends them implicitly."""
    root = Node("#root", {})
    stack, at, end = [root], 0, len(html)
    find, lower = _token.search, None
    while m := find(html, at):
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ENDS_P:
            _implied(stack, {"p"}, P_BORDER)
        elif tag in ENDS:
            _implied(stack, *ENDS[tag])
        own = m[3][:-1]
        attrs = {a.lower(): b or c or d for a, b, c, d in _attr.findall(own)} if own else {}
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in ("article", "main", "h1") and not _named([
            w.lower() for w in _names.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")
        ]):
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        if tag in RAW and not own.endswith("/"):
            lower = html.lower() if lower is None else lower
            close = lower.find(f"</{tag}", at) if len(lower) == len(html) else html.find(f"</{tag}", at)
            close = end if close < 0 else close
            node.kids.append(html[at:close])
            at = html.find(">", close) + 1 or end
        elif tag not in VOID and not (own.endswith("/") and tag not in ENDS_P):
            stack.append(node)
    if at < end:  # a tag that the page's end cuts off is no text
        stack[-1].kids.append(_open_end.sub("", html[at:]))
    return root


def _implied(stack: list[Node], tags: set[str], border: frozenset | set) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in border:
            return


class Tree:
    """Block tree of a page: an element's tag, its text if it holds no other block, and the blocks below it. A run of text beside
    other blocks is a block with the label #. ``whole`` is a hash of the whole subtree."""

    __slots__ = ("label", "text", "kids", "size", "shape", "whole", "links", "plain", "gone", "home", "id", "chars")

    def __init__(self, label: str, text: str, kids: list[Tree], gone: bool = False, home: int = 0):
        self.label, self.text, self.kids, self.gone, self.home = label, text, kids, gone, home
        self.size = self.shape = self.id = -1
        self.whole, self.links, self.plain, self.chars = 0, 0, False, 0

    def order(self) -> list[Tree]:
        """The nodes, parents before children, in page order."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            out.append(x)
            if x.kids:
                todo += x.kids[::-1]
        return out


def tree_of(html: str | None) -> Tree:
    """The block tree of a whole page, menus and all. ``gone`` marks what is boilerplate by tag, role or name; ``home`` is 1 within
    a main element, 2 within an article, 3 within a headline outside both and 4 within one of a main element."""
    root = parse(html or "")
    top = Tree("#root", "", [])
    parts: list[str] = []
    seen = [0, False]  # links, and text outside links, of the run

    def flush(at: Tree) -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                run = Tree("#", text, [], at.gone, at.home)
                run.links, run.plain = seen
                at.kids.append(run)
            parts.clear()
        seen[0], seen[1] = 0, False

    todo: list = [(k, top, False) for k in reversed(root.kids)]
    while todo:
        item, at, link = todo.pop()
        if item is None:
            flush(at)
            if len(at.kids) == 1 and at.kids[0].label == "#":
                run = at.kids.pop()
                at.text, at.links, at.plain = run.text, run.links, run.plain
            continue
        if type(item) is str:
            parts.append(unescape(item) if "&" in item else item)
            if not link and not seen[1] and any(map(str.isalnum, item)):
                seen[1] = True
            continue
        tag = item.tag
        if tag == "br":
            parts.append(" ")
        elif tag in UNSEEN:
            continue
        elif tag in INLINE:
            if at.gone or not _boiler(item, at.home):
                if tag == "a":
                    seen[0] += 1
                    link = True
                todo += [(k, at, link) for k in reversed(item.kids)]
        else:
            flush(at)
            gone = at.gone or _boiler(item, at.home)
            home = at.home
            if not gone and home < 2:
                main = tag == "main" or item.attrs.get("role", "").lower() == "main"
                home = 2 if tag == "article" else 1 if main else 3 + (home in (1, 4)) if tag == "h1" else home
            block = Tree(tag, "", [], gone, home)
            at.kids.append(block)
            todo.append((None, block, False))
            todo += [(k, block, link) for k in reversed(item.kids)]
    flush(top)
    return top


def _boiler(node: Node, home: int) -> bool:
    """True if an element is boilerplate by itself. home: as of its place in the block tree."""
    tag, a = node.tag, node.attrs
    if tag in DROP:
        return True
    if not a:
        return tag == "header" and not home
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main"):
        return False
    if a.get("role", "").lower() in ROLES:
        return True
    for value in (a.get("class", ""), a.get("id", "")):
        for name in value.split():
            words = [w.lower() for w in _names.findall(name)]
            if not words or words[0] in ("has", "with", "no", "without"):
                continue
            if home == 2:
                if _inner(words):
                    return True
            elif _named(words) and not node.holds:
                return True
            if words in (["header"], ["page", "header"], ["site", "header"], ["top", "header"]) and not home:
                return True
    return tag == "header" and not home


def _named(words: list[str]) -> bool:
    """True if a word of a class or id names boilerplate: it is one of NAMES, holds one of PARTS or ends like topnav."""
    return any(w in NAMES or w.endswith("nav") or any(p in w for p in PARTS) for w in words)


def _inner(words: list[str]) -> bool:
    """Within an article a name tells only if all of its words do: one of WITHIN, the rest of them of BESIDE."""
    return any(w in WITHIN for w in words) and all(w in WITHIN or w in BESIDE or w.isdigit() for w in words) and (words[0] not in SHARING or len(words) > 1)


def chosen(root: Tree, slot: Callable[[], Tree | None] = lambda: None) -> list[Tree]:
    """The blocks with text that are in the page's main region and not boilerplate by themselves, in page order. Region: the
    articles, with the headlines outside if they have none; else the main elements; else what ``slot`` gives, with its headline; else
    all. Of the last two without lists and lines of links."""
    order = root.order()
    texts = [x for x in order if x.text and not x.gone]
    found = {x.home for x in order if not x.gone}
    if 2 in found:
        own = any(x.label == "h1" and x.home == 2 and not x.gone for x in order)
        return [x for x in texts if x.home == 2 or not own and x.home > 2]
    if 1 in found:
        return [x for x in texts if x.home in (1, 4)]
    if texts and (main := slot()) is not None and main is not root:
        inside = {id(x) for x in main.order()}
        if sum(len(x.text) for x in texts if id(x) in inside) * 4 < sum(len(x.text) for x in texts):
            inside = {id(x) for x in order}  # this page's text is elsewhere
        lead = [x for x in texts if x.label == "h1"] or [x for x in texts[: next(
            (i for i, x in enumerate(texts) if id(x) in inside), 0
        )] if x.label == "h2"][-1:]
        inside.update(id(x) for x in lead)
        texts = [x for x in texts if id(x) in inside]
    menus: set[int] = set()
    for x in reversed(order):
        if x.kids:
            x.links, x.plain = sum(k.links for k in x.kids), any(k.plain for k in x.kids)
    for x in order:  # parents come first
        if x.links > 1 and not x.plain and (x.label in ("ul", "ol", "dl") or x.text) and id(x) not in menus:
            menus.update(id(k) for k in x.order())
    return [x for x in texts if id(x) not in menus]


def blocks(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) of each block of the main text in page order, the host's template not yet taken out."""
    return [(x.label, x.text) for x in chosen(tree_of(html))] if html else []


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 or 1


class Matcher:
    """Simple tree matching. Subtrees of equal form (tags only) are one shape, so pairs of shapes are weighed once."""

    #: Shapes and their children held until all are forgotten, and cells of a table that is traced back at once (larger ones are halved).
    SHAPES, FORMS, CELLS = 100_000, 1 << 22, 1 << 23
    #: Cells of a table that is filled without NumPy, which costs more for so few.
    FEW = 500

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.memo: dict[tuple[int, int], int] = {}
        self.forms = 0

    def measure(self, root: Tree, whole: bool = True) -> None:
        """Sets size, shape and (with ``whole``) whole of all nodes."""
        for x in reversed(root.order()):
            self.reshape(x)
            if whole:
                x.whole = digest(f"{x.label}\t{x.text}") if not x.kids else xxhash.xxh3_64_intdigest(
                    x.label.encode() + np.array([k.whole for k in x.kids], np.uint64).tobytes()
                ) >> 1

    def reshape(self, x: Tree) -> None:
        """Sets size and shape of a node whose children have theirs."""
        form = tuple([k.shape for k in x.kids])
        key = (x.label, form)
        shape = self.ids.get(key)
        if shape is None:
            shape = self.ids[key] = len(self.label)
            self.label.append(x.label)
            self.kids.append(form)
            self.size.append(1 + sum([self.size[k] for k in form]))
            self.forms += len(form)
        x.shape, x.size = shape, self.size[shape]

    def forget(self) -> bool:
        """Drops what it knows, if that is much; shapes must be measured anew then."""
        if len(self.ids) + len(self.memo) < self.SHAPES and self.forms < self.FORMS:
            return False
        self.__init__()
        return True

    def _known(self, a: int, b: int) -> int | None:
        if self.label[a] != self.label[b]:
            return 0
        if a == b:
            return self.size[a]
        if not self.kids[a] or not self.kids[b]:
            return 1
        return self.memo.get((a, b))

    def weigh(self, a: int, b: int) -> int:
        """The most pairs of nodes of two shapes that keep tags, ancestry and the order of children."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is not None:
                todo.pop()
                continue
            left, right, both = self._trimmed(self.kids[x], self.kids[y])
            wanted = [(i, j) for i in set(left) for j in set(right) if self._known(i, j) is None]
            if wanted:
                todo += wanted
                continue
            todo.pop()
            self.memo[x, y] = 1 + both + (self._best(left, right) if left and right else 0)
        return self._known(a, b)

    def _trimmed(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], int]:
        """Both without their equal heads and tails, which some best matching pairs, and the size of these."""
        n, a = min(len(left), len(right)), 0
        while a < n and left[a] == right[a]:
            a += 1
        z = 0
        while z < n - a and left[-1 - z] == right[-1 - z]:
            z += 1
        return left[a : len(left) - z], right[a : len(right) - z], sum(self.size[k] for k in (*left[:a], *left[len(left) - z :]))

    def _table(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights of distinct shapes, which of them each of left is, and of right)."""
        (a, i), (b, j) = (np.unique(np.array(x, np.int64), return_inverse=True) for x in (left, right))
        return np.array([[self.weigh(x, y) for y in b.tolist()] for x in a.tolist()], np.int32), i, j

    def _best(self, left: tuple[int, ...], right: tuple[int, ...]) -> int:
        if len(left) * len(right) <= self.FEW:
            before = [0] * (len(right) + 1)
            for x in left:
                now, most = [0], 0
                for j, y in enumerate(right):
                    most = max(most, before[j + 1], before[j] + self._known(x, y))
                    now.append(most)
                before = now
            return before[-1]
        weights, i, j = self._table(left, right)
        if len(left) > len(right):
            weights, i, j = weights.T, j, i
        by_row = weights[:, j]
        best = np.zeros(len(j) + 1, np.int32)
        for x in i.tolist():
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + by_row[x]))
        return int(best[-1])

    def _pairs(self, left: list[Tree], right: list[Tree]) -> list[tuple[Tree, Tree]]:
        """The best matching of two lists of siblings, last first; equal subtrees weigh double."""
        head, n = [], min(len(left), len(right))
        while len(head) < n and left[len(head)].whole == right[len(head)].whole and left[len(head)].shape == right[len(head)].shape:
            head.append((left[len(head)], right[len(head)]))
        out, z = [], 0
        while z < n - len(head) and left[-1 - z].whole == right[-1 - z].whole and left[-1 - z].shape == right[-1 - z].shape:
            z += 1
            out.append((left[-z], right[-z]))
        left, right = left[len(head) : len(left) - z], right[len(head) : len(right) - z]
        if left and right:
            out += self._inner(left, right)
        return out + head[::-1]

    def _inner(self, left: list[Tree], right: list[Tree]) -> list[tuple[Tree, Tree]]:
        names = [x.label for x in left]
        if len(set(names)) == len(names) and names == [x.label for x in right]:
            return list(zip(left, right, strict=True))[::-1]
        if len(left) * len(right) <= self.FEW:
            return self._few(left, right)
        weights, i, j = self._table(tuple([x.shape for x in left]), tuple([x.shape for x in right]))
        by_row, whole = weights[:, j], np.array([x.whole for x in right], np.int64)
        same = set(whole.tolist())
        by_column, wholes = np.ascontiguousarray(weights[i].T), np.array([x.whole for x in left], np.int64)
        sizes, met = np.array([x.size for x in left], np.int32), same.intersection(wholes.tolist())

        def row(k: int) -> np.ndarray:
            x = left[k]
            return by_row[i[k]] + x.size * (whole == x.whole) if x.whole in same else by_row[i[k]]

        def column(k: int) -> np.ndarray:
            w = by_column[j[k]]
            return w + sizes * (wholes == whole[k]) if right[k].whole in met else w

        def best(rows, a: int, b: int, back: bool = False) -> np.ndarray:
            out = np.zeros(b - a + 1, np.int64)
            for k in rows:
                w = row(k)[a:b]
                w = w[::-1] if back else w
                out[1:] = np.maximum.accumulate(np.maximum(out[1:], out[:-1] + w))
            return out

        out, todo = [], [(0, len(left), 0, len(right))]
        while todo:
            top, end, a, b = todo.pop()
            if top == end or a == b:
                continue
            if (end - top) * (b - a) > self.CELLS and end - top > 1:
                middle = (top + end) // 2
                cut = a + int(np.argmax(best(range(top, middle), a, b) + best(range(end - 1, middle - 1, -1), a, b, True)[::-1]))
                todo += [(top, middle, a, cut), (middle, end, cut, b)]
                continue
            if end - top <= b - a:
                table = np.zeros((end - top + 1, b - a + 1), np.int32)
                for k in range(top, end):
                    at = table[k - top]
                    table[k - top + 1, 1:] = np.maximum.accumulate(np.maximum(at[1:], at[:-1] + row(k)[a:b]))
            else:  # the same table by columns, of which there are fewer
                columns = np.zeros((b - a + 1, end - top + 1), np.int32)
                for k in range(a, b):
                    at = columns[k - a]
                    columns[k - a + 1, 1:] = np.maximum.accumulate(np.maximum(at[1:], at[:-1] + column(k)[top:end]))
                table = columns.T
            x, y = end - top, b - a
            while x and y:
                k, n = top + x - 1, a + y - 1
                w = weights[i[k], j[n]] + (left[k].size if left[k].whole == right[n].whole else 0)
                if w and table[x, y] == table[x - 1, y - 1] + w:
                    x, y = x - 1, y - 1
                    out.append((left[k], right[n]))
                elif table[x, y] == table[x - 1, y]:
                    x -= 1
                else:
                    y -= 1
        return out

    def _few(self, left: list[Tree], right: list[Tree]) -> list[tuple[Tree, Tree]]:
        table, weights, known = [[0] * (len(right) + 1)], [], self.memo
        for x in left:
            label, shape, size, whole, row, before, now, most = x.label, x.shape, x.size, x.whole, [], table[-1], [0], 0
            for j, y in enumerate(right):
                if label == y.label:
                    w = size if shape == y.shape else 1 if not x.kids or not y.kids else known.get((shape, y.shape)) or self.weigh(shape, y.shape)
                    if whole == y.whole:
                        w += size
                    n = before[j] + w
                    if n > most:
                        most = n
                else:
                    w = 0
                if before[j + 1] > most:
                    most = before[j + 1]
                row.append(w)
                now.append(most)
            weights.append(row)
            table.append(now)
        out, x, y = [], len(left), len(right)
        while x and y:
            w = weights[x - 1][y - 1]
            if w and table[x][y] == table[x - 1][y - 1] + w:
                x, y = x - 1, y - 1
                out.append((left[x], right[y]))
            elif table[x][y] == table[x - 1][y]:
                x -= 1
            else:
                y -= 1
        return out

    def align(self, a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
        """The aligned nodes of two measured trees."""
        out, todo = [], [(a, b)] if a.label == b.label else []
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            if x.kids and y.kids:
                todo += self._pairs(x.kids, y.kids)[::-1]
        return out


def match(a: Tree, b: Tree) -> tuple[int, list[tuple[Tree, Tree]]]:
    """Simple tree matching of two trees: the weight of their best matching (of children, equal subtrees double), and the aligned
    nodes with text."""
    m = Matcher()
    m.measure(a)
    m.measure(b)
    if a.label != b.label:
        return 0, []
    score = 1 + sum(m.weigh(x.shape, y.shape) + x.size * (x.whole == y.whole) for x, y in m._pairs(a.kids, b.kids))
    return score, [(x, y) for x, y in m.align(a, b) if x.text or y.text]


class Skeleton:
    """Trees of a host's pages (``whole`` is set) as one, taken up one by one: nodes that don't align with it are put beside their
    neighbours."""

    def __init__(self, first: Tree):
        self.matcher, self.top = Matcher(), first
        self.matcher.measure(first, whole=False)

    def add(self, tree: Tree) -> None:
        m, seen, grown = self.matcher, [], False
        if m.forget():
            m.measure(self.top, whole=False)
        m.measure(tree, whole=False)
        todo = [(self.top, tree)]
        while todo:
            x, y = todo.pop()
            if not y.kids:
                continue
            seen.append(x)
            pairs = m._pairs(x.kids, y.kids) if x.kids else []
            todo += pairs
            if len(pairs) == len(y.kids):
                continue
            grown, paired = True, {id(b): id(a) for a, b in pairs}
            after: dict[int, list[Tree]] = {}
            last = 0
            for k in y.kids:
                last = paired.get(id(k), last)
                if id(k) not in paired:
                    after.setdefault(last, []).append(k)
            x.kids = [*after.get(0, []), *(z for k in x.kids for z in (k, *after.get(id(k), [])))]
        if grown:
            for x in reversed(seen):  # children come before parents; what was put in has the page's shapes
                m.reshape(x)


def packed(top: Tree) -> bytes:
    """A tree's tags, parents and hashes, and each text's length (-1: boilerplate by itself)."""
    order = top.order()
    for i, x in enumerate(order):
        x.id = i
    parent = np.zeros(len(order), np.int32)
    for x in order:
        for k in x.kids:
            parent[k.id] = x.id
    tags = sorted({x.label for x in order})
    at = {t: i for i, t in enumerate(tags)}
    head = " ".join(tags).encode()
    label = np.array([at[x.label] for x in order], np.int32)
    whole = np.array([x.whole for x in order], np.int64)
    chars = np.array([(-1 if x.gone else len(x.text)) if x.text else 0 for x in order], np.int32)
    return zlib.compress(len(head).to_bytes(4, "little") + head + label.tobytes() + parent.tobytes() + whole.tobytes() + chars.tobytes(), 1)


def unpacked(data: bytes) -> Tree:
    """The tree; ``id`` of each node is its place in page order, ``home`` its parent's, ``chars`` its text's length."""
    data = zlib.decompress(data)
    n = int.from_bytes(data[:4], "little")
    tags, rest = data[4 : 4 + n].decode().split(" "), data[4 + n :]
    size = len(rest) // 20
    label, parent, whole, chars = (
        np.frombuffer(rest, t, size, at * size).tolist() for t, at in ((np.int32, 0), (np.int32, 4), (np.int64, 8), (np.int32, 16))
    )
    nodes: list[Tree] = []
    for i in range(size):
        x = Tree(tags[label[i]], "", [], home=parent[i])
        x.id, x.whole, x.chars = i, whole[i], chars[i]
        if i:
            nodes[parent[i]].kids.append(x)
        nodes.append(x)
    return nodes[0]


class Aligner:
    """Aligns pages with their hosts' skeletons; holds the last ones that it unpacked."""

    HELD = 64

    def __init__(self):
        self.matcher, self.held = Matcher(), {}

    def pairs(self, form: bytes, page: Tree, whole: bool = True) -> list[tuple[Tree, Tree]]:
        """The aligned nodes. whole: as of ``Matcher.measure``, for the page."""
        if self.matcher.forget():
            self.held.clear()
        top = self.held.get(form)
        if top is None:
            if len(self.held) >= self.HELD:
                self.held.clear()
            top = self.held[form] = unpacked(form)
            self.matcher.measure(top, whole=False)
        self.matcher.measure(page, whole)
        return self.matcher.align(top, page)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def trees(pages: DataFrame) -> DataFrame:
    """host, page, copies, whole, fresh, tree of the distinct pages of each batch: page is a hash of the page, whole one of its tree. Of equal
    trees one is fresh; empty ones are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher()
        for batch in batches:
            copies: dict[tuple[str, int], int] = {}
            rows = []
            for i, (host, html) in enumerate(zip(*(batch.column(c) for c in ("host", "html")), strict=True)):
                key = host.as_py(), xxhash.xxh3_64_intdigest(html.as_buffer()) >> 1
                if key not in copies:
                    rows.append((i, *key))
                copies[key] = copies.get(key, 0) + 1
            known: set[tuple[str, int]] = set()
            for at in range(0, len(rows), 1024):
                out = []
                for i, host, page in rows[at : at + 1024]:
                    tree = tree_of(batch.column("html")[i].as_py())
                    matcher.forget()
                    matcher.measure(tree)
                    fresh = bool(tree.kids) and (host, tree.whole) not in known
                    known.add((host, tree.whole))
                    out.append((host, page, copies[host, page], tree.whole, fresh, packed(tree)))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["host", "page", "copies", "whole", "fresh", "tree"]
                )

    some = pages.where((F.col("host") != "") & F.col("html").isNotNull()).select("host", "html")
    return some.mapInArrow(run, "host string, page long, copies long, whole long, fresh boolean, tree binary")


def skeletons(pages: DataFrame) -> DataFrame:
    """host, form: the packed skeleton of each host with LEAST distinct pages, of all of its pages."""
    return united(trees(pages))


def united(found: DataFrame) -> DataFrame:
    """The skeletons from ``trees``. Those of each part of a host first, so that no task puts a large host together; a part's trees come
    in order of their hashes and one skeleton is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = made = None
        whole, n = 0, 0

        def ended() -> pa.RecordBatch:
            form = packed(made.top) if made else first
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([whole], pa.int64()), pa.array([n], pa.int64()), pa.array([form], pa.binary())],
                ["host", "part", "whole", "n", "tree"]
            )

        for batch in batches:
            for host, part, hashed, count, tree in zip(*(batch.column(c) for c in ("host", "part", "whole", "n", "tree")), strict=True):
                now = host.as_py(), part.as_py()
                if now != key:
                    if key is not None:
                        yield ended()
                    key, first, made, whole, n = now, tree.as_py(), None, hashed.as_py(), count.as_py()
                elif whole != hashed.as_py():
                    made = made or Skeleton(unpacked(first))
                    made.add(unpacked(tree.as_py()))
                    whole, n = hashed.as_py(), n + count.as_py()
        if key is not None:
            yield ended()

    def folded(rows: DataFrame) -> DataFrame:
        return rows.repartition("host", "part").sortWithinPartitions("host", "part", "whole").mapInArrow(
            run, "host string, part int, whole long, n long, tree binary"
        )

    parts = folded(found.where("fresh").select(
        "host", F.pmod("whole", F.lit(PARTS_OF_HOST)).cast("int").alias("part"), "whole", F.lit(1).cast("long").alias("n"), "tree"
    ))
    return folded(parts.withColumn("part", F.lit(0))).where(F.col("n") >= LEAST).select("host", F.col("tree").alias("form"))


def votes(rows: DataFrame) -> DataFrame:
    """host, node, parent, text, page, chars for each aligned block of each page (``trees`` with form): text is the node's whole; 0
    stands for the node itself, -1 for the characters that pages have there outside boilerplate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                chars: dict[tuple[int, int, int], int] = {}
                for host, page, copies, tree, form in zip(
                    *(batch.column(c).to_pylist() for c in ("host", "page", "copies", "tree", "form")), strict=True
                ):
                    for x, y in aligner.pairs(form, unpacked(tree), whole=False):
                        if x.kids:
                            out.append((host, x.id, x.home, 0, page, 0))
                        if y.chars:
                            out.append((host, x.id, x.home, y.whole, page, 0))
                            if y.chars > 0:
                                chars[host, x.id, x.home] = chars.get((host, x.id, x.home), 0) + copies * y.chars
                out += [(*key, -1, 0, n) for key, n in chars.items()]
                columns = zip(*out, strict=True) if out else [[]] * 6
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "node", "parent", "text", "page", "chars"]
                )

    return rows.select(F.xxhash64("host").alias("host"), "page", "copies", "tree", "form").mapInArrow(
        run, "host long, node int, parent int, text long, page long, chars long"
    )


def induced(forms: DataFrame, cast: DataFrame) -> DataFrame:
    """host, form, slot, nodes, texts of each host: its main slot (the lowest node with blocks below it that has SLOT of the varying
    text; 0 is the whole page), and the nodes whose text is the same in SHARE of the distinct pages that have their parent, and in
    LEAST at least, with the text's hash."""
    n = cast.groupBy("host", "node", "parent", "text").agg(F.countDistinct("page").alias("n"), F.sum("chars").alias("chars"))
    n = common.stored(n.where((F.col("n") >= LEAST) | (F.col("text") < 0)), "votes")
    there = n.where("text = 0").select("host", F.col("node").alias("parent"), F.col("n").alias("pages"))
    same = n.where("text > 0").join(there.hint("merge"), ["host", "parent"]).where(F.col("n") >= SHARE * F.col("pages"))
    facts = same.unionByName(
        n.where("text < 0"), allowMissingColumns=True
    ).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "text", "chars"))).alias("facts"))
    facts = forms.withColumn("h", F.xxhash64("host")).join(
        facts.withColumnRenamed("host", "h").hint("merge"), "h"
    ).select("host", "form", "facts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, nodes, texts = [], [], []
            for form, found in zip(batch.column("form").to_pylist(), batch.column("facts").to_pylist(), strict=True):
                fixed = {x["node"]: x["text"] for x in found if x["text"] > 0}
                order = unpacked(form).order()
                chars = [0] * len(order)
                for x in found:
                    if x["text"] < 0 and x["node"] not in fixed:
                        chars[x["node"]] += x["chars"]
                for x in reversed(order[1:]):
                    chars[x.home] += chars[x.id]
                slots.append(max((x.id for x in order if x.kids and chars[x.id] >= SLOT * chars[0]), default=0) if chars[0] else 0)
                nodes.append(list(fixed))
                texts.append(list(fixed.values()))
            columns = [
                batch.column("host"), batch.column("form"), pa.array(slots, pa.int32()), pa.array(nodes, pa.list_(pa.int32())),
                pa.array(texts, pa.list_(pa.int64()))
            ]
            yield pa.RecordBatch.from_arrays(columns, ["host", "form", "slot", "nodes", "texts"])

    return facts.mapInArrow(run, "host string, form binary, slot int, nodes array<int>, texts array<long>")


def _beside(hosts: DataFrame, *sizes: str) -> DataFrame:
    """``hosts`` with the way they are joined by host: by broadcast if they are small, else by a shuffle that Spark can split."""
    size = hosts.agg(F.coalesce(F.sum(sum((F.expr(x) for x in sizes), F.lit(64))), F.lit(0))).first()[0]
    return F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts.hint("merge")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html; other columns are ignored).

    text: the blocks of the main text in page order, character references decoded, white space inside a block one space,
    joined by two line feeds. Null or empty html, or a page without main text: the empty text. Null or odd urls have no host
    and so no template. Null page_ids and repeated rows are kept as they are. An empty table gives no rows. Pages of any length,
    depth and width take part in their host's template.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumn("host", host_of(F.col("url")))
    found = common.stored(trees(rows), "trees")
    forms = common.stored(united(found), "skeletons")
    usable = found.join(_beside(forms, "octet_length(host)", "octet_length(form)"), "host")
    known = common.stored(induced(forms, votes(usable)), "templates")
    rows = rows.join(
        _beside(known, "octet_length(host)", "octet_length(form)", "12 * size(nodes)"), "host", "left"
    ).select("page_id", "url", "html", "form", "slot", "nodes", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = [main_text(*x, aligner) for x in zip(
                    *(batch.column(c).to_pylist() for c in ("html", "form", "slot", "nodes", "texts")), strict=True
                )]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()),
                        pa.array([len(t) for t in made], pa.int64())
                    ],
                    ["page_id", "url", "text", "n_chars"]
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(
    html: str | None, form: bytes | None, slot: int | None, nodes: list[int] | None, texts: list[int] | None, aligner: Aligner
) -> str:
    """The main text of a page, without the blocks that stand at the host's constant nodes with these nodes' text."""
    if not html:
        return ""
    page, held = tree_of(html), []

    def pairs() -> list[tuple[Tree, Tree]]:
        if not held:
            held.append(aligner.pairs(form, page))
        return held[0]

    kept = chosen(page, lambda: next((y for x, y in pairs() if x.id == slot), None) if form and slot else None)
    if form and kept and nodes:
        template = dict(zip(nodes, texts, strict=True))
        gone = {id(y) for x, y in pairs() if y.text and template.get(x.id) == y.whole}
        kept = [x for x in kept if id(x) not in gone]
    return "\n\n".join([x.text for x in kept])
