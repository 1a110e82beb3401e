"""Main text of pages by wrapper induction.

The DOM trees of a host's pages are aligned with the host's most common tree by simple tree matching.
Aligned nodes whose text is the same on most pages are template; of the slots that vary, those that
hold the article become the wrapper's content. The wrapper of its host is then laid over every page,
by the same matching, and gives the blocks of its content slots.

Trees are those of containers (body, div, article, lists, ...); what stands between two block borders
is a block of its innermost container.
"""

from __future__ import annotations

import html as html_lib
import json
import math
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.llm.common import mix, shingle_sets, small_batches, via_table, word_hashes

CONTAINERS = frozenset("body div section article main nav header footer aside form ul ol dl table center dialog menu fieldset".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr td th caption thead tbody tfoot figure figcaption hr address details summary html hgroup legend".split()
)
#: Elements without a rendered text of their own.
UNREAD = frozenset("script style noscript template iframe object embed svg canvas head title select option textarea button audio video map applet".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of an article, and a page's header where it stands outside of one.
OUTSIDE = frozenset("nav aside footer dialog menu".split())
#: Words of class, id and role that hint at what is around an article; those of comments apart.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
AROUND = COMMENTS | frozenset(
    "nav navbar navigation menu menubar masthead banner footer sidebar aside ad ads advert adverts advertisement promo promotion sponsor sponsored "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing "
    "related recommended breadcrumb breadcrumbs pagination pager login search toolbar skip "
    "contentinfo complementary feedback widget widgets".split()
)
#: Words that leave a hint what it is.
FILLING = frozenset("list body area section wrapper box container block bar button buttons link links form".split())
#: Names hint at nothing here.
NEVER = frozenset("html body main article".split())
#: A node's hint, and when ``around`` follows it: a word among others, if links have most of the text;
#: a whole name, also if the text is constant or short; comments and forms, if the rest of the page
#: has most of the text or an article; always.
WORD, NAME, COMMENT, ALWAYS = 1, 2, 3, 4
SHORT, MOST = 0.2, 0.5
#: An element that opens closes an open one of these, up to the nearest container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[!?][^>]*>)""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: Attributes one after another, so that no value is searched for names.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
#: What a head may hold; any other element, and text, ends it.
HEAD_HOLDS = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Unread elements that end at the next block where their end tag is missing, and those of them that hold none of their kind.
_ENDED = "select option button object svg canvas audio video map applet".split()
_FLAT = frozenset("select option button audio video map".split())
_ENDS = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1|\Z)|<(/?)({'|'.join(_ENDED)})(?=[\s/>])", re.I | re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def closed_elements(source: str) -> set[int]:
    """Where the elements of ``_ENDED`` begin that have an end tag."""
    out: set[int] = set()
    opened: dict[str, list[int]] = {}
    for m in _ENDS.finditer(source):
        if m[3]:
            held = opened.setdefault(m[3].lower(), [])
            if not m[2]:
                if m[3].lower() in _FLAT:
                    held.clear()
                held.append(m.start())
            elif held:
                out.add(held.pop())
    return out


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = m[2] or ""
        out.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def hint_of(tag: str, marks: dict[str, str]) -> int:
    best = COMMENT if tag == "form" else 0
    if tag in NEVER or marks.get("role") == "main" or "articleBody" in marks.get("itemprop", ""):
        return best
    for key in ("class", "id", "role"):
        for token in marks.get(key, "").split():
            words = {w.lower() for w in _WORDS.findall(token)}
            if words & AROUND:
                whole = words <= AROUND | FILLING
                best = max(best, WORD if not whole else COMMENT if words & COMMENTS else NAME)
    return best


class Page:
    """``nodes``: of each container its parent's number, label, and its hint at what stands around the
    article; ``blocks``: text, container and characters in links, in page order."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, int]] = [(-1, "page", 0)]
        self.blocks: list[tuple[str, int, int]] = []
        self._held: list[str] = []
        self._links = 0
        self._parse(source)

    def _flush(self, node: int) -> None:
        text = " ".join("".join(self._held).split())
        self._held.clear()
        if text:
            self.blocks.append((text, node, min(self._links, len(text))))
        self._links = 0

    def _parse(self, source: str) -> None:
        # Open elements: tag, container number, unread elements around, links around.
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
        at, n = 0, len(source)
        closed: set[int] | None = None
        # Places in the stack: of every tag, of containers, of elements that the next block ends, and of
        # all that may stop a search for what a tag ends. Searches then skip the inline elements, however
        # many are left open.
        where: dict[str, list[int]] = {}
        containers: list[int] = []
        loose: set[int] = set()
        stops: list[int] = []

        def read(text: str) -> None:
            if stack[-1][0] == "head" and not text.isspace() and text:
                close(len(stack) - 1)
            _, _, unread, links = stack[-1]
            if text and not unread:
                text = html_lib.unescape(text) if "&" in text else text
                self._held.append(text)
                if links:
                    self._links += len(text.strip())

        def close(k: int) -> None:
            if any(x[0] in BLOCKS for x in stack[k:]):
                self._flush(stack[-1][1])
            for i in range(len(stack) - 1, k - 1, -1):
                where[stack[i][0]].pop()
                loose.discard(i)
            del stack[k:]
            for places in (containers, stops):
                while places and places[-1] >= k:
                    places.pop()

        def push(tag: str, node: int, unread: int, links: int, ends_soon: bool) -> None:
            k = len(stack)
            stack.append((tag, node, unread, links))
            where.setdefault(tag, []).append(k)
            if tag in CONTAINERS:
                containers.append(k)
            if ends_soon:
                loose.add(k)
            if ends_soon or tag == "head" or tag in CONTAINERS or tag in UNREAD:
                stops.append(k)

        while at < n:
            begin = source.find("<", at)
            if begin < 0:
                read(source[at:])
                break
            found = _TAG.match(source, begin) or _LOOSE.match(source, begin)
            if not found:
                read(source[at : begin + 1])
                at = begin + 1
                continue
            read(source[at:begin])
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                # A list item or a paragraph doesn't end its container.
                if where.get(tag) and (tag in CONTAINERS or not containers or containers[-1] < where[tag][-1]):
                    close(where[tag][-1])
                continue
            if tag == "br":
                read(" ")
                continue
            if tag in EMPTY:
                if tag in BLOCKS:
                    self._flush(stack[-1][1])
                continue
            for k in stops[::-1] if stops and (stops[-1] in loose or stack[stops[-1]][0] == "head") else ():
                if stack[k][0] == "head":
                    if tag not in HEAD_HOLDS:
                        close(k)
                    break
                if k not in loose:
                    break
                # An element without end tag ends where a block, or another of its kind, begins.
                if tag in BLOCKS or tag == stack[k][0]:
                    close(k)
            ends = _CLOSES.get(tag, {"p"} if tag in BLOCKS else ())
            nearest = max((where[e][-1] for e in ends if where.get(e)), default=0)
            if nearest and not (containers and containers[-1] > nearest):
                close(nearest)
            if tag in BLOCKS:
                self._flush(stack[-1][1])
            _, node, unread, links = stack[-1]
            marks = attributes(found[3]) if found[3] else {}
            hidden = "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "").lower()
            hint = ALWAYS if tag in OUTSIDE or (tag == "header" and not self._inside(node)) else hint_of(tag, marks)
            if tag in CONTAINERS or (hint and tag in BLOCKS):
                name = marks.get("class", "") or marks.get("id", "")
                main = "!" if tag == "article" or "articleBody" in marks.get("itemprop", "") else "+" if tag == "main" or marks.get("role") == "main" else ""
                label = f"{main}{tag}.{re.sub(r'[0-9]+', '', ' '.join(sorted(name.split())))}"
                self.nodes.append((node, label, hint))
                node = len(self.nodes) - 1
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag in _ENDED:
                closed = closed_elements(source) if closed is None else closed
            push(tag, node, unread + (tag in UNREAD or hidden), links + (tag == "a"), tag in _ENDED and begin not in closed)
        self._flush(stack[-1][1])

    def _inside(self, node: int) -> bool:
        while node > 0:
            if self.nodes[node][1][0] in "!+":
                return True
            node = self.nodes[node][0]
        return False

    def tree(self) -> list[list]:
        """Of each container: its parent, label and hint, the characters of its own blocks outside
        links, a hash of its own text, and the characters in links."""
        chars, links, texts = [0] * len(self.nodes), [0] * len(self.nodes), [[] for _ in self.nodes]
        for text, node, linked in self.blocks:
            chars[node] += len(text) - linked
            links[node] += linked
            texts[node].append(text)
        hashes = [xxhash.xxh3_64_intdigest("\n".join(t)) >> 11 if t else 0 for t in texts]
        return [[*node, c, h, n] for node, c, h, n in zip(self.nodes, chars, hashes, links, strict=True)]

    def skeleton(self) -> str:
        return json.dumps(self.tree())


def _children(nodes: list) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in nodes]
    for i, node in enumerate(nodes):
        if node[0] >= 0:
            out[node[0]].append(i)
    return out


#: What matching holds in memory at once; its results don't depend on either. Of lists of siblings with more
#: pairs than ``CELLS`` only some rows of their table are kept, and the others computed again where the way
#: back needs them; scores of more than ``PAIRS`` pairs of subtrees lie in a temporary file.
CELLS, PAIRS = 1 << 22, 1 << 22


class TreePair:
    """Two trees and the scores of their subtrees, the sizes of their largest matchings.

    Only nodes whose labels agree all the way from the root can meet. So scores are tables of a path
    of labels, of the different shapes of ``a``'s subtrees at that path against those of ``b``'s, and a row
    of best sums runs over all of ``b``'s siblings at a path at once: their lists follow each other, each
    after a column of its own whose value no earlier list reaches."""

    def __init__(self, a: list, b: list, cells: int, pairs: int):
        self.cells, self.pairs = cells, pairs
        self.below_a, self.below_b = _children(a), _children(b)
        self.tables: dict[int, np.ndarray] = {}
        self.best = np.empty(0, np.int64)
        shapes: dict[tuple, int] = {}
        self.shape_a, self.size_a = self._shapes(a, self.below_a, shapes)
        self.shape_b, self.size_b = self._shapes(b, self.below_b, shapes)
        if self.shape_a[0] != self.shape_b[0]:
            paths: dict[tuple, int] = {}
            # Of each path the shapes' places and first nodes.
            self.path_a, self.place_a, self.first_a = self._paths(a, self.shape_a, paths)
            self.path_b, self.place_b, self.first_b = self._paths(b, self.shape_b, paths)
            self.inner: list[list[int]] = [[] for _ in paths]
            for (outer, _), p in paths.items():
                if outer >= 0 and p in self.first_a and p in self.first_b:
                    self.inner[outer].append(p)

    @staticmethod
    def _shapes(nodes: list, below: list[list[int]], shapes: dict[tuple, int]) -> tuple[list[int], list[int]]:
        """Of each node a number that is the same for subtrees of equal labels, and its subtree's nodes."""
        shape, size = [0] * len(nodes), [1] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            shape[i] = shapes.setdefault((nodes[i][1], tuple([shape[k] for k in below[i]])), len(shapes))
            if i:
                size[nodes[i][0]] += size[i]
        return shape, size

    @staticmethod
    def _paths(nodes: list, shape: list[int], paths: dict[tuple, int]) -> tuple[list[int], list[int], dict[int, list[int]]]:
        path, place = [0] * len(nodes), [0] * len(nodes)
        first: dict[int, list[int]] = {}
        places: dict[tuple[int, int], int] = {}
        for i, node in enumerate(nodes):
            # Roots meet whatever their labels.
            p = path[i] = paths.setdefault((path[node[0]], node[1]) if i else (-1, ""), len(paths))
            known = places.get((p, shape[i]))
            if known is None:
                held = first.setdefault(p, [])
                known = places[p, shape[i]] = len(held)
                held.append(i)
            place[i] = known
        return path, place, first

    def _columns(self, siblings: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each path the columns of ``b``'s nodes in a row (-1: a list's own column) and the places of their shapes."""
        found: dict[int, tuple[list[int], list[int]]] = {}
        for column, y in enumerate(siblings):
            if y >= 0:
                columns, places = found.setdefault(self.path_b[y], ([], []))
                columns.append(column)
                places.append(self.place_b[y])
        return {p: (np.array(columns), np.array(places)) for p, (columns, places) in found.items()}

    def _step(self, row: np.ndarray, columns: dict, known: dict, x: int) -> None:
        """Makes a row of best sums the next one, by ``x``; ``known`` holds scores of ``a``'s shapes along whole rows."""
        key = p, place = self.path_a[x], self.place_a[x]
        if p in columns:
            scores = known.get(key)
            if scores is None:
                if len(known) * len(row) > CELLS:
                    known.clear()
                scores = known[key] = np.zeros(len(row), np.int64)
                at, places = columns[p]
                inside = slice(0, np.searchsorted(at, len(row)))
                scores[at[inside]] = self.tables[p][place][places[inside]]
            if len(self.best) < len(row):
                self.best = np.empty(len(row), np.int64)
            best = self.best[1 : len(row)]
            np.add(row[:-1], scores[1 : len(row)], out=best)
            np.maximum(best, row[1:], out=best)
            np.maximum.accumulate(best, out=row[1:])

    def _score(self, outer: int) -> None:
        """Fills the tables of the paths below ``outer``, the deepest first."""
        order, todo = [], [p for p in self.inner[outer] if p not in self.tables]
        while todo:
            order.append(todo.pop())
            todo += [p for p in self.inner[order[-1]] if p not in self.tables]
        for p in reversed(order):
            if not self.inner[p]:
                self.tables[p] = np.broadcast_to(np.uint8(1), (len(self.first_a[p]), len(self.first_b[p])))
                continue
            xs, ys = self.first_a[p], self.first_b[p]
            most = min(max(self.size_a[x] for x in xs), max(self.size_b[y] for y in ys))
            kind = np.min_scalar_type(most)
            if len(xs) * len(ys) > self.pairs:
                with tempfile.TemporaryFile() as file:
                    table = np.memmap(file, kind, "w+", shape=(len(xs), len(ys)))
            else:
                table = np.empty((len(xs), len(ys)), kind)
            siblings = [z for y in ys for z in (-1, *self.below_b[y])]
            columns = self._columns(siblings)
            widths = [len(self.below_b[y]) + 1 for y in ys]
            own = np.arange(len(ys), dtype=np.int64) * (most + 1)
            empty, last = np.repeat(own, widths), np.cumsum(widths) - 1
            known: dict[tuple[int, int], np.ndarray] = {}
            for i, x in enumerate(xs):
                row = empty.copy()
                for k in self.below_a[x]:
                    self._step(row, columns, known, k)
                table[i] = row[last] - own + 1
            self.tables[p] = table

    def siblings(self, x: int, y: int) -> list[tuple[int, int]]:
        """The pairs of children in the largest matching below a pair of nodes; of equally large ones
        that with the latest children."""
        m, n = self.below_a[x], self.below_b[y]
        if not m or not n:
            return []
        if self.shape_a[x] == self.shape_b[y]:
            return list(zip(m, n, strict=True))
        # A pair of one shape at the end is never worse than another.
        same, least = 0, min(len(m), len(n))
        while same < least and self.shape_a[m[-1 - same]] == self.shape_b[n[-1 - same]]:
            same += 1
        kept = list(zip(m[len(m) - same :], n[len(n) - same :], strict=True))
        m, n = m[: len(m) - same], n[: len(n) - same]
        either = {self.path_a[i] for i in m} & {self.path_b[j] for j in n}
        left, right = [i for i in m if self.path_a[i] in either], [j for j in n if self.path_b[j] in either]
        # Where every label has one node on both sides, in one order, all meet.
        if len(left) == len(right) == len(either) and all(self.path_a[i] == self.path_b[j] for i, j in zip(left, right, strict=True)):
            return kept + list(zip(left, right, strict=True))
        self._score(self.path_a[x])
        return kept + self._longest(m, n)

    def _longest(self, m: list[int], n: list[int]) -> list[tuple[int, int]]:
        """The pairs of the best sum of scores that keep the order of two lists of siblings."""
        columns, known = self._columns([-1, *n]), {}
        # Every ``step``-th row is kept; the way back computes the rows from one to the next again.
        step = len(m) if len(m) * len(n) <= self.cells else math.isqrt(len(m)) + 1
        row, marks = np.zeros(len(n) + 1, np.int64), []
        for i, x in enumerate(m[: (len(m) - 1) // step * step + 1]):
            if i % step == 0:
                marks.append(row.copy())
            self._step(row, columns, known, x)
        block = np.empty((step + 1, len(n) + 1), np.int64)
        i, j, kept = len(m), len(n), []
        while i and j:
            begin = (i - 1) // step * step
            del marks[begin // step + 1 :]
            rows = block[: i - begin + 1, : j + 1]
            rows[0] = marks.pop()[: j + 1]
            for k, x in enumerate(m[begin:i]):
                rows[k + 1] = rows[k]
                self._step(rows[k + 1], columns, known, x)
            while i > begin and j:
                x, y, here, above = m[i - 1], n[j - 1], rows[i - begin], rows[i - begin - 1]
                p = self.path_a[x]
                if p == self.path_b[y] and here[j] == above[j - 1] + self.tables[p][self.place_a[x], self.place_b[y]]:
                    kept.append((x, y))
                    i, j = i - 1, j - 1
                elif here[j] == above[j]:
                    i -= 1
                else:
                    j -= 1
        return kept


def match_trees(a: list, b: list, cells: int = CELLS, pairs: int = PAIRS) -> dict[int, int]:
    """Simple tree matching: the largest set of pairs of equal labels that keeps parents and the order
    of siblings. ``a``'s node numbers to ``b``'s. ``cells`` and ``pairs`` bound the memory, not the
    matching; time is at most that of all pairs of nodes that labels let meet, in rows of numpy."""
    trees = TreePair(a, b, cells, pairs)
    out, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        todo += trees.siblings(x, y)
    return out


def _sums(nodes: list, values: list[float], out: list[bool]) -> list[float]:
    """Of each node the sum of its own and its descendants' values, without what ``out`` takes."""
    total = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        if not out[i]:
            total[i] += values[i]
            if nodes[i][0] >= 0:
                total[nodes[i][0]] += total[i]
    return total


def _below(nodes: list, out: list[bool]) -> list[bool]:
    for i, node in enumerate(nodes):
        out[i] = out[i] or (node[0] >= 0 and out[node[0]])
    return out


def around(nodes: list, weights: list[float], links: list[float]) -> list[bool]:
    """Which nodes stand around the article or inside of what does, from the varying text of each
    node and its characters in links. Names alone take nothing that has most of the text."""
    out = _below(nodes, [node[2] == ALWAYS for node in nodes])
    text = _sums(nodes, weights, out)
    asked = [i for i, node in enumerate(nodes) if node[2] == COMMENT and not out[i]]
    if asked:
        named = set(asked)
        own = _below(nodes, [i in named for i in range(len(nodes))])
        # Articles and mains that no comments hold.
        free = any(node[1][0] in "!+" and text[i] > 0 and not own[i] and not out[i] for i, node in enumerate(nodes))
        # A main, or in a form an article, is not what stands around it.
        mains, articles = ([float(node[1][0] in marks and t > 0) for node, t in zip(nodes, text, strict=True)] for marks in ("+", "!"))
        mains, articles = _sums(nodes, mains, [False] * len(nodes)), _sums(nodes, articles, [False] * len(nodes))
        for i in asked:
            holds = mains[i] or (articles[i] and nodes[i][1].startswith("form."))
            out[i] = not holds and (free or text[i] < MOST * text[0])
        _below(nodes, out)
        text = _sums(nodes, weights, out)
    linked = _sums(nodes, links, out)
    for i, node in enumerate(nodes):
        if node[2] in (WORD, NAME) and not out[i] and (text[i] < MOST * text[0] or not text[i]):
            out[i] = linked[i] > text[i] or (node[2] == NAME and text[i] < max(SHORT * text[0], 1e-9))
    return _below(nodes, out)


def choose(nodes: list, weights: list[float], links: list[float], constant: list[bool]) -> dict:
    """What is content and what is template of a tree, from its nodes and the mean varying text of each.

    ``slots``: all that are marked as articles and vary (``mark`` is ``!``), else the main element
    (``+``), else the page. ``gone``: what stands around them, with all below. ``constant``: nodes whose
    own text is template. Without a mark the page narrows to the only container with plain text, while
    it has no text itself; ``path`` is what encloses that container, and ``left`` are link-heavy
    containers beside the path."""
    out = around(nodes, weights, links)
    total, linked = _sums(nodes, weights, out), _sums(nodes, links, out)
    slots, mark, left, path, at = [0], "", [], [], 0
    for kind in "!+":
        marked = [i for i, node in enumerate(nodes) if node[1][0] == kind and not out[i] and total[i] > 0]
        if marked:
            slots, mark = marked, kind
            break
    else:
        below = _children(nodes)
        while not weights[at]:
            heavy = [i for i in below[at] if not out[i] and linked[i] > total[i]]
            plain = [i for i in below[at] if not out[i] and total[i] > 0 and i not in heavy]
            if len(plain) != 1:
                break
            path.append(at)
            left += heavy
            at = plain[0]
    keep = {at}
    for i in slots:
        while i >= 0:
            keep.add(i)
            i = nodes[i][0]
    return {"mark": mark, "slots": slots, "gone": [i for i, x in enumerate(out) if x], "constant": [i for i, c in enumerate(constant) if c and i not in keep], "left": left, "path": path}


def teasers(nodes: list, slots: set[int], text: list[float], linked: list[float]) -> set[int]:
    """Articles of a page that only point to others: much smaller than its largest, and link-heavy or
    in a list of such articles with links."""
    most = max((text[i] for i in slots), default=0.0)
    small = {i for i in slots if text[i] < 0.25 * most}
    lists: dict[tuple[int, str], list[int]] = {}
    for i in slots:
        lists.setdefault((nodes[i][0], nodes[i][1]), []).append(i)
    out = {i for i in small if linked[i] > text[i]}
    for held in lists.values():
        if len(held) > 1 and all(i in small and linked[i] >= 0.2 * (text[i] + linked[i]) for i in held):
            out.update(held)
    return out


def main_blocks(page: Page, nodes: list, tree: list, to: dict[int, int], wrapper: dict) -> list[tuple[str, int]]:
    """The texts and nodes of the blocks of a page that ``wrapper``, laid over it by ``to``, leaves as content.

    A template's text goes where the page repeats it. What has no counterpart is judged by the page
    itself."""
    slots, gone_slots, constant, left, path = (set(wrapper[x]) for x in ("slots", "gone", "constant", "left", "path"))
    mark = wrapper["mark"]
    weights, links = [float(x[3]) for x in nodes], [float(x[5]) for x in nodes]
    own = around(nodes, weights, links)
    gone = _below(nodes, [to[i] in gone_slots if i in to else own[i] for i in range(len(nodes))])
    text, linked = _sums(nodes, weights, gone), _sums(nodes, links, gone)
    mine = {i for i in range(len(nodes)) if not gone[i] and (to[i] in slots if i in to else mark and nodes[i][1][0] == mark)}
    if mark == "!":
        mine -= teasers(nodes, mine, text, linked)
    for i, node in enumerate(nodes):
        if linked[i] > text[i] and (to[i] in left if i in to else to.get(node[0]) in path):
            gone[i] = True
    _below(nodes, gone)
    inside = _below(nodes, [i in mine for i in range(len(nodes))])
    said = [i in to and to[i] in constant and nodes[i][4] == tree[to[i]][4] for i in range(len(nodes))]
    return [(text, node) for text, node, _ in page.blocks if inside[node] and not gone[node] and not said[node]]


def extract(source: str | None, wrapper: tuple[list, dict] | None) -> str:
    """The main text of a page; by its own tree, where the wrapper's content has no counterpart."""
    page = Page(source or "")
    nodes = page.tree()
    if wrapper:
        tree, chosen = wrapper
        found = main_blocks(page, nodes, tree, match_trees(nodes, tree), chosen)
        if found:
            return "\n".join(text for text, _ in found)
    return "\n".join(text for text, _ in own_blocks(page, nodes))


#: Wrappers that a task keeps parsed at most, and the characters of their JSON together; parsed ones take some six times as many bytes.
KEPT, KEPT_CHARS = 256, 1 << 22


def parsed(wrapper: str | None, known: dict[str, tuple], chars: int = KEPT_CHARS) -> tuple[list, dict] | None:
    """A wrapper from its JSON. ``known`` keeps parsed ones for later rows, up to ``KEPT`` and ``chars``; one
    that is larger by itself stays until the next."""
    if wrapper is not None and wrapper not in known:
        if len(known) >= KEPT or sum(map(len, known)) + len(wrapper) > chars:
            known.clear()
        known[wrapper] = tuple(json.loads(wrapper))
    return known.get(wrapper)


def own_blocks(page: Page, nodes: list) -> list[tuple[str, int]]:
    """The main blocks of a page by its own tree."""
    chosen = choose(nodes, [float(x[3]) for x in nodes], [float(x[5]) for x in nodes], [False] * len(nodes))
    return main_blocks(page, nodes, nodes, {i: i for i in range(len(nodes))}, chosen)


def content_of(page: Page, nodes: list) -> tuple[int, str]:
    """A hash of the larger parts of a page's main text by its own tree, the same for pages that differ
    around it or in small parts only, and the text."""
    found = own_blocks(page, nodes)
    own = {node for _, node in found}
    most = max((nodes[i][3] for i in own), default=0)
    large = [nodes[i][4] for i in sorted(own) if nodes[i][3] >= SHORT * most]
    return xxhash.xxh3_64_intdigest(json.dumps(large)) - (1 << 63), "\n".join(text for text, _ in found)


def host_of(url: str) -> object:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: Pages of different main text that a host must have for its constant slots to count.
LEAST_PAGES = 3
CONSTANT_SHARE = 0.9
#: Minima of the hashed five-word shingles; pages that share one are taken for near copies.
MINIMA = ("m0", "m1", "m2")


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: the host's most common tree and what ``choose`` finds in it (JSON).

    HTML is read where it lies; only trees (a few hundred bytes a page) travel. A host's pages are
    counted by combining aggregates, so one host may hold any share of the pages. Pages of one main
    text count once, so copies are no evidence for a template; inside articles and main elements near
    copies count once as well."""

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, shapes, contents, texts = [], [], [], []
            for source in batch.column(1).to_pylist():
                page = Page(source or "")
                nodes = page.tree()
                content, text = content_of(page, nodes)
                trees.append(json.dumps(nodes))
                shapes.append(xxhash.xxh3_64_intdigest(json.dumps([x[:2] for x in nodes])) - (1 << 63))
                contents.append(content)
                texts.append(text)
            sets = shingle_sets(*word_hashes(pa.array(texts, pa.string()))) if texts else []
            least = [[int(mix(x, 11 + j).min().astype(np.int64)) if len(x) else 0 for x in sets] for j in range(len(MINIMA))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(trees, pa.string()), *(pa.array(x, pa.int64()) for x in (shapes, contents, *least))],
                ["host", "tree", "shape", "content", *MINIMA],
            )

    schema = "host string, tree string, shape long, content long, " + ", ".join(f"{m} long" for m in MINIMA)
    rows = pages.select(host_of("url").alias("host"), "html").mapInArrow(skeletons, schema)
    # One page of each main text; of those, pages that are nobody's near copy.
    rows = rows.groupBy("host", "content").agg(F.min(F.struct("tree", "shape", *MINIMA)).alias("x")).select("host", "content", "x.*")
    rows = via_table(rows, "html-trees")
    apart = rows.select("host", "content", *MINIMA)
    for m in MINIMA:
        apart = apart.groupBy("host", m).agg(F.min(F.struct("content", *(x for x in MINIMA if x != m))).alias("x")).select("host", m, "x.*")
    apart = apart.select("host", "content", F.lit(1).alias("apart"))
    rows = rows.join(apart, ["host", "content"], "left").select("host", "tree", "shape", F.coalesce("apart", F.lit(0)).cast("long").alias("apart"))
    rows = via_table(rows, "html-pages")
    shapes = rows.groupBy("host", "shape").agg(F.sum("apart").alias("apart"), F.count(F.lit(1)).alias("n"), F.min("tree").alias("tree"))
    common = shapes.groupBy("host").agg(F.max(F.struct("apart", "n", "shape", "tree")).alias("x"), F.sum("n").alias("pages"))
    common = via_table(common.select("host", F.col("x.tree").alias("common"), "pages"), "html-common")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, list] = (None, [])
        for batch in batches:
            out: list[tuple] = []
            for host, tree, apart, other in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if other != last[0]:
                    last = (other, json.loads(other))
                nodes = json.loads(tree)
                for x, y in match_trees(nodes, last[1]).items():
                    same = int(nodes[x][4] == last[1][y][4])
                    out.append((host, y, nodes[x][3], same, nodes[x][5], apart, same * apart))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.string() if i == 0 else pa.int64()) for i in range(7)], ["host", "slot", "chars", "same", "links", "apart", "same_apart"]
            )

    met = rows.join(common.select("host", "common"), "host").select("host", "tree", "apart", "common")
    slots = met.mapInArrow(aligned, "host string, slot long, chars long, same long, links long, apart long, same_apart long")
    counts = ("chars", "links", "same", "apart", "same_apart")
    slots = slots.groupBy("host", "slot").agg(*(F.sum(x).alias(x) for x in counts), F.count(F.lit(1)).alias("n"))
    # As many as the common tree has nodes.
    per = slots.groupBy("host").agg(F.collect_list(F.struct("slot", *counts, "n")).alias("slots")).join(common, "host")

    def induced(host: pa.Array, tree: pa.Array, pages: pa.Array, slots: pa.Array) -> pa.Array:
        out = []
        for t, n, found in zip(tree.to_pylist(), pages.to_pylist(), slots.to_pylist(), strict=True):
            nodes = json.loads(t)
            weights, links, constant = [0.0] * len(nodes), [0.0] * len(nodes), [False] * len(nodes)
            marked = _below(nodes, [x[1][0] in "!+" for x in nodes])
            for s in found:
                k = s["slot"]
                met, same = (s["apart"], s["same_apart"]) if marked[k] else (s["n"], s["same"])
                constant[k] = nodes[k][4] != 0 and met >= LEAST_PAGES and same >= CONSTANT_SHARE * met
                weights[k] = 0.0 if constant[k] else s["chars"] / n
                links[k] = s["links"] / n
            # Where nothing varies no text is template.
            if not any(weights):
                weights, constant = [float(x[3]) for x in nodes], [False] * len(nodes)
            out.append(json.dumps([nodes, choose(nodes, weights, links, constant)]))
        return pa.array(out, pa.string())

    induced.__annotations__ = {x: pa.Array for x in ("host", "tree", "pages", "slots", "return")}
    return via_table(per.select("host", F.arrow_udf(induced, T.StringType())("host", "common", "pages", "slots").alias("wrapper")), "html-wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text``: one row for every row of ``pages``.

    Blocks are joined by line feeds in page order; white space inside a block is one space; character
    references are decoded. Null or empty HTML gives an empty text, a page without tags its whole text.
    Pages without a host share the empty host. Repeated rows repeat. Empty input gives an empty result.
    """
    small_batches(pages.sparkSession)
    made = wrappers(pages)
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host")).join(made, "host", "left").select("page_id", "url", "html", "wrapper")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for source, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append(extract(source, parsed(wrapper, known)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(read, "page_id long, url string, text string")
