"""Main text of HTML pages by minimum-cut labelling.

A page becomes a graph. Its nodes are the text blocks and those elements whose tag, role or class
says something (containers). A linear classifier gives each block a cost for either label from its
own tag, size, links and wording, and each container one from its names; these are the capacities of
the edges to the terminals. Blocks are tied to their nearest container and containers to the next one
above, neighbours on the page to each other, by edges that are heavier the closer they stand in the
tree. One maximum flow over the whole page labels all nodes: a footer's sentence goes although it
reads like text, a short line of an article stays although it does not.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("head script style textarea title noscript template iframe svg math canvas object audio video select option button datalist progress meter xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open p, and those that end an open one of their own kind up to a boundary.
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend summary".split())
SELF_ENDING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
AWAY_TAGS = frozenset("nav footer aside form menu dialog fieldset label".split())
HOME_TAGS = frozenset(("article", "main"))
AWAY_ROLES = frozenset("navigation banner contentinfo complementary alert alertdialog dialog search menu menubar toolbar form status".split())
HOME_ROLES = frozenset(("main", "article"))
#: Elements whose compound class names say less than the text in them.
TEXTUAL = frozenset("p blockquote pre li dd dt td th figcaption h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names.
AWAY_WORDS = frozenset(
    "ad ads adv advert advertisement adverts adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead toolbar topbar pagination pager comment comments commentlist respond reply replies disqus discussion "
    "share sharing social related recommended recommendations subscribe subscription newsletter signup login search widget tagcloud skip legal copyright".split()
)
HOME_WORDS = frozenset("article content post entry story main maincontent articlebody body text prose".split())
_NOTICE = re.compile(r"(?i)©|\bcopyright\b|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|sign up|subscribe|log in")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute: a quote opens a value only behind the equals sign.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_BETWEEN = re.compile(r"[\s/=]*")
_WORDS = frozenset(
    "ad ads adv advert advertisement adverts adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead toolbar topbar pagination pager comment comments commentlist respond reply replies disqus discussion "
    "share sharing social related recommended recommendations subscribe subscription newsletter signup login search widget tagcloud skip legal copyright".split()
)
HOME_WORDS = frozenset("article content post entry story main maincontent articlebody body text prose".split())
_NOTICE = re.compile(r"(?i)©|\bcopyright\b|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|sign up|subscribe|log in")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"(?i)</{tag}[^>]*>?") for tag in RAW}

SCALE = 100
#: Evidence of a container by its tag or role, by a class name that is one of the words, by one that holds one, and hidden.
TAG, NAME, PART, HIDDEN = 8.0, 6.0, 4.0, 30.0
#: The most that ties a block to its container, a container to the next one, and what a step between them costs.
HELD, NESTED, STEP = 6.0, 2.0, 0.5
#: Weights of neighbours by their steps in the tree; further ones, and the share across containers.
NEAR, FAR, ACROSS = (2.0, 1.6, 1.5, 0.8, 0.5), 0.25, 0.25


class _Element:
    __slots__ = ("depth", "evidence", "link", "own", "parent", "tag", "within")

    def __init__(self, tag: str, parent: _Element | None, found: dict[str, str]):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        above = parent.within if parent else None
        home = bool(above and above.evidence > 0)
        #: evidence makes it a container; own counts for its own text only.
        self.evidence, self.own = 0.0, 0.0
        if tag not in ("html", "body"):
            self.evidence, self.own = _evidence(tag, found, home)
        self.within = self if self.evidence else above


def _evidence(tag: str, found: dict[str, str], home: bool) -> tuple[float, float]:
    """What an element's tag and attributes say: (of all that is in it, of its own text only)."""
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return -HIDDEN, 0.0
    if role in AWAY_ROLES or tag in AWAY_TAGS or (tag == "header" and not home):
        return -TAG, 0.0
    if role in HOME_ROLES or tag in HOME_TAGS or "articleBody" in found.get("itemprop", ""):
        return TAG, 0.0
    away = part = good = 0.0
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        words = set(_WORDS.findall(name))
        if words & AWAY_WORDS or ("header" in words and not home):
            away, part = max(away, NAME if name in AWAY_WORDS else PART), PART
        elif words & HOME_WORDS:
            good = PART
    if tag in TEXTUAL and away <= PART:
        return 0.0, 0.6 * (good - away)
    return good - away if not good else good - part, 0.0


class _Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, element: _Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def parse(page: str) -> list[_Block]:
    """The text blocks of a page in order; character references are decoded, white space is one space."""
    root = _Element("#root", None, {})
    stack, out, standing = [root], [], Counter()
    parts: list[str] = []
    linked = dropped = 0
    owner = root

    def flush() -> None:
        nonlocal linked, owner
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(_Block(owner, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        """Ends the elements from the k-th of the stack on."""
        nonlocal dropped
        for e in stack[k:]:
            standing[e.tag] -= 1
            dropped -= e.tag in DROPPED
        if any(e.tag in BLOCK for e in stack[k:]):
            flush()
        del stack[k:]

    def text(piece: str) -> None:
        nonlocal linked, owner
        if dropped or not piece:
            return
        if not parts or not owner:
            e = stack[-1]
            while e.parent and e.tag not in BLOCK:
                e = e.parent
            owner = e
        parts.append(piece)
        if stack[-1].link:
            linked += len(piece.strip())

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            at = n if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
            continue
        closing = nxt == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                text("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        at, found = m.end(), {}
        while at < n and page[at] != ">":
            part = None if closing else _ATTRIBUTE.match(page, at)
            if part:
                found.setdefault(part[1].lower(), part[2] or part[3] or part[4] or "")
            after = part.end() if part else _BETWEEN.match(page, at).end()
            at = after if after > at else at + 1
        if at >= n:
            break
        empty, at = page[at - 1] == "/", at + 1
        if closing:
            if not standing[tag]:
                if tag in BLOCK:
                    flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
        if tag == "body" and standing["head"]:  # ends a head that was left open
            for k in range(1, len(stack)):
                if stack[k].tag == "head":
                    close(k)
                    break
        if tag in SELF_ENDING:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or {stack[k].tag, tag} <= {"dt", "dd"} or {stack[k].tag, tag} <= {"td", "th"}:
                    close(k)
                    break
                if stack[k].tag in SELF_ENDING[tag]:
                    break
        if empty and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        stack.append(_Element(tag, stack[-1], found))
        standing[tag] += 1
        dropped += tag in DROPPED
    flush()
    return out


def cost(block: _Block) -> float:
    """Log-odds that a block is content, by itself: the linear classifier."""
    size, tag = len(block.text), block.element.tag
    out = -1.0 + block.element.own
    out += 1.5 if tag in ("p", "blockquote", "pre") else 1.0 if tag in HEADINGS or tag == "figcaption" else -0.5 if tag in ("li", "td", "th", "dd", "dt") else 0.0
    out += min(3.0, math.log2(1 + size / 20)) - 7.0 * block.linked / size
    out += 0.5 * (block.text[-1] in ".!?…\"”»")
    if size < 200 and _NOTICE.search(block.text):
        out -= 3.0
    if size < 25 and tag not in HEADINGS:
        out -= 1.0
    return out


def tie(a: _Element, b: _Element) -> float:
    """Weight between neighbours: heavier the fewer steps their elements are apart in the tree."""
    steps, x, y = 0, a, b
    while x is not y and steps < len(NEAR):
        if x.depth >= y.depth:
            x, steps = x.parent, steps + 1
        else:
            y, steps = y.parent, steps + 1
    weight = NEAR[steps] if steps < len(NEAR) else FAR
    return weight if a.within is b.within else weight * ACROSS


def min_cut(gain: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Labels that minimise the sum of gains forgone and ties cut.

    gain > 0 speaks for True. ties: (a, b, weight). True is the source side of the minimum cut.
    """
    near: list[dict[int, int]] = [{} for _ in gain]
    for a, b, w in ties:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    return _max_flow(list(range(len(gain))), gain, near) if gain else []


def _max_flow(nodes: list[int], own: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Source side of the minimum cut between a source for gains and a sink for losses (Dinic's algorithm)."""
    number = {k: i for i, k in enumerate(nodes)}
    n = len(nodes)
    source, sink = n, n + 1
    edges: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def link(a: int, b: int, forth: int, back: int) -> None:
        edges[a].append(len(to))
        to.append(b)
        room.append(forth)
        edges[b].append(len(to))
        to.append(a)
        room.append(back)

    for k in nodes:
        if own[k] > 0:
            link(source, number[k], own[k], 0)
        elif own[k] < 0:
            link(number[k], sink, -own[k], 0)
        for j, w in near[k].items():
            if j in number and j > k:
                link(number[k], number[j], w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in edges[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                pushed = min(room[e] for e in path)
                for e in path:
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                path, a = [], source
                continue
            while turn[a] < len(edges[a]):
                e = edges[a][turn[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def graph(blocks: list[_Block]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(gain of each node, ties): the blocks first, then their containers.

    A container's capacity grows with the blocks tied to it, so that it can hold all of them.
    """
    gain = [round(SCALE * cost(b)) for b in blocks]
    ties: list[tuple[int, int, int]] = []
    number: dict[int, int] = {}
    known: list[_Element] = []
    held: list[int] = []

    def of(e: _Element) -> int:
        """The node of a container; those above it get theirs too."""
        below = None
        while e is not None:
            fresh = id(e) not in number
            if fresh:
                number[id(e)] = len(blocks) + len(known)
                known.append(e)
                held.append(1)
            if below is not None:
                ties.append((number[id(below)], number[id(e)], round(SCALE * NESTED)))
            if not fresh or e.parent is None:
                break
            below, e = e, e.parent.within
        return 0

    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        e = b.element
        if e.within is not None:
            of(e.within)
            node = number[id(e.within)]
            held[node - len(blocks)] += 1
            weight = min(abs(e.within.evidence) * 1.5, max(HELD, abs(e.within.evidence) - TAG + HELD)) - STEP * min(4, e.depth - e.within.depth)
            ties.append((k, node, round(SCALE * weight)))
        if k:
            ties.append((k - 1, k, round(SCALE * tie(blocks[k - 1].element, e))))
        holder = id(e.parent)
        if holder in last and last[holder] != k - 1:
            ties.append((last[holder], k, round(SCALE * tie(blocks[last[holder]].element, e) / 2)))
        last[holder] = k
    gain += [round(SCALE * e.evidence * n) for e, n in zip(known, held)]
    return gain, ties


def label(blocks: list[_Block]) -> list[bool]:
    return min_cut(*graph(blocks))[: len(blocks)]


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, blocks kept, blocks seen) of a page."""
    blocks = parse(page) if page else []
    kept = label(blocks)
    return "\n".join(b.text for b, k in zip(blocks, kept) if k), sum(kept), len(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [main_text(p.as_py()) for p in batch.column(batch.num_columns - 1)]  # one page at a time
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "text", "n_chars", "n_kept", "n_blocks"])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(the columns of keep, text, n_chars, n_kept, n_blocks) for each row.

    Null or empty html gives an empty text. Broken markup is read as far as it goes. Repeated rows
    stay, rows are not moved, other columns are not read.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    chosen = pages.select(*(pages[c] for c in keep), pages[html_col].cast("string").alias("__html"))
    return chosen.mapInArrow(_extracted, f"{kinds}, text string, n_chars long, n_kept int, n_blocks int")
