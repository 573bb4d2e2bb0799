"""Union-free expressions over HTML token streams.

A page is a stream of tags and texts.  An expression is a sequence of nodes: a tag, a
text slot (its string while all pages agree, else open), an optional group or a repeated
group.  ``fold`` turns a stream into an expression by resolving neighbouring equal
groups into repeats; ``merge`` aligns two expressions and resolves what differs:
strings into open slots, groups on one side only into optional ones, a group against a
repeat of it into the repeat.  No node ever holds alternatives.  Bare inline tags are no
part of a stream: the text of a line is one slot, with the share of it that is linked.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np

TAG, TEXT, GROUP = 0, 1, 2
#: Elements without content, and elements whose content is not markup (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that stand in a line of text and don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SCOPES = frozenset("html body table td th caption button object article section div main aside nav header footer ul ol".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMED = ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop")


#: Different page contents that are told apart for each text.
SEEN = 5


@dataclass(slots=True)
class Node:
    kind: int
    #: Tag with class and id (after a #), or the key of a group's content.
    label: str = ""
    #: Labels of the open elements around a text.
    path: tuple[str, ...] = ()
    #: A text's string while it is the same on all pages.
    value: str | None = None
    body: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    #: Texts of the page that it was made from (places in the stream).
    places: list[int] = field(default_factory=list)
    size: int = 0
    #: Characters of it that are linked.
    linked: int = 0
    #: The least digests, ``SEEN`` at most, of the page contents that a text was seen on.
    seen: frozenset[int] = frozenset()


def stream(html: str):
    """(kind, tag label, path, text, inline, open) tokens; unclosed and misplaced tags are put right as browsers do.

    ``path`` has the labels of the open elements, ``open`` a number for each of them.
    """
    path: list[tuple[str, str, int]] = []
    at = made = 0

    def pop_to(name: str) -> bool:
        for k in range(len(path) - 1, -1, -1):
            if path[k][0] == name:
                del path[k:]
                return True
        return False

    labels: tuple[str, ...] = ()
    opened: tuple[int, ...] = ()
    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            yield TEXT, "", labels, html[at : m.start()], False, opened
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if not m[4]:  # a tag that the page's end cuts off
            break
        if m[1]:
            if name == "p" and not any(x[0] == "p" for x in path):
                yield TAG, "p", labels, "", False, opened
            inside = name in INLINE
            if inside:  # an inline end tag doesn't close blocks around it
                for k in range(len(path) - 1, -1, -1):
                    if path[k][0] == name:
                        del path[k]
                        break
                    if path[k][0] not in INLINE:
                        break
            else:
                pop_to(name)
            if len(path) < len(labels):
                if path and path[-1][2] != opened[len(path) - 1]:  # one in the middle went
                    labels, opened = tuple(x[1] for x in path), tuple(x[2] for x in path)
                else:
                    labels, opened = labels[: len(path)], opened[: len(path)]
            yield TAG, "/" + name, labels, "", inside, opened
            continue
        got = {}
        if len(m[3]) > 1:
            got = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[3]) if k.lower() in NAMED}
        label = name
        if got:
            ids = " ".join("#" + x.replace(".", "_") for x in got.get("id", "").split())
            words = f"{got.get('class', '')} {ids} {got.get('role', '')} {got.get('itemprop', '')}".lower().split()
            hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
            label = ".".join([name, *words, *["-hidden"] * hidden])
        if name in ENDS_P:
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] == "p":
                    del path[k:]
                    break
                if path[k][0] in SCOPES:
                    break
        for k in range(len(path) - 1, -1, -1):
            if path[k][0] in CLOSES.get(name, ()):
                del path[k:]
                break
            if path[k][0] in SCOPES or path[k][0] in ("ul", "ol", "dl", "select"):
                break
        if len(path) < len(labels):
            labels, opened = labels[: len(path)], opened[: len(path)]
        made += 1
        yield TAG, label, labels, "", name in INLINE, opened
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            inner = html[at : end.start() if end else len(html)]
            at = end.end() if end else len(html)
            if inner:
                yield TEXT, "", (*labels, label), inner, False, (*opened, made)
            yield TAG, "/" + name, labels, "", False, opened
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            path.append((name, label, made))
            labels, opened = (*labels, label), (*opened, made)
    if at < len(html):
        tail = html[at:]
        if "<" not in tail or not re.match(r"</?[a-zA-Z]", tail[tail.rfind("<") :]):
            yield TEXT, "", labels, tail, False, opened


@dataclass(slots=True)
class Unit:
    """A tag, or all text of one line."""

    kind: int
    label: str
    path: tuple[str, ...] = ()
    #: Numbers of the open elements of ``path``.
    opened: tuple[int, ...] = ()
    text: str = ""
    linked: int = 0
    #: Texts of the stream that it holds.
    places: list[int] = field(default_factory=list)

    def node(self) -> Node:
        if self.kind == TAG:
            return Node(TAG, self.label)
        return Node(TEXT, _slot(self.path), self.path, self.text, places=self.places, size=len(self.text), linked=self.linked)


def _bare(label: str) -> bool:
    return label.lstrip("/") in INLINE


@lru_cache(maxsize=4096)
def _around(path: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[int, ...], bool]:
    """Open elements of a line's text without bare inline ones, their places, and whether the text is linked."""
    kept = tuple(k for k, x in enumerate(path) if not _bare(x))
    return tuple(path[k] for k in kept), kept, any(x == "a" or x.startswith("a.") for x in path)


def units(parts: list) -> list[Unit]:
    """A stream's tags and lines of text; bare inline tags and texts of white space only leave no mark."""
    out: list[Unit] = []
    place = 0
    for kind, label, path, text, inside, opened in parts:
        if kind == TAG:
            if not inside or not _bare(label):
                out.append(Unit(TAG, label))
            continue
        if not text.isspace():
            around, kept, link = _around(path)
            linked = len(text) if link else 0
            last = out[-1] if out else None
            if last is not None and last.kind == TEXT and last.path == around:
                last.text, last.linked = last.text + text, last.linked + linked
                last.places.append(place)
            else:
                out.append(Unit(TEXT, "#", around, opened if len(kept) == len(opened) else tuple(opened[k] for k in kept), text, linked, [place]))
        place += 1
    return out


@lru_cache(maxsize=4096)
def _slot(path: tuple[str, ...]) -> str:
    """Key of a text: texts meet only below the same elements."""
    return f"#{crc32('>'.join(path).encode('utf-8', 'replace')):x}"


def key(node: Node) -> str:
    """What two nodes must share to be aligned."""
    return node.label if node.kind != GROUP else "{" + node.label + "}"


def body_key(nodes: list[Node]) -> str:
    return " ".join(key(n) for n in nodes)


def together(a: frozenset[int], b: frozenset[int]) -> frozenset[int]:
    """The least digests of both; copies of a page, wherever they were read, count once."""
    return a if b <= a else b if a <= b else frozenset(sorted(a | b)[:SEEN])


def short(text: str) -> str:
    """A text, or a digest of a longer one."""
    return text if len(text) <= 64 else blake2b(text.encode("utf-8", "replace"), digest_size=12).hexdigest()


def join(a: Node, b: Node) -> Node:
    """Two nodes of one key in one stream as one; its string is both of theirs."""
    value = None if a.value is None or b.value is None else short(f"{a.value}\0{b.value}")
    out = Node(a.kind, a.label, a.path, value, [], a.optional or b.optional, a.repeated or b.repeated, a.places + b.places, a.size + b.size, a.linked + b.linked, together(a.seen, b.seen))
    if a.kind == GROUP:
        out.body = [join(x, y) for x, y in zip(a.body, b.body)]
    return out


#: Spans that are always looked for; longer ones where strings of as many keys stand again.
NEAR = 12


def _spans(keys: list[str]) -> list[int]:
    """Lengths that a group next to its like may have, in order.

    All strings of keys in the second of two long groups stand one length before, too.
    """
    last: dict[tuple, int] = {}
    far: Counter[int] = Counter()
    for k in range(len(keys) - NEAR):
        gram = tuple(keys[k : k + NEAR + 1])
        if gram in last:
            far[k - last[gram]] += 1
        last[gram] = k
    return [*range(1, NEAR + 1), *sorted(d for d, n in far.items() if n >= d - NEAR > 0)]


def _fold(nodes: list[Node], keys: list[str], span: int) -> list[Node]:
    out: list[Node] = []
    k = 0
    while k < len(nodes):
        n = 1
        # A repeat begins with a tag, or else text and tags around it would pair up anyhow.
        if nodes[k].kind != TEXT and keys[k][0] != "/" and keys[k : k + 1] == keys[k + span : k + span + 1]:
            unit = keys[k : k + span]
            while len(unit) == span and keys[k + n * span : k + (n + 1) * span] == unit:
                n += 1
        if n == 1:
            out.append(nodes[k])
            k += 1
            continue
        body = nodes[k : k + span]
        for i in range(1, n):
            body = [join(x, y) for x, y in zip(body, nodes[k + i * span : k + (i + 1) * span])]
        if span == 1 and body[0].kind == GROUP:
            body[0].repeated = True
            out.append(body[0])
        else:
            out.append(Node(GROUP, body_key(body), body=body, repeated=True))
        k += n * span
    return out


def _tandem(ids: np.ndarray, span: int) -> bool:
    """Whether some group of ``span`` stands next to its like."""
    same = np.append(0, np.cumsum(ids[:-span] == ids[span:]))
    return len(same) > span and bool((same[span:] - same[:-span] == span).any())


def fold(nodes: list[Node]) -> list[Node]:
    """Neighbouring equal groups of any length become repeats, small groups first."""
    done = 0
    while True:
        keys = [key(n) for n in nodes]
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(k, len(number)) for k in keys])
        spans = [x for x in _spans(keys) if x > done and 2 * x <= len(keys)] if len(number) < len(keys) else []
        for done in spans:
            if _tandem(ids, done):
                after = _fold(nodes, keys, done)
                if len(after) < len(nodes):  # keys and distances are others now
                    nodes = after
                    break
        else:
            return nodes


def _exact(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(len(x) - 1, -1, -1):
        row, below = best[p], best[p + 1]
        for q in range(len(y) - 1, -1, -1):
            row[q] = below[q + 1] + 1 if x[p] == y[q] else max(below[q], row[q + 1])
    out, p, q = [], 0, 0
    while p < len(x) and q < len(y):
        if x[p] == y[q] and best[p][q] == best[p + 1][q + 1] + 1:
            out.append((p, q))
            p, q = p + 1, q + 1
        elif best[p + 1][q] >= best[p][q + 1]:
            p += 1
        else:
            q += 1
    return out


def _anchors(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of strings of keys that stand once on each side, in an order that both share."""
    for size in (1, 2, 4, 8, 16, 32):
        once: list[dict[tuple, int]] = []
        for side in (x, y):
            seen: dict[tuple, int] = {}
            for k in range(len(side) - size + 1):
                gram = tuple(side[k : k + size])
                seen[gram] = -1 if gram in seen else k
            once.append(seen)
        met = [(i, once[1][gram]) for gram, i in once[0].items() if i >= 0 and once[1].get(gram, -1) >= 0]
        if met:
            # The longest run of them that rises on both sides (patience sorting).
            ends: list[int] = []
            tops: list[int] = []
            back = [-1] * len(met)
            met.sort()
            for k, (_, j) in enumerate(met):
                at = bisect_left(ends, j)
                back[k] = tops[at - 1] if at else -1
                ends[at : at + 1] = [j]
                tops[at : at + 1] = [k]
            out, k = [], tops[-1]
            while k >= 0:
                out.append(met[k])
                k = back[k]
            return out[::-1]
    return []


def _pairs(a: list[str], b: list[str], cells: int = 40_000) -> list[tuple[int, int]]:
    """A common subsequence of two lists of keys: a longest one where that takes few cells, else between anchors."""
    lo, head, tail = 0, [], []
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        head.append((lo, lo))
        lo += 1
    i, j = len(a), len(b)
    while i > lo and j > lo and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
        tail.append((i, j))
    todo, inner = [(lo, i, lo, j)], []
    while todo:
        p, q, u, v = todo.pop()
        if p == q or u == v:
            continue
        x, y = a[p:q], b[u:v]
        if len(x) * len(y) <= cells:
            inner += [(p + m, u + n) for m, n in _exact(x, y)]
            continue
        met = [(p + m, u + n) for m, n in _anchors(x, y)]
        if not met:  # nothing tells places apart: halves meet halves
            m, n = (p + q) // 2, (u + v) // 2
            todo += [(p, m, u, n), (m, q, n, v)] if q - p > 1 and v - u > 1 else []
            continue
        inner += met
        edges = [(p - 1, u - 1), *met, (q, v)]
        todo += [(m + 1, m2, n + 1, n2) for (m, n), (m2, n2) in zip(edges, edges[1:])]
    return head + sorted(inner) + tail[::-1]


def merge(a: list[Node], b: list[Node]) -> tuple[list[Node], list[tuple[Node, Node]]]:
    """The expression of both, and (node of b, its node in the result) for all texts of ``b``."""
    met: list[tuple[Node, Node]] = []
    out: list[Node] = []

    def pair(x: Node, y: Node) -> Node:
        new = Node(x.kind, x.label, x.path, x.value if x.value == y.value else None, [], x.optional or y.optional, x.repeated or y.repeated, [], x.size + y.size, x.linked + y.linked, together(x.seen, y.seen))
        if x.kind == GROUP:
            new.body = [pair(p, q) for p, q in zip(x.body, y.body)]
        elif x.kind == TEXT:
            met.append((y, new))
        return new

    def alone(node: Node, mine: bool) -> Node:
        new = Node(node.kind, node.label, node.path, node.value, [], True, node.repeated, [], node.size, node.linked, node.seen)
        new.body = [alone(x, mine) for x in node.body]
        if node.kind == TEXT and not mine:
            met.append((node, new))
        return new

    def occurrence(side: list[Node], other: list[Node]) -> tuple[int, int, int] | None:
        """(place of a group, where and how long its like stands on the other side)."""
        groups = [k for k, node in enumerate(side) if node.kind == GROUP]
        if not groups:
            return None
        keys = [key(n) for n in other]
        where: dict[str, list[int]] = {}
        for at, k in enumerate(keys):
            where.setdefault(k, []).append(at)
        for k in groups:
            body = [key(n) for n in side[k].body]
            for at in where.get(body[0], ()):
                if keys[at : at + len(body)] == body:
                    return k, at, len(body)
        return None

    def gap(left: list[Node], right: list[Node]) -> None:
        # One occurrence of a group against a repeat of it.
        while left and right:
            if hit := occurrence(left, right):
                k, at, n = hit
                gap(left[:k], right[:at])
                out.append(pair(left[k], Node(GROUP, left[k].label, body=right[at : at + n], repeated=True)))
                left, right = left[k + 1 :], right[at + n :]
            elif hit := occurrence(right, left):
                k, at, n = hit
                gap(left[:at], right[:k])
                out.append(pair(Node(GROUP, right[k].label, body=left[at : at + n], repeated=True), right[k]))
                left, right = left[at + n :], right[k + 1 :]
            else:
                break
        out.extend(alone(x, True) for x in left)
        out.extend(alone(x, False) for x in right)

    p = q = 0
    for i, j in [*_pairs([key(n) for n in a], [key(n) for n in b]), (len(a), len(b))]:
        gap(a[p:i], b[q:j])
        if i < len(a):
            out.append(pair(a[i], b[j]))
        p, q = i + 1, j + 1
    return out, met


def texts(nodes: list[Node]):
    for n in nodes:
        if n.kind == TEXT:
            yield n
        elif n.kind == GROUP:
            yield from texts(n.body)


def show(nodes: list[Node]) -> str:
    """An expression as a regular expression would be written."""
    out = []
    for n in nodes:
        if n.kind == GROUP:
            s = "( " + show(n.body) + " )" + ("+" if n.repeated else "")
        else:
            s = f"<{n.label}>" if n.kind == TAG else "#text" if n.value is None else repr(n.value)
        out.append(f"( {s} )?" if n.optional else s)
    return " ".join(out)
