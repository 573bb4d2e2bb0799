"""Main text of web pages by inferred host wrappers (operator 6).

Learning: every task turns each page into a token stream and keeps, for each host and
stream of labels, which texts are alike on all its pages and how long they are.  Each
such stream is folded into a union-free expression and aligned with the host's wrapper
so far (:mod:`wrappers`).  Wrappers of tasks are merged ``fan_in`` at a time, so a host
that holds a third of all pages is learnt by all tasks.

Extraction: a page's stream is aligned with its host's wrapper, which gives every text of
the page its slot.  The article is the innermost element that holds half or more of what
surrounds it, counting the text that varies over the host's pages and is not linked (each
path with its mass on all pages of the host; an article or main element counts fourfold),
or the article or main element around that.  Within it, elements whose slots are all
constant go, if they are a small part of it, and so do constant slots where a page has no
article or main element: constant means one string on all pages of the host and on
``wrappers.SEEN`` different page contents at least, so copies of a page make nothing constant.

Elements that never hold an article's text (menus, forms, scripts ...) count for nothing.
Class and id names are evidence beside the wrapper: parts under names of menus, headers,
footers, sidebars, notices, adverts, forms or comments go, but names that may be the
article's own go only if most of their text is constant or linked; ids of headings and
lines mark nothing.  Plans are kept for each host and stream of labels.

Text of one block is put together, references decoded, white space squeezed; blocks are
joined by newlines.  Defined results: a null or empty page has an empty text; a null or
unusual URL belongs to one host of that name; very long pages are read whole; repeated
rows give repeated rows; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_module
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import common, tokens
from tallyloom.llm import wrappers as W

#: Elements that never hold an article's text (fixed values).
DROPPED = frozenset(
    "head title nav footer aside form script style noscript template iframe button select option optgroup datalist textarea label fieldset menu dialog svg canvas object applet audio video map math input".split()
)
#: Parts of class and id names that mark what isn't the article (fixed values).
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pager pagination toc skip "
    "header masthead topbar toolbar footer foot copyright legal colophon "
    "sidebar sidebars aside rail widget widgets related recommended recommendations trending popular teaser teasers outbrain taboola "
    "notice notices cookie cookies consent gdpr alert alerts popup popups modal overlay toast paywall disclaimer "
    "comment comments commentlist discussion replies reply respond disqus feedback "
    "share sharing social login signin signup subscribe subscription newsletter search searchbox form tags hidden".split()
)
#: Marks that may also name a part of an article (fixed values).
TOPICS = frozenset(
    "sponsor sponsored sponsors promotion banner banners navigation menu menus header legal copyright widget widgets related recommended recommendations trending popular "
    "notice notices cookie cookies consent alert alerts popup modal overlay toast paywall disclaimer discussion reply replies feedback "
    "sharing social login subscription newsletter search form tags skip foot rail".split()
)
#: Elements that hold a line or paragraph; their ids are places to link to.
LINES = W.INLINE | frozenset("h1 h2 h3 h4 h5 h6 hgroup p li dt dd td th tr pre blockquote figcaption caption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OPEN = re.compile(r"^(has|with|no|without|not|show|enable|is)[-_]")
SPACES = re.compile(r"\s+")


def _names(label: str) -> list[str]:
    return label.split(".")[1:]


def _marks(path: tuple[str, ...]) -> Iterator[tuple[int, bool]]:
    """(number of open elements, whether that is settled) for each that marks a text as outside of any article.

    Inside an article, names of lines and names that may be the article's own are not settled.
    """
    inside = False
    for k, label in enumerate(path, 1):
        name = label.partition(".")[0]
        names = _names(label) if "." in label else ()
        if name in DROPPED or "-hidden" in names or name == "header" and not inside:
            yield k, True
            return
        if name in ("article", "main") or ("main" in names or "#main" in names) and name == "div":
            inside = True
            continue
        if name in ("html", "body", "header"):
            continue
        for x in names:
            if x[0] == "#" and name in LINES:
                continue
            x = x.lstrip("#")
            parts = re.split(r"[-_]+", x)
            if x in ROLES and x not in TOPICS:
                yield k, True
            elif not OPEN.match(x) and not MARKS.isdisjoint(parts):
                own = name in LINES or MARKS.intersection(parts) <= TOPICS and not (len(parts) > 1 and MARKS.issuperset(parts))
                yield k, not (inside and own)
            elif x in ROLES:
                yield k, True


def boiler(path: tuple[str, ...], own: dict = {}) -> bool:
    """Whether a text's open elements mark it as outside of any article, but for parts that are its ``own``."""
    return any(settled or not own.get(path[:k], False) for k, settled in _marks(path))


def own_parts(nodes: list[W.Node]) -> dict[tuple[str, ...], bool]:
    """Paths of marked elements inside articles, and whether most of their text varies and is not linked.

    Where too few pages were seen to tell, sections and lines are the article's own.
    """
    mass: dict[tuple[str, ...], int] = {}
    for t in W.texts(nodes):
        for k, settled in _marks(t.path):
            if not settled:
                name = t.path[k - 1].partition(".")[0]
                below = {x.partition(".")[0] for x in t.path[k:]}
                varies = t.value is None or len(t.seen) < W.SEEN and (name == "section" or name in LINES)
                prose = varies and 2 * t.linked < t.size and "a" not in below and DROPPED.isdisjoint(below)
                mass[t.path[:k]] = mass.get(t.path[:k], 0) + (t.size if prose else -t.size)
    return {path: m > 0 for path, m in mass.items()}


def _is_main(label: str) -> bool:
    name, *names = label.split(".")
    names = [x.lstrip("#") for x in names]
    return name in ("article", "main") or "main" in names and name in ("div", "section") or "articlebody" in names


def constant(slot: W.Node) -> bool:
    """Whether a slot has one string on all pages of the host, of several different contents."""
    return slot.value is not None and len(slot.seen) >= W.SEEN


@dataclass
class Line:
    """A page's line of text and its slot in the host's wrapper."""

    unit: W.Unit
    slot: W.Node

    def name(self, k: int) -> str:
        return self.unit.path[k].partition(".")[0]


def masses(wrapper: list[W.Node]) -> dict[tuple[str, ...], int]:
    """Text of all pages of a host that varies and is not linked, by path; an article or main element counts fourfold."""
    out: dict[tuple[str, ...], int] = {}
    for t in W.texts(wrapper):
        if not constant(t) and 2 * t.linked <= t.size:
            out[t.path] = out.get(t.path, 0) + (t.size - t.linked) * (4 if any(_is_main(x) for x in t.path) else 1)
    return out


def article(lines: list[Line], mass: dict[tuple[str, ...], int]) -> list[Line]:
    """The lines that belong to the article, of those that no name or element rules out."""
    if not any(mass.get(x.unit.path) for x in lines):  # nothing varies: all text counts
        mass = {x.unit.path: max(1, len(x.unit.text) - x.unit.linked) for x in lines}
    depth, own = 0, lines
    while True:
        inner: dict[int, set] = {}
        for x in own:
            deeper = len(x.unit.opened) > depth and x.name(depth) not in LINES
            inner.setdefault(x.unit.opened[depth] if deeper else -1, set()).add(x.unit.path)
        weight = {element: sum(mass.get(p, 0) for p in paths) for element, paths in inner.items()}
        best = max(weight, key=weight.get, default=-1)
        if best < 0 or 2 * weight[best] < sum(weight.values()):
            break
        own, depth = [x for x in own if len(x.unit.opened) > depth and x.unit.opened[depth] == best], depth + 1
    around = own[0].unit.opened[:depth] if own else ()
    path = own[0].unit.path[:depth] if own else ()
    # Back to the article or main element around it, or to the element that has its heading.
    mains = [k for k, x in enumerate(path, 1) if _is_main(x)]
    within = lambda k: [x for x in lines if x.unit.opened[:k] == around[:k]]
    headed = [k for k in range(1, depth) if path[k - 1].partition(".")[0] not in ("html", "body") and any(len(x.unit.path) > k and re.fullmatch("h[1-6]|hgroup", x.name(k)) for x in within(k))]
    if mains:
        own = within(mains[0])
    elif headed:
        own = within(headed[0])
    if not mains and any(_is_main(x) for line in own for x in line.unit.path):
        own = [line for line in own if any(_is_main(x) for x in line.unit.path)]
        mains = [1]
    depth = mains[0] if mains else headed[0] if headed else depth
    if not mains:
        return [x for x in own if not constant(x.slot)] or own
    # Elements inside whose slots are all constant, if small.
    total = sum(len(x.unit.text) for x in own)
    size: dict[int, int] = {}
    varying = set()
    for x in own:
        inner = [element for k, element in enumerate(x.unit.opened[depth:], depth) if x.name(k) not in LINES]
        if not constant(x.slot):
            varying.update(inner)
        for element in inner:
            size[element] = size.get(element, 0) + len(x.unit.text)
    fixed = {element for element, n in size.items() if element not in varying and 4 * n < total}
    return [x for x in own if fixed.isdisjoint(x.unit.opened)]


def signature(units: list[W.Unit]) -> str:
    """A stream's labels and where its lines stand."""
    return " ".join(u.label for u in units)


def tokens_of(html: str) -> list:
    """Tokens of a page, without texts of white space only where a block may begin."""
    return [p for p in W.stream(html) if p[0] == W.TAG or not p[3].isspace() or p[2] and p[2][-1].partition(".")[0] in W.INLINE | {"p"}]


def content(units: list[W.Unit]) -> int:
    """Digest of a page's texts."""
    own = "\0".join(u.text for u in units if u.kind == W.TEXT)
    return int.from_bytes(blake2b(own.encode("utf-8", "replace"), digest_size=8).digest(), "big")


def expression(units: list[W.Unit]) -> list[W.Node]:
    nodes, seen = [u.node() for u in units], frozenset([content(units)])
    for node in nodes:
        if node.kind == W.TEXT:
            node.value, node.seen = W.short(node.value), seen
    return W.fold(nodes)


class HostLearner:
    """What one task has seen of a host."""

    def __init__(self, most_streams: int = 64):
        self.seen: dict[str, list] = {}
        self.wrapper: list[W.Node] | None = None
        self.most_streams = most_streams

    def add(self, units: list[W.Unit]) -> None:
        held = self.seen.get(mark := signature(units))
        own = [u for u in units if u.kind == W.TEXT]
        if held is None:
            if len(self.seen) >= self.most_streams:
                self.settle()
            self.seen[mark] = [units, [W.short(u.text) for u in own], [len(u.text) for u in own], [u.linked for u in own], frozenset([content(units)])]
            return
        held[4] = W.together(held[4], frozenset([content(units)]))
        for k, u in enumerate(own):
            held[2][k] += len(u.text)
            held[3][k] += u.linked
            if held[1][k] is not None and held[1][k] != W.short(u.text):
                held[1][k] = None

    def settle(self) -> None:
        """Streams seen so far go into the wrapper."""
        for units, values, sizes, linked, seen in self.seen.values():
            nodes, place = [u.node() for u in units], 0
            for node in nodes:
                node.places = []
                if node.kind == W.TEXT:
                    node.value, node.size, node.linked, node.seen = values[place], sizes[place], linked[place], seen
                    place += 1
            folded = W.fold(nodes)
            self.wrapper = folded if self.wrapper is None else W.merge(self.wrapper, folded)[0]
        self.seen.clear()


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, hosts = TaskContext.get().partitionId(), {}

    def flush() -> pa.RecordBatch:
        for learner in hosts.values():
            learner.settle()
        out = pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([part] * len(hosts), pa.int64()), pa.array([pickle.dumps(x.wrapper) for x in hosts.values()], pa.binary())], ["host", "part", "wrapper"])
        hosts.clear()
        return out

    for whole in batches:
        for batch in tokens.slices(whole, 1):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page:
                    hosts.setdefault(host, HostLearner()).add(W.units(tokens_of(page)))
                if len(hosts) >= 500:
                    yield flush()
    if hosts:
        yield flush()


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    out = None
    for data in rows.sort_values("wrapper")["wrapper"]:
        own = pickle.loads(data)
        out = own if out is None else W.merge(out, own)[0]
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [int(rows["part"].min())], "wrapper": [pickle.dumps(out)]})


def infer(pages: DataFrame, fan_in: int = 64) -> DataFrame:
    """A wrapper for each ``host`` of ``(host, html)``: host, wrapper (pickled nodes)."""
    schema = "host string, part long, wrapper binary"
    held = common.stored(pages.select("host", "html").mapInArrow(_learn, schema), "wrappers")
    top = held.agg(F.max("part")).first()[0]
    while True:
        merged = held.withColumn("part", F.floor(F.col("part") / fan_in).cast("long")).groupBy("host", "part").applyInPandas(_merge, schema)
        merged = common.stored(merged, "wrappers")
        common.forget(held)
        held, top = merged, (top or 0) // fan_in
        if not top:
            return held.select("host", "wrapper")


class Extractor:
    """Texts of pages by their hosts' wrappers, with what was found for each stream of labels."""

    def __init__(self, most_kept: int = 20_000):
        self.hosts: dict = {}
        self.plans: dict = {}
        self.most_kept = most_kept

    def text(self, host: str, page: str | None, data: bytes | None) -> str:
        if not page:
            return ""
        parts = tokens_of(page)
        units = W.units(parts)
        mark = (host, signature(units))
        plan = self.plans.get(mark)
        if plan is None:
            plan = self._plan(host, units, data)
            if len(self.plans) >= self.most_kept:
                self.plans.clear()
            self.plans[mark] = plan
        kept = {k for u, keep in zip((u for u in units if u.kind == W.TEXT), plan) if keep for k in u.places}
        return blocks(parts, kept)

    def _plan(self, host: str, units: list[W.Unit], data: bytes | None) -> list[bool]:
        """Which lines of a page belong to the article."""
        nodes = expression(units)
        if host not in self.hosts:
            if len(self.hosts) >= 1000:
                self.hosts.clear()
            wrapper = pickle.loads(data) if data else nodes
            self.hosts[host] = wrapper, own_parts(wrapper), masses(wrapper)
        wrapper, own, mass = self.hosts[host]
        own = {**own_parts(nodes), **own}
        slots = {}
        for node, slot in W.merge(wrapper, nodes)[1]:
            slots.update(dict.fromkeys(node.places, slot))
        texts = [u for u in units if u.kind == W.TEXT]
        kept = article([Line(u, slots[u.places[0]]) for u in texts if not boiler(u.path, own)], mass)
        chosen = {x.unit.places[0] for x in kept}
        return [u.places[0] in chosen for u in texts]


def blocks(parts: list, kept: set[int]) -> str:
    out, held, place = [], [], 0

    def end() -> None:
        text = SPACES.sub(" ", html_module.unescape("".join(held))).strip()
        if text:
            out.append(text)
        held.clear()

    for kind, label, _, text, inside, _ in parts:
        if kind == W.TEXT:
            # White space between the texts of a line is the line's.
            if place in kept or held and text.isspace():
                held.append(text)
            place += 1
        elif not inside:
            end()
        elif label == "br":
            held.append(" ")
    end()
    return "\n".join(out)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor()
        for whole in batches:
            for batch in tokens.slices(whole, 3):
                hosts, pages = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                made = [extractor.text(h, p, shared.value.get(h)) for h, p in zip(hosts, pages)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["page_id", "url", "text"])

    return run


def _extract_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order of host and part, each such group led by a row with the host's wrapper."""
    extractor, at, wrapper = Extractor(), None, None
    for whole in batches:
        for batch in tokens.slices(whole, 3):
            ids, urls, made = [], [], []
            for page_id, url, host, page, own in zip(*(c.to_pylist() for c in batch.columns[:5])):
                if own is not None:
                    at, wrapper = host, own
                    continue
                ids.append(page_id)
                urls.append(url)
                made.append(extractor.text(host, page, wrapper if at == host else None))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(made, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, fan_in: int = 64, broadcast_bytes: int = 64 << 20, parts: int = 32) -> DataFrame:
    """page_id, url and main ``text`` of every row of ``(page_id, url, html)``.

    Wrappers of all hosts go to every task if they are within ``broadcast_bytes``.  Beyond
    it, the pages of each host are dealt to up to ``parts`` groups by page_id, and a row
    with the host's wrapper leads each group that has pages.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    learnt = infer(rows, fan_in)
    size = learnt.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    schema = "page_id long, url string, text string"
    if size <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["wrapper"]) for r in learnt.collect()})
        return rows.mapInArrow(_extract(shared), schema)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(parts)).cast("int"))
    none = F.lit(None)
    leads = dealt.select("host", "part").distinct().join(learnt, "host").select(none.cast("long").alias("page_id"), none.cast("string").alias("url"), "host", none.cast("string").alias("html"), "wrapper", "part")
    both = dealt.select("page_id", "url", "host", "html", none.cast("binary").alias("wrapper"), "part").unionByName(leads)
    ordered = both.repartition("host", "part").sortWithinPartitions("host", "part", F.col("wrapper").isNull())
    return ordered.mapInArrow(_extract_sorted, schema)
