"""Main text of web pages by wrapper induction.

Each page becomes a DOM tree. Trees are compared by simple tree matching: two nodes match if their labels (tag, class,
id, role) agree, and the children of two matched nodes are aligned in order so that as many nodes as possible match
below them. Neighbouring children of one label are an iteration (boxes without a name only if ALIKE of their nodes
match); they become one child, so a page with three paragraphs and one with three thousand have the same form.

A host's wrapper is the union of REFERENCES of its pages, aligned one after the other; what a reference lacks or has
alone stays in it, so an error page among them does no harm. Then every page of the host is aligned with the wrapper,
and over all pages the slots (the wrapper's places of text) are told apart:

- A text that stands in one slot on SHARE of the host's pages is constant: template. Copies of a page count as one page.
  A slot is known by the labels down to it, equal ones in a row as one, so pages that nest a level deeper share slots.
- The other slots vary. The wrapper is entered at its root and left for the child that holds MAIN of the varying text
  that isn't linked (in paragraphs and headings it weighs more), as long as one does and is no mere block of text; where this ends is the content region. Varying
  slots in the region, and first-level headings, are the main text; menus, adverts, footers and comments vary too, but
  outside it. Inside it, a constant text without links that stands between varying ones in a slot of theirs, now here, now
  there, is content; one that has the same place on SHARE of the pages, from the start or the end, is template.

Names (tags such as nav or footer, words in class, id and role) are a prior: what they call no content doesn't count
for the region and isn't taken from it. A page with less than OTHER of its varying text in the region has another layout;
that and a page of a host with fewer than FEW different pages is judged alone: what isn't constant and lies in article or main, if
that is half of its text; else what its names leave; if they say nothing, the region of its own text.

Most texts stand on one page, so they are not all shuffled. A text that stands on SHARE of a host's pages does so in at
least one part of any division of the pages; tasks mark those of parts of PART pages, and only marked ones are
counted, over all pages. Counts are summed before they are shuffled, so a host with a third of all pages is no larger a
task than others; pages are never grouped, but for the REFERENCES of each host.

Cases: a null or empty html, or one without content, gives an empty text; markup that ends early or isn't closed is
read as far as it goes, nested to any depth; a null url is a host of its own; repeated rows are extracted and counted
once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import BROADCAST_ROWS, drop_stored, only_ids, spread_join, stored
from quire.operators.components import once

FEW, SHARE = 2, 0.8  # different pages a host needs for a wrapper; share of them on which a template slot's text is the same
REFERENCES, MAIN, ALIKE = 8, 2 / 3, 0.8
OTHER = 1 / 4  # of a page's varying text, by weight, that is in the region unless the page has another layout
BLOCK = 3  # times that text in paragraphs and headings weighs what text in bare boxes does
PART = 2048
BROADCAST_CHARS = 8 << 20  # of all wrappers together

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: HTML's own lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BLOCKS_OF_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure table thead tbody tfoot tr".split())
BOXES = frozenset("div section center table tbody tr td".split())
OFF_TAGS = frozenset("head nav footer aside form button select option input dialog menu object canvas audio video".split())
OFF_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments "
    "disqus reply replies respond related recommended breadcrumb breadcrumbs pagination pager widget complementary contentinfo".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element, or with the label # the text between two block boundaries."""

    __slots__ = ("aligned", "at", "children", "inside", "label", "linked", "off", "path", "runs", "shape", "tag", "text", "weight")

    def __init__(self, tag: str, label: str, off: bool, above: Node | None = None, inside: str = ""):
        self.tag, self.label, self.off, self.inside = tag, label, off, inside
        if above is not None and above.label == label:
            self.path = above.path
        else:  # of the labels down to here, without repeats
            self.path = hashlib.blake2b((above.path if above else b"") + label.encode(errors="replace"), digest_size=8).digest()
        self.children: list[Node] = []
        self.text, self.linked, self.weight = "", 0, 0


def _named(tag: str, rest: str, inside: str) -> tuple[str, bool]:
    """(label, whether the names say that the element is no content) by tag and attributes; numbers in names don't count."""
    names = [x[1] or x[2] or x[3] for x in ATTRIBUTE.findall(rest)] if rest and "=" in rest else []
    words = {w for n in names for w in _SPLIT.split(n.lower())}
    off = tag in OFF_TAGS or tag in RAW or tag == "header" and inside != "article" or bool(words & OFF_NAMES) and tag not in ("body", "html", "article", "main")
    return (f"{tag}.{_DIGITS.sub('0', ' '.join(names))}" if names else tag), off


def parse(page: str) -> tuple[list[Node], list[Node]]:
    """All nodes, each before its children, the root first; and the text leaves in page order."""
    root = Node("#root", "#root", False)
    nodes, stack, leaves, text, linked = [root], [root], [], [], []
    open_tags: Counter[str] = Counter()
    links = 0

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            top = stack[-1]
            leaf = Node("#", "#", top.off, top, top.inside)
            leaf.text, leaf.linked = joined, min(len(joined), sum(linked))
            leaf.weight = (len(joined) - leaf.linked) * (BLOCK if top.tag in BLOCKS_OF_TEXT else 1)
            top.children.append(leaf)
            nodes.append(leaf)
            leaves.append(leaf)
        text.clear()
        linked.clear()

    def close(k: int) -> None:
        for n in stack[k:]:
            open_tags[n.tag] -= 1
        del stack[k:]

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            if links:
                linked.append(len(piece))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                links = max(0, links - 1) if m[1] else 1
            continue
        flush()
        if m[1]:
            if open_tags[tag]:
                close(max(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag) if stack[-1].tag != tag else len(stack) - 1)
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in SAME_LEVEL:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME_LEVEL[tag]:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select", "div", "article", "section", "body"):
                    break
        top = stack[-1]
        label, off = _named(tag, m[3], top.inside)
        node = Node(tag, label, off or top.off, top, tag if tag in ("article", "main") else top.inside)
        top.children.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else at if m[3].endswith("/") else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    flush()
    return nodes, leaves


class Shapes:
    """Forms of trees, each kept once: a label and the children's forms. A child may stand for neighbours of one label."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, tuple[int, ...]]] = []
        self.size: list[int] = []
        self.ids: dict[tuple, int] = {}
        self.scores: dict[tuple[int, int], int] = {}
        self.unions: dict[tuple[int, int], int] = {}
        self.aligned: dict[tuple[int, int], tuple[tuple[int, int], ...]] = {}

    def make(self, label: str, entries: tuple[int, ...]) -> int:
        key = label, entries
        if key not in self.ids:
            self.ids[key] = len(self.rows)
            self.rows.append(key)
            self.size.append(1 + sum(self.size[s] for s in entries))
        return self.ids[key]

    def label(self, shape: int) -> str:
        return self.rows[shape][0]

    def _comparable(self, a: int, b: int) -> set[tuple[int, int]]:
        """The pairs of different children of a and b that have one label."""
        by: dict[str, set[int]] = {}
        for s in self.rows[b][1]:
            by.setdefault(self.label(s), set()).add(s)
        return {(x, y) for x in set(self.rows[a][1]) for y in by.get(self.label(x), ()) if x != y}

    def _worked(self, memo: dict, a: int, b: int, needs, result):
        """memo[a, b], worked out with a list of open pairs, so that trees may be of any depth."""
        todo = [(a, b)]
        while todo:
            pair = todo[-1]
            if pair in memo:
                todo.pop()
                continue
            missing = [p for p in needs(*pair) if p not in memo]
            if missing:
                todo.extend(missing)
            else:
                memo[pair] = result(*pair)
                todo.pop()
        return memo[a, b]

    def score(self, a: int, b: int) -> int:
        """Simple tree matching: how many nodes of two trees match at most."""
        if a == b:
            return self.size[a]
        if self.label(a) != self.label(b):
            return 0
        return self._worked(self.scores, a, b, self._comparable, lambda a, b: 1 + sum(self._pair(self.rows[a][1][i], self.rows[b][1][j]) for i, j in self._children(a, b)))

    def _pair(self, x: int, y: int) -> int:
        return self.size[x] if x == y else self.scores.get((x, y), 0) if self.label(x) == self.label(y) else 0

    def _children(self, a: int, b: int) -> list[tuple[int, int]]:
        """The best alignment, in order, of the children of a and b; scores of comparable children must be known."""
        xs, ys = self.rows[a][1], self.rows[b][1]
        ux, ix = np.unique(xs, return_inverse=True) if xs else (np.empty(0, int), np.empty(0, int))
        uy, iy = np.unique(ys, return_inverse=True) if ys else (np.empty(0, int), np.empty(0, int))
        table = np.array([[self._pair(int(x), int(y)) for y in uy] for x in ux]).reshape(len(ux), len(uy))
        out: list[tuple[int, int]] = []

        def last_row(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
            best = np.zeros(len(columns) + 1, np.int64)
            for x in rows:
                best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + table[x][columns]))
            return best

        parts = [(0, len(xs), 0, len(ys))]
        while parts:  # halves of a, each with the part of b that suits it: memory stays linear
            i, k, j, n = parts.pop()
            if i == k or j == n:
                continue
            if k - i == 1:
                w = table[ix[i]][iy[j:n]]
                if w.max() > 0:
                    out.append((i, j + int(w.argmax())))
                continue
            mid = (i + k) // 2
            split = last_row(ix[i:mid], iy[j:n]) + last_row(ix[mid:k][::-1], iy[j:n][::-1])[::-1]
            cut = j + int(split.argmax())
            parts += [(i, mid, j, cut), (mid, k, cut, n)]
        return sorted(out)

    def pairs(self, a: int, b: int) -> tuple[tuple[int, int], ...]:
        """The alignment of the children of a and b, as positions."""
        if (a, b) not in self.aligned:
            if a == b:
                got = [(i, i) for i in range(len(self.rows[a][1]))]
            else:
                self.score(a, b)
                got = self._children(a, b)
            self.aligned[a, b] = tuple(got)
        return self.aligned[a, b]

    def _matched(self, a: int, b: int) -> list[tuple[int, int]]:
        """The different pairs of children that are aligned."""
        found = ((self.rows[a][1][i], self.rows[b][1][j]) for i, j in self.pairs(a, b))
        return [(x, y) for x, y in found if x != y]

    def union(self, a: int, b: int) -> int:
        """The form that has the nodes of both; a and b have one label."""
        if a == b:
            return a
        return self._worked(self.unions, a, b, self._to_unite, lambda a, b: self.make(self.label(a), self.run(self._laid(a, b))[0]))

    def _to_unite(self, a: int, b: int) -> list[tuple[int, int]]:
        todo = [p for p in self._matched(a, b) if p not in self.unions]
        return todo or self._neighbours(self._laid(a, b))

    def _laid(self, a: int, b: int) -> list[int]:
        """The children of both in order, those that are aligned united."""
        xs, ys, out, i, j = self.rows[a][1], self.rows[b][1], [], 0, 0
        for p, q in (*self.pairs(a, b), (len(xs), len(ys))):
            out += [*xs[i:p], *ys[j:q]]
            if p < len(xs):
                out.append(xs[p] if xs[p] == ys[q] else self.unions[xs[p], ys[q]])
            i, j = p + 1, q + 1
        return out

    def alike(self, a: int, b: int) -> bool:
        """Whether neighbours of these forms are one iteration: one label, and for plain boxes most nodes in common."""
        return self.label(a) == self.label(b) and (a == b or self.label(a) not in BOXES or 2 * self.score(a, b) >= ALIKE * (self.size[a] + self.size[b]))

    def _neighbours(self, entries: list[int]) -> list[tuple[int, int]]:
        """The first union that an iteration among entries still needs, if any."""
        last = None
        for s in entries:
            if last is not None and self.alike(last, s):
                if last != s and (last, s) not in self.unions:
                    return [(last, s)]
                last = last if last == s else self.unions[last, s]
            else:
                last = s
        return []

    def run(self, entries: list[int]) -> tuple[tuple[int, ...], list[int]]:
        """(entries with neighbours of one label made one, the number of each entry's new one)."""
        out: list[int] = []
        where = []
        for s in entries:
            if out and self.alike(out[-1], s):
                out[-1] = self.union(out[-1], s)
            else:
                out.append(s)
            where.append(len(out) - 1)
        return tuple(out), where

    def of(self, nodes: list[Node]) -> int:
        """The form of a page's tree; sets shape and runs of its nodes."""
        for n in reversed(nodes):
            entries, n.runs = self.run([c.shape for c in n.children])
            n.shape = self.make(n.label, entries)
        return nodes[0].shape


class Wrapper:
    """A host's wrapper: nodes numbered so that parents come first."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.parent, self.label = [p for p, _ in rows], [x for _, x in rows]
        self.children: list[list[int]] = [[] for _ in rows]
        for k, p in enumerate(self.parent):
            if k:
                self.children[p].append(k)
        self.shape: list[int] = []
        self.known: Shapes | None = None

    @classmethod
    def induce(cls, pages: list[str]) -> Wrapper:
        """The wrapper of a few pages."""
        shapes, whole = Shapes(), None
        for page in pages:
            shape = shapes.of(parse(page)[0])
            whole = shape if whole is None else shapes.union(whole, shape)
        rows, todo = [], [(0, whole)]
        while todo:
            parent, shape = todo.pop()
            rows.append((parent, shapes.label(shape)))
            todo += [(len(rows) - 1, s) for s in reversed(shapes.rows[shape][1])]
        return cls(rows)

    def dump(self) -> str:
        return json.dumps(list(zip(self.parent, self.label)))

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(json.loads(text))

    def align(self, nodes: list[Node], shapes: Shapes) -> None:
        """Sets at, the wrapper's node of each page node or its nearest aligned ancestor, and aligned."""
        if self.known is not shapes:
            self.known, self.shape = shapes, [0] * len(self.label)
            for k in range(len(self.label) - 1, -1, -1):
                self.shape[k] = shapes.make(self.label[k], tuple(self.shape[c] for c in self.children[k]))
        shapes.of(nodes)
        nodes[0].at, nodes[0].aligned = 0, True
        for n in nodes:
            pairs = dict(shapes.pairs(n.shape, self.shape[n.at])) if n.aligned else {}
            for c, r in zip(n.children, n.runs):
                c.aligned = r in pairs
                c.at = self.children[n.at][pairs[r]] if c.aligned else n.at

    def region(self, mass: dict[int, float]) -> list[int]:
        """The nodes of the content region; mass: varying text by node."""
        return _region(self.parent, self.label, self.children, mass)


def _region(parent: list[int], label: list[str], children: list[list[int]], mass: dict[int, float]) -> list[int]:
    total = [mass.get(k, 0.0) for k in range(len(label))]
    for k in range(len(total) - 1, 0, -1):
        total[parent[k]] += total[k]
    top = 0
    while total[top] > 0 and children[top]:
        best = max(children[top], key=lambda c: (total[c], -c))
        if total[best] < MAIN * total[top] or label[best].split(".")[0] in BLOCKS_OF_TEXT or all(label[c] == "#" for c in children[best]):
            break
        top = best
    inside = [False] * len(total)
    for k in range(len(total)):
        inside[k] = k == top or k > 0 and inside[parent[k]]
    return [k for k, x in enumerate(inside) if x]


def own_region(nodes: list[Node]) -> set[int]:
    """The ids of the nodes in the content region of a page that is looked at alone."""
    number = {id(n): k for k, n in enumerate(nodes)}
    parent = [0] * len(nodes)
    children: list[list[int]] = [[number[id(c)] for c in n.children] for n in nodes]
    for k, cs in enumerate(children):
        for c in cs:
            parent[c] = k
    mass = {k: float(n.weight) for k, n in enumerate(nodes) if not n.off}
    return {id(nodes[k]) for k in _region(parent, [n.label for n in nodes], children, mass)}


def slots(leaves: list[Node]) -> list[int]:
    """The slot and text of each leaf, as 64 bits of the labels down to it (the wrapper's, where it is aligned), text and number."""
    seen: Counter[tuple[bytes, str]] = Counter()
    out = []
    for x in leaves:
        key = x.path, x.text
        seen[key] += 1
        out.append(int.from_bytes(hashlib.blake2b(b"%s %d %s" % (x.path, seen[key], x.text.encode(errors="replace")), digest_size=8).digest(), "little", signed=True))
    return out


def positions(leaves: list[Node]) -> list[tuple[int, int]]:
    """The place of each leaf among those of its labels, from the start and from the end, from 1."""
    total, seen = Counter(x.path for x in leaves), Counter()
    out = []
    for x in leaves:
        seen[x.path] += 1
        out.append((seen[x.path], total[x.path] + 1 - seen[x.path]))
    return out


def _wrappers(rows: DataFrame) -> DataFrame:
    """(host, pages, wrapper) of the hosts with FEW different pages or more. rows: (host, html, share)."""
    full = rows.where(F.length("html") > 0)
    turn = F.struct(F.xxhash64("html").alias("h"), "html")
    one = full.groupBy("host", F.pmod(F.xxhash64("html", F.lit(1)), F.lit(REFERENCES)).alias("part")).agg(F.min(turn).alias("r"), F.sum("share").alias("n"))
    listed = one.groupBy("host").agg(F.round(F.sum("n")).cast("long").alias("pages"), F.array_sort(F.collect_list("r")).alias("refs")).where(F.col("pages") >= FEW)
    listed = listed.select("host", "pages", F.col("refs.html").alias("refs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                made = Wrapper.induce(batch.column(2)[k].as_py()).dump()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([made])], names=["host", "pages", "wrapper"])

    return listed.mapInArrow(run, "host string, pages long, wrapper string")


LEAF = "slot: long, at: int, often: boolean, out: boolean, head: boolean, named: boolean, own: boolean, plain: int, weight: int, first: int, last: int, text: string"
_LEAF = pa.struct([("slot", pa.int64()), ("at", pa.int32()), *((x, pa.bool_()) for x in ("often", "out", "head", "named", "own")), ("plain", pa.int32()), ("weight", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("text", pa.string())])


def _blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, share, leaves) of pages (page_id, url, host, share, html, wrapper).

    A leaf is marked often if SHARE of the host's pages in this part have it; out if its names say so; head if it is a
    first-level heading; named in article or main; own in the region of the page alone; plain counts its characters
    outside links, and weight is their weight for the region; first and last are its positions().
    """
    names = [f.name for f in _LEAF]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, Wrapper] = {}
        shapes = Shapes()
        for batch in batches:
            for i in range(0, len(batch), PART):
                part = batch.slice(i, PART)
                pages, times, blocks = Counter(), Counter(), []
                for host, share, page, text in zip(*(part.column(k).to_pylist() for k in (2, 3, 4, 5))):
                    nodes, leaves = parse(page or "")
                    if text:
                        if len(shapes.rows) > 100_000:  # a cache that starts anew
                            shapes = Shapes()
                        if host not in wrappers:
                            wrappers[host] = Wrapper.load(text)
                        wrappers[host].align(nodes, shapes)
                    heads = {id(c) for n in nodes if n.tag == "h1" for c in n.children}
                    alone = set() if any(x.off for x in leaves) else own_region(nodes)  # only asked for where names say nothing
                    own, places = slots(leaves), positions(leaves)
                    blocks.append((host, own, [(x.at if text else -1, x.off, id(x) in heads, bool(x.inside), id(x) in alone, len(x.text) - x.linked, x.weight, *at, x.text) for x, at in zip(leaves, places)]))
                    if page:
                        pages[host] += share
                    for s in own:
                        times[host, s] += share
                marked = [[dict(zip(names, (s, x[0], times[host, s] >= SHARE * pages[host] - 1e-6, *x[1:]))) for s, x in zip(own, rest)] for host, own, rest in blocks]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(marked, pa.list_(_LEAF))], names=["page_id", "url", "host", "share", "leaves"])

    return pages.mapInArrow(run, f"page_id long, url string, host string, share double, leaves array<struct<{LEAF}>>")


def _regions(varying: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, region): the wrapper nodes of each host's content region. varying: (host, at, plain)."""
    mass = varying.groupBy("host", "at").agg(F.sum("plain").alias("plain")).groupBy("host").agg(F.collect_list(F.struct("at", "plain")).alias("mass"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Wrapper.load(w).region({m["at"]: float(m["plain"]) for m in ms or ()}) for w, ms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["host", "region"])

    return wrappers.select("host", "wrapper").join(mass, "host", "left").select("host", "wrapper", "mass").mapInArrow(run, "host string, region array<int>")


def _chosen(rows: DataFrame) -> DataFrame:
    """(page_id, url, text) of rows (page_id, url, leaves, template, fixed, region)."""
    mass = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["weight"])
    const = "coalesce(array_contains(template, s.slot), false) AS const, coalesce(array_contains(fixed, s.slot), false) AS fixed, coalesce(array_contains(region, s.at), false) AS inside"
    rows = rows.select("page_id", "url", "region", F.expr(f"transform(filter(leaves, s -> not s.out), s -> struct(s.at, s.head, s.named, s.own, s.plain, s.weight, s.text, {const}))").alias("l"), F.exists("leaves", lambda s: s["out"]).alias("told"))
    rows = rows.withColumn("varied", F.filter("l", lambda s: ~s["const"])).withColumn("core", F.filter("varied", lambda s: s["inside"]))
    place = F.transform("l", lambda s: s["inside"] & ~s["const"])
    edge = F.struct(F.array_position(place, True).alias("begin"), (F.size("l") + 1 - F.array_position(F.reverse(place), True)).alias("end"), F.array_distinct(F.transform("core", lambda s: s["at"])).alias("ats"))
    rows = once(rows, "edge", edge)
    between = lambda s, i: ~s["fixed"] & s["inside"] & (i + 1 > F.col("edge.begin")) & (i + 1 < F.col("edge.end")) & (s["plain"] == F.length(s["text"])) & F.array_contains(F.col("edge.ats"), s["at"])
    by_wrapper = F.filter("l", lambda s, i: F.when(s["const"], between(s, i)).otherwise(s["inside"] | s["head"]))
    rest = F.when(F.size("varied") > 0, F.col("varied")).otherwise(F.col("l"))
    rows = rows.withColumn("rest", rest).withColumn("article", F.filter("rest", lambda s: s["named"]))
    alone = F.when((F.size("article") > 0) & (2 * mass(F.col("article")) >= mass(F.col("rest"))), F.col("article")).when(F.col("told"), F.col("rest")).otherwise(F.filter("rest", lambda s: s["own"] | s["head"]))
    follows = F.col("region").isNotNull() & (mass(F.col("core")) > 0) & (mass(F.col("core")) >= OTHER * mass(F.col("varied")))
    return rows.select("page_id", "url", F.array_join(F.transform(F.when(follows, by_wrapper).otherwise(alone), lambda s: s["text"]), "\n").alias("text"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    rows = rows.withColumn("copy", F.xxhash64("host", "html"))
    copies = stored(rows.where(F.length("html") > 0).groupBy("copy").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(copies), "copy", "left") if few else spread_join(rows, copies, "copy", "left")
    rows = rows.select("page_id", "url", "host", (1 / F.coalesce("n", F.lit(1))).alias("share"), "html")  # copies share one vote
    wrappers = stored(_wrappers(rows.select("host", "html", "share")), "wrappers")
    chars = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    small = chars <= BROADCAST_CHARS

    def by_host(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right), "host", "left") if small else spread_join(left, right, "host", "left")

    blocks = by_host(rows, wrappers.select("host", "wrapper")).select("page_id", "url", "host", "share", "html", "wrapper")
    blocks = stored(_blocks(blocks), "blocks")
    slot = blocks.select("host", F.explode(F.expr("transform(filter(leaves, s -> s.often), s -> s.slot)")).alias("slot")).distinct()
    slot = stored(only_ids(slot, wrappers.select("host"), "host"), "slots")
    votes = only_ids(blocks.select("host", "share", F.explode("leaves.slot").alias("slot")), slot, ["host", "slot"]).groupBy("host", "slot").agg(F.sum("share").alias("votes"))
    template = votes.join(wrappers.select("host", "pages"), "host").where(F.col("votes") >= SHARE * F.col("pages") - 1e-6).select("host", "slot", "pages")
    constant = stored(template, "constant")
    drop_stored(slot)
    # A constant text is fixed if it also has one place among the texts of its labels, from the start or from the end.
    held = only_ids(blocks.select("host", "share", F.explode(F.expr("transform(leaves, s -> struct(s.slot, s.first, s.last))")).alias("s")).select("host", "share", "s.*"), constant.select("host", "slot"), ["host", "slot"])
    place = held.select("host", "slot", "share", F.explode(F.array("first", -F.col("last"))).alias("place")).groupBy("host", "slot", "place").agg(F.sum("share").alias("n"))
    place = place.groupBy("host", "slot").agg(F.max("n").alias("n"))
    template = constant.join(place, ["host", "slot"]).groupBy("host").agg(F.collect_set("slot").alias("template"), F.collect_set(F.when(F.col("n") >= SHARE * F.col("pages") - 1e-6, F.col("slot"))).alias("fixed"))
    template = stored(template, "template")
    drop_stored(constant)
    varies = F.expr("filter(leaves, s -> not s.out and (template is null or not array_contains(template, s.slot)))")
    varying = by_host(blocks, template).select("host", varies.alias("leaves"))
    mass = varying.select("host", F.explode("leaves").alias("s")).where("s.at >= 0").select("host", "s.at", F.col("s.weight").alias("plain"))
    regions = stored(_regions(mass, wrappers), "regions")
    out = _chosen(by_host(by_host(blocks.select("page_id", "url", "host", "leaves"), template), regions))
    return out.select("page_id", "url", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
