"""Main text of web pages, by wrappers induced from the pages of each host.

A page becomes a tree of its block elements.  One page of each host, that with
the smallest hash, is the host's skeleton; the trees of all its pages are
aligned with it by simple tree matching, equal texts deciding between equal
alignments.  So each element of each page gets a slot: its place in the
skeleton, or its path below the nearest aligned element.  A text that nearly
all of the host's pages with a slot hold there is template; what varies in a
slot is content.  A page's region is its article element, or, if it has none,
the element with most of the varying text; of the region all content is its
text.  Element names, roles and class names leave out what can't be content
though it varies (menus, adverts, comments); within an article, names that only
might mean such a thing are overruled by a varying slot.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .urls import host_path

sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # matching goes as deep as pages do

#: A text is template if it is in its slot on such a share of the pages (of n of N
#: pages: (n + 1) / (N + 2), so that few pages are weak evidence), outside and within an article.
TEMPLATE, IN_ARTICLE = 0.8, 0.9
#: A page's body without an article: go down while one child has this share of the varying text.
DOWN = 0.8
#: An article in an element whose names exclude it counts if that has this share of the page's text.
HALF = 0.5
#: Wrappers are sent to all executors up to this many bytes, and joined by host beyond.
BROADCAST_BYTES = 16 << 20
#: Hosts whose skeletons or wrappers a task holds at once.
HOSTS = 2000
#: Cells of an alignment's table; longer lists of children are halved first.
CELLS = 1 << 22

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg canvas select button object audio video map".split())
UNPARSED = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOT_TEXT = frozenset("nav footer aside form dialog menu fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

#: Names of what isn't content.
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot adunit banner promo promotion sponsor sponsored cookie cookies "
    "consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription sidebar aside rail menu menus mainmenu "
    "submenu nav navbar topnav subnav navigation breadcrumb breadcrumbs footer foot colophon copyright masthead topbar toolbar comment "
    "comments commentlist respond responses reply replies disqus related recommended recommendations share sharing social widget widgets "
    "pagination pager login signup search skip".split()
)
#: Names that, as a whole, may or may not be such.
MAYBE_WORDS = frozenset("discussion".split())
#: Words beside them that leave the meaning as it is, and words that turn it round.
BESIDE = frozenset(
    "area article bar block blog body bottom box button buttons col column container content entry form global group header icons inner item items "
    "js left link links list main marketing page panel post posts primary right row secondary section site slot text title top unit user web wrap "
    "wrapper".split()
)
TURNED = frozenset("has is no non not with without".split())
WHOLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}} | {t: {"table"} for t in ("tr", "td", "th", "thead", "tbody", "tfoot")}
#: Comments, other declarations, tags.  Nothing in it goes back, and what isn't closed ends with the page.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?)*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ZEROS, _TOO_LARGE = re.compile(r"&#([xX]?)0{8,}"), re.compile(r"&#(?:0?[1-9][0-9]{7,}|[xX]0?[1-9a-fA-F][0-9a-fA-F]{6,});?")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}


class Page:
    """Block elements in page order: signatures, parents (by place) and the
    blocks of text: (element's place, text)."""

    __slots__ = ("sigs", "parents", "blocks")

    def __init__(self):
        self.sigs, self.parents, self.blocks = ["html||"], [-1], []


def _named(token: str) -> str:
    """n: a name of what isn't content; m: perhaps one; else empty."""
    parts = [p.lower() for p in _PARTS.findall(token)]
    if not NOT_TEXT_WORDS.intersection(parts):
        return "m" if MAYBE_WORDS.issuperset(parts) and parts else ""
    if TURNED.intersection(parts):
        return ""
    return "n" if all(p in NOT_TEXT_WORDS or p in BESIDE or len(p) == 1 for p in parts) else "m"


@lru_cache(4096)
def signature(tag: str, attributes: str) -> str:
    """tag, what it is (x: never content, n: not by its names, m: perhaps not by
    its names, h: a header by its names, a: article), class and id."""
    if not attributes.strip():
        return f"{tag}|{'x' if tag in NOT_TEXT else 'a' if tag in WHOLE else ''}|"
    found: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), unescaped(v.strip("\"'")))
    names = f"{found.get('class', '')} {found.get('id', '')}"
    parts = {p.lower() for p in _PARTS.findall(names)}
    role, style = found.get("role", "").lower(), found.get("style", "").replace(" ", "").lower()
    said = {_named(t) for t in names.split()}
    kind = ""
    if tag in NOT_TEXT or role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        kind = "x"
    elif "n" in said or "m" in said:
        kind = "n" if "n" in said else "m"
    elif tag in WHOLE or role in ("main", "article") or found.get("itemprop") == "articleBody":
        kind = "a"
    elif "header" in parts and not parts & {"post", "entry", "article", "content", "story", "section"} and tag not in HEADINGS:
        kind = "h"
    return f"{tag}|{kind}|{re.sub(r'[0-9]+', '#', ' '.join(names.split()))}"


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond all characters are U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _TOO_LARGE.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", text))
    return entities.unescape(text)


def parse(page: str | None) -> Page:
    """The block elements and texts of a page; malformed pages give some.  Takes
    time in proportion to the page's length, however deep its elements."""
    page, out = page or "", Page()
    names, nodes = ["html"], [0]
    places: dict[str, list[int]] = {}  # of each open element's name the places in names
    solid: list[int] = []  # those of block elements
    text: list[str] = []
    last_end: dict[str, int] = {}
    skip, at = "", 0

    def flush() -> None:
        if text:
            if block := " ".join(unescaped("".join(text)).split()):
                out.blocks.append((nodes[-1], block))
            text.clear()

    def open_(tag: str, sig: str) -> None:
        out.sigs.append(sig)
        out.parents.append(nodes[-1])
        places.setdefault(tag, []).append(len(names))
        if tag in BLOCKS:
            solid.append(len(names))
        names.append(tag)
        nodes.append(len(out.sigs) - 1)

    def close(where: int) -> None:
        while len(names) > where:
            places[names.pop()].pop()
            nodes.pop()
            if solid and solid[-1] == len(names):
                solid.pop()

    def last(tag: str) -> int:
        held = places.get(tag)
        return held[-1] if held else 0

    def ends_later(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in _ENDS[tag].finditer(page)), default=-1)
        return last_end[tag] >= at

    while m := _TOKEN.search(page, at):
        if m.start() > at and not skip:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or (skip and not (tag == skip and m[1])):
            continue
        if tag in RAW:
            if m[1]:
                skip = ""
            elif tag in UNPARSED:
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
            elif not m[3].endswith("/") and ends_later(tag):
                skip = tag
        elif tag == "br":
            text.append(" ")
        elif m[1]:
            where = last(tag)
            if where and (tag in BLOCKS or not (solid and solid[-1] > where)):
                flush()
                close(where)
            elif tag in BLOCKS:
                flush()
        elif tag in ("html", "body", "head"):
            flush()
        elif tag in BLOCKS:
            flush()
            if (where := last("p")) and solid[-1] == where:
                close(where)  # a block ends an open paragraph
            if tag in _CLOSES:
                scope = max(map(last, _SCOPE[tag]))
                held = [places[t] for t in _CLOSES[tag] if last(t) > scope]
                if held:
                    close(min(p[bisect(p, scope)] for p in held))
            if tag not in VOID:
                open_(tag, signature(tag, m[3]))
                if m[3].endswith("/"):
                    close(len(names) - 1)
        elif m[3].strip() and tag not in VOID and (sig := signature(tag, m[3])).split("|")[1] in ("x", "n"):
            flush()
            open_(tag, sig)
    if at < len(page) and not skip:
        text.append(page[at:])
    flush()
    return out


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


class Tree:
    """Elements with children, and hashes of each one's structure and text with all below it."""

    __slots__ = ("sigs", "kids", "shapes", "marks", "sizes")

    def __init__(self, sigs: list[str], parents: list[int], own: list[int]):
        n = len(sigs)
        self.sigs, self.kids = sigs, [[] for _ in range(n)]
        for i in range(1, n):
            self.kids[parents[i]].append(i)
        self.shapes, self.marks, self.sizes = [0] * n, [0] * n, [1] * n
        for i in range(n - 1, -1, -1):
            below = self.kids[i]
            self.shapes[i] = xxhash.xxh64_intdigest(sigs[i].encode("utf-8", "replace") + b"".join([self.shapes[k].to_bytes(8, "big") for k in below]))
            self.marks[i] = xxhash.xxh64_intdigest(b"".join([self.marks[k].to_bytes(8, "big") for k in below]), own[i]) >> 1
            self.sizes[i] += sum([self.sizes[k] for k in below])


def tree(page: Page) -> Tree:
    own = [0] * len(page.sigs)
    for i, text in page.blocks:
        own[i] = own[i] * 31 + text_hash(text) & (1 << 63) - 1
    return Tree(page.sigs, page.parents, own)


_MEMO: dict[tuple[int, int], int] = {}
#: Matched elements count before equal texts, which only decide between alignments of as many.
_ELEMENT = 1 << 24


def match(a: Tree, i: int, b: Tree, j: int) -> int:
    """Simple tree matching: elements in the largest common top-down ordered mapping."""
    if a.sigs[i] != b.sigs[j]:
        return 0
    if a.shapes[i] == b.shapes[j]:
        return a.sizes[i]
    key = (a.shapes[i], b.shapes[j])
    if key not in _MEMO:
        if len(_MEMO) > 1 << 20:
            _MEMO.clear()
        x, y = a.kids[i], b.kids[j]
        _MEMO[key] = 1 + (int(_table(_weights(a, x, b, y, False), len(x), len(y), False)[-1][-1]) if x and y else 0)
    return _MEMO[key]


def _weights(a: Tree, x: list[int], b: Tree, y: list[int], texts: bool):
    """Of an element of x (by place) its weights with all of y."""
    firsts: dict[int, int] = {}
    classes = np.array([firsts.setdefault(b.shapes[j], k) for k, j in enumerate(y)])
    rows: dict[int, np.ndarray] = {}
    marks = np.array([b.marks[j] for j in y], np.int64)

    def of(k: int) -> np.ndarray:
        shape = a.shapes[x[k]]
        if shape not in rows:
            own = np.zeros(len(y), np.int64)
            for first in firsts.values():
                own[first] = match(a, x[k], b, y[first])
            rows[shape] = own[classes]
        if not texts:
            return rows[shape]
        return rows[shape] * _ELEMENT + ((marks == a.marks[x[k]]) & (rows[shape] > 0))

    return of


def _table(of, n: int, m: int, whole: bool, turned: bool = False) -> list[np.ndarray]:
    """Weights of the best alignments of the first i and j; all rows or the last one."""
    row = np.zeros(m + 1, np.int64)
    rows = [row]
    for i in range(n):
        w = of(n - 1 - i)[::-1] if turned else of(i)
        best = np.zeros(m + 1, np.int64)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w), out=best[1:])
        row = best
        if whole:
            rows.append(row)
        else:
            rows = [row]
    return rows


def aligned(a: Tree, x: list[int], b: Tree, y: list[int]) -> list[tuple[int, int]]:
    """Pairs of the best alignment of two lists of siblings."""
    out, head, tail = [], 0, 0
    most = min(len(x), len(y))
    same = lambda i, j: a.shapes[i] == b.shapes[j] and a.marks[i] == b.marks[j]
    while head < most and same(x[head], y[head]):
        out.append((x[head], y[head]))
        head += 1
    while tail < most - head and same(x[-1 - tail], y[-1 - tail]):
        out.append((x[-1 - tail], y[-1 - tail]))
        tail += 1
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if not x or not y:
        return out
    if len(x) == len(y) and (len(x) == 1 or all(a.shapes[i] == b.shapes[j] for i, j in zip(x, y, strict=True))):
        return out + [(i, j) for i, j in zip(x, y, strict=True) if a.sigs[i] == b.sigs[j]]
    parts = [(x, y)]
    while parts:
        x, y = parts.pop()
        of = _weights(a, x, b, y, True)
        if len(x) > 1 and len(x) * len(y) > CELLS:
            half = len(x) // 2
            top = _table(of, half, len(y), False)[-1]
            rest = _table(lambda k, half=half, of=of: of(k + half), len(x) - half, len(y), False, True)[-1]
            cut = int(np.argmax(top + rest[::-1]))
            parts += [(p, q) for p, q in ((x[:half], y[:cut]), (x[half:], y[cut:])) if p and q]
            continue
        t, i, j = _table(of, len(x), len(y), True), len(x), len(y)
        while i and j:
            w = of(i - 1)[j - 1]
            if w and t[i][j] == t[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((x[i], y[j]))
            elif t[i][j] == t[i][j - 1]:
                j -= 1
            else:
                i -= 1
    return out


def slots(page: Page, skeleton: Tree | None) -> list[int]:
    """Of each element its place in the skeleton, or, where it is aligned with
    none, a hash of its signature and the slot of the element that holds it."""
    out = [-1] * len(page.sigs)
    if skeleton is not None:
        own, pairs = tree(page), [(0, 0)]
        while pairs:
            i, j = pairs.pop()
            out[j] = i
            pairs += aligned(skeleton, skeleton.kids[i], own, own.kids[j])
    for j, slot in enumerate(out):
        if slot < 0:
            above = out[page.parents[j]] if j else 0
            out[j] = xxhash.xxh64_intdigest(page.sigs[j].encode("utf-8", "replace"), above) >> 2 | 1 << 62
    return out


class Wrapper:
    """A host's skeleton, and its template: (slot, text's hash), strong where it counts within articles too."""

    def __init__(self, skeleton: Tree | None = None, template: dict[tuple[int, int], bool] | None = None):
        self.skeleton, self.template = skeleton, template or {}

    @classmethod
    def read(cls, skeleton: str | None, template: list | None) -> Wrapper:
        return cls(Tree(*json.loads(skeleton)) if skeleton else None, {(t["slot"], t["text"]): t["strong"] for t in template or []})


def skeleton_json(page: str | None) -> str:
    found = parse(page)
    own = [0] * len(found.sigs)
    for i, text in found.blocks:
        own[i] = own[i] * 31 + text_hash(text) & (1 << 63) - 1
    return json.dumps([found.sigs, found.parents, own])


class Layout:
    """Which elements of a page are left out by element and names."""

    def __init__(self, page: Page):
        n = len(page.sigs)
        self.parents = page.parents
        self.kinds = [s.split("|", 2)[1] for s in page.sigs]
        self.headers = [k == "h" or s.startswith("header|") for k, s in zip(self.kinds, page.sigs, strict=True)]
        self.total, self.holds = [0] * n, [False] * n
        for i, text in page.blocks:
            self.total[i] += len(text)
        for i in range(n - 1, 0, -1):
            above = page.parents[i]
            self.total[above] += self.total[i]
            if self.kinds[i] == "a" or (self.kinds[i] != "x" and self.holds[i]):
                self.holds[above] = True

    def excluded(self, i: int, inside: bool, strict: bool) -> bool:
        kind = self.kinds[i]
        if kind == "n" or (kind == "m" and not inside):  # names that would leave no content say something else
            return strict or self.total[i] < (HALF if self.holds[i] else DOWN) * self.total[0]
        return kind == "x" or (self.headers[i] and not inside)

    def article(self) -> list[bool]:
        """Of each element whether it is of an article element's content; empty if the page has none with text."""
        for strict in (True, False):
            within, inside = [], []
            for i, above in enumerate(self.parents):
                how, deep = (within[above], inside[above]) if i else (False, False)
                if self.excluded(i, deep, strict):
                    how, deep = False, True
                elif self.kinds[i] == "a" and not deep and self.total[i]:
                    how, deep = True, True
                within.append(how)
                inside.append(deep)
            if any(within):
                return within
        return []

    def body(self, chars: list[int]) -> list[bool]:
        """Of each element whether it is of the body: the element in which most varying text is.  chars: each one's own."""
        n = len(self.parents)
        out = [self.excluded(i, False, False) for i in range(n)]
        mass = list(chars)
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            mass[i] = 0 if out[i] else mass[i]
            mass[self.parents[i]] += mass[i]
            kids[self.parents[i]].append(i)
        root = 0
        while kids[root] and mass[root]:
            best = max(reversed(kids[root]), key=mass.__getitem__)
            if out[best] or mass[best] < DOWN * mass[root] or not kids[best]:
                break
            root = best
        within = [False] * n
        for i in range(root, n):
            within[i] = not out[i] and (i == root or (self.parents[i] >= root and within[self.parents[i]]))
        return within


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The page's content, block by block in page order; without a wrapper all its text varies."""
    found, wrapper = parse(page), wrapper or Wrapper()
    layout = Layout(found)
    strong: list[bool | None] = [None] * len(found.blocks)  # of template whether its evidence is strong
    if wrapper.template:
        at = slots(found, wrapper.skeleton)
        strong = [wrapper.template.get((at[i], text_hash(text))) for i, text in found.blocks]
    if within := layout.article():
        # Perhaps-names need less: name and template agree.
        weak = [k == "m" for k in layout.kinds]
        for i in range(1, len(weak)):
            weak[i] = weak[i] or weak[found.parents[i]]
        kept = [text for (i, text), s in zip(found.blocks, strong, strict=True) if within[i] and not (s or (s is False and weak[i]))]
        return "\n\n".join(kept or [text for i, text in found.blocks if within[i]])
    chars = [0] * len(found.sigs)
    for (i, text), s in zip(found.blocks, strong, strict=True):
        chars[i] += len(text) if s is None else 0
    within = layout.body(chars)
    return "\n\n".join([text for (i, text), s in zip(found.blocks, strong, strict=True) if within[i] and s is None])


def evidence(page: str | None, skeleton: Tree | None) -> list[tuple[int, int, int]]:
    """(slot, text, other): of each block its slot and hash, and the hash of the
    page's longest other text.

    Pages that hold a text and have one longest other text count once for it:
    they are near copies, and what those share is no template.  A line is
    template where pages hold it that differ beside it."""
    found = parse(page)
    at = slots(found, skeleton)
    blocks = {(at[i], text_hash(text)) for i, text in found.blocks}
    longest = sorted({(-len(text), text_hash(text)) for _, text in found.blocks})[:2]
    first, second = [h for _, h in longest + [(0, 0)] * (2 - len(longest))]
    return [(slot, text, second if text == first else first) for slot, text in blocks]


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, skeleton (JSON), template array<struct<slot, text, strong>>: of every host.

    The skeleton is the host's page with the smallest hash, and texts are counted
    exactly over its distinct pages, so neither the order of pages nor
    their partitions nor copies change a wrapper.  A task holds one page for each
    of its hosts; counts combine before they are shuffled, whatever a host's share."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, str | None]] = {}
        for batch in batches:
            for host, mark, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if host not in held or mark < held[host][0]:
                    held[host] = mark, page
            if len(held) > HOSTS:
                yield _skeletons(held)
                held = {}
        if held:
            yield _skeletons(held)

    host, _ = host_path(F.col(url))
    page = F.col(html).cast("string")
    rows = pages.select(host.alias("host"), F.coalesce(F.xxhash64(page), F.lit(0)).alias("mark"), page.alias("page"))
    skeletons = rows.mapInArrow(smallest, "host string, mark long, skeleton string")
    skeletons = written(skeletons.groupBy("host").agg(F.min_by("skeleton", F.struct("mark", "skeleton")).alias("skeleton")), "skeletons")
    own, shared = _beside(rows, skeletons, "skeleton")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Tree | None] = {}
        for batch in batches:
            found: dict[tuple, None] = {}
            for host, mark, page, skeleton in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if host not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    skeleton = skeleton if shared is None else shared.value[host][0]
                    known[host] = Tree(*json.loads(skeleton)) if skeleton else None
                found.update(((host, mark, *e), None) for e in evidence(page, known[host]))
            if found:
                cols = zip(*found, strict=True)
                types = (pa.string(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "mark", "slot", "text", "other"])

    blocks = written(own.mapInArrow(counted, "host string, mark long, slot long, text long, other long"), "blocks")
    n = blocks.select("host", "slot", "text", "other").distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("n")).where("n > 1")
    of = blocks.select("host", "slot", "mark").distinct().groupBy("host", "slot").agg(F.count("*").alias("of"))
    share = (F.col("n") + 1) / (F.col("of") + 2)
    found = n.join(of, ["host", "slot"]).where(share >= TEMPLATE)
    found = found.select("host", F.struct("slot", "text", (share >= IN_ARTICLE).alias("strong")).alias("t"))
    template = found.groupBy("host").agg(F.sort_array(F.collect_list("t")).alias("template"))
    return skeletons.join(template, "host", "left")


def _skeletons(held: dict[str, tuple[int, str | None]]) -> pa.RecordBatch:
    marks, pages = zip(*held.values(), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(marks, pa.int64()), pa.array(list(map(skeleton_json, pages)))], names=["host", "mark", "skeleton"])


def _beside(rows: DataFrame, known: DataFrame, *names: str) -> tuple[DataFrame, Broadcast | None]:
    """rows with what is known of their host as the last columns; a small table is
    broadcast instead (by host), with nulls in these columns."""
    size = sum([F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in ("host", *names)], F.lit(0))
    if known.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        held = {r.host: tuple(r[c] for c in names) for r in known.select("host", *names).collect()}
        shared = rows.sparkSession.sparkContext.broadcast(held)
        return rows.select("*", *[F.lit(None).cast(known.schema[c].dataType).alias(f"known {c}") for c in names]), shared
    known = known.select("host", *[F.col(c).alias(f"known {c}") for c in names])
    return rows.join(known, "host", "left").select(*rows.columns, *[f"`known {c}`" for c in names]), None


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every row.

    Null html is an empty page, with empty text.  Pages without a host are
    taken for one host's; where all of a host's pages are copies, all their text
    varies.  Of an article whose every text is template all are kept.
    Repeated rows come back as often as they came.
    """
    host, _ = host_path(F.col(url))
    ids = F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url")
    rows = pages.select(*ids, F.col(html).cast("string").alias("page"), host.alias("host"))
    own, shared = _beside(rows, written(wrappers(pages, url, html), "wrappers"), "skeleton", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for page, host, *w in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if host not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    known[host] = Wrapper.read(*(w if shared is None else shared.value[host]))
                texts.append(extract(page, known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return own.mapInArrow(run, "page_id long, url string, text string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    from .common import table

    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
