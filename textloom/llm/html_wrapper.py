"""Operator 1: main text of pages by wrappers that are inferred for each host.

Method: a page is a balanced stream of block tags and texts.  A *wrapper* is a
union-free regular expression over such streams: tags with content, text slots,
groups that may be missing (optional) and groups that may repeat.  It starts as
one page, whose repeated siblings are folded into repeated groups, and takes in
one page of the same host after another: both streams are aligned; equal tags
go into each other; different texts at a place make a text slot; what stands in
one stream only becomes optional; neighbours that have become alike become a
repeated group.

Each slot knows how many texts it took, their length, how much of it was links,
and whether all were equal.  From these the wrapper's regions get a role: menus,
headers, footers, adverts, forms, comments and the like by tag or by a class, id
or role that says nothing else; where such a word stands among others
(``notice-of-award``), the slots decide: what is mostly links, or the same on
``FIXED_PAGES`` pages and more.  A form around half of the text or more is a
plain container.  Article regions go by their tag, all of them but those that
are mostly links or teasers beside others; without such a tag, by descending to
the container of most changing, unlinked text.  A page is aligned with its
host's wrapper and yields the texts of slots in the article.

A wrapper's size does not follow the number of pages.  Parts of names where
letters and digits take turns (``css-x1y2z3``) are generated and count as one
name.  A place that has taken more than ``KEYS_AT_PLACE`` different keys or
``GROUPS_AT_PLACE`` groups becomes *loose*: it holds one unit for each tag and
role, in any order and number, ``(a?b?)*``.  What a name says about a region's
role outlives this.  If the article has no tag and the descent ends at a loose
place, the wrapper doesn't tell its parts apart, and the page is judged alone.

Alignment is a longest common subsequence at every size, in linear space.
Wrappers are folded inside each task and then merged by host, some ``FAN`` at a
time until one is left: what is shuffled is a wrapper for each task and host,
never a page, so a host with a third of all pages is like any other.  Which
slots become optional or repeated can depend on how pages fall into tasks; the
order of merging inside a group is fixed.

Cases: null or empty html gives empty text; a null url is a host of its own;
equal pages and page_ids are extracted row by row; a page whose article is not
where its host has it is judged by itself; cut-off pages and unclosed tags close
at the end of what encloses them; tags may nest to any depth; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import slices, table, written

#: Lists whose lengths multiply to less are aligned by a full table; longer ones are halved first.
SMALL_TABLE = 4096
#: Hosts that a task folds at a time before it hands on their wrappers.
HELD_HOSTS = 500
#: Wrappers of a host that a task merges at once.
FAN = 32
SALTS = 64
#: Wrappers are broadcast up to this many characters in all, and joined by host and salt beyond.
BROADCAST_CHARS = 32_000_000
#: A slot is fixed text of the host if so many pages at least had the same text there.
FIXED_PAGES = 5
#: Different keys, and groups, that a place takes in order; beyond them it is loose.
KEYS_AT_PLACE, GROUPS_AT_PLACE = 64, 512
#: Share of a container's changing text that a part must hold to be descended to.
DESCEND = 0.7

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IGNORED = frozenset("html head body".split())
#: Opening one of these closes an open one of those.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: End tags of other elements don't close these.
CONTAINERS = frozenset("article aside blockquote div footer form header main nav section table td th ul ol dl".split())
#: Block tags without a rule of their own; other names are those of custom elements.
PLAIN_TAGS = frozenset("address caption center col colgroup dd details dt fieldset figcaption figure hgroup legend li optgroup option p pre search slot summary tbody tfoot thead tr".split())
CHROME_TAGS = frozenset("nav footer aside form button select datalist dialog noscript template svg object audio video canvas menu map".split())
CHROME_WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus dropdown footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: The same, but only outside an article.
HEADER_WORDS = frozenset(("header", "masthead"))
#: Words that may stand beside those of CHROME_WORDS in a class and change nothing.
SOFT_WORDS = frozenset(
    "area article author bar block body bottom box button buttons col column container content count entry feed form group head heading holder icon icons inner item items left link links list main message module more outer page panel post right row section site slot story thread title top unit wrap wrapper".split()
)
#: Articles of these classes are pointers to others.
TEASER_WORDS = frozenset("card excerpt preview promo related teaser teasers tile".split())
ARTICLE_ROLES = frozenset(("main", "articlebody"))

_TAGS = INLINE | VOID | HEADINGS | CONTAINERS | PLAIN_TAGS | CHROME_TAGS

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|iframe|xmp)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s<>/]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z!?][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_LOOSE = re.compile(r"</?([a-zA-Z][^\s<>/]*)")
_ATTRIBUTE = re.compile(r"(?<![-\w])(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?<![-\w])hidden(?![-\w=])|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
#: A part of a name in which letters and digits take turns.
_GENERATED = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z]+\d+[A-Za-z]+\d|\d+[A-Za-z]+\d+[A-Za-z])[A-Za-z0-9]*")


class Leaf:
    """Text of a page; in a wrapper, a slot: texts taken, their characters, linked ones, hash while all are equal."""

    __slots__ = ("text", "n", "chars", "linked", "same")
    key = "#"

    def __init__(self, text: str, n: int, chars: int, linked: int, same: int | None):
        self.text, self.n, self.chars, self.linked, self.same = text, n, chars, linked, same


class Node:
    __slots__ = ("key", "kids", "groups", "loose")

    def __init__(self, key: str):
        self.key = key
        self.loose = False
        self.kids: list[Node | Leaf] = []
        self.groups: list[Group] | None = None


class Group:
    """Units that stand together; may be missing, may repeat."""

    __slots__ = ("keys", "units", "optional", "repeated")

    def __init__(self, units: list, optional: bool = False, repeated: bool = False):
        self.keys, self.units = tuple(u.key for u in units), units
        self.optional, self.repeated = optional, repeated


# --- pages as trees ---------------------------------------------------------


@lru_cache(65536)
def _key(tag: str, attributes: str) -> str:
    """The tag, and the class, id and role with digits and generated parts made equal."""
    if not attributes.strip(" /"):
        return tag
    found = sorted((k.lower(), v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes))
    name = " ".join(v for _, v in found)
    if _HIDDEN.search(attributes):
        name += " hidden"
    return f"{tag}.{_DIGITS.sub('0', _GENERATED.sub('0', name))}" if name else tag


@lru_cache(65536)
def _words(key: str) -> frozenset[str]:
    name = key.partition(".")[2]
    return frozenset(w.lower() for w in [*re.split(r"[^A-Za-z]+", name), *_PARTS.findall(name)] if w)


def _tag(key: str) -> str:
    return key.partition(".")[0]


def parse(html: str) -> Node:
    """The tree of block tags and texts."""
    root = Node("")
    stack, tags = [root], [""]
    text: list[str] = []
    links = linked = 0
    last = 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(text)
        text.clear()
        clean = " ".join(unescape(raw).split()) if raw else ""
        if clean:
            stack[-1].kids.append(Leaf(clean, 1, len(clean), min(linked, len(clean)), crc32(clean.encode("utf-8", "surrogatepass"))))
        linked = 0

    def close_to(at: int) -> None:
        del stack[at:], tags[at:]

    for m in _MARKUP.finditer(html):
        start, end = m.span()
        if start > last:
            piece = html[last:start]
            text.append(piece)
            if links:
                linked += len(piece)
        last = end
        name = m[3]
        if name:
            closing, attributes = bool(m[2]), m[4]
        elif (loose := _LOOSE.match(html, start, end)) and not m[1]:
            # quotes that don't match: what can be read of the tag
            name, closing, attributes = loose[1], html[start + 1] == "/", ""
        else:
            continue
        tag = name.lower()
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            if tag in ("br", "img", "wbr"):
                text.append(" ")
            marked = False
            if not closing and attributes and tag in ("span", "a"):
                marked = bool(_words(_key(tag, attributes)) & CHROME_WORDS)
            if not marked and not (closing and tags[-1] == tag):
                continue
        flush()
        links = 0 if tag != "a" else links
        if tag in IGNORED:
            continue
        if closing:
            for at in range(len(tags) - 1, 0, -1):
                if tags[at] == tag:
                    close_to(at)
                    break
                if tags[at] in CONTAINERS and (tag not in CONTAINERS or tags[at] in ("td", "th") and tag not in ("table",)):
                    break
            continue
        if tags[-1] == "p" or tag in HEADINGS and tags[-1] in HEADINGS:
            close_to(len(tags) - 1)
        for other in CLOSES.get(tag, ()):
            for at in range(len(tags) - 1, 0, -1):
                if tags[at] == other:
                    close_to(at)
                    break
                if tags[at] in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in VOID:
            continue
        node = Node(_key(tag, attributes))
        stack[-1].kids.append(node)
        stack.append(node)
        tags.append(tag)
    text.append(html[last:])
    flush()
    return root


# --- wrappers ---------------------------------------------------------------


def _periods(keys: list[str]) -> list[tuple[int, np.ndarray]]:
    """Periods that may repeat, the shortest first, and for each place how many of its keys equal those a period later."""
    code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    if len(code) == len(keys):
        return []
    x = np.array([code[k] for k in keys])
    order = np.argsort(x, kind="stable")
    near = np.diff(order)[x[order][1:] == x[order][:-1]]  # distances of equal keys that follow each other
    out = []
    for p in np.unique(near).tolist():
        same = np.append(x[:-p] == x[p:], False)
        stop = np.flatnonzero(~same)
        run = stop[np.searchsorted(stop, np.arange(len(same)))] - np.arange(len(same))
        if (run >= p).any():
            out.append((p, np.append(run, np.zeros(p, np.int64))))
    return out


def _runs(kids: list) -> Iterator[tuple[int, int, int]]:
    """``(place, period, times)``: siblings cut where what stands twice or more in a row begins and ends."""
    i, n = 0, len(kids)
    periods = _periods([k.key for k in kids]) if n > 1 else []
    while i < n:
        best, period = 1, 1
        for p, run in periods:
            times = 1 + int(run[i]) // p
            if times > 1 and times * p > best * period:
                best, period = times, p
        yield i, period, best
        i += best * period


def fold(kids: list) -> list[Group]:
    """Groups of siblings: what stands twice or more in a row is a repeated group."""
    groups = []
    for i, period, times in _runs(kids):
        units = [_wrap(kids[i + j]) for j in range(period)]
        for t in range(1, times):
            units = [merge(u, _wrap(kids[i + t * period + j])) for j, u in enumerate(units)]
        groups.append(Group(units, repeated=times > 1))
    return groups


def _wrap(unit: Node | Leaf) -> Node | Leaf:
    if isinstance(unit, Leaf):
        return Leaf("", unit.n, unit.chars, unit.linked, unit.same)
    out = Node(unit.key)
    out.groups = fold(unit.kids)
    return out


def wrapper_of(page: Node) -> Node:
    return _wrap(page)


def merge(a: Node | Leaf, b: Node | Leaf) -> Node | Leaf:
    """A unit that takes what either takes; their keys are equal."""
    if isinstance(a, Leaf):
        return Leaf("", a.n + b.n, a.chars + b.chars, a.linked + b.linked, a.same if a.same == b.same else None)
    out = Node(a.key)
    out.loose = a.loose or b.loose
    groups = [*a.groups, *b.groups] if out.loose else generalise(a.groups, b.groups)
    if not out.loose:
        out.loose = len(groups) > GROUPS_AT_PLACE or len({u.key for g in groups for u in g.units}) > KEYS_AT_PLACE
    out.groups = loosened(groups) if out.loose else groups
    return out


def loosened(groups: list[Group]) -> list[Group]:
    """One optional, repeated unit for each tag and role of the groups' units."""
    held: dict[str, Node | Leaf] = {}
    for g in groups:
        for u in g.units:
            key = role_key(u.key)
            one = u
            if isinstance(u, Node):
                one = Node(key)
                one.groups, one.loose = u.groups, u.loose
            held[key] = merge(held[key], one) if key in held else one
    return [Group([held[key]], True, True) for key in sorted(held)]


def _together(a: Group, b: Group, repeated: bool = False) -> Group:
    units = [merge(x, y) for x, y in zip(a.units, b.units, strict=True)]
    return Group(units, a.optional or b.optional, a.repeated or b.repeated or repeated)


def _collapse(groups: list[Group], periods: set[tuple[str, ...]]) -> list[Group]:
    """Single groups in a row that the other stream has as one period become that period."""
    if not periods:
        return groups
    out: list[Group] = []
    for g in groups:
        out.append(g)
        for keys in periods:
            tail = out[-len(keys) :]
            if all(len(t.keys) == 1 for t in tail) and tuple(t.keys[0] for t in tail) == keys:
                one = Group([t.units[0] for t in tail], all(t.optional for t in tail))
                out[-len(keys) :] = [one]
                break
    return out


def _table(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence by the table of all suffixes."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, under = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = under[j + 1] + 1 if a[i] == b[j] else max(under[j], row[j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _common(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` with each beginning of ``b``; a row of the table is one number's bits."""
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        both = row & at.get(x, 0)
        row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; long lists are halved where both halves have most in common."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= SMALL_TABLE:
            out += [(i + x, j + y) for x, y in _table(a[i:n], b[j:m])]
        elif n - i == 1:
            if a[i] in b[j:m]:
                out.append((i, b.index(a[i], j, m)))
        else:
            mid = (i + n) // 2
            cut = int(np.argmax(_common(a[i:mid], b[j:m]) + _common(a[mid:n][::-1], b[j:m][::-1])[::-1]))
            todo += [(mid, n, j + cut, m), (i, mid, j, j + cut)]
    return sorted(out)


def generalise(a: list[Group], b: list[Group]) -> list[Group]:
    """The groups of both streams: matched ones merged, others optional, neighbours alike repeated."""
    a2 = _collapse(a, {g.keys for g in b if len(g.keys) > 1})
    b2 = _collapse(b, {g.keys for g in a if len(g.keys) > 1})
    out: list[Group] = []

    def put(g: Group) -> None:
        if out and out[-1].keys == g.keys:
            both = _together(out[-1], g, repeated=True)
            both.optional = out[-1].optional and g.optional
            out[-1] = both
        else:
            out.append(g)

    def alone(groups: list[Group]) -> None:
        for g in groups:
            put(Group(g.units, True, g.repeated))

    i = j = 0
    for x, y in [*aligned([g.keys for g in a2], [g.keys for g in b2]), (len(a2), len(b2))]:
        alone(a2[i:x])
        alone(b2[j:y])
        if x < len(a2):
            put(_together(a2[x], b2[y]))
        i, j = x + 1, y + 1
    return out


def dumps(unit: Node) -> str:
    """A flat list, a unit's groups and their units following it, so that no depth is too much."""
    out: list = []
    todo: list = [unit]
    while todo:
        u = todo.pop()
        if isinstance(u, Group):
            out += [len(u.units), int(u.optional) + 2 * int(u.repeated)]
            todo += reversed(u.units)
        elif isinstance(u, Leaf):
            out += ["#", u.n, u.chars, u.linked, u.same]
        else:
            out += [u.key, 2 * len(u.groups) + u.loose]
            todo += reversed(u.groups)
    return json.dumps(out, separators=(",", ":"), ensure_ascii=False)


def loads(text: str) -> Node:
    flat = iter(json.loads(text))
    whole: list[Node] = []

    def opened(key: str) -> tuple[Node, int]:
        n = next(flat)
        node = Node(key)
        node.groups, node.loose = [], bool(n & 1)
        whole.append(node)
        return node, n >> 1

    root, first = opened(next(flat))
    #: What is still to be read: groups of a node, or units of a group.
    todo: list[tuple[Node | list, int]] = [(root, first)]
    while todo:
        into, left = todo.pop()
        if not left:
            continue
        todo.append((into, left - 1))
        if isinstance(into, Node):
            n, how = next(flat), next(flat)
            g = Group([], bool(how & 1), bool(how & 2))
            into.groups.append(g)
            todo.append((g.units, n))
            continue
        key = next(flat)
        if key == "#":
            into.append(Leaf("", next(flat), next(flat), next(flat), next(flat)))
        else:
            node, n = opened(key)
            into.append(node)
            todo.append((node, n))
    for node in whole:
        for g in node.groups:
            g.keys = tuple(u.key for u in g.units)
    return root


def expression(unit: Node | Leaf) -> str:
    """The wrapper as a regular expression over tags, with ``#`` for a text slot."""
    if isinstance(unit, Leaf):
        return "#"
    if unit.loose:
        inner = "(" + "".join(f"({expression(u)})?" for u in _units(unit)) + ")*"
        return f"<{unit.key}>{inner}</>" if unit.key else inner
    inner = "".join((f"({x})" if len(g.units) > 1 or g.optional or g.repeated else x) + ("*" if g.optional and g.repeated else "?" if g.optional else "+" if g.repeated else "") for g in unit.groups for x in ["".join(map(expression, g.units))])
    return f"<{unit.key}>{inner}</>" if unit.key else inner


# --- roles ------------------------------------------------------------------


@lru_cache(65536)
def _said(key: str) -> int:
    """Whether class, id or role name a menu, advert or the like: 2 if they say nothing else, 1 if such a word stands among others."""
    out = 0
    for token in key.partition(".")[2].split():
        plain = {w.lower() for w in re.split(r"[^A-Za-z]+", token) if w}
        for words in (plain, {w.lower() for w in _PARTS.findall(token)}):
            if words & CHROME_WORDS:
                out = max(out, 2 if words <= CHROME_WORDS | SOFT_WORDS else 1)
    return out


def is_chrome(key: str, in_article: bool) -> int:
    """2 for what is no article by tag or class, 1 for what may be none."""
    tag = _tag(key)
    words = _words(key)
    if tag in ("article", "main", "h1", ""):
        return 2 if "hidden" in words else 0
    if tag in CHROME_TAGS or "hidden" in words or not in_article and (tag == "header" or words & HEADER_WORDS):
        return 2
    return _said(key)


def is_article(key: str) -> bool:
    return _tag(key) in ("article", "main") or bool(_words(key) & ARTICLE_ROLES)


@lru_cache(65536)
def role_key(key: str) -> str:
    """The tag, and of the names only what they say about a region's role: as many keys as there are tags and roles."""
    tag, words = _tag(key), _words(key)
    if tag in ("#", ""):
        return key
    says = [name for name, on in (("header", words & HEADER_WORDS), ("hidden", "hidden" in words), ("main", words & ARTICLE_ROLES), ("tile", words & TEASER_WORDS)) if on]
    says += [("menu-of", "menu")[how - 1] for how in [_said(key)] if how]
    tag = tag if tag in _TAGS else "div"
    return f"{tag}.{' '.join(says)}" if says else tag


def _units(node: Node) -> list:
    return [u for g in node.groups for u in g.units]


def _measured(wrapper: Node) -> dict[int, tuple[int, int, bool]]:
    """Of each node, by id(): characters, linked ones, and whether all its slots are fixed text of the host."""
    out: dict[int, tuple[int, int, bool]] = {}
    todo: list[tuple[Node, bool]] = [(wrapper, False)]
    while todo:
        u, seen = todo.pop()
        if not seen:
            todo.append((u, True))
            todo += [(x, False) for x in _units(u) if isinstance(x, Node)]
            continue
        chars = linked = 0
        fixed = True
        for x in _units(u):
            c, k, f = (x.chars, x.linked, _fixed(x)) if isinstance(x, Leaf) else out[id(x)]
            chars, linked, fixed = chars + c, linked + k, fixed and (f or not c)
        out[id(u)] = chars, linked, fixed
    return out


def _fixed(slot: Leaf) -> bool:
    return slot.same is not None and slot.n >= FIXED_PAGES


class _Roles:
    """Which regions of a wrapper are the article."""

    def __init__(self, wrapper: Node):
        self.wrapper, self.of = wrapper, _measured(wrapper)

    def dropped(self, u: Node, in_article: bool) -> bool:
        how = is_chrome(u.key, in_article)
        chars, linked, fixed = self.of[id(u)]
        if how == 2 and _tag(u.key) == "form" and "hidden" not in _words(u.key) and 2 * chars >= self.of[id(self.wrapper)][0]:
            how = _said(u.key)  # a form around the page
        return how == 2 or how == 1 and (2 * linked > chars or fixed)

    def articles(self) -> list[Node]:
        """Article regions, none inside another; those in menus, adverts and the like don't count."""
        out: list[Node] = []
        todo = [(u, None) for u in reversed(_units(self.wrapper)) if isinstance(u, Node)]
        mains: dict[int, tuple[Node, list[Node]]] = {}
        while todo:
            u, main = todo.pop()
            tag = _tag(u.key)
            if is_article(u.key) and tag != "main":
                out.append(u)
                if main is not None:
                    mains[id(main)][1].append(u)
                continue
            if tag != "form" and self.dropped(u, False):
                continue
            if tag == "main" and main is None:
                main = u
                mains[id(u)] = u, []
                out.append(u)
            todo += [(x, main) for x in reversed(_units(u)) if isinstance(x, Node)]
        out = [u for u in out if not (id(u) in mains and mains[id(u)][1])]
        some = [u for u in out if 2 * self.of[id(u)][1] <= self.of[id(u)][0] and not _words(u.key) & TEASER_WORDS]
        return some or out

    def largest(self) -> Node:
        """The container of most changing, unlinked text."""
        sizes: dict[int, int] = {}
        for lively in (True, False):  # where every page of the host has the same text, that text counts
            todo: list[tuple[Node, bool]] = [(self.wrapper, False)]
            while todo:
                u, seen = todo.pop()
                if self.dropped(u, False):
                    sizes[id(u)] = 0
                elif not seen:
                    todo.append((u, True))
                    todo += [(x, False) for x in _units(u) if isinstance(x, Node)]
                else:
                    total = 0
                    for x in _units(u):
                        total += sizes[id(x)] if isinstance(x, Node) else 0 if lively and _fixed(x) else x.chars - x.linked
                    sizes[id(u)] = total
            self.lively = lively
            if sizes[id(self.wrapper)]:
                break
        at = self.wrapper
        while True:
            inner = [u for u in _units(at) if isinstance(u, Node) and sizes[id(u)] >= DESCEND * sizes[id(at)] > 0 and _tag(u.key) in CONTAINERS]
            if not inner:
                return at
            # where it repeats, others of its tag that hold text are more of the same
            tag = _tag(inner[0].key)
            if any(g.repeated and inner[0] in g.units for g in at.groups) and any(u is not inner[0] and _tag(u.key) == tag and sizes[id(u)] for u in _units(at)):
                return at
            at = inner[0]

    def kept(self, alone: bool) -> dict[int, bool]:
        found = self.articles()
        by_tag = bool(found)
        keep: dict[int, bool] = {}
        todo = list(found) if by_tag else [self.largest()]
        if not by_tag and not alone and todo[0].loose:
            return keep
        while todo:
            for x in _units(todo.pop()):
                if isinstance(x, Node):
                    if not self.dropped(x, True):
                        todo.append(x)
                else:
                    keep[id(x)] = by_tag or not (self.lively and _fixed(x)) and 2 * x.linked <= x.chars
        return keep


def roles(wrapper: Node, alone: bool = False) -> dict[int, bool]:
    """Slots whose text belongs to the article, by the slot's id(); none where a host's wrapper can't tell (``alone``: it is one page's)."""
    return _Roles(wrapper).kept(alone)


def _spans(kids: list, periods: set[tuple[str, ...]]) -> list[tuple[int, int, int]]:
    """``_runs``, where single siblings in a row that the wrapper has as one period become that period."""
    out: list[tuple[int, int, int]] = []
    for span in _runs(kids):
        out.append(span)
        for keys in periods:
            tail = out[-len(keys) :]
            if len(tail) == len(keys) and all(p == t == 1 for _, p, t in tail) and tuple(kids[i].key for i, _, _ in tail) == keys:
                out[-len(keys) :] = [(tail[0][0], len(keys), 1)]
                break
    return out


def _texts(page: Node, wrapper: Node, keep: dict[int, bool], out: list[str]) -> None:
    """The page's texts whose slots are kept, in order of the page."""
    kids = page.kids
    if wrapper.loose:
        of_role = {u.key: u for u in _units(wrapper)}
        for kid in kids:
            unit = of_role.get(role_key(kid.key))
            if isinstance(kid, Leaf):
                if unit is not None and keep.get(id(unit)):
                    out.append(kid.text)
            elif unit is not None:
                _texts(kid, unit, keep, out)
        return
    mine = _spans(kids, {g.keys for g in wrapper.groups if len(g.keys) > 1})
    keys = [tuple(k.key for k in kids[i : i + period]) for i, period, _ in mine]
    slots = _collapse(wrapper.groups, {k for k in keys if len(k) > 1})
    to = {x: slots[y].units for x, y in aligned(keys, [g.keys for g in slots])}
    by_key: dict[str, Node | Leaf] = {}
    for s in slots:
        for u in s.units:
            by_key.setdefault(u.key, u)
    for x, (i, period, times) in enumerate(mine):
        for k in range(period * times):
            kid = kids[i + k]
            unit = to[x][k % period] if x in to else by_key.get(kid.key)
            if isinstance(kid, Leaf):
                if unit is not None and keep.get(id(unit)):
                    out.append(kid.text)
            elif unit is not None:
                _texts(kid, unit, keep, out)


def any_depth() -> None:
    """Trees are walked by plain functions, whose frames are not on the C stack; pages may nest as they like."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def main_text(html: str | None, wrapper: Node | None = None, keep: dict[int, bool] | None = None) -> str:
    """The article of a page by its host's wrapper, or by the page alone."""
    if not html:
        return ""
    any_depth()
    page = parse(html)
    out: list[str] = []
    if wrapper is not None:
        _texts(page, wrapper, keep, out)
    if not out:
        own = wrapper_of(page)
        _texts(page, own, roles(own, alone=True), out)
    return "\n\n".join(out)


# --- tables -----------------------------------------------------------------


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper for each host of the task."""
    held: dict[str, Node] = {}

    def out() -> pa.RecordBatch:
        texts = [dumps(w) for w in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(texts, pa.string())], ["host", "wrapper"])

    any_depth()
    for b in slices(batches):
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            if html:
                own = wrapper_of(parse(html))
                held[host] = merge(held[host], own) if host in held else own
        if len(held) > HELD_HOSTS:
            yield out()
            held.clear()
    yield out()


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    any_depth()
    texts = sorted(pdf["wrapper"], key=lambda t: (-len(t), t))
    one = loads(texts[0])
    for t in texts[1:]:
        one = merge(one, loads(t))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [dumps(one)]})


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return pages.withColumn("host", host)


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` for each host of ``pages(url, html)``, as a written table."""
    kinds = "host string, wrapper string"
    found = _with_host(pages.select("url", "html")).select("host", "html").mapInArrow(_learn, kinds)
    while True:
        found = written(found)
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // FAN)))
        found = found.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(_merged, kinds)
        if most <= FAN:
            return written(found)


@lru_cache(4096)
def _known(text: str) -> tuple[Node, dict[int, bool]]:
    any_depth()
    wrapper = loads(text)
    return wrapper, roles(wrapper)


def _extract(known):
    """Texts of pages; wrappers come by host from a broadcast, or with the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = b.column("wrapper").to_pylist() if known is None else map(known.value.get, b.column("host").to_pylist())
            texts = [main_text(html, *(_known(w) if w else (None, None))) for html, w in zip(b.column("html").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``page_id, url, text`` for each row of ``pages(page_id, url, html)``; ``known`` are wrappers of ``wrappers``."""
    known = wrappers(pages) if known is None else known
    rows = _with_host(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    kinds = "page_id long, url string, text string"
    if (known.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in known.toLocalIterator()})
        return rows.select("page_id", "url", "html", "host").mapInArrow(_extract(shared), kinds)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper").mapInArrow(_extract(None), kinds)


def op1_wrapper_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
