"""Operator 11: main text of web pages by a minimum cut.

A page is read into its elements and its blocks (the text between two block-level tags). A linear classifier says for each
block what it costs to call it boilerplate rather than content: where it stands (article, menu, comments and so on, by
tags, roles and words in class and id), its length, its share of linked text, its punctuation. Those costs are the terminal
capacities of a flow network; neighbours in page order, and blocks with the elements that hold them, are joined by
smoothness edges that weaken with their distance in the tree and across regions. The side of the source of a minimum cut is
the article. The flow is found after what no edge can overturn is decided, which is exact and settles most pages.

No page has a label, so the classifier's weights are stated below rather than learnt. A page is one row and one task's
work; nothing is shuffled.

Defined cases: null and empty html give an empty text; a null page_id or url is kept, as are repeated rows; markup that
ends inside a tag, comment, script or style ends there; text without any tag is a block like others; form controls, scripts,
styles, hidden elements and embedded objects are never text; `br` counts as white space; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, pa_schema, tidy

TEXTS = "page_id long, url string, text string"

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text for the reader of markup alone, up to their own end tag.
RAW = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in "iframe noembed noframes noscript script style textarea title xmp".split()}
NEVER = frozenset("audio button canvas datalist map math object option select svg template video".split())
#: An opening tag ends these where they stand nearer than the elements behind them.
ENDS = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table")}
TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
QUOTED = re.compile(r"=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Words in class and id, by what they begin with ("*") or as they are.
REMARKS = ("comment*", "disqus*", "respond", "reply", "replies", "discussion*")
ADVERTS = ("ad", "ads", "adbox", "adslot", "adunit", "adsbygoogle", "advert*", "sponsor*", "promo*", "outbrain", "taboola", "banner*")
ASIDE = (
    "menu*", "nav", "navbar*", "navigation", "breadcrumb*", "pagination", "pager", "sidebar*", "aside", "widget*", "related*", "recommend*", "trending", "popular", "share", "sharing", "social*", "footer*", "copyright", "legal", "toolbar*",
    "cookie*", "consent", "gdpr", "notice*", "notification*", "alert*", "disclaimer*", "popup*", "modal*", "overlay", "newsletter*", "subscri*", "signup", "login", "signin", "register", "search*", "form", "skip", "paywall", "donate*", "masthead",
)
TOPS = ("header*", "head", "topbar", "top")
CONTENT = ("article*", "main", "content*", "entry", "post", "story", "body")
ROLES = {"navigation": "aside", "banner": "top", "contentinfo": "aside", "complementary": "aside", "search": "aside", "alert": "aside", "alertdialog": "aside", "dialog": "aside", "form": "form", "menu": "aside", "menubar": "aside", "main": "main", "article": "article"}
KINDS = {"nav": "aside", "aside": "aside", "footer": "aside", "menu": "aside", "search": "aside", "dialog": "aside", "fieldset": "form", "legend": "form", "label": "form", "form": "form", "header": "top", "article": "article", "main": "main"}
#: Headings over readers' comments, in the languages of the tables.
REMARKS_HEADING = re.compile(r"\W*\d*\W*(?:reader|user|leser|all|\d+)?\W*(?:comments?|responses?|replies|kommentare?|commentaires?|comentarios?|réponses?|respuestas?)\W*\d*\W*", re.I)
RIGHTS = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", re.I)

#: The classifier's weights: place of a block, then its own features. Positive is content.
PLACE = {"article": 5.0, "main": 3.5, "content": 3.0, None: 0.0, "top": -8.0, "form": -8.0, "aside": -12.0, "advert": -12.0, "remarks": -12.0}
OUTSIDE = -5.0
LENGTH, MOST_LENGTH, SHORT = 1.0, 2.5, 2.0
LINKED, SENTENCE, HEADING, RIGHTS_LINE, LONE = -6.0, 1.0, 2.0, -6.0, 0.5
#: Smoothness: neighbours in page order, a block and its element, an element and its parent; across regions they hardly bind.
NEXT, HELD, NESTED, FADE, ACROSS = 1.5, 1.0, 0.5, 0.7, 0.1
#: Where no article stands outside of such, an element is taken for the page's frame, not for a region, if it holds an article or so much of the unlinked words.
FRAME = 0.8
UNIT = 1000
BAD = frozenset(("top", "form", "aside", "advert", "remarks"))
GOOD = frozenset(("article", "main"))


def _matcher(words: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("|".join(w[:-1] + ".*" if w.endswith("*") else w for w in words))


MATCHERS = [("remarks", _matcher(REMARKS)), ("advert", _matcher(ADVERTS)), ("aside", _matcher(ASIDE)), ("top", _matcher(TOPS)), ("content", _matcher(CONTENT))]


def kind_of(tag: str, attributes: str) -> tuple[str | None, bool, bool]:
    """What region an element opens, whether its class or id alone says so, whether it is hidden."""
    kind, named, hidden = KINDS.get(tag), False, False
    if not attributes or attributes.isspace():
        return kind, named, hidden
    found = {}
    for name, *values, flag in ATTRIBUTE.findall(attributes):
        found[name.lower() or "hidden"] = "".join(values)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", found.get("style", ""), re.I) is not None
    role = ROLES.get(found.get("role", "").strip().lower())
    if role or "articlebody" in found.get("itemprop", "").lower():
        return role or "article", False, hidden
    if tag in ("html", "body"):
        return None, False, hidden
    parts = WORDS.findall(CAMEL.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").lower())
    said = {name for name, pattern in MATCHERS for part in parts if pattern.fullmatch(part)}
    for name in ("remarks", "advert", "aside"):
        if name in said:
            return name, kind is None or kind not in BAD, hidden
    if "top" in said and "content" not in said and kind is None:
        return "top", True, hidden
    if "content" in said and "top" not in said and kind is None:
        return "content", True, hidden
    return kind, named, hidden


class Page:
    """Elements (parents before children) and blocks of a page."""

    def __init__(self, text: str):
        self.tags, self.parents, self.kinds, self.named = ["html"], [-1], [None], [False]
        self.texts: list[str] = []
        self.holders: list[int] = []
        self.linked: list[float] = []
        self._open: list[tuple[str, int, bool]] = [("html", 0, True)]
        self._at: dict[str, list[int]] = {}
        self._blocks, self._links, self._gone = [0], 0, 0
        self._run: list[str] = []
        self._linked = 0
        self.read(text)

    def read(self, text: str) -> None:
        last = {q: text.rfind(q) for q in "\"'"}
        at, size = 0, len(text)
        while at < size:
            tag = TAG.search(text, at)
            self.add(text[at : tag.start() if tag else size])
            if tag is None:
                break
            close, name, comment = tag.group(1), (tag.group(2) or "").lower(), tag.group(3)
            if comment:
                end = text.find("-->", tag.start() + 2)
                at = size if end < 0 else end + 3
                continue
            end = self.end_of(text, tag.end(), last) if name else text.find(">", tag.end())
            if end < 0:
                break
            at = end + 1
            if not name:
                continue
            if close:
                self.close(name)
            else:
                attributes = text[tag.end() : end]
                if name in RAW:
                    found = RAW[name].search(text, at)
                    at = found.start() if found else size
                else:
                    self.open(name, attributes)
        self.flush()

    @staticmethod
    def end_of(text: str, at: int, last: dict[str, int]) -> int:
        """Where a tag's > is, outside quoted values; a quote that is never closed is none."""
        while (end := text.find(">", at)) >= 0:
            quote = QUOTED.search(text, at, end)
            if quote is None or quote.end() > last[quote.group(1)]:
                return end
            at = text.find(quote.group(1), quote.end()) + 1
        return -1

    def add(self, piece: str) -> None:
        if not piece or self._gone:
            return
        piece = entities.unescape(piece) if "&" in piece else piece
        self._run.append(piece)
        if self._links:
            self._linked += len(piece.strip())

    def flush(self) -> None:
        """Ends the block that is being read."""
        text = " ".join("".join(self._run).split())
        if text:
            self.texts.append(text)
            self.holders.append(self._open[-1][1])
            self.linked.append(min(1.0, self._linked / len(text)))
        self._run, self._linked = [], 0

    def nearest(self, names: str) -> int:
        return max((self._at[n][-1] for n in names.split() if self._at.get(n)), default=0)

    def open(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        if block:
            self.flush()
            if self._at.get("p"):
                self.drop(self._at["p"][-1])
            if name in ENDS:
                own, around = ENDS[name]
                if (place := self.nearest(own)) > self.nearest(around):
                    self.drop(place)
        elif name == "br":
            self.add(" ")
        if name in VOID:
            return
        kind, named, hidden = kind_of(name, attributes)
        gone, node = hidden or name in NEVER, self._open[-1][1]
        if block and name not in ("html", "body"):
            self.tags.append(name)
            self.parents.append(node)
            self.kinds.append(kind)
            self.named.append(named)
            node = len(self.tags) - 1
        if gone and not self._gone:
            self._run.append(" ")
        self._gone += gone
        self._links += name == "a"
        self._at.setdefault(name, []).append(len(self._open))
        if block:
            self._blocks.append(len(self._open))
        self._open.append((name, node, gone))

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        places = self._at.get(name)
        if places and (name in BLOCKS or places[-1] > self._blocks[-1]):
            self.drop(places[-1])

    def drop(self, place: int) -> None:
        """Closes all elements down to that place of the stack."""
        while len(self._open) > place:
            name, _, gone = self._open.pop()
            self._gone -= gone
            self._links -= name == "a"
            self._at[name].pop()
            if name in BLOCKS:
                self._blocks.pop()

    def regions(self) -> list[int]:
        """For each element the one that says what region it is in (0: none). Frames of the page are no regions."""
        count = len(self.tags)
        held, main = [0.0] * count, [False] * count
        for text, node, linked in zip(self.texts, self.holders, self.linked):
            held[node] += (1 - linked) * (text.count(" ") + 1)
        for node in range(count - 1, 0, -1):
            held[self.parents[node]] += held[node]
            main[node] = main[node] or self.kinds[node] in GOOD
            main[self.parents[node]] |= main[node] and self.kinds[node] not in ("remarks", "advert")
        free, clean = [True] * count, False
        for node in range(1, count):
            free[node] = free[self.parents[node]] and self.kinds[node] not in BAD
            clean |= free[node] and self.kinds[node] in GOOD
        region = [0] * count
        for node in range(1, count):
            kind, above = self.kinds[node], region[self.parents[node]]
            around = self.kinds[above] if above else None
            frame = kind in ("aside", "top", "form") and (self.named[node] or kind == "form") and not clean and (main[node] or held[node] > FRAME * held[0])
            opens = kind is not None and not frame and around not in BAD
            if kind == "top" and around in ("article", "main", "content"):
                opens = False
            if kind == "aside" and self.tags[node] == "footer" and self.tags[self.parents[node]] == "blockquote":
                opens = False
            if kind in ("content", "main") and around == "article":
                opens = False
            region[node] = node if opens else above
        return region

    def remarks(self) -> set[int]:
        """Blocks under a heading over readers' comments, to the end of the heading's element or the next heading of its rank."""
        found, until, rank = set(), -1, 9
        last = list(range(len(self.tags)))
        for node in range(len(self.tags) - 1, 0, -1):
            last[self.parents[node]] = max(last[self.parents[node]], last[node])
        for i, node in enumerate(self.holders):
            tag = self.tags[node]
            own = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 9
            if own < 9 and REMARKS_HEADING.fullmatch(self.texts[i]):
                until, rank = last[self.parents[node]], own
            elif node > until or own <= rank < 9:
                until, rank = -1, 9
            if until >= 0:
                found.add(i)
        return found

    def costs(self, region: list[int]) -> list[float]:
        """For each block what calling it boilerplate costs more than calling it content."""
        kinds = [self.kinds[r] if r else None for r in region]
        somewhere, remarks = any(k in GOOD for k in kinds), self.remarks()
        out = []
        for i, (text, node, linked) in enumerate(zip(self.texts, self.holders, self.linked)):
            kind, tag = kinds[node], self.tags[node]
            words = text.count(" ") + 1
            u = PLACE["remarks" if i in remarks else kind]
            if somewhere and kind in (None, "content"):
                u += OUTSIDE
            u += min(MOST_LENGTH, LENGTH * (math.log2(1 + words) - SHORT)) + LINKED * linked
            if text[-1] in ".!?…:;\"'”’»)":
                u += SENTENCE
            if tag == "h1":
                u += HEADING
            if words < 40 and RIGHTS.search(text):
                u += RIGHTS_LINE
            out.append(u + (LONE if len(self.texts) == 1 else 0))
        return out

    def main_text(self) -> str:
        """Blocks on the content side of the minimum cut, in page order."""
        if not self.texts:
            return ""
        region = self.regions()
        blocks = len(self.texts)
        depth = [0] * len(self.tags)
        for node in range(1, len(self.tags)):
            depth[node] = depth[self.parents[node]] + 1
        edges = []
        for i in range(blocks):
            node = self.holders[i]
            edges.append((i, blocks + node, HELD))
            if i + 1 < blocks:
                other = self.holders[i + 1]
                apart = abs(depth[node] - depth[other]) + (self.parents[node] != self.parents[other]) + (node != other)
                edges.append((i, i + 1, NEXT * FADE ** min(apart, 9) if region[node] == region[other] else ACROSS))
        for node in range(1, len(self.tags)):
            up = self.parents[node]
            edges.append((blocks + node, blocks + up, NESTED if region[node] == region[up] else ACROSS * NESTED))
        costs = [round(c * UNIT) for c in self.costs(region)] + [0] * len(self.tags)
        content = minimum_cut(costs, [(a, b, max(1, round(w * UNIT))) for a, b, w in edges])
        return "\n\n".join(t for t, keep in zip(self.texts, content) if keep)


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels that minimise the costs of blocks called wrongly (positive: not content, negative: content) and of the edges between both sides. Of several the one with most content."""
    near: list[list[tuple[int, int]]] = [[] for _ in costs]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    terminal, open_ = list(costs), [sum(w for _, w in n) for n in near]
    label: list[bool | None] = [None] * len(costs)
    # a node whose own cost is as great as all its open edges has that label in some minimum cut; nodes without any content are settled last, so that ties go to content
    todo = deque(range(len(costs)))
    while todo:
        v = todo.popleft()
        if label[v] is not None or not (terminal[v] >= open_[v] or -terminal[v] > open_[v]):
            continue
        label[v] = terminal[v] >= open_[v]
        for u, w in near[v]:
            if label[u] is None:
                terminal[u] += w if label[v] else -w
                open_[u] -= w
                todo.append(u)
    for start in range(len(costs)):
        if label[start] is None:
            part, at = [start], {start: 0}
            for v in part:
                for u, _ in near[v]:
                    if label[u] is None and u not in at:
                        at[u] = len(part)
                        part.append(u)
            inner = [(at[v], at[u], w) for v in part for u, w in near[v] if u in at and at[v] < at[u]]
            for v, side in zip(part, source_side([terminal[v] for v in part], inner)):
                label[v] = side
    return [bool(x) for x in label]


def source_side(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Maximum flow by blocking flows over shortest paths; what cannot reach the sink afterwards is the source's side."""
    size = len(terminal)
    source, sink = size, size + 1
    heads: list[list[int]] = [[] for _ in range(size + 2)]
    to, room = [], []

    def link(a: int, b: int, there: int, back: int) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            heads[x].append(len(to))
            to.append(y)
            room.append(c)

    for v, t in enumerate(terminal):
        if t > 0:
            link(source, v, t, 0)
        elif t < 0:
            link(v, sink, -t, 0)
    for a, b, w in edges:
        link(a, b, w, w)

    def levels() -> list[int]:
        level = [-1] * (size + 2)
        level[source], queue = 0, deque([source])
        while queue:
            v = queue.popleft()
            for e in heads[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        return level

    while (level := levels())[sink] >= 0:
        turn, path, v = [0] * (size + 2), [], source
        while True:
            if v == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[cut] ^ 1]
                del path[cut:]
            elif turn[v] < len(heads[v]):
                e = heads[v][turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                else:
                    turn[v] += 1
            elif v == source:
                break
            else:
                v = to[path.pop() ^ 1]
                turn[v] += 1
    reach, queue = [False] * (size + 2), deque([sink])
    reach[sink] = True
    while queue:
        v = queue.popleft()
        for e in heads[v]:
            if room[e ^ 1] and not reach[to[e]]:
                reach[to[e]] = True
                queue.append(to[e])
    return [not r for r in reach[:size]]


def main_text(page: str | None) -> str:
    return Page(page).main_text() if page else ""


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
        yield as_batch({"page_id": ids, "url": urls, "text": [main_text(p) for p in batch.column("html").to_pylist()]}, pa_schema(TEXTS))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of each page."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(tidy(_texts, "extraction"), TEXTS)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
