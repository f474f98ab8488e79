"""Main text of HTML pages by a minimum cut.

A page is read in one linear scan into blocks of text. A classifier gives every block a cost for
being content and one for being boilerplate; the costs are the capacities from the source and to
the sink. Neighbouring blocks, and blocks under the same parent, are tied by smoothness edges.
Maximum flow then splits the graph: blocks that the source still reaches are the main text.

What the markup says (elements, class and id words, roles) enters with fixed costs. What the text
looks like (length, links, punctuation, kind of block) is learned: logistic regression around fixed
prior weights, taught by the blocks of a bounded sample of pages that stand inside unambiguous elements.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

# About this many pages teach the weights of the text features.
TRAIN_PAGES = 2000

_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p "
    "pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
_RAW = frozenset("script style template noscript iframe svg math object head title textarea select xmp noframes".split())
_VOID = frozenset("hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag ends open elements of these names, up to the next list, table or section.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
         "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table menu section article main aside nav div body".split())
# Inside these no text belongs to the article.
_OUTSIDE = frozenset("nav footer aside form button dialog menu fieldset search".split())
_INSIDE = frozenset("article main".split())
_OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside widget related recommended share sharing social footer header masthead topbar toolbar pagination "
    "pager comment comments disqus reply replies respond form search copyright legal disclaimer".split()
)
_INSIDE_WORDS = frozenset("article content main post entry story body text".split())
_READERS = frozenset("comment comments disqus reply replies respond sidebar related recommended".split())
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_INSIDE_ROLES = frozenset("main article".split())

_NAME = r"[a-zA-Z][^\s/>]*+"
_TAG = re.compile(
    r"<(?:!--(?P<comment>)|(?P<odd>[!?])|(?P<end>/?)(?P<name>" + _NAME + r")(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)"
)
_LOOSE = re.compile(r"<(?:!--(?P<comment>)|(?P<odd>[!?])|(?P<end>/?)(?P<name>" + _NAME + r")(?P<attrs>[^>]*+)>)")
_OPEN = re.compile(r"<[!?/]?[a-zA-Z!?-]")
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ENDING = re.compile(r"[.!?…:;][\"'”’»)\]]*$")

# Costs are whole numbers, so that flows are exact.
_UNIT = 1000
_MARKUP_IN, _MARKUP_OUT = 4.0, -7.0
_NEXT, _SAME_PARENT = 1.2, 0.6

# Prior weights of the text features, in log-odds of being content.
_PRIOR = {
    "bias": 0.0, "len0": -0.8, "len1": -0.3, "len2": 0.3, "len3": 0.8, "links1": -0.5, "links2": -2.0,
    "ends": 0.5, "p": 0.5, "h": 0.2, "li": -0.4, "cell": -0.2, "other": -0.1,
}
FEATURES = list(_PRIOR)
PRIOR = np.array([_PRIOR[f] for f in FEATURES])
_AT = {f: i for i, f in enumerate(FEATURES)}


@dataclass
class Block:
    """A run of text between block borders."""

    text: str
    linked: int  # characters inside links
    tag: str
    parent: int  # number of the element around
    depth: int
    hint: int  # what the markup says: 1 article, -1 something else, 0 nothing
    features: tuple[int, ...] = field(default=())


def _hint(name: str, attrs: str, outer: int) -> int:
    """What an element says about its text; ``outer`` is what holds around it (-2 stays whatever is inside)."""
    own = 0
    words: set[str] = set()
    roles: set[str] = set()
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                roles.add(value.strip().lower())
            elif name not in ("html", "body", "main"):
                words.update(w.lower() for w in _WORD.findall(value))
    bad, good = words & _OUTSIDE_WORDS, words & _INSIDE_WORDS
    if name in _OUTSIDE or roles & _OUTSIDE_ROLES:
        own = -1
    elif name == "header":
        own = 0 if outer == 1 else -1
    elif name in _INSIDE or roles & _INSIDE_ROLES:
        own = -2 if bad & _READERS else 1
    elif bad and not good:
        own = -1
    elif good and not bad:
        own = 1
    if bad & _READERS and not good or name in ("aside", "form"):
        own = -2
    if outer == -2 or own == 0:
        return outer
    if outer == -1 and own == 1 and name not in _INSIDE:
        return outer
    return own


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order; one scan, linear in the page."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # name, number, hint
    pieces: list[str] = []
    opened = link = linked = 0
    tag_of, at, size = _TAG, 0, len(page)

    def finish() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                name, number, hint = stack[-1]
                up = stack[-2][1] if name in ("p", *_HEADINGS) and len(stack) > 1 else number
                out.append(Block(text, min(linked, len(text)), name, up, len(stack), max(hint, -1)))
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if link:
            linked += len(text.strip())

    while at < size:
        found = page.find("<", at)
        if found < 0:
            said(page[at:])
            break
        if found > at:
            said(page[at:found])
        m = tag_of.match(page, found)
        if m is None and tag_of is _TAG and _OPEN.match(page, found):
            # a quote that never ends: from here on quotes are not looked at, so the scan stays linear
            tag_of = _LOOSE
            m = tag_of.match(page, found)
        if m is None:
            if _OPEN.match(page, found) and page.find(">", found) < 0:
                break  # the page ends inside a tag
            said("<")
            at = found + 1
            continue
        at = m.end()
        if m["comment"] is not None:
            end = page.find("-->", found + 2)
            at = size if end < 0 else end + 3
            continue
        if m["odd"]:
            end = page.find(">", found)
            at = size if end < 0 else end + 1
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in _BLOCKS:
                finish()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name == "a":
                link = 0
            continue
        if name in _RAW:
            if m["attrs"].endswith("/") and name in ("svg", "math", "object"):
                continue
            # their content is no text; where the end is missing, it ends with the head or the page
            end = _after(page, at, name)
            if name in _BLOCKS:
                finish()
            at = end
            continue
        if name in _BLOCKS:
            finish()
            if stack[-1][0] == "p" and name not in ("button",):
                stack.pop()
            if name in _ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _ENDS[name]:
                        del stack[k:]
                    elif stack[k][0] in _STOPS:
                        break
            if name in _HEADINGS and stack[-1][0] in _HEADINGS:
                stack.pop()
            if name not in _VOID:
                opened += 1
                stack.append((name, opened, _hint(name, m["attrs"], stack[-1][2])))
        elif name == "br":
            said(" ")
        elif name == "a":
            link = 1
    finish()
    return out


_RAW_ENDS: dict[str, re.Pattern] = {}


def _after(page: str, at: int, name: str) -> int:
    """Where the content of an element without text ends."""
    if name not in _RAW_ENDS:
        also = r"|<body[\s>]" if name in ("head", "title") else ""
        _RAW_ENDS[name] = re.compile(rf"</{name}\b[^>]*+>{also}", re.I)
    m = _RAW_ENDS[name].search(page, at)
    if m is None:
        return len(page)
    return m.start() if m[0][1] != "/" else m.end()


def features(b: Block) -> tuple[int, ...]:
    """Numbers of the text features that hold for a block."""
    n = len(b.text)
    share = b.linked / n
    kind = b.tag if b.tag in ("p", "li") else "h" if b.tag in _HEADINGS else "cell" if b.tag in ("td", "th") else "other"
    names = ["bias", f"len{0 if n < 20 else 1 if n < 60 else 2 if n < 160 else 3}", kind]
    if share > 0.1:
        names.append("links2" if share > 0.5 else "links1")
    if _ENDING.search(b.text[-8:]):
        names.append("ends")
    return tuple(_AT[x] for x in names)


def train(counts: dict[tuple[tuple[int, ...], bool], int], strength: float = 20.0) -> np.ndarray:
    """Weights of the text features from counted (features, is content): Newton steps around the prior."""
    w = PRIOR.copy()
    if not counts:
        return w
    x = np.zeros((len(counts), len(FEATURES)))
    y, n = np.zeros(len(counts)), np.zeros(len(counts))
    for k, ((on, good), c) in enumerate(sorted(counts.items())):
        x[k, list(on)], y[k], n[k] = 1.0, good, c
    n *= min(1.0, 5000.0 / n.sum())  # a page set teaches at most like 5000 blocks
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - strength * (w - PRIOR)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + strength * np.eye(len(w)), slope)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


def costs(found: list[Block], weights: np.ndarray) -> list[int]:
    """For each block, how much more it costs to call it boilerplate than to call it content."""
    out = []
    for b in found:
        text = max(-3.0, min(3.0, float(sum(weights[i] for i in features(b)))))
        markup = _MARKUP_IN if b.hint > 0 else _MARKUP_OUT if b.hint < 0 else 0.0
        out.append(round((text + markup) * _UNIT))
    return out


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness: next blocks, weaker the further apart in the tree; and the last block of the same parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            apart = abs(a.depth - b.depth) + (a.parent != b.parent)
            out.append((i - 1, i, round(_NEXT / (1 + apart) * _UNIT)))
        if last.get(b.parent, i) < i - 1:
            out.append((last[b.parent], i, round(_SAME_PARENT * _UNIT)))
        last[b.parent] = i
    return out


def minimum_cut(unary: list[int], pairs: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut, the smallest such side where cuts tie.

    A node with ``unary`` u > 0 hangs on the source with capacity u, one with u < 0 on the sink with
    -u; ``pairs`` are undirected edges. Shortest augmenting paths by levels.
    """
    n = len(unary)
    if not any(u < 0 for u in unary):
        return [_fed(i, unary, pairs) for i in range(n)] if not all(u > 0 for u in unary) else [True] * n
    if not any(u > 0 for u in unary):
        return [False] * n
    source, sink = n, n + 1
    to: list[int] = []
    left: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: int, back: int) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((forth, back))

    for i, u in enumerate(unary):
        if u > 0:
            arc(source, i, u, 0)
        elif u < 0:
            arc(i, sink, -u, 0)
    for a, b, w in pairs:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        here = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                most = min(left[e] for e in path)
                for e in path:
                    left[e] -= most
                    left[e ^ 1] += most
                full = next(k for k, e in enumerate(path) if not left[e])
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            own, k = arcs[a], here[a]
            while k < len(own) and not (left[own[k]] and level[to[own[k]]] == level[a] + 1):
                k += 1
            here[a] = k
            if k < len(own):
                path.append(own[k])
                a = to[own[k]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break


def _fed(i: int, unary: list[int], pairs: list[tuple[int, int, int]]) -> bool:
    """Without a sink everything joined to the source by edges is on its side; chains join all blocks."""
    return bool(unary[i] > 0 or pairs)


def main_blocks(page: str | None, weights: np.ndarray = PRIOR) -> tuple[list[Block], list[bool]]:
    """All blocks of a page and which of them are its main text."""
    found = blocks(page or "")
    return found, minimum_cut(costs(found, weights), edges(found))


def _lessons(page: str | None) -> Iterator[tuple[tuple[int, ...], bool]]:
    for b in blocks(page or ""):
        if b.hint:
            yield features(b), b.hint > 0


def fit(pages: DataFrame, content: str = "html", train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the text features from about ``train_pages`` pages, chosen by a hash of their content.

    Only counts of feature sets reach the driver: a few hundred rows at most, however long the pages.
    """
    total = pages.count()
    share = min(1.0, train_pages / max(1, total))
    chosen = pages.select(F.col(content).alias("page"))
    if share < 1:
        chosen = chosen.where(F.pmod(F.xxhash64("page"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                held.update(_lessons(page))
        if held:
            yield pa.RecordBatch.from_pydict(
                {"on": [list(k[0]) for k in held], "good": [k[1] for k in held], "n": list(held.values())},
                schema=pa.schema([("on", pa.list_(pa.int32())), ("good", pa.bool_()), ("n", pa.int64())]),
            )

    counted = chosen.mapInArrow(count, "on array<int>, good boolean, n long").groupBy("on", "good").agg(F.sum("n").alias("n"))
    return train({(tuple(r.on), r.good): r.n for r in counted.collect()})


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars, n_blocks, n_kept)`` per row of ``pages`` (page_id, url, html).

    Blocks of the main text are joined by line breaks; white space inside a block is one space,
    character references are decoded, ``n_chars`` counts code points. A null or empty page, and one
    without main text, has the empty text. Repeated rows and null ids or addresses return as they
    are; pages of any length are read whole, in linear time but for the flow, which works on blocks.
    Blocks whose two costs tie (cuts of equal size) are not main text. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    learned = fit(pages) if weights is None else weights
    named = pages.select("page_id", "url", "html")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, sizes, all_blocks, kept = [], [], [], []
            for page in batch.column(2).to_pylist():
                found, good = main_blocks(page, learned)
                text = "\n".join(b.text for b, g in zip(found, good, strict=True) if g)
                texts.append(text)
                sizes.append(len(text))
                all_blocks.append(len(found))
                kept.append(sum(good))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (sizes, all_blocks, kept))],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    types = {f.name: f.dataType.simpleString() for f in named.schema}
    return named.mapInArrow(
        run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long, n_blocks long, n_kept long"
    )
