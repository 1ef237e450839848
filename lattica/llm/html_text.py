"""Main text of web pages by a minimum cut over their blocks.

A page is read into blocks of text, each with its place in the element tree. A
logistic classifier of the blocks' own text and shape (length, links,
punctuation), fitted on blocks whose markup says what they are, gives each block
log-odds, which become its capacities to the two terminals. The elements around
the blocks are nodes, too: those that their name or class marks hang on a
terminal. Smoothness edges join each block with its element, elements with their
parents, blocks that follow each other, the stronger the nearer they stand in the
tree, and blocks of one container with its longest block. So what markup says
spreads through the tree, and the cut of least capacity separates content from
boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t-\r\x85\xa0  -     　]+")

# Element names by role, and words in class, id and role attributes.
RAW = frozenset("script style noscript template iframe textarea title select svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AWAY = frozenset("nav header footer aside form menu dialog button fieldset".split())
TOWARDS = frozenset("article main".split())
AWAY_WORDS = frozenset("ad ads adbox alert advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply replies respond responses share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
TOWARDS_WORDS = frozenset("article body content entry main post story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

MODIFIERS = frozenset("has with no without not hide show is".split())
REMARKS = frozenset("comment comments disqus reply replies respond responses".split())
TEASERS = REMARKS | frozenset("ad ads advert advertisement promo promoted related sponsored teaser widget".split())
LEAVES = HEADINGS | frozenset("p li dt dd td th tr pre blockquote figcaption caption summary address".split())

#: Limits of the text's evidence: hundredths of log-odds.
TEXT_LOW, TEXT_HIGH = -290, 300
#: How strongly a block hangs on the element that marks it: hidden ones, elements by name and away classes, content classes.
HIDDEN_LINK, LINK, CLASS_LINK = 900, 400, 120
#: Capacity of a marked element to its terminal, and of an unmarked one to what marks it.
MARKED, INSIDE = 5000, 20000
#: Capacities between blocks that follow each other in one container, in neighbouring ones, elsewhere; and to a container's longest block.
SAME, NEAR, FAR, LONGEST = 60, 30, 8, 60
#: Share of a page's text from which a wrapper's away mark counts less, and from which not at all.
WRAPS_SOME, WRAPS_ALL = 0.5, 0.75
#: Pages, at most about, whose blocks the text classifier is fitted on.
TRAIN_PAGES = 2000


@dataclass
class Element:
    """``hidden``, ``away``, ``towards`` (how strongly): its own marks. ``chars`` and ``main`` count unlinked text inside, all of it and that of articles."""

    name: str
    parent: "Element | None"
    hidden: bool = False
    away: bool = False
    towards: int = 0
    remarks: bool = False
    chars: int = 0
    main: int = 0


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    def container(self) -> Element:
        e = self.element
        while e.name in LEAVES and e.parent is not None and not (e.away or e.hidden or e.towards):
            e = e.parent
        return e


def _element(name: str, attributes: str, parent: Element | None) -> Element:
    e = Element(name, parent)
    e.away = name in AWAY
    main = name in TOWARDS
    if attributes.strip(" /") and name not in ("html", "body", "a"):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" and name != "input" or key == "aria-hidden" and value == "true":
                e.hidden = True
            elif key in ("class", "id", "role"):
                names = [_WORD.findall(x) for x in value.split()]
                words = {w for own in names if own and own[0] not in MODIFIERS for w in own}
                marks = {own[0] for own in names if len(own) == 1} & TEASERS if main else words & AWAY_WORDS
                # a post's own header or footer is part of it
                if marks - ({"header", "footer"} if words & TOWARDS_WORDS else set()):
                    e.away = True
                    e.remarks |= bool(marks & REMARKS)
                elif words & TOWARDS_WORDS:
                    e.towards = CLASS_LINK
    if main and not e.away:
        e.towards = LINK
    return e


def blocks(page: str) -> list[Block]:
    """Text blocks of a page, in order, with white space collapsed and references decoded."""
    root = Element("", None)
    stack = [root]
    out: list[Block] = []
    current: Block | None = None
    links = 0

    def put(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            current = Block(next((e for e in reversed(stack) if e.name not in INLINE), root))
            out.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE:
            current = None
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
        elif name in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
        elif name not in VOID:
            if name == "a":
                links += 1
            if name not in INLINE:  # a new block ends an open paragraph
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p" and (name in ("p", "ul", "ol", "div", "table", "pre", "blockquote", "hr") or name in HEADINGS or name in AWAY or name in TOWARDS):
                        del stack[k:]
                        break
                    if stack[k].name not in INLINE and stack[k].name != "p":
                        break
            if not m[3].rstrip().endswith("/"):
                stack.append(_element(name, m[3], stack[-1]))
    for b in out:
        b.text = _SPACE.sub(" ", html.unescape("".join(b.parts))).strip(" ")
    return [b for b in out if b.text]


FEATURES = ("constant", "log_words", "linked", "sentence", "few_words", "heading", "digits", "capitals", "signs")
#: Weights that the fit starts from, and keeps where a page sample teaches nothing: log-odds of content.
PRIOR = np.array([-2.0, 1.0, -4.0, 0.8, -0.8, 0.5, -1.0, -1.0, -1.5])
RIDGE = 20.0


def features(found: list[Block]) -> np.ndarray:
    """What the text of each block shows; nothing of classes, and of names only whether it is a heading."""
    out = np.zeros((len(found), len(FEATURES)))
    for i, b in enumerate(found):
        t, n = b.text, len(b.text)
        words = t.count(" ") + 1
        out[i] = (1.0, min(math.log1p(words), 5.0), min(1.0, b.linked / n), words > 3 and t[-1] in ".!?…。\"'»)", words < 4, b.element.name in HEADINGS, len(_DIGITS.findall(t)) / n, len(_CAPITALS.findall(t)) / n, _SIGNS.search(t) is not None)
    return out


_DIGITS, _CAPITALS, _SIGNS = re.compile(r"\d"), re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[©®™|·›]")


def _above(e: Element | None) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


class Tree:
    """The elements around some blocks, and what their marks come to on this page."""

    def __init__(self, found: list[Block]):
        self.elements: dict[int, Element] = {}
        for b in found:
            for e in _above(b.element):
                if id(e) in self.elements:
                    break
                e.chars = e.main = 0
                self.elements[id(e)] = e
        self.total = 0
        for b in found:
            own, main = max(0, len(b.text) - b.linked), False
            self.total += own
            for e in _above(b.element):
                main = main or e.towards == LINK
                e.chars += own
                e.main += own * main
        self.main = next((e.main for e in self.elements.values() if e.parent is None), 0)
        self.marks: dict[int, int] = {}
        self.known: dict[int, int] = {}
        for k, e in self.elements.items():
            self.marks[k] = self._mark(e)

    def _mark(self, e: Element) -> int:
        """Above 0 for content, below for boilerplate: how strongly blocks hang on the mark.

        An away mark around most of the page's text, beyond which there is no
        article, is a wrapper's, and counts less or not at all. A header within an
        article is part of it.
        """
        if e.hidden:
            return -HIDDEN_LINK
        if not e.away or e.name == "header" and any(x.towards for x in _above(e.parent)):
            return e.towards
        if e.remarks or self.main > e.main or (e.name in AWAY and not e.main and e.name != "form"):
            return -LINK
        share = e.chars / max(1, self.total)
        return -round(LINK * (1 - min(1.0, max(0.0, (share - WRAPS_SOME) / (WRAPS_ALL - WRAPS_SOME)))))

    def mark(self, e: Element | None) -> int:
        """The mark of the nearest marked element; content in boilerplate is boilerplate."""
        path = []
        for x in _above(e):
            if id(x) in self.known:
                break
            path.append(id(x))
        m = 0 if e is None else self.known.get(id(x), 0)
        for k in reversed(path):
            own = self.marks[k]
            m = own if own < 0 or own > 0 and m > -LINK else m
            self.known[k] = m
        return m

    def graph(self, found: list[Block]) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Gains of taking elements for content, numbered after the blocks, and the edges of the tree."""
        number = {k: len(found) + i for i, k in enumerate(self.elements)}
        gains, links = [], []
        for k, e in self.elements.items():
            m, outer = self.marks[k], self.mark(e.parent)
            gains.append(MARKED if m > 0 else -2 * MARKED if m < 0 else 0)
            if outer and (m == 0 or m > 0 > outer):
                links.append((number[k], number[id(e.parent)], INSIDE))
            elif e.parent is not None and not m:
                links.append((number[k], number[id(e.parent)], NEAR))
        links += [(i, number[id(b.element)], abs(m)) for i, b in enumerate(found) if (m := self.mark(b.element))]
        return gains, links


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to ``PRIOR``; each label has half of the weight. Without both labels: ``PRIOR``."""
    w = PRIOR.copy()
    if not 0 < y.sum() < len(y):
        return w
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - RIDGE * (w - PRIOR)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def taught(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the blocks whose markup is plain, and whether they are content."""
    found = blocks(page)
    tree = Tree(found)
    says = np.array([tree.mark(b.element) for b in found], np.int64)
    plain = abs(says) >= LINK
    return features(found)[plain], (says[plain] > 0).astype(float)


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness between blocks: those that follow each other, and each block with the longest of its container."""
    boxes = [b.container() for b in found]
    out = []
    for i in range(len(found) - 1):
        a, b = boxes[i], boxes[i + 1]
        near = a.parent is b or b.parent is a or a.parent is b.parent and a.parent is not None
        out.append((i, i + 1, SAME if a is b else NEAR if near and not (a.away or b.away or a.hidden or b.hidden) else FAR))
    longest: dict[int, int] = {}
    for i, box in enumerate(boxes):
        k = longest.setdefault(id(box), i)
        if len(found[i].text) - found[i].linked > len(found[k].text) - found[k].linked:
            longest[id(box)] = i
    out += [(i, longest[id(box)], LONGEST) for i, box in enumerate(boxes) if longest[id(box)] != i]
    return out


def cut(source: list[int], sink: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Minimum cut by shortest augmenting paths; says which nodes stay on the source's side.

    Of several least cuts, the one with the smallest source side is returned. A
    node whose terminal outweighs all its edges stands on that terminal's side in
    every least cut, so such nodes go first, and flow runs through the rest only.
    """
    n = len(source)
    gain = [a - b for a, b in zip(source, sink)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in links:
        if a != b:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    pull = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    queue = [v for v in range(n) if abs(gain[v]) > pull[v]]
    for v in queue:
        if side[v] is not None:
            continue
        side[v] = gain[v] > 0
        for w, c in near[v].items():
            if side[w] is None:
                del near[w][v]
                gain[w] += c if side[v] else -c
                pull[w] -= c
                if abs(gain[w]) > pull[w]:
                    queue.append(w)
    left = {v: max(0, gain[v]) for v in range(n) if side[v] is None}
    room = {v: max(0, -gain[v]) for v in left}
    while True:
        before: dict[int, int] = {v: -1 for v in left if left[v]}
        queue = list(before)
        end = -1
        for v in queue:
            if room[v]:
                end = v
                break
            for w, c in near[v].items():
                if c and w not in before:
                    before[w] = v
                    queue.append(w)
        if end < 0:
            return [v in before if s is None else s for v, s in enumerate(side)]
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        path.reverse()
        most = min([left[path[0]], room[end], *(near[a][b] for a, b in zip(path, path[1:]))])
        left[path[0]] -= most
        room[end] -= most
        for a, b in zip(path, path[1:]):
            near[a][b] -= most
            near[b][a] += most


def odds(found: list[Block], weights: np.ndarray = PRIOR) -> list[int]:
    """The text's evidence for content, in hundredths of log-odds."""
    return np.clip(np.rint(100 * (features(found) @ weights)), TEXT_LOW, TEXT_HIGH).astype(int).tolist()


def labels(found: list[Block], weights: np.ndarray = PRIOR) -> list[bool]:
    """Which blocks are content. Where a cut leaves none, blocks that the markup alone puts in an article or content box are."""
    if not found:
        return []
    tree = Tree(found)
    more, links = tree.graph(found)
    gains = odds(found, weights) + more
    kept = cut([max(0, g) for g in gains], [max(0, -g) for g in gains], edges(found) + links)[: len(found)]
    return kept if any(kept) else [tree.mark(b.element) > 0 for b in found]


def main_blocks(page: str, weights: np.ndarray = PRIOR) -> list[str]:
    """Texts of the blocks labelled as content."""
    found = blocks(page)
    return [b.text for b, k in zip(found, labels(found, weights)) if k]


def learned(pages: DataFrame, most: int = TRAIN_PAGES) -> np.ndarray:
    """Weights fitted on the blocks of about ``most`` pages, picked by a hash of their ids; only features leave the executors."""
    rate = max(1, -(-pages.count() // most))
    picked = pages.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(rate)) == 0).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("html").fill_null("").to_pylist():
                x, y = taught(page)
                x, y = x[:TRAIN_BLOCKS], y[:TRAIN_BLOCKS]
                if len(y):
                    yield pa.RecordBatch.from_pydict({"x": pa.array([x.astype("<f4").tobytes()]), "y": pa.array([y.astype("u1").tobytes()])})

    got = picked.mapInArrow(runtime.trimmed(run), "x binary, y binary").collect()
    # in one order, whatever the partitions, so that the same pages give the same weights
    rows = sorted((bytes(r["x"]), bytes(r["y"])) for r in got)
    x = np.frombuffer(b"".join(a for a, _ in rows), "<f4").reshape(-1, len(FEATURES)).astype(float)
    return fit(x, np.frombuffer(b"".join(b for _, b in rows), "u1").astype(float))


#: Blocks of one page, at most, that the fit takes.
TRAIN_BLOCKS = 200


def extracted(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``page_id``, ``url``, main ``text`` and its code points; ``weights`` of the text classifier are fitted here unless given.

    Null html is empty; a page without content has an empty text. Rows stand
    alone, so repeated pages and ids change nothing; a very long page is one row
    of blocks; an empty table gives no rows.
    """
    runtime.prepare(pages.sparkSession)
    if weights is None:
        weights = learned(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(p, weights)) for p in batch.column("html").fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(runtime.trimmed(run), "page_id long, url string, text string, n_chars long")
