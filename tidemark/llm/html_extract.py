"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is read once into blocks of text and tags. The score of a word follows from where it stands: in a
link, in which elements, under which class names, ids and roles. The weights of these places are
fitted on labelled pages (:mod:`labelled_pages`) by logistic regression, so words of an article score above
zero; tags score below it, each kind by its log odds inside and outside of the labelled articles. One linear scan
finds the contiguous region with the largest sum. The region is then widened to the smallest element
that holds its words, as far as that isn't the body, since a long advert may cut off a short end; and
blocks in it whose words score below zero in all are left out. What an element is named does not count if it
wraps the page's article: if it holds more than half of its words and a main heading, an article or a main element.

Rows: a null or empty page gives an empty text, as does one without words that score above zero.
Markup may be broken: what isn't closed ends with what encloses it, and an unknown end tag is nothing.
Depth of nesting costs no more than length.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .labelled_pages import PAGES

# HTML's own element kinds.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HIDDEN = frozenset("head script style template noscript iframe object canvas svg math textarea title xmp noembed noframes".split())
#: What a start tag closes if it is still open.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDS = frozenset("article aside body div footer header main nav section table ul ol dl td th li form html".split())
#: Elements that say nothing of what they hold.
NEUTRAL = frozenset("#root body center div html section".split())
#: Elements out of which no p is closed.
SCOPE = frozenset("body button caption html table td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_NEUTRAL = {"<" + name for name in NEUTRAL}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
_NAMED, _SPLIT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE), re.compile(r"[^a-z]+")
#: Kinds of tags with a score of their own, the weight of the ridge, and the most that a word can score.
TAGS, RIDGE, MOST = frozenset("div h1 h2 h3 li p td ul".split()), 1.0, 3.0
#: How firmly a word in no special place is held to score one.
BIAS_RIDGE = 200.0
#: Texts between two tags of fewer words are short, of so many long.
SHORT, LONG = 5, 10

class _Open:
    """The open elements, with where each kind of them stands, so that none has to be searched for."""

    def __init__(self):
        self.names, self.places = ["#root"], [(0, False, False)]  # of each: number, hidden, in a link
        self.at: dict[str, list[int]] = {}
        self.holds, self.scopes, self.blocks = [], [], [0]

    def push(self, name: str, place: tuple) -> None:
        i = len(self.names)
        self.names.append(name)
        self.places.append(place)
        for own, there in self._lists(name):
            if there:
                own.append(i)

    def _lists(self, name: str):
        return (self.at.setdefault(name, []), True), (self.holds, name in HOLDS), (self.scopes, name in SCOPE), (self.blocks, name not in INLINE)

    def cut(self, i: int) -> None:
        """Close the i-th element and all in it."""
        while len(self.names) > i:
            self.places.pop()
            for own, there in self._lists(self.names.pop()):
                if there:
                    own.pop()

    def last(self, name: str) -> int:
        own = self.at.get(name)
        return own[-1] if own else 0


class Page:
    """A page in reading order: blocks of text, tags, and which element holds each."""

    def __init__(self, text: str):
        self.kinds: list[str] = []  # "word", "link" or "tag" and its kind
        self.texts: list[str] = []  # "" for a tag
        self.holders: list[int] = []  # element of each
        self.parents, self.names, self.tokens = [-1], ["#root"], [frozenset()]
        self.open = _Open()
        self._read(text)

    def _read(self, text: str) -> None:
        at, size = 0, len(text)
        while at < size:
            mark = text.find("<", at)
            found = _TOKEN.match(text, mark) if mark >= 0 else None
            while mark >= 0 and not found:  # a "<" that opens nothing is text
                mark = text.find("<", mark + 1)
                found = _TOKEN.match(text, mark) if mark >= 0 else None
            end = mark if mark >= 0 else size
            if end > at:
                self._text(text[at:end])
            if not found:
                return
            at = found.end()
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                self._close(name)
            elif name in RAW:
                close = _RAW_END[name].search(text, at)
                at = close.end() if close else size
            else:
                self._start(name, found[3])

    def _start(self, name: str, attributes: str) -> None:
        stack = self.open
        if name in ENDS_P and stack.last("p") > (stack.scopes[-1] if stack.scopes else 0):
            self._close("p")
        for other in CLOSES.get(name, ()):
            if (i := stack.last(other)) and i >= (stack.holds[-1] if stack.holds else 0):
                self._close(other)
        if name not in INLINE:
            self._tag(name)
        if name in VOID:
            if name == "br":
                self._text(" ")
            return
        holder, hidden, link = stack.places[-1]
        if name not in INLINE:
            self.parents.append(holder)
            self.names.append(name)
            self.tokens.append(frozenset(w for m in _NAMED.finditer(attributes) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w))
            holder = len(self.names) - 1
        stack.push(name, (holder, hidden or name in HIDDEN, link or name == "a"))

    def _close(self, name: str) -> None:
        stack = self.open
        i = stack.last(name)
        if not i or (name in INLINE and stack.blocks[-1] > i):
            return
        stack.cut(i)
        if name not in INLINE:
            self._tag(name)

    def _tag(self, name: str) -> None:
        self._add("tag " + (name if name in TAGS else "other"), "")

    def _text(self, raw: str) -> None:
        _, hidden, link = self.open.places[-1]
        if not hidden:
            self._add("link" if link else "word", html.unescape(raw))

    def _add(self, kind: str, text: str) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.holders.append(self.open.places[-1][0])

    def features(self) -> list[list[str]]:
        """What is new on the way to each element: its kind and names, unless an element around it has them.

        The names of an element that wraps the article don't count, nor does its kind.
        """
        words, marked = [0] * len(self.names), [name in ("article", "main", "h1") for name in self.names]
        for holder, text in zip(self.holders, self.texts, strict=True):
            words[holder] += len(text.split())
        for x in range(len(self.names) - 1, 0, -1):  # parents come before their children
            words[self.parents[x]] += words[x]
            marked[self.parents[x]] |= marked[x]
        out, path, around = [], [], set()
        for x, name in enumerate(self.names):
            while path and path[-1][0] != self.parents[x]:
                around.difference_update(path.pop()[1])
            wraps = 2 * words[x] > words[0] and marked[x] and name not in ("article", "main", "h1")
            new = [] if wraps else [f for f in sorted({"." + t for t in self.tokens[x]} | ({"<" + name} - _NEUTRAL)) if f not in around]
            around.update(new)
            path.append((x, new))
            out.append(new)
        return out


    def blocks(self) -> list[str]:
        """For every item, how long the text between the tags around it is."""
        words, number = [0], []
        for kind, text in zip(self.kinds, self.texts, strict=True):
            if kind.startswith("tag"):
                words.append(0)
            words[-1] += len(text.split())
            number.append(len(words) - 1)
        size = ["short" if n < SHORT else "long" if n >= LONG else "" for n in words]
        return [size[i] for i in number]


def _labels(page: str) -> tuple[Page, list[bool]]:
    """A labelled page, and whether each of its items stands in the article."""
    for mark, code in (("[[", "\x02"), ("]]", "\x03"), ("{{", "\x03"), ("}}", "\x02")):
        page = page.replace(mark, f"<br>{code}<br>")
    read, inside, out = Page(page), False, []
    for i, text in enumerate(read.texts):
        inside = (inside or "\x02" in text) and "\x03" not in text
        read.texts[i] = text.strip("\x02\x03")
        out.append(inside)
    return read, out


@lru_cache(maxsize=16)
def weights(pages: tuple[str, ...] = PAGES) -> dict[str, float]:
    """The weight of every place of a word, and the score of every kind of tag, from labelled pages."""
    rows, y, n, tags = [], [], [], {}
    for page in pages:
        read, inside = _labels(page)
        own = read.features()
        full = [set(own[0])]
        for x in range(1, len(own)):
            full.append(full[read.parents[x]] | set(own[x]))
        for kind, text, holder, size, label in zip(read.kinds, read.texts, read.holders, read.blocks(), inside, strict=True):
            if kind.startswith("tag"):
                tags.setdefault(kind, [0.5, 0.5])[0 if label else 1] += 1
            elif words := len(text.split()):
                rows.append(full[holder] | {kind, size} - {"word", ""})
                y.append(label)
                n.append(words)
    names = sorted(set().union(*rows))
    x = np.array([[f in row for f in names] + [1] for row in rows], float)
    y, n, w = np.array(y, float), np.array(n, float), np.zeros(len(names) + 1)
    ridge, mean = np.append(np.full(len(names), RIDGE), BIAS_RIDGE), np.append(np.zeros(len(names)), 1.0)
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * (w - mean))
    odds = {k: min(-0.2, float(np.log(c[0] / c[1]))) for k, c in tags.items()}
    return dict(zip([*names, "word"], w.tolist(), strict=True)) | odds


def scores(page: Page, weight: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Score of every item in all, and of one of its words."""
    places = np.zeros(len(page.names))
    for x, new in enumerate(page.features()):
        places[x] = (places[page.parents[x]] if x else weight["word"]) + sum(weight.get(f, 0.0) for f in new)
    each = places[page.holders] + [weight.get(s, 0.0) + (weight["link"] if k == "link" else 0.0) for s, k in zip(page.blocks(), page.kinds, strict=True)]
    each = np.clip(each, -MOST, MOST)
    tag = np.array([weight.get(k, weight["tag other"]) if k.startswith("tag") else 0.0 for k in page.kinds])
    return np.where(tag < 0, tag, each * [len(t.split()) for t in page.texts]), each


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """Begin and end of the contiguous run with the largest sum, in one pass; (0, 0) if none is positive."""
    best, total, begin, found = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores.tolist()):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def main_text(page: str, weight: dict[str, float] | None = None) -> str:
    """The article's blocks, each with its white space collapsed, joined by line feeds."""
    read = Page(page)
    if not read.kinds:
        return ""
    score, each = scores(read, weight or weights())
    begin, end = best_region(score)
    if begin == end:
        return ""
    # The element that holds the region's words, unless that is the page itself. Elements are numbered in
    # the order in which they open, so what holds the first and the last of them holds all.
    held = [read.holders[i] for i in range(begin, end) if each[i] > 0 and read.texts[i].strip()]
    x, y = min(held), max(held)
    while x != y:
        x, y = min(x, y), read.parents[max(x, y)]
    while begin and not read.kinds[begin - 1].startswith("tag"):
        begin -= 1
    while end < len(score) and not read.kinds[end].startswith("tag"):
        end += 1
    chosen = range(begin, end)
    if read.names[x] not in ("body", "html", "#root"):
        within = {x}
        for z in range(x + 1, len(read.names)):
            if read.parents[z] in within:
                within.add(z)
        chosen = [i for i, z in enumerate(read.holders) if z in within]
    blocks, current, total, last = [], [], 0.0, -2
    for i in chosen:
        if read.kinds[i].startswith("tag") or i != last + 1:
            blocks.append("".join(current) if total > 0 else "")
            current, total = [], 0.0
        if not read.kinds[i].startswith("tag"):
            current.append(read.texts[i])
            total += score[i]
        last = i
    blocks.append("".join(current) if total > 0 else "")
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def make():
        return lambda keys, texts: {"page_id": [k["page_id"] for k in keys], "url": [k["url"] for k in keys], "text": [main_text(t) for t in texts]}

    own = pages.select(F.struct("page_id", "url").alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    return map_texts(own, make, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string", column="html")
