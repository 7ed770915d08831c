"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block-level tags into flat blocks of text. Each block is
described by its word count and link density, by those of the blocks before
and after it, and by what encloses it; a decision tree, trained here on a
small labelled table of blocks, keeps or drops it. Pages are independent, so
the whole operator is one narrow pass.

A name such as ``sidebar`` on an element marks what it holds only if it does
not hold the main text: the ``<main>`` element, else the longest ``<article>``
outside reader comments, else the longest element with an article's name, else
more than half of the page's words outside links. A form is treated alike, as
some pages are one form. Tags are read as browsers read them, in one pass: a
quote opens a value only behind ``=``, and a tag that is never closed runs to
the end of the page.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.llm.common import ship

_RAW = "script|style|noscript|template|svg|iframe|object|canvas|math"
# names, each with an optional value; nothing is given back, so a page is read once
_ATTRS = (r"(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)"
          r"(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])[^\s>]*+))?+)*+")
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{_RAW})(?=[\s/>]|\Z){_ATTRS}(?:>|\Z).*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[a-z]+|[0-9]+")

_BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div
dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol
option p pre search section select summary table tbody td textarea tfoot th thead title tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
_ASIDE = frozenset("nav footer aside head menu dialog button select textarea fieldset label search".split())
_ASIDE_NAMES = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert
adverts advertisement promo promotion sponsor sponsored banner cookie cookies consent gdpr notice alert popup modal
overlay newsletter subscribe signup social share sharing related recommended recommendations login search toolbar
pagination pager legal copyright masthead contentinfo complementary""".split())
_COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
_MAIN_NAMES = frozenset("article articlebody story post entry".split())
# a class word with one of these says how a page looks, not what the element is
_STATE = frozenset("""has no with without is not closed open opened enabled disabled on off active layout free loaded
loading hidden visible allowed""".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "enclosed", "inside")
_NAMED, _CERTAIN = 1, 2

# The labelled table: FEATURES, then 1 for main text. enclosed: 2 in a menu,
# footer, sidebar or the like by its tag, or in comments, 1 by a name only;
# inside: in the article.
_LABELLED = np.array([
    # in the article
    (120, 0.0, 90, 0.0, 80, 0.0, 0, 1, 1), (45, 0.1, 60, 0.0, 30, 0.0, 0, 1, 1), (8, 0.0, 0, 0.0, 70, 0.0, 0, 1, 1),
    (1, 0.0, 40, 0.0, 1, 0.0, 0, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1), (2, 0.0, 5, 1.0, 50, 0.0, 0, 1, 1),
    (15, 0.4, 20, 0.0, 33, 0.1, 0, 1, 1), (6, 1.0, 80, 0.0, 64, 0.0, 0, 1, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (30, 0.0, 6, 1.0, 7, 0.0, 0, 1, 1), (220, 0.02, 3, 0.0, 4, 1.0, 0, 1, 1), (12, 0.0, 2, 1.0, 4, 0.3, 0, 1, 1),
    # enclosed by something that is not the article, wherever it stands
    (1, 1.0, 0, 0.0, 1, 1.0, 2, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0), (2, 1.0, 1, 1.0, 12, 0.0, 2, 0, 0),
    (12, 0.0, 1, 1.0, 9, 0.0, 2, 0, 0), (14, 0.0, 80, 0.0, 0, 0.0, 2, 0, 0), (60, 0.0, 70, 0.0, 50, 0.0, 2, 0, 0),
    (90, 0.0, 40, 0.0, 30, 0.0, 2, 1, 0), (5, 0.0, 60, 0.0, 45, 0.0, 2, 1, 0), (3, 1.0, 100, 0.0, 2, 1.0, 2, 1, 0),
    (25, 0.5, 10, 0.0, 3, 1.0, 2, 0, 0), (150, 0.0, 12, 0.0, 0, 0.0, 2, 0, 0), (9, 0.0, 0, 0.0, 1, 1.0, 2, 0, 0),
    # named as something else: only long runs among long runs are kept
    (12, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0), (8, 0.0, 3, 1.0, 12, 0.0, 1, 0, 0), (14, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0),
    (25, 0.5, 10, 0.0, 3, 1.0, 1, 0, 0), (60, 0.0, 14, 0.0, 3, 1.0, 1, 0, 0), (40, 0.0, 45, 0.0, 30, 0.0, 1, 0, 0),
    (9, 0.0, 70, 0.0, 85, 0.0, 1, 1, 0), (30, 0.0, 60, 0.0, 55, 0.0, 1, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0),
    (2, 0.0, 14, 0.0, 0, 0.0, 1, 0, 0), (85, 0.0, 9, 0.0, 2, 1.0, 1, 0, 0), (70, 0.0, 120, 0.0, 90, 0.0, 1, 0, 0),
    (110, 0.6, 80, 0.0, 90, 0.0, 1, 0, 0), (120, 0.0, 8, 0.0, 3, 1.0, 1, 0, 0), (140, 0.0, 20, 0.0, 130, 0.0, 1, 0, 0),
    (130, 0.0, 95, 0.0, 110, 0.0, 1, 0, 1), (115, 0.02, 120, 0.0, 90, 0.0, 1, 0, 1), (125, 0.0, 140, 0.0, 100, 0.0, 1, 1, 1),
    # neither: long runs of text are kept, link lists and lone labels are not
    (55, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1), (140, 0.05, 3, 1.0, 90, 0.0, 0, 0, 1), (35, 0.1, 2, 1.0, 25, 0.0, 0, 0, 1),
    (24, 0.0, 50, 0.0, 2, 1.0, 0, 0, 1), (80, 0.2, 0, 0.0, 0, 0.0, 0, 0, 1), (18, 0.0, 60, 0.0, 44, 0.0, 0, 0, 1),
    (7, 0.0, 3, 1.0, 85, 0.0, 0, 0, 1), (5, 0.0, 66, 0.0, 72, 0.0, 0, 0, 1), (4, 0.0, 38, 0.0, 48, 0.0, 0, 0, 1),
    (9, 0.0, 41, 0.0, 20, 0.0, 0, 0, 1), (1, 0.0, 55, 0.0, 30, 0.0, 0, 0, 1), (22, 0.1, 15, 0.0, 18, 0.0, 0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (3, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0), (6, 0.8, 5, 0.9, 60, 0.0, 0, 0, 0), (12, 0.9, 10, 1.0, 8, 1.0, 0, 0, 0),
    (40, 0.9, 3, 1.0, 5, 1.0, 0, 0, 0), (2, 0.0, 1, 0.0, 3, 0.0, 0, 0, 0), (5, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0),
    (8, 0.6, 50, 0.0, 6, 1.0, 0, 0, 0), (3, 1.0, 70, 0.0, 2, 1.0, 0, 0, 0), (4, 0.5, 0, 0.0, 2, 0.0, 0, 0, 0),
])


def train_tree(table: np.ndarray, least: int = 1, depth: int = 8):
    """A binary decision tree by Gini impurity: a leaf is 0 or 1, an inner
    node (feature, threshold, tree at or below it, tree above it). Ties of
    impurity go to the earlier feature and the lower threshold."""
    x, y = table[:, :-1], table[:, -1]
    best, gain = None, 1e-12
    parent = len(y) * 2 * y.mean() * (1 - y.mean())
    if depth and parent > 0:
        for f in range(x.shape[1]):
            cuts = np.unique(x[:, f])
            for t in (cuts[1:] + cuts[:-1]) / 2:
                low = x[:, f] <= t
                if min(low.sum(), (~low).sum()) < least:
                    continue
                child = sum(m.sum() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
                if parent - child > gain:
                    best, gain = (f, float(t), low), parent - child
    if best is None:
        return int(y.mean() >= 0.5)
    f, t, low = best
    return f, t, train_tree(table[low], least, depth - 1), train_tree(table[~low], least, depth - 1)


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def _names(attrs: str) -> set[str]:
    """The parts of all class words, ids, roles and item properties that tell
    what an element is."""
    found = set()
    for _, a, b, c in _ATTR.findall(attrs):
        for word in (a or b or c).split():
            parts = _PARTS.findall(_HUMP.sub("-", word).lower())
            if _STATE.isdisjoint(parts):
                found.update(parts)
    return found


class _Reader:
    """Reads one page into blocks; what a name means is settled at its end."""

    def __init__(self):
        self.out: list[list] = []     # text, words, link words, certain, mark, inside
        self.piece: list[str] = []    # of the open block
        self.links = self.in_link = 0
        self.stack: list[tuple] = []  # tag, state within, own mark, own place in mains
        self.state = (0, 0, 0, -1)    # certain, in comments, inside, innermost mark
        self.open: dict[str, int] = {}
        self.words = 0                # outside links, certain and comments
        self.marks: list[list] = []   # [outer mark, of comments, words]
        self.mains: list[list] = []   # [rank, words, enclosing mark, in comments]

    def close(self):
        if self.piece:
            text = " ".join("".join(self.piece).split())
            if text:
                n = text.count(" ") + 1
                certain, comments, inside, mark = self.state
                self.out.append([text, n, self.links, certain, mark, inside])
                if not certain and not comments:
                    self.words += n - min(n, self.links)
            self.piece.clear()
        self.links = 0

    def text(self, raw: str):
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            self.piece.append(t)
            if self.in_link:
                self.links += len(t.split())

    def leave(self, k: int):
        """Ends all open elements from the k-th on."""
        for tag, _, mark, main in self.stack[k:]:
            self.open[tag] -= 1
            if mark >= 0:
                self.marks[mark][2] = self.words - self.marks[mark][2]
            if main >= 0:
                self.mains[main][1] = self.words - self.mains[main][1]
        del self.stack[k:]
        self.state = self.stack[-1][1] if self.stack else (0, 0, 0, -1)

    def end(self, tag: str, block: bool):
        if not self.open.get(tag):
            return
        k = len(self.stack) - 1
        while self.stack[k][0] != tag:
            k -= 1
        if not block:
            self.close()
        self.leave(k)

    def start(self, tag: str, attrs: str, block: bool):
        if block and self.stack and self.stack[-1][0] == "p":
            self.leave(len(self.stack) - 1)
        if tag in ("body", "html"):
            self.leave(0)
            return
        certain, comments, inside, mark = self.state
        names = _names(attrs) if "=" in attrs else set()
        of_comments = not _COMMENT_NAMES.isdisjoint(names)
        named = tag not in _MAIN and (tag == "form" or of_comments or not _ASIDE_NAMES.isdisjoint(names))
        aside = tag in _ASIDE or (tag == "header" and not inside)
        if not (block or aside or named):
            return
        if not block and not certain:
            self.close()
        rank = 2 if tag == "main" or (names and "main" in names and "role" in attrs.lower()) else 1 if tag == "article" else 0
        main = rank or (not named and not _MAIN_NAMES.isdisjoint(names))
        own = place = -1
        if main and not (certain or aside):
            place = len(self.mains)
            self.mains.append([rank, self.words, mark, comments])
        if named and not certain:
            own = len(self.marks)
            self.marks.append([mark, of_comments, self.words])
            mark = own
        certain = 1 if aside else certain
        self.state = (certain, comments or of_comments, 1 if main and not certain else inside, mark)
        if attrs.endswith("/") and tag not in _BLOCK:
            self.state = self.stack[-1][1] if self.stack else (0, 0, 0, -1)
        else:
            self.open[tag] = self.open.get(tag, 0) + 1
            self.stack.append((tag, self.state, own, place))

    def lifted(self) -> set[int]:
        """The marks that hold the main text."""
        ranked = [m for m in self.mains if m[0] == 2] or max(
            ([m for m in self.mains if m[0] == r and m[1] and not m[3]] for r in (1, 0)), key=bool)
        out = set()
        if ranked and ranked[0][0] < 2:
            ranked = [max(ranked, key=lambda m: m[1])]
        for rank, _, mark, _ in ranked:
            while mark >= 0 and mark not in out:
                if rank == 2 or not self.marks[mark][1]:
                    out.add(mark)
                mark = self.marks[mark][0]
        if not ranked:
            out = {k for k, m in enumerate(self.marks) if not m[1] and 2 * m[2] > self.words}
        return out

    def finish(self) -> list[list]:
        self.close()
        self.leave(0)
        lifted, level = self.lifted(), []
        for k, (outer, of_comments, _) in enumerate(self.marks):
            own = 0 if k in lifted else _CERTAIN if of_comments else _NAMED
            level.append(max(own, level[outer] if outer >= 0 else 0))
        return [[text, n, links, _CERTAIN if certain else level[mark] if mark >= 0 else 0, inside]
                for text, n, links, certain, mark, inside in self.out]


def blocks(page: str):
    """The page's text blocks as [text, words, link words, enclosed, inside]."""
    r = _Reader()
    at = 0
    for m in _TOKEN.finditer(page):
        r.text(page[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            r.in_link = 0 if m.group("end") else 1
            continue
        if tag == "br":
            r.piece.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            r.close()
        if m.group("end"):
            r.end(tag, block)
        elif tag not in _VOID:
            r.start(tag, m.group("attrs"), block)
    r.text(page[at:])
    return r.finish()


def main_text(page: str | None, tree) -> str:
    """The kept blocks in page order, joined by one newline."""
    found = blocks(page or "")
    kept = []
    n = len(found)
    density = [b[2] / b[1] for b in found]
    for i, b in enumerate(found):
        before = (found[i - 1][1], density[i - 1]) if i else (0, 0.0)
        after = (found[i + 1][1], density[i + 1]) if i + 1 < n else (0, 0.0)
        if decide(tree, (b[1], density[i], *before, *after, b[3], b[4])):
            kept.append(b[0])
    return "\n".join(kept)


def _job(tree):
    def run(batches):
        for b in batches:
            texts = [main_text(p.as_py(), tree) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text
    and n_chars (code points of text).

    A null or empty page, or one without main text, gives an empty text;
    repeated rows are extracted each; null ids and urls stay; other columns
    are ignored. Broken markup is read as browsers do: an unclosed comment,
    script, tag or quoted value runs to the end of the page.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_job(train_tree(_LABELLED)), "page_id long, url string, text string, n_chars long")
