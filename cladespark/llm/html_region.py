"""Main text of web pages: the maximum-scoring contiguous region of words and tags.

Words score above zero and tags below, with weights learned from labelled pages: those whose markup names its article
element, so every word and tag is known to lie inside or outside of it. Learned are the kinds of elements (name and class) whose words lie outside,
the weights of words by the block they stand in, and those of tags. One linear scan of a page finds the region with the greatest sum, which is then
grown to whole blocks. Words of an element without content score nothing and are left out, also inside the region; on a page that names its article so are words beside it.
Tags that articles are made of (links, lists, tables, plain containers) cost little however rare they are in the labelled pages, so they don't cut an article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

SAMPLE_PAGES = 500
LEAST_WORDS = 20  #: of a kind of element; rarer ones get no weight of their own

# Element names of HTML by their part in a page, and whole class, id or role names of parts that hold no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption br hr".split())
LISTS = frozenset("ul ol dl table".split())
NO_CONTENT = frozenset("head nav header footer aside form button menu dialog fieldset select svg math canvas object template".split())
NO_CONTENT_NAMES = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner navbar navigation breadcrumb breadcrumbs sidebar contentinfo complementary search dialog alertdialog menubar toolbar cookie-banner cookie-notice cookie-consent newsletter share-buttons social-share related-posts comment comments comment-list comment-section reader-comments replies disqus_thread".split()
)

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]+)?(?:\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
LABELLED = "article"


@dataclass(slots=True)
class Segment:
    """A tag, or text between tags."""

    tag: str  #: name of a tag, "" for text
    text: str
    kind: str  #: nearest enclosing element with a class or a part of its own, as ``name`` or ``name.class``
    out: bool  #: inside an element without content
    labelled: bool  #: inside the article element
    block: str = ""  #: the block that a text stands in: the last tag of running text, or "a" inside a link
    ends: bool = False  #: a tag that ends a block
    inner: bool = False  #: a tag below an element without content, or its end


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """``text, name, names, close`` of texts and tags, by HTML's rules for tags, in one pass without going back.

    ``names``: the values of a tag's class, id and role. Comments, and what stands in scripts, styles and the like, give nothing; a tag, quote or
    comment that never ends runs to the end of the page.
    """
    at, size = 0, len(page)
    while at < size:
        less = page.find("<", at)
        if less < 0:
            yield page[at:], "", "", False
            return
        if less > at:
            yield page[at:less], "", "", False
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = end + 3 if end >= 0 else size
            continue
        close = page.startswith("</", less)
        name = _NAME.match(page, less + 1 + close)
        if not name:
            if close or page.startswith(("<!", "<?"), less):
                end = page.find(">", less)
                at = end + 1 if end >= 0 else size
            else:
                yield "<", "", "", False
                at = less + 1
            continue
        at, names = name.end(), []
        while at < size and page[at] != ">":
            found = _ATTRIBUTE.match(page, at)
            if found.end() == at:
                at += 1
                continue
            at = found.end()
            if found[1] and found[2] and found[1].lower() in ("class", "id", "role"):
                names.append(found[2].strip("\"'"))
        at += 1
        if at > size:
            return
        own = name[0].lower()
        if own in RAW and not close:
            yield "", own, "", False
            end = _RAW_END[own].search(page, at)
            if not end:
                return
            at = end.start()
        else:
            yield "", own, " ".join(names), close


def segments(page: str, no_content: frozenset[str] = frozenset()) -> Iterator[Segment]:
    """Tags and text in order; ``no_content``: kinds known to hold none. Elements that are never closed end with their parent."""
    stack: list[tuple[str, str, bool, bool]] = []  # name, kind, out, labelled
    opened: Counter = Counter()
    block, link = "", False
    for text, name, names, close in tokens(page):
        _, kind, out, labelled = stack[-1] if stack else ("", "", False, False)
        if not name:
            yield Segment("", text, kind, out, labelled, "a" if link else block)
            continue
        if name == "a":
            link = not close
        elif name not in INLINE:
            block, link = ("" if close or name not in PROSE else name), False
        holds = name not in INLINE and name not in PROSE and name not in VOID or name in LISTS
        if not holds or name in RAW:
            yield Segment(name, "", kind, out or name in RAW, labelled, "", name not in INLINE, out)
            continue
        inner = out
        if not close:
            if name == "body" and opened["head"]:
                _close(stack, opened, "head")
                _, kind, out, labelled = stack[-1] if stack else ("", "", False, False)
            classes = [c for c in names.lower().split() if c]
            own = [f"{name}.{c}" for c in classes] or [name]
            if classes or name in NO_CONTENT:
                kind = next((k for k in own if k in no_content), own[0])
            bare = name in NO_CONTENT and not (name == "header" and labelled)
            out = out or bare or any(k in no_content for k in own) or not NO_CONTENT_NAMES.isdisjoint(classes)
            labelled = labelled or name == LABELLED and not out
            yield Segment(name, "", kind, out, labelled, "", True, inner)
            stack.append((name, kind, out, labelled))
            opened[name] += 1
        else:
            yield Segment(name, "", kind, out, labelled, "", True, inner)
            if opened[name]:
                _close(stack, opened, name)


def _close(stack: list, opened: Counter, name: str) -> None:
    while stack:
        top = stack.pop()[0]
        opened[top] -= 1
        if top == name:
            return


@dataclass
class Weights:
    """Kinds of elements without content; scores of words by block (those of a named article under its name), and of tags by name."""

    no_content: frozenset[str] = frozenset()
    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)

    def of_word(self, s: Segment, named: bool) -> float:
        if s.out or named and not s.labelled:
            return 0.0
        return self.word.get(LABELLED, 3.0) if named else self.word.get(s.block, 1.0)

    def of_tag(self, s: Segment) -> float:
        """An element without content costs one tag, as its words are left out anyway."""
        if s.inner:
            return 0.0
        return -0.1 if s.labelled else self.tag.get(s.tag, -1.0 if s.out else -0.1)


def _cheap(tag: str) -> bool:
    return tag in INLINE or tag in PROSE or tag not in NO_CONTENT and tag != LABELLED


def _chosen(pages: DataFrame, sample: int, html_col: str, id_col: str) -> DataFrame:
    """``page`` of at most ``sample`` different labelled pages, those with the least hash. Hashes are chosen first, so only chosen pages move."""
    hashed = pages.where(F.col(html_col).ilike(f"%<{LABELLED}%")).select(F.xxhash64(F.col(id_col).cast("string"), html_col).alias("hash"), F.col(html_col).alias("page"))
    hashes = hashed.select("hash").distinct().orderBy("hash").limit(sample)
    return hashed.join(F.broadcast(hashes), "hash", "left_semi").groupBy("hash").agg(F.min("page").alias("page")).select("page")


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES, html_col: str = "html", id_col: str = "page_id") -> Weights:
    """Weights from at most ``sample`` labelled pages.

    A kind of element with at least ``LEAST_WORDS`` words, of which not one in twenty lies inside an article, holds no content. A word's weight is the log-odds
    of lying inside, from 0.3 to 3. So is a tag's, from -1 to -0.1, and at least -0.3 for tags that articles are made of. Executors count; a row for each
    kind, block and tag of the sample comes back.
    """
    prepare(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for s in segments(page):
                    if s.tag:
                        found["tag", s.tag, s.labelled and not s.out] += 1
                    elif n := len(s.text.split()):
                        found["kind", s.kind, s.labelled] += n
                        found["word", s.block, s.labelled and not s.out] += n
        rows = [(*k, v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["part", "name", "inside", "n"])

    counted = _chosen(pages, sample, html_col, id_col).mapInArrow(count, "part string, name string, inside boolean, n long")
    own: dict[str, dict[str, list[int]]] = {"kind": {}, "word": {}, "tag": {}}
    for r in counted.groupBy("part", "name", "inside").agg(F.sum("n").alias("n")).collect():
        own[r.part].setdefault(r.name, [0, 0])[r.inside] += r.n

    def odds(part: str, name: str) -> float:
        total = [sum(n[i] for n in own[part].values()) + len(own[part]) for i in (0, 1)]
        out, inside = own[part][name]
        return log((inside + 1) / total[1]) - log((out + 1) / total[0])

    weights = Weights(frozenset(k for k, (out, inside) in own["kind"].items() if k and k.partition(".")[0] != LABELLED and out + inside >= LEAST_WORDS and 19 * inside < out))
    weights.word = {k: max(0.3, min(3.0, odds("word", k))) for k, n in own["word"].items() if sum(n) >= LEAST_WORDS}
    inside = sum(n[1] for n in own["word"].values())
    weights.word[LABELLED] = max(1.0, min(3.0, log((inside + 1) / (sum(n[0] for k, n in own["kind"].items() if k.partition(".")[0] == LABELLED) + 1))))
    weights.tag = {k: max(-0.3 if _cheap(k) else -1.0, min(-0.1, odds("tag", k))) for k in own["tag"]}
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous range with the greatest positive sum, by one scan; (0, 0) if no score is positive."""
    best, found, total, first = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, k
        total += score
        if total > best:
            best, found = total, (first, k + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region: references decoded, white space made one space, trimmed, joined by one space."""
    own = list(segments(page or "", weights.no_content))
    named = any(s.labelled and not s.out and s.text.strip() for s in own)
    words = [0.0 if s.tag else weights.of_word(s, named) for s in own]
    first, last = best_region([weights.of_tag(s) if s.tag else w * len(s.text.split()) for s, w in zip(own, words, strict=True)])
    if first == last:
        return ""
    while first and not own[first - 1].ends:
        first -= 1
    while last < len(own) and not own[last].ends:
        last += 1
    blocks: list[str] = []
    parts: list[str] = []
    for s, w in zip(own[first:last], words[first:last], strict=True):
        if w > 0:
            parts.append(html.unescape(s.text))
        elif s.ends:
            blocks.append("".join(parts))
            parts = []
    blocks.append("".join(parts))
    return " ".join(filter(None, (" ".join(b.split()) for b in blocks)))


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; weights are learned from ``pages`` if none are given.

    Null, empty and tag-only pages have an empty text; null ids and urls stay null; repeated pages each get a row; an
    empty table gives an empty result; other columns are not read.
    """
    prepare(pages.sparkSession)
    weights = weights or learn(pages, html_col=html_col, id_col=id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), "url", html_col)
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
