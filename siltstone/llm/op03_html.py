"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. A word scores by the block of text that it is in: positive where labelled pages have
main text, negative where they don't. Tags score negative, the more the rarer they are in main text. One linear scan finds
the contiguous region with the largest sum; blocks within it that are no main text themselves are left out.

All weights are learned from labelled pages: logistic regression over what is known of a block (the elements around it and
their names, how long it is, how much of it is links, how it ends, what stands beside it). No name decides by itself, and
elements that hold most of a page, whatever they are called, are told from small ones.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import labelled_pages
from siltstone.llm.textkit import chunks, tidy

_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"""["'>]""")
_WORD = re.compile(r"[^\W\d_]+|\S")

_BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text to read.
_RAW = frozenset("script style noscript template textarea iframe object svg math canvas select title".split())
_ENDS_P = _BLOCKS - frozenset("button body html head".split())
_ITEMS = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
_SCOPES = frozenset("ul ol dl menu table div section article main body td th form".split())
#: Elements that say what the text in them is for.
_PLACES = frozenset("article main section aside nav header footer form dialog figure table".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(slots=True)
class Element:
    """An open element: names are its tag and parts of its class, id and role."""

    tag: str
    parent: int
    names: tuple[str, ...]
    words: int = 0
    paragraphs: int = 0
    heads: bool = False


@dataclass(slots=True)
class Block:
    """A run of text that no block tag cuts: where it begins, and how many of its words are in links."""

    tag: str
    element: int
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    text: str = ""
    under: tuple[str, ...] = ()


@dataclass
class Parsed:
    """Elements, blocks, and the sequence: tags as strings, words as (block, number)."""

    elements: list[Element]
    blocks: list[Block]
    sequence: list


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """Pieces of a page in order, in one pass over it: ("", "", text), or ("" or "/", tag, attributes). Comments,
    declarations and elements without text to read are left out; what isn't closed by the end is lost, as in browsers."""
    n, at, last = len(page), 0, page.rfind(">")
    unquoted: set[str] = set()  # quotes of which none follows
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "", "", page[at:]
            return
        following = page[lt + 1 : lt + 2]
        slash = following == "/"
        name = _TAG.match(page, lt + 1 + slash)
        if not name and following not in ("!", "?", "/"):  # not a tag: text that goes on
            yield "", "", page[at : lt + 1]
            at = lt + 1
            continue
        if lt > at:
            yield "", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if lt > last:
            return
        if not name:
            at = page.find(">", lt) + 1
            continue
        i = name.end()
        while True:
            stop = _STOP.search(page, i)
            if stop is None:
                return
            c, i = stop[0], stop.end()
            if c == ">":
                break
            if c not in unquoted and page[name.end() : i - 1].rstrip()[-1:] == "=":
                end = page.find(c, i)
                if end < 0:
                    unquoted.add(c)
                else:
                    i = end + 1
        tag, attributes = name[0].lower(), page[name.end() : i - 1]
        at = i
        if tag in _RAW and not slash and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}(?![a-z0-9:-])", re.I).search(page, at)
            if end is None:
                return
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        yield "/" * slash, tag, attributes


def parse(page: str) -> Parsed:
    """Elements, blocks and the sequence of a page. Markup that isn't closed or nested well is repaired."""
    elements = [Element("", -1, ())]
    stack = [0]
    blocks: list[Block] = []
    sequence: list = []
    block: Block | None = None
    linked = 0
    heading: tuple[str, ...] = ()

    def close(depth: int) -> None:
        nonlocal linked
        for e in stack[depth:]:
            linked -= elements[e].tag == "a"
        del stack[depth:]

    def nearest(wanted: frozenset[str] | set[str], limit: frozenset[str]) -> int:
        for d in range(len(stack) - 1, 0, -1):
            tag = elements[stack[d]].tag
            if tag in wanted:
                return d
            if tag in limit:
                return 0
        return 0

    for slash, tag, attributes in tags(page):
        if not tag:
            text = references.unescape(attributes) if "&" in attributes else attributes
            words = len(text.split())
            if block is None:
                if not words:
                    continue
                block = Block(next((elements[e].tag for e in reversed(stack) if elements[e].tag in _BLOCKS), ""), stack[-1], under=heading)
                blocks.append(block)
            block.parts.append(text)
            if words:
                if not block.words:
                    block.element = stack[-1]
                block.words += words
                block.linked += words * (linked > 0)
                sequence.append((len(blocks) - 1, words))
                for e in stack:
                    elements[e].words += words
            continue
        sequence.append(slash + tag)
        if tag in _BLOCKS:
            if slash and tag in _HEADINGS and block is not None:
                heading = tuple(_WORD.findall("".join(block.parts).lower())[:4]) if tag != "h1" else ()
            block = None
        if slash:
            depth = nearest({tag}, frozenset() if tag in _BLOCKS else _BLOCKS)
            if depth:
                close(depth)
            continue
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P and (depth := nearest({"p"}, _SCOPES)):
            close(depth)
        if tag in _ITEMS and (depth := nearest(_ITEMS[tag], _SCOPES - _ITEMS[tag])):
            close(depth)
        if tag == "a" and (depth := nearest({"a"}, _BLOCKS)):
            close(depth)
        if tag in _HEADINGS or tag in ("article", "main", "p"):
            for e in stack:
                elements[e].paragraphs += tag == "p"
                elements[e].heads |= tag in ("h1", "article", "main")
        if attributes.endswith("/") and tag not in _BLOCKS:
            continue
        elements.append(Element(tag, stack[-1], (tag, *_named(attributes))))
        stack.append(len(elements) - 1)
        linked += tag == "a"
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return Parsed(elements, blocks, sequence)


@lru_cache(4096)
def _named(attributes: str) -> tuple[str, ...]:
    """Parts of class, id, role and label, in lower case, each once."""
    if len(attributes) > 2000:
        attributes = attributes[:0]  # no name is so long; data in attributes is
    values = " ".join(m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attributes))
    return tuple(dict.fromkeys("." + p.lower() for p in _PART.findall(values)))


def _size(n: int) -> int:
    return min(6, n.bit_length())


def _kind(b: Block) -> str:
    """How long a block is, how much of it is links, and whether it ends as a sentence does."""
    share = b.linked / b.words if b.words else 0
    links = 0 if not b.linked else 1 if share < 0.4 else 2 if share < 0.95 else 3
    return f"{_size(b.words)}{links}{'.' if b.text[-1:] in _ENDS else ''}"


_ENDS = frozenset(".!?:;…\"”»’)")


def around(parsed: Parsed) -> list[list[str]]:
    """For every element what it says of the text in it, by its names and whether it frames most of the page."""
    total = parsed.elements[0].words
    out = []
    for e in parsed.elements:
        frames = 2 * e.words > total and (e.heads or e.paragraphs > 1)
        out.append([f"{'frame' if frames else 'in'} {n}" for n in e.names])
    return out


def features(parsed: Parsed) -> list[list[str]]:
    """What is known of every block but the elements around it."""
    kinds = [_kind(b) for b in parsed.blocks]
    out = []
    for i, (b, k) in enumerate(zip(parsed.blocks, kinds)):
        before, after = (kinds[j] if 0 <= j < len(kinds) else "none" for j in (i - 1, i + 1))
        e = b.element
        while e and parsed.elements[e].tag not in _PLACES:
            e = parsed.elements[e].parent
        place = parsed.elements[e].tag
        f = ["any", f"own {b.tag}", f"own {b.tag} at {place}", f"kind {k[1:]} at {place}", f"kind {k}", f"own {b.tag} {k[1:]}", f"size {k[0]}", f"links {k[1]}", f"before {before}", f"after {after}", f"under {' '.join(b.under) or 'none'}"]
        f += [f"under {w}" for w in b.under]
        if b.words <= 12:
            f += [f"word {w}" for w in set(_WORD.findall(b.text[:200].lower()))]
        out.append(f)
    return out


@dataclass
class Weights:
    """Log-odds by feature of being main text (``keep``) and of standing between its ends (``span``), and of tags; how much
    tags count, and the least score of a word."""

    keep: dict[str, float]
    span: dict[str, float]
    tags: dict[str, float]
    share: float = 1.0
    least: float = -1.0


#: A word's score and a tag's log-odds are at most the first, either way; a tag's are at most the second, always negative.
WORD_MOST, TAG_LEAST = 3.0, -0.05
#: Among these the labelled pages choose how much tags count, and the least score of a word.
SHARES, LEASTS = (1.0, 0.5, 0.25, 0.1), (-1.0, -3.0, -0.3)


def _fit(rows: list[list[str]], labels: np.ndarray, names: dict[str, int], ridge: float = 0.5, rounds: int = 500) -> dict[str, float]:
    """Ridge logistic regression over counts of features, by gradient descent with momentum."""
    at = [[names[f] for f in row if f in names] for row in rows]
    of = np.repeat(np.arange(len(rows)), [len(x) for x in at])
    column = np.concatenate([np.array(x, np.int64) for x in at])
    w = now = np.zeros(len(names))
    most = np.bincount(of, minlength=len(rows)).max()
    curve = np.bincount(column, minlength=len(names)) * (most / 4) + ridge  # bounds the curvature, feature by feature
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(of, now[column], len(rows))))
        after = now - (np.bincount(column, (p - labels)[of], len(names)) + ridge * now) / curve
        now, w = after + k / (k + 3) * (after - w), after
    return {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}


def label(parsed: Parsed, main: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks are main text, matched in order, and which stand between the first and last of them."""
    keep = np.zeros(len(parsed.blocks), bool)
    at = 0
    for i, b in enumerate(parsed.blocks):
        if at < len(main) and b.text == " ".join(main[at].split()):
            keep[i], at = True, at + 1
    span = np.zeros(len(keep), bool)
    if keep.any():
        first, last = np.flatnonzero(keep)[[0, -1]]
        span[first : last + 1] = True
    return keep, span


def learn(pages: Iterable[tuple[str, list[str]]]) -> Weights:
    """Weights from labelled pages (html, blocks of main text in order)."""
    rows, keeps, spans, held = [], [], [], []
    tag_in, tag_out = Counter(), Counter()
    for page, main in pages:
        parsed = parse(page)
        held.append(parsed)
        of = around(parsed)
        keep, span = label(parsed, main)
        for b, f in zip(parsed.blocks, features(parsed)):
            e = b.element
            while e >= 0:
                f = f + of[e]
                e = parsed.elements[e].parent
            rows.append(f)
        keeps.append(keep)
        spans.append(span)
        inside = [i for i, t in enumerate(parsed.sequence) if not isinstance(t, str) and span[t[0]]]
        first, last = (inside[0], inside[-1]) if inside else (0, -1)
        for i, t in enumerate(parsed.sequence):
            if isinstance(t, str):
                (tag_in if first <= i <= last else tag_out)[t] += 1
    count = Counter(f for row in rows for f in set(row))
    names = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 5))}
    keep, span = (_fit(rows, np.concatenate(x).astype(float), names) for x in (keeps, spans))
    odds = lambda a, b: max(-WORD_MOST, min(TAG_LEAST, math.log((a + 0.5) / (b + 0.5))))
    found = Weights(keep, span, {t: odds(tag_in[t], tag_out[t]) for t in {*tag_in, *tag_out}})
    tried = [(parsed, *scores(parsed, found), wanted) for parsed, wanted in zip(held, keeps)]

    def wrong(choice: tuple[float, float]) -> int:
        found.share, found.least = choice
        return sum(np.count_nonzero(chosen(parsed, k, s, found) != wanted) for parsed, k, s, wanted in tried)

    found.share, found.least = min(((a, b) for a in SHARES for b in LEASTS), key=wrong)
    return found


@lru_cache(4)
def learned(count: int = 1200, seed: int = 1) -> Weights:
    """Weights from so many pages of :mod:`labelled_pages`."""
    return learn(labelled_pages.pages(count, seed))


def scores(parsed: Parsed, weights: Weights) -> tuple[list[float], list[float]]:
    """Log-odds of every block: of being main text, and of standing between its ends."""
    sums: list[tuple[float, float]] = []
    for e, names in zip(parsed.elements, around(parsed)):
        up = sums[e.parent] if e.parent >= 0 else (0.0, 0.0)
        sums.append((up[0] + sum(weights.keep.get(n, 0.0) for n in names), up[1] + sum(weights.span.get(n, 0.0) for n in names)))
    keep, span = [], []
    for b, f in zip(parsed.blocks, features(parsed)):
        k, s = sums[b.element]
        keep.append(k + sum(weights.keep.get(x, 0.0) for x in f))
        span.append(s + sum(weights.span.get(x, 0.0) for x in f))
    return keep, span


def region(values: Iterable[float]) -> tuple[int, int]:
    """The half-open range of values with the largest sum, the first of equals; (0, 0) if none is positive."""
    best, best_at, now, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if now <= 0:
            now, start = 0.0, i
        now += v
        if now > best:
            best, best_at = now, (start, i + 1)
    return best_at


def chosen(parsed: Parsed, keep: list[float], span: list[float], weights: Weights) -> np.ndarray:
    """Which blocks are main text: those in the best region that are so by themselves."""
    worth = [max(weights.least, min(WORD_MOST, max(k, s))) for k, s in zip(keep, span)]  # main text stands between its ends
    tag = {t: w * weights.share for t, w in weights.tags.items()}
    a, b = region(tag.get(t, TAG_LEAST * weights.share) if isinstance(t, str) else t[1] * worth[t[0]] for t in parsed.sequence)
    out = np.zeros(len(parsed.blocks), bool)
    for t in parsed.sequence[a:b]:
        if not isinstance(t, str):
            out[t[0]] = keep[t[0]] > 0
    return out


def main_text(page: str, weights: Weights) -> str:
    """Blocks of main text in page order, joined by two line ends; empty if there are none."""
    parsed = parse(page)
    take = chosen(parsed, *scores(parsed, weights), weights)
    return "\n\n".join(b.text for b, yes in zip(parsed.blocks, take) if yes and b.text)


def _extract(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, pages in chunks(batch, "html"):
                out = [main_text(p.decode("utf-8", "replace"), weights) for p in pages]
                keys = [batch.column(c).slice(a, b - a) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return tidy(run)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """A row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    Null or empty html, or a page without main text: empty text. Equal html gives equal text, repeated rows stay rows of
    their own, other columns are not read, and a page takes time in proportion to its length. No rows: no rows."""
    x = pages.select("page_id", "url", F.col("html"))
    return x.mapInArrow(_extract(weights or learned()), "page_id bigint, url string, text string, n_chars bigint")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_html": op3_html}
