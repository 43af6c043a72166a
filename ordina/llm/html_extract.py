"""HTML extraction: the maximum-scoring run of words and tags, with weights learned from labelled pages."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled pages that weights are fitted on at most, those with the smallest hashes of their contents.
FIT_PAGES = 1000
#: A word's score; tags score at most LEAST, so that short blocks at the edge of the text stay.
WORD = 1.0
LEAST = -0.02
SCALE = 2.0
#: Times that each kind of tag counts as seen on both sides, so that few labelled pages say little.
PSEUDO = 5
#: Score of a tag that has no weight.
UNKNOWN = -0.1
#: An element is far from the text when its words' odds of standing in the text are below the average by this log.
FAR = -2.0
#: Weights where no labelled page has the tag.
PRIOR = {"a": -1.5, "/a": -1.5, "option": -3.0, "img": -0.5, "button": -3.0}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math|object|select|title)\b(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*>.*?(?:</\1\s*>|\Z)"
    # A head whose end tag is left out is only its start tag here; what stands in it has tokens of its own.
    r"|<head\b(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*>(?:(?:(?!<body\b).)*?</head\s*>)?"
    r"|<[!?][^>]*>|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*)>|</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_UNSEEN = re.compile(r"aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr td th ul".split())
#: Elements that are holes in the text wherever they stand: a contiguous run cannot leave out what is within it.
APART = frozenset("nav footer aside form button dialog menu input label".split())
#: Words in a class, id or role that mark an element as a hole.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar sidebar side aside footer header masthead topbar "
    "toolbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist reply replies disqus discussion "
    "respond share sharing social follow subscribe subscription newsletter signup login related recommended recommendations trending popular widget pagination pager tags tagcloud "
    "legal copyright disclaimer search skip complementary contentinfo".split()
)


#: Of those, the ones that count for an article element itself.
OF_ARTICLES = MARKS & frozenset("ad ads advert advertisement comment comments promo promotion related reply replies sponsored teaser".split())


def _names(attributes: str) -> list[list[str]]:
    """The words of each class, id and role."""
    out = []
    for found in _NAMES.finditer(attributes):
        names = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", found[1] or found[2] or found[3] or "").lower()
        out.append([x for x in re.split(r"[^a-z0-9]+", re.sub(r"\b(?:with|has|no|without)-[a-z]+", "", names)) if x])
    return out


def _apart(tag: str, attributes: str, names: list[list[str]], in_text: bool) -> bool:
    if tag in APART or tag == "header" and not in_text:
        return True
    if tag in ("body", "html", "main") or not attributes:
        return False
    if _UNSEEN.search(attributes) or _HIDDEN.search(_QUOTED.sub("", attributes)):
        return True
    marks = OF_ARTICLES if tag == "article" else MARKS - {"header"} if in_text else MARKS
    return any(not marks.isdisjoint(x) for x in names)


#: Open elements, the outermost first: name, whether it is a hole, kinds.
Open = list[tuple[str, bool, tuple[str, ...]]]


def tokens(page: str) -> Iterator[tuple[str, tuple[str, ...], str, bool, Open]]:
    """(tag, kinds, text, hole, open elements) in page order; text has no tag, end tags are as "/p".

    An element's kinds are its name with each word of its class, id and role, as "div.ad", or its name alone where it
    has none of these; an end tag has the kinds of its start tag, as "/div.ad".
    """
    stack: Open = []
    apart = inside = 0
    at = 0

    def pop(upto: int) -> None:
        nonlocal apart, inside
        while len(stack) > upto:
            name, off, _ = stack.pop()
            apart -= off
            inside -= name in ("article", "main")

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "", (), page[at : m.start()], apart > 0, stack
        at = m.end()
        name = (m[2] or m[4] or "").lower()
        if not name:
            continue
        if page[m.start() + 1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    off, kinds = apart > 0, stack[i][2]
                    pop(i)
                    yield "/" + name, tuple("/" + k for k in kinds), "", off, stack
                    break
            continue
        attributes = m[3] or m[5] or ""
        if name == "p" and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        names = _names(attributes) if "=" in attributes else []
        off = _apart(name, attributes, names, inside > 0)
        if name in ("article", "main") and not off and apart:
            pop(0)  # an element before it was never closed
        kinds = tuple(f"{name}.{x}" for words in names for x in words) or (name,)
        hole = apart > 0 or off
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, off, kinds))
            apart += off
            inside += name in ("article", "main")
        yield name, kinds, "", hole, stack
    if at < len(page):
        yield "", (), page[at:], apart > 0, stack


def _is_far(stack: Open, far: frozenset[str]) -> bool:
    return bool(far) and any(not far.isdisjoint(e[2]) for e in stack)


def counts(page: str, far: frozenset[str], tags: bool) -> tuple[Counter, Counter]:
    """Counts inside and outside of the article element, a labelled page's own mark: words by the kinds of the elements
    that they stand in, from the outermost one to the first of the ``far``; or with ``tags``, kinds of tags that are
    not within a far element. All words are counted as ""."""
    inside, outside, depth = Counter(), Counter(), 0
    for tag, kinds, text, _, stack in tokens(page):
        depth += tag == "article"
        into = inside if depth else outside
        if not tag:
            n = len(text.split())
            into[""] += n
            for _, _, own in stack if n and not tags else ():
                for k in set(own):
                    into[k] += n
                if not far.isdisjoint(own):
                    break
        elif tags and not _is_far(stack if tag[0] == "/" else stack[:-1], far):
            into.update(kinds)
        depth = max(0, depth - (tag == "/article"))
    return inside, outside


def far_kinds(inside: Mapping[str, int], outside: Mapping[str, int]) -> frozenset[str]:
    """Kinds of elements whose words stand outside of the text far more often than words do on average."""
    odds = lambda k: math.log((inside.get(k, 0) + 1) / (outside.get(k, 0) + 1))
    return frozenset(k for k in outside if k and odds(k) - odds("") < FAR)


def weigh(inside: Mapping[str, int], outside: Mapping[str, int]) -> dict[str, float]:
    """Score of each kind of tag: its log odds of standing in the text, against those of a word, at most LEAST."""
    kinds = {k for k in (*inside, *outside) if k}
    a, b, n = sum(inside.values()), sum(outside.values()), len(kinds) + 1
    odds = lambda k: math.log((inside.get(k, 0) + PSEUDO) / (a + PSEUDO * n)) - math.log((outside.get(k, 0) + PSEUDO) / (b + PSEUDO * n))
    return PRIOR | {k: min(LEAST, SCALE * (odds(k) - odds(""))) if inside.get(k, 0) < outside.get(k, 0) else LEAST for k in kinds}


def _sum(pages: Iterable[str], far: frozenset[str], tags: bool) -> tuple[Counter, Counter]:
    inside, outside = Counter(), Counter()
    for page in pages:
        a, b = counts(page, far, tags)
        inside.update(a)
        outside.update(b)
    return inside, outside


@dataclass(frozen=True)
class Weights:
    """Scores of tags by kind, and the kinds of elements whose words score -WORD."""

    tags: Mapping[str, float] = field(default_factory=dict)
    far: frozenset[str] = frozenset()


def _fitted(counted: Callable[[frozenset[str], bool], tuple[Mapping[str, int], Mapping[str, int]]]) -> Weights:
    """Weights in three passes over the labelled pages: far elements, the outermost of them alone, and tags."""
    far = far_kinds(*counted(frozenset(), False))
    far = far_kinds(*counted(far, False)) & far
    return Weights(weigh(*counted(far, True)), far)


def fit(pages: Sequence[str]) -> Weights:
    """Weights from labelled pages."""
    return _fitted(lambda far, tags: _sum(pages, far, tags))


def best_run(scores: Sequence[tuple[float, float]]) -> tuple[int, int]:
    """(first, end) of the run of blocks with the highest sum, by one scan; (0, 0) if none is above zero.

    A block has the score of the tags before it, which counts where the run has begun before, and its own. Of equal
    sums, the run that ends first counts, and of those the shortest.
    """
    best, top, first, run = (0, 0), 0.0, 0, 0.0
    for i, (before, score) in enumerate(scores):
        run += before
        if run <= 0:
            first, run = i, 0.0
        run += score
        if run > top:
            best, top = (first, i + 1), run
    return best


def extract(page: str | None, weights: Weights, holes: bool = True) -> str:
    """The main text: blocks of the best run, joined by an empty line.

    Every word and tag of the page is scored: words WORD, or -WORD within a far element; tags by the least weight among
    their kinds, or UNKNOWN within a far element. ``holes``: words within elements that cannot be text (see APART and
    MARKS) score nothing, and are left out of the run that has been chosen.
    """
    blocks: list[tuple[float, float, str]] = []  # score of tags before, score of words and tags in it, text
    words: list[str] = []
    before = inner = 0.0

    def close() -> None:
        nonlocal before, inner, distant
        if done := " ".join(html.unescape("".join(words)).split()):
            blocks.append((before, inner + WORD * (len(done.split()) - 2 * distant), done))
            before = inner = 0.0
        words.clear()
        distant = 0

    known, far, distant = weights.tags.get, weights.far, 0
    for tag, kinds, text, apart, stack in tokens(page or ""):
        apart = apart and holes
        if not tag:
            words.append(" " if apart else text)
            if not apart and _is_far(stack, far):
                distant += len(text.split())
            continue
        name = tag.lstrip("/")
        if name in BLOCKS:
            close()
        elif name in ("br", "img", "wbr", "input") or apart:
            words.append(" ")
        if _is_far(stack if tag[0] == "/" else stack[:-1], far):
            score = UNKNOWN
        else:
            score = min((w for k in kinds if (w := known(k)) is not None), default=known(tag, UNKNOWN))
        # An inline tag is its block's own, but one within a hole says nothing about the block around it.
        before, inner = (before + score, inner) if name in BLOCKS or apart else (before, inner + score)
    close()
    first, end = best_run([b[:2] for b in blocks])
    return "\n\n".join(b[2] for b in blocks[first:end])


def _counted(far: frozenset[str], tags: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, outside = _sum((p.as_py() for p in batch.column(0)), far, tags)
            kinds = list(inside | outside)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "inside", "outside"])

    return run


def learn(df: DataFrame, html_col: str = "html", pages: int = FIT_PAGES) -> Weights:
    """Weights from at most ``pages`` pages that mark their own text by an article element.

    The sample is those with the smallest hashes of their contents, of any length, copies once; it does not depend on
    ids or order. Executors count words and tags, in one pass over the sample each; only counts come to the driver, of
    kinds that are met more than once.
    """
    page = F.col(html_col).cast("string")
    marked = df.filter(page.contains("<article") & page.contains("</article>")).select(page.alias("html"), F.xxhash64(page).alias("h"))
    chosen = F.broadcast(marked.select("h").distinct().orderBy("h").limit(pages))
    sample = common.stage(marked.join(chosen, "h", "left_semi").dropDuplicates(["h"]).select("html"), "html-sample")

    def counted(far: frozenset[str], tags: bool) -> tuple[dict[str, int], dict[str, int]]:
        found = sample.mapInArrow(_counted(far, tags), "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        rows = found.filter("inside + outside > 1").collect()
        return {r.kind: r.inside for r in rows if r.inside}, {r.kind: r.outside for r in rows if r.outside}

    return _fitted(counted)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Words and tags score their weights, fitted on at most FIT_PAGES labelled pages where not given; a linear
    scan over the whole page finds the best contiguous run of blocks. What a run cannot leave out by itself, such as
    an advert, a form or a reader's comments within the text, is cut out of it as a hole.

    * null or empty html, and a page without text, give an empty text; broken markup never fails: an end tag
      that nothing opened is ignored, elements left open end with their parent;
    * repeated rows and null ids are carried through; an empty table gives an empty result; the whole page is
      read, whatever its length; other columns are not read.
    """
    known = learn(df, html_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), known) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
