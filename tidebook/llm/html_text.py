"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tags and runs of words. Words score the log-odds, learned from labelled pages, that a word in
their place is main text; tags score below 0, the more so where they stand outside of it. One linear scan finds the
contiguous region of highest sum, and the text of that region is the page's.

The evidence of a place: the elements around it, the words of their classes, ids and roles, its innermost block, links,
and the length of its block. A logistic model weighs them. Its first weights come from the labelled pages of
``labelled_pages``; pages of the corpus that mark their article by <article> or <main> then move them. The marks are
labels alone: both elements are read as plain divisions, in learning as in extracting, so neither they nor any list of
class words chooses the region. An element that holds nearly all words of a page says nothing about them and is passed
over. Fixed exclusions are what never is text (scripts, styles, head, embedded objects), form controls and what is
hidden. An element whose own evidence is against it by LEFT_OUT or more is left out, but for what elements
within it outweigh that.

Weights come from at most ``sample`` marked pages and SIGNATURES kinds of places; pages are then read one by one without
a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import small_batches
from tidebook.llm.labelled_pages import PAGES
from tidebook.sources.tables import table

SAMPLE, SIGNATURES = 500, 20_000
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noscript|template|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
NEVER = frozenset("head button select option input label datalist svg canvas object video audio".split())
#: Elements that mark the article, and those in it that aren't labelled as its text.
#: Elements whose names alone, around a block, say nothing.
PLAIN = frozenset("div p article main".split())
MARKED, PARTED = ("article", "main"), frozenset("nav aside footer form menu dialog".split())
#: Score of a word in an element that is left out, dearest and cheapest tag, bounds of a word's score.
EXCLUDED, TAG_COST, TAG, BOUND = -0.3, 0.5, 0.02, 3.0
#: Log-odds from which an element's own evidence leaves it out.
LEFT_OUT = -1.0
#: Share of a page's words from which an element is a wrapper of the page, and a mark a label.
WRAPPER, LABEL = 0.9, 0.3
#: Weight of either class in a fit, and the penalties of the first weights and of the corpus's departure from them.
CLASS, FIRST, RIDGE = 100.0, 0.01, 1.0


@dataclass
class Element:
    name: str
    own: tuple[str, ...]  # evidence of the element: its name, if that says something, and the words of its class, id and role
    above: int  # the element around it, -1 for none
    fixed: bool  # in a fixed exclusion
    inside: bool  # of the marked article
    words: int = 0
    heading: bool = False


@dataclass
class Page:
    """A page in order: ``items`` are (tag, '', inside, -1) or ('', text, inside, element) with the block's number."""

    elements: list[Element] = field(default_factory=list)
    items: list[tuple[str, str, int, int]] = field(default_factory=list)  # tag, text, element, block
    lengths: list[int] = field(default_factory=list)  # words by block


def _own(name: str, attributes: str) -> tuple[tuple[str, ...], bool, set[str]]:
    """Evidence of an element, whether it is hidden, and the names of its attributes."""
    kind = () if name in PLAIN else (f"e:{name}",)
    if not attributes or "=" not in attributes:
        return kind, bool(attributes) and re.search(r"(?<![\w-])hidden(?![\w-])", attributes) is not None, set(attributes.lower().split())
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    words = re.findall(r"[a-z]{2,}", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", " ".join(found.get(k, "") for k in ("class", "id", "role"))).lower())
    bare = re.sub(ATTRIBUTE, " ", attributes).lower().split()
    hidden = found.get("aria-hidden") == "true" or "hidden" in bare or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    return (*kind, *sorted({f"c:{w[:40]}" for w in words})), hidden, {*bare, *found}


def parse(html: str, labelled: bool = False) -> Page:
    """The page as tags and texts. ``labelled``: data-main and data-out mark the main text, else <article> and <main>.

    Markup is read as browsers do in the main: paragraphs and items end where the next begins, an end tag ends what it
    holds, unclosed elements end with what holds them.
    """
    page = Page([Element("body", (), -1, False, False)])
    elements, items, stack, block = page.elements, page.items, [0], 0
    page.lengths.append(0)
    for m in TOKEN.finditer(html or ""):
        name = m[3]
        if name is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1 or m[1]:
                continue
            text = unescape(text) if "&" in text else text
            at = stack[-1]
            if not elements[at].fixed:
                words = len(text.split())
                page.lengths[block] += words
                elements[at].words += words
            items.append(("", text, at, block))
            continue
        name = name.lower()
        if name in BLOCK or name == "br":
            block += name in BLOCK
            if len(page.lengths) <= block:
                page.lengths.append(0)
        if m[2]:
            if any(elements[i].name == name for i in stack[1:]):
                while elements[stack.pop()].name != name:
                    pass
            items.append(("/" + name, "", stack[-1], block))
            continue
        if name in BLOCK:  # a block ends an open paragraph; items end their like
            for k in range(len(stack) - 1, 0, -1):
                open_ = elements[stack[k]].name
                if open_ == "p" or name in ("li", "td", "th", "tr", "dt", "dd", "option") and open_ == name:
                    del stack[k:]
                    break
                if open_ in BLOCK:
                    break
        above = elements[stack[-1]]
        own, hidden, names = _own(name, m[4])
        if labelled:
            inside = "data-main" in names or above.inside and "data-out" not in names
        else:
            inside = name in MARKED or above.inside and name not in PARTED
        items.append((name, "", stack[-1], block))
        if name == "h1":
            elements[stack[-1]].heading = True
        if name not in VOID and not m[4].endswith("/") and name not in ("html", "body"):
            elements.append(Element(name, own, stack[-1], above.fixed or hidden or name in NEVER, inside, 0, name == "h1"))
            stack.append(len(elements) - 1)
    for i in range(len(elements) - 1, 0, -1):
        e = elements[i]
        up = elements[e.above]
        up.words += e.words
        up.heading = up.heading or e.heading
    return page


def evidence(page: Page) -> tuple[list[tuple[str, ...] | None], list[tuple[tuple[str, ...], ...]]]:
    """Of each element, what its texts have for evidence (None in a fixed exclusion), and the own evidence of all blocks
    around them from the outside. Wrappers have none: they hold nearly all words, and the heading where there is one."""
    whole, found, chains = page.elements[0], [], []
    for i, e in enumerate(page.elements):
        if i == 0:
            found.append(("i:body",))
            chains.append(())
            continue
        above, chain = found[e.above], chains[e.above]
        if e.fixed or above is None:
            found.append(None)
            chains.append(())
            continue
        if e.name == "a":
            above = (*above, "a:link") if "a:link" not in above else above
        elif e.name in BLOCK:
            wraps = e.words >= WRAPPER * whole.words and (e.heading or not whole.heading) and e.name not in ("p", "li")
            own = () if wraps else e.own
            above = (*[x for x in above if x[:2] != "i:"], "i:" + ("div" if e.name in MARKED else e.name), *[x for x in own if x not in above])
            chain = (*chain, own) if own else chain
        found.append(above)
        chains.append(chain)
    return found, chains


def _length(words: int) -> str:
    return f"n:{min(6, words.bit_length())}"


def counted(html: str, labelled: bool = False) -> dict[str, tuple[int, int]]:
    """Words (inside, outside) by kind of place, 'w' and its evidence, and tags by name, 't' and the name.

    Nothing of a page that marks less than LABEL of its words: such a mark is a card's or a teaser's.
    """
    page, out = parse(html, labelled), {}
    found, _ = evidence(page)
    if not labelled and sum(len(t.split()) for _, t, at, _ in page.items if t and page.elements[at].inside) < LABEL * page.elements[0].words:
        return {}
    for tag, text, at, block in page.items:
        inside = page.elements[at].inside
        if tag:
            key, n = f"t\x1f{tag.lstrip('/')}", 1
        elif found[at] is None or not (n := len(text.split())):
            continue
        else:
            key = "\x1f".join(["w", *sorted(found[at]), _length(page.lengths[block])])
        x = out.setdefault(key, [0, 0])
        x[not inside] += n
    return {k: (a, b) for k, (a, b) in out.items()}


@dataclass
class Weights:
    bias: float
    evidence: dict[str, float]
    tags: dict[str, float]

    def word(self, place: tuple[str, ...], chain: tuple[tuple[str, ...], ...], length: str) -> float:
        if self.left_out(chain):
            return EXCLUDED
        return max(-BOUND, min(BOUND, self.bias + sum(self.evidence.get(x, 0.0) for x in (*place, length))))

    def left_out(self, chain: tuple[tuple[str, ...], ...]) -> bool:
        """Whether an element's evidence is against it, and nothing within it, down to the text, outweighs that: a title
        or an element with a class, id or role, for paragraphs and lists are in all kinds of places."""
        most = 0.0
        for own in reversed(chain):
            value = sum(self.evidence.get(x, 0.0) for x in own)
            if value <= LEFT_OUT and most < -value:
                return True
            if own == ("e:h1",) or any(x[0] == "c" for x in own):
                most = max(most, value)
        return False

    def tag(self, name: str) -> float:
        return self.tags.get(name.lstrip("/"), -TAG - TAG_COST / 2)


def fitted(counts: dict[str, tuple[int, int]], start: Weights | None = None, ridge: float = RIDGE, steps: int = 2000) -> Weights:
    """Weights by penalised likelihood, both classes weighing alike; the penalty pulls towards ``start`` or 0."""
    rows = sorted((k.split("\x1f")[1:], v) for k, v in counts.items() if k[0] == "w")
    names = sorted({x for r, _ in rows for x in r} | set(start.evidence if start else ()))
    at = {x: i + 1 for i, x in enumerate(names)}  # 0: the bias
    mean = np.array([start.bias if start else 0.0, *((start.evidence.get(x, 0.0) if start else 0.0) for x in names)])
    w = mean.copy()
    if rows:
        size = np.array([len(r) + 1 for r, _ in rows])
        owner = np.repeat(np.arange(len(rows)), size)
        column = np.concatenate([[0, *(at[x] for x in r)] for r, _ in rows])
        n = np.sqrt(np.array([v for _, v in rows], np.float64))  # long texts are many words of one kind
        n *= CLASS / np.maximum(n.sum(0), CLASS)  # few pages weigh less
        step = 1 / (ridge + 0.25 * np.bincount(column, (n.sum(1) * size)[owner], len(w)))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[column], len(rows)), -35, 35)))
            slope = n.sum(1) * p - n[:, 0]
            w -= step * (np.bincount(column, slope[owner], len(w)) + ridge * (w - mean))
    tags: dict[str, float] = dict(start.tags) if start else {}
    for k, (x, y) in counts.items():
        if k[0] == "t":
            name, before = k[2:], (-tags.get(k[2:], -TAG - TAG_COST / 2) - TAG) / TAG_COST
            total, strength = x + y, 50.0
            tags[name] = -TAG - TAG_COST * (before * strength + y * min(1.0, 50.0 / total)) / (strength + min(50.0, total))
    return Weights(float(w[0]), dict(zip(names, w[1:].tolist(), strict=True)), tags)


def first_weights() -> Weights:
    """Weights of the labelled pages alone."""
    counts: dict[str, list[int]] = {}
    for page in PAGES:
        for k, (a, b) in counted(re.sub(r"\{(\d+)\}", lambda m: "w " * int(m[1]), page), labelled=True).items():
            x = counts.setdefault(k, [0, 0])
            x[0], x[1] = x[0] + a, x[1] + b
    return fitted({k: (a, b) for k, (a, b) in counts.items()}, ridge=FIRST)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of highest sum, the first such; (0, 0) where no sum is above 0."""
    best, start, end, total, begin = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, start, end = total, begin, i + 1
    return start, end


def main_text(html: str, known: Weights, scan: bool = True) -> str:
    """The text of the best region, block by block. Without ``scan`` the region is the whole page, to show what it does."""
    page = parse(html)
    found, chains = evidence(page)
    out = [found[i] is None or known.left_out(chains[i]) for i in range(len(found))]
    memo: dict[tuple[int, int], float] = {}
    scores = []
    for tag, text, at, block in page.items:
        if tag:
            scores.append(known.tag(tag))
        elif found[at] is None or not (words := len(text.split())):
            scores.append(0.0)
        else:
            key = (at, page.lengths[block])
            if (s := memo.get(key)) is None:
                s = memo[key] = known.word(found[at], chains[at], _length(page.lengths[block]))
            scores.append(s * words)
    start, end = best_region(scores) if scan else (0, len(scores))
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if block := " ".join("".join(parts).split()):
            blocks.append(block)
        parts.clear()

    for tag, text, at, _ in page.items[start:end]:
        if tag:
            name = tag.lstrip("/")
            if name in BLOCK:
                flush()
            elif name == "br":
                parts.append(" ")
        elif not out[at]:
            parts.append(text)
    flush()
    return "\n\n".join(blocks)


def train(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights of the labelled pages, moved by at most ``sample`` pages that mark their article."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]") & F.col("page_id").isNotNull())
    picked = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = marked.join(F.broadcast(picked), "page_id").select("page_id", "html").dropDuplicates(["page_id", "html"]).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for html in batch.column(0).to_pylist():
                for k, (a, b) in counted(html or "").items():
                    x = counts.setdefault(k, [0, 0])
                    x[0], x[1] = x[0] + a, x[1] + b
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array(x, pa.int64()) for x in zip(*counts.values(), strict=True))], ["k", "a", "b"])

    found = rows.mapInArrow(run, "k string, a long, b long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = found.orderBy(F.desc(F.col("a") + F.col("b")), "k").limit(SIGNATURES)
    return fitted({r["k"]: (r["a"], r["b"]) for r in found.collect()}, first_weights())


def extract(spark: SparkSession, pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html, any others).

    text: the blocks of the best region, white space in a block as one space, blocks joined by two line feeds; empty
    where there is none, as for null, empty and wordless pages. Of regions with equal sums the first counts. Broken
    markup is read as browsers do in the main. Long pages are read whole, repeated rows each for itself, null ids
    allowed. Without any marked page the labelled pages of this package alone decide. An empty table gives no rows.
    """
    small_batches(spark)
    sent = spark.sparkContext.broadcast(train(pages, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h or "", sent.value) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"))
