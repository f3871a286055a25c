"""Main text of HTML pages as a maximum-scoring subsequence.

A page is read as a sequence of words and tags.  A word scores twice its probability of being main
text less 1, a tag its probability less 1, so tags never score above 0.  The probabilities are by
weights that a logistic regression learns from labelled pages: of words by the elements, classes
and roles they stand in, by the length, the share of links and the end of their block, by the
lengths of the blocks beside it, and by whether they are in an article or main element or such an
element is elsewhere; of tags by their name and by the same surroundings.  One linear scan finds
the contiguous region with the largest sum of scores.  Inside the region a text is left out where
a third set of weights, learned from the texts inside the labelled regions by their surroundings
alone, gives a probability of a half or less, so that short lines of the main text stay and a menu or
readers' comments in its midst go; words and tags of such surroundings count 0 in the scan.

Nothing is known but by these weights, used as they are learned: menus, adverts or readers'
comments go because their surroundings score below 0, and a name like ``login-guide`` or
``legal`` on a paragraph can be outweighed.  Only elements without running text (scripts, styles,
option lists, drawings) are never read.

Elements that are never closed end where the next block begins, but for article, main, body and
html, which reach to the end; close tags are matched in one pass, so the work grows with the
page's length only.

Defined results: null or empty html gives an empty text and 0; markup that is cut off or not closed is
read as far as it goes; of regions with equal sums the longest that ends last is taken; any page
length is read whole; repeated rows are each read; columns of the frame that are named as the
results are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import tanh

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm.common import fresh, slices, table
from linkstone.llm.html_labels import labelled_pages

_TOKEN = re.compile(
    r"<!--(?P<mark>[+-]?).*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|select)\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+|[^<>]*)>"
    r"|<[/!?a-zA-Z][^<>]*(?:>|(?=<)|\Z)",
    re.S | re.I,
)
_BLOCK = frozenset("address article blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN_ENDED = frozenset("article main body html".split())
#: Elements whose class says nothing of their surroundings: inline markup and the page as a whole.
_UNNAMED = frozenset("a abbr b body code em font html i img input mark q s small strong sub sup td th tr u".split())
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s'\">]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


Weights = tuple[dict[str, float], dict[str, float], dict[str, float]]


@dataclass
class Item:
    """A text or a tag of a page."""

    text: str | None
    words: int
    breaks: bool
    space: bool
    features: tuple[str, ...]  # of its surroundings; filled for training only
    block: tuple[str, ...]  # of its block; filled for training only
    score: float  # log odds, as is the next
    inner: float
    where: str  # in an article or main element, outside of the page's, or on a page without
    at: str  # the innermost element that makes a block
    content: bool


def surroundings(name: str, rest: str) -> list[str]:
    """The features an element gives to what stands in it."""
    found = [f"in:{name}"]
    if not rest or name in _UNNAMED:
        return found
    for kind, *values in _ATTRIBUTE.findall(rest):
        value = "".join(values)
        if kind.lower() == "role":
            found.append(f"role:{value.strip().lower()}")
            continue
        for label in value.split():
            parts = _PART.findall(label)
            on = "p:" if name == "p" else ""
            if len(parts) <= 1:
                found.append(f"{on}name:{label.lower()}")
            else:
                found += [f"{on}part:{p.lower()}" for p in parts]
                found.append(f"{on}last:{parts[-1].lower()}")
    return found


def _parts(page: str) -> list[tuple]:
    """("text", text), ("mark", mark), ("open", name, rest) and ("close", name) of a page."""
    out: list[tuple] = []
    at = 0
    for found in _TOKEN.finditer(page):
        if found.start() > at:
            out.append(("text", page[at : found.start()]))
        at = found.end()
        if found["mark"]:
            out.append(("mark", found["mark"]))
        elif found["name"]:
            out.append(("close", found["name"].lower()) if found["close"] else ("open", found["name"].lower(), found["rest"]))
    if at < len(page):
        out.append(("text", page[at:]))
    return out


def _matches(parts: list[tuple]) -> tuple[dict[int, int], set[int]]:
    """The opening tag of each closing tag, and the opening tags that are never closed."""
    waiting: dict[str, list[int]] = {}
    opened: dict[int, int] = {}
    for k, part in enumerate(parts):
        if part[0] == "open" and part[1] not in _VOID and not part[2].endswith("/"):
            waiting.setdefault(part[1], []).append(k)
        elif part[0] == "close" and waiting.get(part[1]):
            opened[k] = waiting[part[1]].pop()
    return opened, {k for left in waiting.values() for k in left}


def read(page: str, weights: Weights | None = None) -> list[Item]:
    """The items of a page, scored by the weights; without them with their features."""
    parts = _parts(page)
    opened, unclosed = _matches(parts)
    named = any(p[0] == "open" and p[1] in ("article", "main") for p in parts)
    word_weight, tag_weight, inner_weight = weights or ({}, {}, {})
    train = weights is None
    items: list[Item] = []
    active: dict[str, None] = {}  # the features of all open elements, in order
    stack: list[tuple[int, list[str], float, float, float, bool]] = []  # opening tag, features it brought, scores before it, never closed
    standing: set[int] = set()
    inner_blocks = [""]
    word_score = tag_score = inner_score = 0.0
    content = False

    def pop() -> None:
        nonlocal word_score, tag_score, inner_score
        k, brought, word_score, tag_score, inner_score, _ = stack.pop()
        standing.discard(k)
        if parts[k][1] in _BLOCK:
            inner_blocks.pop()
        for f in brought:
            del active[f]

    def region() -> str:
        return "named:in" if "in:article" in active or "in:main" in active else "named:out" if named else "named:none"

    def inner(where: str) -> float:
        return inner_score + inner_weight.get("word", 0.0) + inner_weight.get(where, 0.0)

    def tag(name: str) -> None:
        where = region()
        score = tag_score + tag_weight.get("tag", 0.0) + tag_weight.get(f"tag:{name}", 0.0) + tag_weight.get(where, 0.0)
        items.append(Item(None, 0, name in _BLOCK, name == "br", ("tag", f"tag:{name}", where, *active) if train else (), (), score, inner(where), where, "", content))

    for k, part in enumerate(parts):
        if part[0] == "text":
            text = entities.unescape(part[1])
            where, at = region(), inner_blocks[-1]
            score = word_score + word_weight.get("word", 0.0) + word_weight.get(where, 0.0)
            items.append(Item(text, len(text.split()), False, False, ("word", where, *active) if train else (), (), score, inner(where), where, at, content))
            if "in:a" in active:
                items[-1].space = True  # marks the words of links until blocks are known
        elif part[0] == "mark":
            content = part[1] == "+"
        elif part[0] == "close":
            tag(part[1])
            if opened.get(k) in standing:
                while stack[-1][0] != opened[k]:
                    pop()
                pop()
        else:
            name, rest = part[1], part[2]
            if name in _BLOCK:
                while stack and stack[-1][5]:
                    pop()
            tag(name)
            if name in _VOID or rest.endswith("/"):
                continue
            brought = [f for f in dict.fromkeys(surroundings(name, rest)) if f not in active]
            stack.append((k, brought, word_score, tag_score, inner_score, k in unclosed and name not in _OPEN_ENDED))
            standing.add(k)
            if name in _BLOCK:
                inner_blocks.append(name)
            for f in brought:
                active[f] = None
                word_score += word_weight.get(f, 0.0)
                tag_score += tag_weight.get(f, 0.0)
                inner_score += inner_weight.get(f, 0.0)
    _add_blocks(items, word_weight, train)
    return items


def _add_blocks(items: list[Item], weight: dict[str, float], train: bool) -> None:
    """Adds what the texts of one block have in common: its length, its share of links, how it ends, and the lengths of its neighbours."""
    blocks, held = [], []
    for item in items:
        if item.breaks:
            blocks.append(held)
            held = []
        elif item.words:
            held.append(item)
    blocks = [b for b in [*blocks, held] if b]
    lengths = [0, *(sum(i.words for i in b) for b in blocks), 0]
    for k, texts in enumerate(blocks):
        words = lengths[k + 1]
        links = sum(i.words for i in texts if i.space)
        before, own, after = (min(n.bit_length(), 8) for n in lengths[k : k + 3])
        more = (f"length:{own}", f"before:{before}", f"after:{after}", f"links:{4 * links // words}", f"end:{texts[-1].text.rstrip()[-1] in '.!?:;…。！？'}")
        more += tuple(f"{f}:{texts[0].where}" for f in (more[0], more[3], f"at:{texts[0].at}"))
        extra = sum(weight.get(f, 0.0) for f in more)
        for item in texts:
            item.score += extra
            item.block = more if train else ()
    for item in items:
        if item.text is not None:
            item.space = False


def fit(rows: list[tuple[tuple[str, ...], float, bool]], prior: float = 1.0) -> dict[str, float]:
    """Weights of a logistic regression of (features, weight, label) rows, with a Gaussian prior; Newton's method."""
    merged: dict[tuple, list[float]] = {}
    for features, weight, label in rows:
        merged.setdefault(tuple(sorted(features)), [0.0, 0.0])[label] += weight
    names = sorted({f for features in merged for f in features})
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(merged), len(names)))
    for k, features in enumerate(merged):
        x[k, [place[f] for f in features]] = 1
    against, for_ = np.array(list(merged.values())).T
    total, w = against + for_, np.zeros(len(names))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (total * p * (1 - p))[:, None]).T @ x + prior * np.eye(len(names)), x.T @ (for_ - total * p) - prior * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, w.tolist(), strict=True))


@lru_cache(maxsize=1)
def weights() -> Weights:
    """Weights of words, of tags and of words inside a region, from the labelled pages."""
    words, tags, inner = [], [], []
    for page in labelled_pages():
        items = read(page)
        inside = [k for k, item in enumerate(items) if item.content]
        for k, item in enumerate(items):
            if item.text is None:
                tags.append((item.features, 1.0, item.content))
            elif item.words:
                words.append((item.features + item.block, float(item.words) ** 0.5, item.content))
                if inside[0] <= k <= inside[-1]:
                    inner.append((item.features, 1.0, item.content))
    return fit(words), fit(tags), fit(inner)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part with the largest positive sum; (0, 0) if no score is above 0."""
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for k, score in enumerate(scores):
        total += score
        if total < 0:
            total, start = 0.0, k + 1
        elif total >= best and total > 0:
            best, region = total, (start, k + 1)
    return region


def value(item: Item) -> float:
    """What an item counts in the scan."""
    if item.inner <= 0:
        return 0.0
    odd = tanh(item.score / 2)
    return (odd - 1) / 2 if item.text is None else odd * item.words


def _joined(items: list[Item], kept) -> str:
    """The texts that are kept, a line for each block; what is left out still parts the words beside it."""
    blocks, held = [], []
    for item in items:
        if item.breaks:
            blocks.append("".join(held))
            held = []
        elif item.text is None:
            held.append(" " if item.space else "")
        else:
            held.append(item.text if not item.words or kept(item) else " ")
    blocks.append("".join(held))
    return "\n".join(b for b in (" ".join(block.split()) for block in blocks) if b)


def main_text(page: str, learned: Weights | None = None) -> str:
    items = read(page, learned or weights())
    start, end = best_region([value(i) for i in items])
    return _joined(items[start:end], lambda item: item.inner > 0)


def labelled_text(page: str) -> str:
    """The main text of a labelled page by its marks."""
    return _joined(read(page), lambda item: item.content)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", *keep: str) -> DataFrame:
    """(id, keep..., text): the main text of each page."""
    keep = tuple(c for c in keep if c != "text")
    (raw,) = fresh(df, "html_")
    learned = weights()  # some hundred numbers, sent with the function

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, raw):
            text = pa.array([main_text(page, learned) for page in batch.column(raw).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*batch.schema.names[:-1], "text"])

    kept = df.select(id_col, *keep, F.coalesce(F.col(html_col), F.lit("")).alias(raw))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, text string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length in code points."""
    found = extract(table(spark, sf_dir, "pages"), "page_id", "html", "url")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
