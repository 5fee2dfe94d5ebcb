"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

Words score positive and tags negative. The weights come from labelled pages, those that name their content by an
`article` or `main` element: for each tag, and for words by the block element around them, the log of how often it is
inside against outside the content. One linear scan finds the run with the greatest sum. A run inside an `article` or
`main` element is widened to that element, as its edges are exact where a sum of weights is not; of several, to the one
whose words score most in the run.

Menus, notices, adverts, forms, comments and the like are told by element names, roles, ids and whole class names (fixed
list below); they are left out, and so are scripts, styles and markup comments. Outside the content, an element that
holds an `article` or `main` element is not left out, unless it is marked as comments. What is left is up to the weights.

Weights are counted over all pages in one pass and cut to the MAX_KEYS most frequent keys before they are broadcast;
words of other keys score NEW_WORD each, other tags NEW_TAG. Each page is then worked on by itself, without a shuffle.

Text: character references are decoded; white space inside a block is one space; blocks are joined by one newline; a
line break inside a block is a space. The scan takes time in proportion to the page, whatever its tags and quotes: a tag
ends at the next > outside quotes, or at the next > at all; a < that no > follows is text. Formulas and fallback text of
objects are text; drawings, templates and selections are left out with all they hold. Defined results: a null or empty page, or one without words outside what is left
out, gives an empty text. Repeated rows and further columns change nothing.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import with_python_columns

MAX_KEYS = 1000

# Elements of HTML by their role, and classes, ids and roles that mark what is not main text.
CONTENT = frozenset("article main".split())
RAW_TEXT = frozenset("script style noscript textarea iframe".split())  # no tags inside, only their own end
GONE = frozenset("svg template select".split())  # left out with all tags in them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span "
    "strike strong sub sup time tt u var wbr object math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup".split())
LEFT_OUT = frozenset("head nav aside footer form button dialog menu".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer cookie cookies consent notice alert popup modal overlay newsletter "
    "subscribe signup login search share sharing social related recommended comment comments reply replies disqus "
    "masthead skip pagination pager toolbar widget complementary contentinfo hidden".split())
COMMENT_MARKS = frozenset("comment comments reply replies".split())

_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_MARK = re.compile("[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TEXT}
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?(?=[\s/"']|$)""", re.I)


def marks(attributes: str) -> set[str]:
    """Lower-case class names, id and role; `hidden` for a hidden element."""
    out = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            out.add("hidden")
        out |= set(value.strip("\"'").lower().split())
    return out


def tag_ends(page: str) -> Callable[[int], int]:
    """A function from a place to that of the next > outside quotes, or, if there is none, of the next > at all; -1 for none.

    Every quote is followed to its partner once, so all tags of a page together take time in proportion to its length.
    """
    known: dict[int, int] = {}
    last = page.rfind(">")

    def end(at: int) -> int:
        if at > last:
            return -1
        passed, out = [], -1
        found = _MARK.search(page, at)
        while found:
            i = found.start()
            if page[i] == ">" or i in known:
                out = known.get(i, i)
                break
            passed.append(i)
            partner = page.find(page[i], i + 1)
            found = _MARK.search(page, partner + 1) if partner >= 0 else None
        known.update(dict.fromkeys(passed, out))
        return out if out >= 0 else page.find(">", at)

    return end


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', raw, ''), ('open', name, attributes) or ('close', name, ''); raw elements and comments are gone."""
    at, look, end = 0, 0, tag_ends(page)
    while m := _START.search(page, look):
        name = (m[2] or "").lower()
        if m[0] == "<!--":
            stop = page.find("-->", m.end())
            stop = stop + 2 if stop >= 0 else len(page)
        else:
            stop = end(m.end()) if name else page.find(">", m.end())
            if stop < 0:  # no tag ends from here on; only a comment may follow
                look = page.find("<!--", m.end())
                if look < 0:
                    break
                continue
        if m.start() > at:
            yield "text", page[at:m.start()], ""
        at = look = stop + 1
        if not name:
            continue
        attributes = "" if m[1] else page[m.end():stop]
        if m[1]:
            yield "close", name, ""
        elif name not in RAW_TEXT:
            yield "open", name, attributes
        elif not attributes.endswith("/"):
            closing = _RAW_END[name].search(page, at)
            at = look = closing.start() if closing else len(page)
    if at < len(page):
        yield "text", page[at:], ""


def _left_out(name: str, attributes: str, inside_content: bool) -> bool:
    if name in ("html", "body"):
        return False
    if name in LEFT_OUT or name == "header" and not inside_content:
        return True
    found = marks(attributes) if attributes else set()
    return bool(found & (COMMENT_MARKS if name in CONTENT else MARKS))


def tokens(page: str | None) -> list[dict]:
    """Tags and texts in order: key of the weight, number of words, block, content element, and whether left out."""
    parts = list(pieces(page or ""))
    # Where elements close: the nearest open one of the name; one that is never closed ends with its parent.
    ends, stack, opened = {}, [], Counter()
    for i, (kind, name, more) in enumerate(parts):
        if kind == "open" and name not in VOID and not (name in GONE and more.endswith("/")):
            stack.append((name, i))
            opened[name] += 1
        elif kind == "close" and opened[name]:
            while True:
                n, start = stack.pop()
                opened[n] -= 1
                if n == name:
                    ends[start] = i
                    break
    # Content elements that are not comments themselves.
    named = [i for i, (kind, name, more) in enumerate(parts)
             if kind == "open" and name in CONTENT and not marks(more) & COMMENT_MARKS]

    def wraps_content(i: int) -> bool:
        k = bisect_right(named, i)
        return k < len(named) and named[k] < ends.get(i, i) and not marks(parts[i][2]) & COMMENT_MARKS

    out, block, around = [], 0, []
    content: list[tuple[int, int]] = []  # content elements that are open: number, end
    gone_until, dead_until, dead_loose = -1, -1, False
    n_content = 0
    for i, (kind, name, more) in enumerate(parts):
        if i <= gone_until:
            continue
        if kind == "open" and name in GONE:
            gone_until = ends.get(i, i)
            continue
        while content and i > content[-1][1]:
            content.pop()
        if dead_loose and kind != "text" and name not in INLINE:
            dead_loose = False  # a left-out element without an end goes on to the next block only
        dead = i <= dead_until or dead_loose
        if kind == "text":
            words = len(name.split())
            key = "w " + (around[-1][0] if around else "body")
            out.append({"key": key, "words": words, "text": name, "block": block,
                        "content": content[0][0] if content else 0, "dead": dead})
            continue
        if name not in INLINE:
            block += 1
        # Elements that have ended no longer surround; unclosed ones surround up to the next tag.
        while around and around[-1][1] <= i:
            around.pop()
        if kind == "open":
            if not dead and _left_out(name, more, bool(content)) and (content or not wraps_content(i)):
                dead = True
                if i in ends:
                    dead_until = ends[i]
                elif name not in VOID:
                    dead_loose = True
            if name in CONTENT and not dead:
                n_content += 1
                content.append((n_content, ends.get(i, len(parts))))
            if name not in VOID and name not in INLINE or name == "a":
                around.append((name, ends.get(i, i)))
        key = ("/" if kind == "close" else "") + name
        out.append({"key": key, "words": 0, "text": " " if name == "br" else "", "block": block,
                    "content": content[0][0] if content else 0, "dead": dead})
    return out


# ---- weights -------------------------------------------------------------------------------------------


def counted(page: str | None) -> dict[str, list[int]]:
    """Per key how many words or tags lie inside and outside the content; nothing for a page without such element."""
    listed = tokens(page)
    if not any(t["content"] for t in listed):
        return {}
    out: dict[str, list[int]] = {}
    for t in listed:
        n = t["words"] if t["key"].startswith("w ") else 1
        entry = out.setdefault(t["key"], [0, 0])
        entry[0 if t["content"] and not t["dead"] else 1] += n
    return out


def weight(key: str, inside: int, outside: int) -> float:
    """Words score from 0.05 to 5, tags from -5 to -0.05, by the log of inside against outside."""
    odds = math.log((inside + 1) / (outside + 1))
    return min(5.0, max(0.05, odds)) if key.startswith("w ") else max(-5.0, min(-0.05, odds))


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights of the most frequent keys, from all pages that name their content."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([a for a, _ in sums.values()], pa.int64()),
                 pa.array([b for _, b in sums.values()], pa.int64())], names=["key", "inside", "outside"])

        for batch in batches:
            for page in batch.column(0):
                for key, (a, b) in counted(page.as_py()).items():
                    entry = sums.setdefault(key, [0, 0])
                    entry[0] += a
                    entry[1] += b
                if len(sums) > 10 * MAX_KEYS:
                    yield flush()
                    sums = {}
        yield flush()

    parts = pages.select(F.col(f"`{html_col}`").alias("html")).mapInArrow(run, "key string, inside long, outside long")
    sums = parts.groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    top = sums.orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(MAX_KEYS)
    return {r.key: weight(r.key, r.inside, r.outside) for r in top.collect()}


# Weights of keys that no labelled page has shown.
NEW_WORD, NEW_TAG = 1.0, -0.5


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the run with the greatest sum, the first of equals; empty if no score is above 0."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    listed = tokens(page)
    scores = []
    for t in listed:
        if t["key"].startswith("w "):
            scores.append(0.0 if t["dead"] else t["words"] * weights.get(t["key"], NEW_WORD))
        else:
            scores.append(weights.get(t["key"], NEW_TAG))
    start, end = best_run(scores)
    if start == end:
        return ""
    chosen = listed[start:end]
    sums: dict[int, float] = {}
    for t, score in zip(chosen, scores[start:end]):
        if t["content"] and t["words"] and not t["dead"]:
            sums[t["content"]] = sums.get(t["content"], 0.0) + score
    if sums:
        wide = max(sums, key=sums.get)
        chosen = [t for t in listed if t["content"] == wide]
    blocks: dict[int, list[str]] = {}
    for t in chosen:
        if not t["dead"]:
            blocks.setdefault(t["block"], []).append(html.unescape(t["text"]))
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def extracted(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """(row, main): each page as a struct with its main text."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(rows: Iterable[dict]) -> Iterator[dict]:
        for row in rows:
            yield {"main": main_text(row["page"], shared.value)}

    return with_python_columns(pages, {"page": F.col(f"`{html_col}`")}, [("main", T.StringType())], run)
