"""HTML extraction by tree scoring.

A page becomes a tree with one pass of a regular expression over its tags.  Every paragraph of some length earns
points for itself, its commas and its length; the parent gets all of them, the grandparent half, ancestors further up a
third over their distance.  Containers start from what their tag, class and id say, and their score is discounted by the share of
text in links.  The container of best score is kept, and those of its siblings that score
well or read like paragraphs.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: No alternative is tried twice, and but for what ends with the page none reads beyond the next "<": time grows with the page only.
#: The tag is one whose values hold no "<"; others are for tag_end().
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"'=]++|=\s*+\"[^\"<]*+\"|=\s*+'[^'<]*+'|=(?!\s*+[\"'])|\"[^\"<]*+\"|'[^'<]*+'|(?<![=\s])[\"'])*+)>"
    r"|[^<]+|<",
    re.S | re.I,
)
_OPENS = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_PIECE = re.compile(r"[^<>\"'=]++|=\s*+[\"']?|\"[^\"<]*+\"|'[^'<]*+'|[\"'<>]")
#: A tag with a quote that is no value's, up to the next ">".
_BROKEN = re.compile(r"(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+(?=>)")
_RAW = re.compile(r"(?:script|style|noscript|template|iframe|svg|textarea|select)\b", re.I)
_ATTR = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_EVERY_ATTR = re.compile(r"([^\s\"'=/]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']++)))?|[\"'=/]")
_GOOD = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
_BAD = re.compile(r"\bads?\b|banner|combx|comment|contact|foot|masthead|meta|nav|outbrain|promo|related|scroll|share|side|sponsor|shopping|tags|widget", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes if it is the innermost open element.
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
PARAGRAPH = frozenset("p pre td blockquote dd".split())
TAG_SCORE = {"article": 10, "main": 10, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3}
TAG_SCORE |= dict.fromkeys(("address", "ol", "ul", "dl", "dd", "dt", "li", "form"), -3)
TAG_SCORE |= dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "th"), -5)
TAG_SCORE |= dict.fromkeys(("nav", "footer", "aside", "header"), -25)
#: Ancestors that a paragraph's points reach.
REACH = 5
LEAST = 25
BREAK = "\n"


def tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the ">" of a tag is whose attributes begin at ``at``; -1 if "<" or the page's end comes first.

    A quote after "=" goes on to its like, whatever is between; if there is none, and elsewhere, it is a letter as any, but for two
    without "<" between.  ``dead`` are places between attributes from which no end was found: none is tried twice.
    """
    tried = []
    while at < len(page) and at not in dead:
        tried.append(at)
        m = _PIECE.match(page, at)
        c = page[at]
        if c == ">":
            return at
        if c == "<":
            break
        at = m.end()
        if c == "=" and page[at - 1] in "\"'":
            at = page.find(page[at - 1], at) + 1 or at
    dead.update(tried)
    return -1


def tokens(page: str) -> Iterator[tuple[str, str | None, bool]]:
    """Texts (text, None), and tags (attributes, name, whether it closes) without comments and what isn't read as markup."""
    at, dead, raw = 0, set(), {}
    while at < len(page):
        for m in _TOKEN.finditer(page, at):
            at, name, ends, attrs = m.end(), m[2], bool(m[1]), m[3]
            if name is None:
                if page[m.start()] != "<":
                    yield m[0], None, False
                    continue
                opens = _OPENS.match(page, m.start()) if m.end() - m.start() == 1 else None
                if opens is None:
                    if m.end() - m.start() == 1:
                        yield "<", None, False
                    continue
                end = tag_end(page, opens.end(), dead)
                if end < 0 and (broken := _BROKEN.match(page, opens.end())):
                    end = broken.end()
                if end < 0:
                    yield "<", None, False
                    continue
                at, name, ends, attrs = end + 1, opens[2], bool(opens[1]), page[opens.end() : end]
            name = name.lower()
            if not ends and (kind := _RAW.match(name)):
                close = raw.get(kind[0]) or raw.setdefault(kind[0], re.compile(rf"</{kind[0]}\s*>", re.I))
                over = close.search(page, at)
                at = over.end() if over else len(page)
                break
            yield attrs, name, ends
            if at != m.end():
                break


def hints(attrs: str) -> str:
    """The values of class and id."""
    if "<" not in attrs:
        return " ".join(x for a in _ATTR.findall(attrs) for x in a if x)
    return " ".join(x for name, *a in _EVERY_ATTR.findall(attrs) if name.lower() in ("class", "id") for x in a if x)


class Tree:
    """Elements in order of opening; each spans a range of text chunks."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.start, self.end, self.hint = ["#root"], [-1], [0], [0], [""]
        self.chunks: list[str] = []
        self.linked: list[bool] = []
        self.title = ""
        stack, count, title, seen_title = [0], {}, [], False

        def close(upto: int) -> None:
            while len(stack) > upto:
                e = stack.pop()
                self.end[e] = len(self.chunks)
                count[self.tag[e]] -= 1

        def mark() -> None:
            if self.chunks and self.chunks[-1] != BREAK:
                self.chunks.append(BREAK)
                self.linked.append(False)

        for text, name, ends in tokens(page):
            if name is None:
                if "&" in text:
                    text = entities.unescape(text)
                if count.get("title"):
                    title.append(text)
                elif not count.get("head") or count.get("body"):
                    self.chunks.append(text)
                    self.linked.append(bool(count.get("a")))
                continue
            if ends:
                if count.get(name):
                    at = len(stack) - 1
                    while self.tag[stack[at]] != name:
                        at -= 1
                    if name in BLOCK:
                        mark()
                    close(at)
                    if name == "title":
                        seen_title = True
                elif name == "p":
                    mark()
                continue
            if name == "title" and seen_title:
                continue
            if name in BLOCK:
                mark()
                if count.get("p") and name != "br" and self.tag[stack[-1]] != "p":
                    at = len(stack) - 1
                    while at > 0 and self.tag[stack[at]] not in BLOCK:
                        at -= 1
                    if self.tag[stack[at]] == "p":
                        close(at)
                elif self.tag[stack[-1]] == "p" and name != "br":
                    close(len(stack) - 1)
            if name == "body" and count.get("head"):
                at = len(stack) - 1
                while self.tag[stack[at]] != "head":
                    at -= 1
                close(at)
            while len(stack) > 1 and self.tag[stack[-1]] in CLOSES.get(name, ()):
                close(len(stack) - 1)
            if name in VOID or text.endswith("/"):
                continue
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.start.append(len(self.chunks))
            self.end.append(len(self.chunks))
            self.hint.append(hints(text) if text else "")
            stack.append(len(self.tag) - 1)
            count[name] = count.get(name, 0) + 1
        count["#root"] = 1
        close(0)
        self.title = " ".join("".join(title).split())

    def text(self, e: int) -> str:
        lines = (" ".join(line.split()) for line in "".join(self.chunks[self.start[e] : self.end[e]]).split(BREAK))
        return "\n".join(line for line in lines if line)


def extract(page: str) -> tuple[str, str, float]:
    """Title, text and the best container's score; of a page without a paragraph all its text, with score 0."""
    t = Tree(page)
    size, links, commas = [0], [0], [0]
    for chunk, linked in zip(t.chunks, t.linked):
        n = 0 if chunk == BREAK else len(" ".join(chunk.split()))
        size.append(size[-1] + n)
        links.append(links[-1] + (n if linked else 0))
        commas.append(commas[-1] + chunk.count(",") + chunk.count("，") + chunk.count("、"))

    def length(e: int) -> int:
        return size[t.end[e]] - size[t.start[e]]

    def density(e: int) -> float:
        n = length(e)
        return (links[t.end[e]] - links[t.start[e]]) / n if n else 0.0

    scores: dict[int, float] = {}

    def opening(e: int) -> float:
        s, hint = TAG_SCORE.get(t.tag[e], 0), t.hint[e]
        if hint:
            s += 25 * (bool(_GOOD.search(hint)) - bool(_BAD.search(hint)))
        return s

    def award(first: int, points: float) -> None:
        e, level = first, 0
        while e > 0 and level < REACH:
            if e not in scores:
                scores[e] = opening(e)
            scores[e] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            e, level = t.parent[e], level + 1

    holds_block = [False] * len(t.tag)
    for e in range(len(t.tag) - 1, 0, -1):
        if holds_block[e] or t.tag[e] in BLOCK:
            holds_block[t.parent[e]] = True
    for e in range(1, len(t.tag)):
        own = t.tag[e] in PARAGRAPH or (t.tag[e] in ("div", "section", "article") and not holds_block[e])
        n = length(e) if own else 0
        if n >= LEAST:
            points = 1 + commas[t.end[e]] - commas[t.start[e]] + min(n / 100, 3)
            award(t.parent[e] if t.tag[e] in PARAGRAPH and t.parent[e] > 0 else e, points * (1 - density(e)))
    if not scores:
        return t.title, t.text(0), 0.0
    final = {e: s * (1 - density(e)) for e, s in scores.items()}
    best = min(final, key=lambda e: (-final[e], e))
    least = max(10.0, final[best] * 0.2)
    kept = []
    for e in range(1, len(t.tag)):
        if t.parent[e] != t.parent[best]:
            continue
        if e == best or final.get(e, 0) >= least:
            kept.append(e)
        elif t.tag[e] == "p":
            n, d = length(e), density(e)
            if (n > 80 and d < 0.25) or (0 < n <= 80 and d == 0 and t.text(e).endswith((".", "!", "?"))):
                kept.append(e)
    return t.title, "\n".join(x for x in map(t.text, kept) if x), final[best]


EXTRACTED = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])


@F.arrow_udf(EXTRACTED)
def extracted(page: pa.Array) -> pa.Array:
    found = [None if x is None else extract(x) for at in range(0, len(page), 256) for x in page.slice(at, 256).to_pylist()]
    cols = [pa.array([None if x is None else x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))]
    return pa.StructArray.from_arrays(cols, names=["title", "text", "score"], mask=pa.array([x is None for x in found], pa.bool_()))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text and score of every page.

    Null html: title, text and score are null.  A page without paragraphs (empty, or plain text) gives all its text, with
    score 0.  Of equal scores the element that opens first wins.  Null and repeated page_ids are rows as any; other columns are left out.
    """
    return pages.select("page_id", "url", extracted("html").alias("e")).select("page_id", "url", "e.*")
