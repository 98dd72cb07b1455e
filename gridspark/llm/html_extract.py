"""Main text of web pages by the maximum-scoring run of tokens.

Words score above zero and tags below; the weights are log-odds of lying inside the content, learned from
pages that label their content themselves (an ``article`` or ``main`` element).  A linear scan finds the
contiguous run with the largest sum, which is widened to the content element that holds it.  Subtrees that
are never content (menus, forms, scripts, adverts, comments ...) score as barriers and are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import map_texts

# Element names of HTML by their role.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas")
NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "input", "label", "fieldset", "dialog", "menu",
         "head", *RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr", "br", "img"}
# Left-out elements that stand inside a line of text and do not end its block.
WITHIN = {*RAW, "button", "select", "input", "label"}
HOLDERS = {"article", "main", "section", "div", "td", "body", "html", ""}
# An open element of the first kind ends where one of the second begins.
ENDS = {"p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3",
              "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"},
        "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"},
        "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
# Words of class, id and role that name what is no article text.
_NAMES = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter"
                    r"|subscri\w+|sidebar|side|widget|menu|nav\w*|breadcrumbs?|header|footer|masthead|comments?|replies|disqus"
                    r"|respond|share|sharing|social|related|recommended|pagination|pager|login|search|toolbar|alert|dialog"
                    r"|complementary|contentinfo|copyright|skip)(?=$|[\s_\d-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

# Weights for a table without any labelled page.
DEFAULT = {"word": 1.0, "tag": -1.0}
BARRIER = -1e9


def tokens(html: str):
    """Yield ("text", string), ("open", name, attributes) and ("close", name); comments and raw elements are skipped."""
    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            yield "text", html[at:m.start()], ""
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3] or ""
        if name in RAW and not (m[3] or "").endswith("/"):
            end = _RAW_END[name].search(html, at)
            yield "close", name, ""
            at = end.end() if end else len(html)
    if at < len(html):
        yield "text", html[at:], ""


def is_never(name: str, attributes: str, inside: bool) -> bool:
    """Whether the element holds no article text; a header inside the article holds its title."""
    if name in NEVER or name == "header" and not inside:
        return True
    if name in ("body", "html", "article", "main") or not attributes:
        return False
    return bool(_HIDDEN.search(attributes)) or any(_NAMES.search(a or b or c) for a, b, c in _NAMED.findall(attributes))


def parse(html: str) -> list[tuple]:
    """Events (kind, name or text, parent node) of a page outside what is never content; barriers mark what is left out.

    Nodes are numbers; the last value of the result maps each node to (name, parent).
    """
    nodes: list[tuple[str, int]] = [("", -1)]
    stack, skip, inside, events = [0], 0, 0, []
    for kind, value, attributes in tokens(html):
        if kind == "text":
            if not skip:
                events.append(("text", value, stack[-1]))
            continue
        if kind == "open":
            while not skip and len(stack) > 1 and value in ENDS.get(nodes[stack[-1]][0], ()):
                events.append(("close", nodes[stack.pop()][0], stack[-1]))
            if not skip and "p" in (open_names := [nodes[n][0] for n in stack[-6:]]) and value in ENDS["p"]:
                # An unclosed inline element does not keep its paragraph open.
                k = len(stack) - len(open_names) + max(i for i, n in enumerate(open_names) if n == "p")
                if all(nodes[n][0] in INLINE for n in stack[k + 1:]):
                    while len(stack) > k:
                        events.append(("close", nodes[stack.pop()][0], stack[-1]))
            if value in VOID:
                if not skip:
                    events.append(("void", value, stack[-1]))
                continue
            if attributes.endswith("/") and value not in HOLDERS:
                continue
            nodes.append((value, stack[-1]))
            stack.append(len(nodes) - 1)
            inside += value in ("article", "main")
            if skip or is_never(value, attributes, inside > 0):
                skip += 1
                if skip == 1:
                    events.append(("barrier", value, stack[-2]))
            else:
                events.append(("open", value, stack[-1]))
            continue
        names = [nodes[n][0] for n in stack]
        if value not in names:
            continue
        while True:
            name = nodes[stack.pop()][0]
            inside -= name in ("article", "main")
            if skip:
                skip -= 1
            else:
                events.append(("close", name, stack[-1]))
            if name == value:
                break
    return [events, nodes]


def scored(events: list[tuple], weights: dict[str, float]) -> list[float]:
    word, other = weights["word"], weights["tag"]
    return [word * len(v.split()) if k == "text" else BARRIER if k == "barrier" and v not in WITHIN
            else weights.get(v, other) for k, v, _ in events]


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last index of the contiguous run with the largest sum (the first of equal ones); (0, -1) if none is positive."""
    best, run, start, found = 0.0, 0.0, 0, (0, -1)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, found = run, (start, i)
    return found


def holder(events: list[tuple], nodes: list[tuple], first: int, last: int) -> int:
    """The content element that holds the run: its outermost article or main, else the nearest block above both ends."""
    def path(n: int) -> list[int]:
        out = []
        while n >= 0:
            out.append(n)
            n = nodes[n][1]
        return out

    seen: set[int] | None = None
    for k, _, n in events[first:last + 1]:
        if k == "text":
            seen = set(path(n)) if seen is None else seen.intersection(path(n))
    common = sorted(seen or {0}, reverse=True)
    content = [n for n in common if nodes[n][0] in ("article", "main")]
    return min(content) if content else next(n for n in common if nodes[n][0] in HOLDERS)


def extract(html: str | None, weights: dict[str, float]) -> str:
    """Main text of one page: blocks in page order, joined by an empty line."""
    events, nodes = parse(html or "")
    first, last = best_run(scored(events, weights))
    if last < first:
        return ""
    top, inside, blocks, block = holder(events, nodes, first, last), {}, [], []

    def within(n: int) -> bool:
        if n not in inside:
            inside[n] = n == top or (nodes[n][1] >= 0 and within(nodes[n][1]))
        return inside[n]

    for kind, value, node in events:
        if kind == "text":
            if within(node):
                block.append(unescape(value))
        elif kind == "barrier" and value in WITHIN:
            continue
        elif value in ("br", "img"):
            block.append(" ")
        elif value not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def learn_counts(html: str | None) -> Counter:
    """Tokens of one labelled page, by (kind, inside the content or not); empty if the page labels nothing."""
    out: Counter = Counter()
    depth = {"article": 0, "main": 0}
    labelled = False
    for kind, value, _ in tokens(html or ""):
        if kind == "open" and value in depth:
            depth[value] += 1
            labelled = True
        inside = any(depth.values())
        if kind == "text":
            out["word", inside] += len(value.split())
        else:
            out[value, inside] += 1
        if kind == "close" and value in depth:
            depth[value] = max(0, depth[value] - 1)
    return out if labelled else Counter()


def learn_weights(pages: DataFrame, html: str = "html", key: str = "url", sample: int = 500) -> dict[str, float]:
    """Weights from at most ``sample`` labelled pages (those with the smallest hashes of ``key``).

    A word's weight is the log-odds of inside against outside, at least 0.2; a tag's is at most -0.2.
    """
    labelled = pages.where(F.col(html).rlike("(?i)<(article|main)[\\s>]")).select(html, F.xxhash64(key, html).alias("h"))
    counts: Counter = Counter()
    for row in labelled.orderBy("h").limit(sample).toLocalIterator():
        counts.update(learn_counts(row[0]))
    if not counts:
        return DEFAULT

    def odds(*names: str) -> float:
        return math.log((sum(counts[n, True] for n in names) + 1) / (sum(counts[n, False] for n in names) + 1))

    tags = {n for n, _ in counts} - {"word"}
    weights = {n: min(-0.2, odds(n)) for n in sorted(tags) if counts[n, True] + counts[n, False] >= 5}
    return {**weights, "word": max(0.2, odds("word")), "tag": min(-0.2, odds(*tags))}


def extract_pages(pages: DataFrame, html: str = "html", weights: dict[str, float] | None = None, sample: int = 500) -> DataFrame:
    """``pages`` with ``text``, the main text.

    Null, empty and text-free pages give an empty text; broken markup is read to its end.  Other columns and repeated
    rows are kept; a column named ``text`` is replaced.  Without ``weights`` they are learned from a bounded sample.
    """
    if weights is None:
        weights = learn_weights(pages, html, "url" if "url" in pages.columns else html, sample)
    return map_texts(pages, html, [("text", "string")], lambda: lambda texts: ([extract(t, weights) for t in texts],))
