"""Main text of web pages by composite text density (Sun, Song and Liao, 2011).

For every element with C characters and T tags in it, of which LC characters and
LT tags are in links, of a body with C_b and LC_b,

    density = C / T * log(C / LC * T / LT, base = ln(C / (C - LC) * LC + LC_b / C_b * C + e))

where a zero count under a fraction is taken as one, as is a logarithm to the
base of one. The density sum of an
element is the sum over its children. The element of the greatest sum is found
among the body and all below it; the least density on its path to the body,
without the body, is the threshold. From the body down, every element that
reaches it by elements that do yields its subtree of the greatest sum, and the
content is all of these in document order; tag and density sum are those of the
element of the greatest sum. Subtrees whose sum is below the threshold too are
passed over: a footer or notice that is one run of text is dense, but no block.

Pages are parsed one by one in Arrow batches, without a shuffle. The parser is
iterative and forgiving: unclosed paragraphs, list items, cells and rows end
where the next begins, stray end tags are passed over, comments, scripts and
styles are no text. A slash before the end of a tag closes it only for elements
that HTML doesn't know, as in drawings; on others it has no meaning.

Defined results. A null page gives a null text, an empty one or one without any
text an empty text; both have a density sum of 0. Very long and deep pages are
read whole. Of equal sums the first in
document order is taken. Repeated rows give equal results. Columns other than
page_id and html are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: Elements of HTML, which a slash doesn't close.
PLAIN = BLOCK | SILENT | frozenset("a abbr b bdi bdo button caption cite code colgroup data datalist del dfn em head i iframe ins kbd label legend map mark menu meter object optgroup option output picture progress q s samp select small span strong sub sup time u var video audio".split())
#: Elements that end where one of the others begins, up to the nearest boundary.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_SCOPE = frozenset("article aside blockquote body div footer header html li main nav section table td th".split())
#: Attributes are names with a value in quotes or up to a blank; a slash that ends an unquoted value is part of it.
_TAG = re.compile(
    r"""<(?:!--(?P<note>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|=\s*+[^\s"'>][^\s>]*+|(?P<shut>/(?=>))|[^>=])*+(?P<closed>>)|[!?][^>]*+>)"""
)
_BLANK = re.compile(r"\s+")


def parse(page: str) -> tuple[list[str], list[int], list[list]]:
    """Tags and parents of all elements in document order, and for each its contents: texts and numbers of children. Element 0 is the page."""
    tags, parents, inside = ["#page"], [-1], [[]]
    stack, at, n = [0], 0, len(page)

    def close(upto: int) -> None:
        del stack[upto:]

    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            cut = n
        if cut > at:
            inside[stack[-1]].append(page[at:cut])
        if cut == n:
            break
        m = _TAG.match(page, cut)
        if not m:
            inside[stack[-1]].append("<")
            at = cut + 1
            continue
        at = m.end()
        if m["note"] is not None:
            stop = page.find("-->", at)
            at = n if stop < 0 else stop + 3
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == name:
                    close(k)
                    break
            continue
        if name in ENDS:
            own, bound = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in bound:
                    break
                if tags[stack[k]] in own:
                    close(k)
                    break
        elif name in BLOCK and name != "br":
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in _SCOPE:
                    break
                if tags[stack[k]] == "p":
                    close(k)
                    break
        tags.append(name)
        parents.append(stack[-1])
        inside.append([])
        me = len(tags) - 1
        inside[stack[-1]].append(me)
        if name in VOID or m["shut"] and name not in PLAIN:
            continue
        if name in SILENT:
            stop = re.compile(rf"</{re.escape(name)}\s*+>?", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else n
            continue
        stack.append(me)
    return tags, parents, inside


def densities(tags: list[str], parents: list[int], inside: list[list]) -> tuple[list[float], list[float], int]:
    """Density and density sum of every element, and the body (or the page, if it has none)."""
    n = len(tags)
    chars, links = [0] * n, [0] * n
    count, link_tags = [0] * n, [0] * n
    linked = [False] * n
    body = next((i for i in range(n) if tags[i] == "body"), 0)
    for i in range(n):
        linked[i] = tags[i] == "a" or (i > 0 and linked[parents[i]])
    for i in range(n - 1, -1, -1):
        own = sum(len(_BLANK.sub(" ", entities.unescape(x)).strip()) for x in inside[i] if isinstance(x, str))
        chars[i] += own
        if linked[i]:
            links[i] += own
        if i:
            up = parents[i]
            chars[up] += chars[i]
            links[up] += links[i]
            count[up] += count[i] + 1
            link_tags[up] += link_tags[i] + (tags[i] == "a")
    share = links[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], max(1, count[i]), links[i], max(1, link_tags[i])
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = c / t * math.log(c / max(1, lc) * t / lt) / math.log(base) if base > 1 else c / t
        if i:
            total[parents[i]] += density[i]
    return density, total, body


def content(parents: list[int], density: list[float], total: list[float], body: int) -> tuple[int, list[int]]:
    """The element of the greatest sum, and the elements whose subtrees are the content, in document order."""
    n = len(parents)
    most = list(range(n))  # the element of the greatest sum in each subtree
    for i in range(n - 1, body, -1):
        if total[most[i]] >= total[most[parents[i]]] and most[parents[i]] != parents[i] or total[most[i]] > total[most[parents[i]]]:
            most[parents[i]] = most[i]
    best = most[body]
    if total[best] <= 0 or best == body:
        return best, [body]
    threshold, i = density[best], parents[best]
    while i != body:
        threshold = min(threshold, density[i])
        i = parents[i]
    found, reached = set(), {body}
    marked = set()  # in the content already
    for i in range(body + 1, n):
        if parents[i] in marked or i in found:
            marked.add(i)
        elif parents[i] in reached and density[i] >= threshold:
            reached.add(i)
            if total[most[i]] >= threshold:
                found.add(most[i])
                if most[i] == i:
                    marked.add(i)
    return best, sorted(found)


def text_of(root: int, tags: list[str], inside: list[list]) -> str:
    """The text below an element: a line a block, single blanks within."""
    parts: list[str] = []
    todo: list = [(root, 0)]
    while todo:
        i, k = todo.pop()
        if k == 0 and tags[i] in BLOCK:
            parts.append("\n")
        if k == len(inside[i]):
            if tags[i] in BLOCK:
                parts.append("\n")
            continue
        todo.append((i, k + 1))
        x = inside[i][k]
        if isinstance(x, str):
            parts.append(_BLANK.sub(" ", entities.unescape(x)))
        else:
            todo.append((x, 0))
    lines = (_BLANK.sub(" ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def extract(page: str) -> tuple[str, str, float]:
    """Text, tag and density sum of the content of a page."""
    tags, parents, inside = parse(page)
    density, total, body = densities(tags, parents, inside)
    best, roots = content(parents, density, total, body)
    return "\n".join(x for i in roots if (x := text_of(i, tags, inside))), tags[best], max(0.0, total[best])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, text, tag, density_sum and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(None, None, 0.0) if x is None else extract(x) for x in b.column("html").to_pylist()]
            text, tag, total = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array(text, pa.string()), pa.array(tag, pa.string()), pa.array(total, pa.float64()), pa.array([len(x or "") for x in text], pa.int64())],
                ["page_id", "text", "tag", "density_sum", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string, tag string, density_sum double, n_chars long")
