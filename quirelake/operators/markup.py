"""Markup of source pages: visible text, images, block elements, repair, links between files."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SILENT = ("style", "script")
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "li")
KEPT = ("h1", "h2", "h3")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def local_name(tag: str) -> str:
    """Tag without namespace or prefix, in lower case."""
    return re.split(r"[}:]", tag)[-1].lower()


def resolved(base: str, href: str) -> str:
    """Path of a reference from the file that holds it, normalised; escapes and fragments stay as they are."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), href))


class _Page(HTMLParser):
    """Collects visible text, image references and block elements of the body, or of all if there is no body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.restart()

    def restart(self) -> None:
        self.texts: list[str] = []
        self.images: list[str] = []
        self.blocks: list[list] = []
        self.open: list[list] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        name, own = local_name(tag), {local_name(k): v for k, v in attrs}
        if name == "body":
            self.restart()
        elif name in SILENT:
            self.silent += 1
        elif name == "img" and own.get("src"):
            self.images.append(own["src"])
        elif name == "image" and own.get("href"):
            self.images.append(own["href"])
        if name in BLOCKS:
            if name == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()
            block = [name, []]
            self.blocks.append(block)
            self.open.append(block)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if local_name(tag) not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        name = local_name(tag)
        if name in SILENT:
            self.silent = max(0, self.silent - 1)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.texts.append(data)
            for block in self.open:  # nested blocks repeat their text
                block[1].append(data)


def read(page: str) -> _Page:
    out = _Page()
    out.feed(page)
    out.close()
    return out


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def preserved(page: str) -> str:
    """Block elements as they follow each other; the three top headings keep their tag, others become paragraphs."""
    made = []
    for tag, parts in read(page).blocks:
        own = _squeezed(parts)
        if own:
            name = tag if tag in KEPT else "p"
            made.append(f"<{name}>{escape(own)}</{name}>")
    return "\n".join(made) or "<p></p>"


class _Repair(HTMLParser):
    """Writes markup again, so that every element is closed in its turn."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9._:-]*", tag):
            return
        own: dict[str, str] = {k: v or "" for k, v in attrs if re.fullmatch(r"[a-zA-Z_][\w.:-]*", k)}
        self.out.append(f"<{tag}" + "".join(f' {k}="{escape(v)}"' for k, v in own.items()) + ("/>" if tag in VOID else ">"))
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while True:
                top = self.stack.pop()
                self.out.append(f"</{top}>")
                if top == tag:
                    return

    def handle_data(self, data: str) -> None:
        self.out.append(escape(data, quote=False))


def repaired(fragment: str | None) -> str | None:
    """Well-formed markup of a fragment; None if nothing is left."""
    p = _Repair()
    p.feed(fragment or "")
    p.close()
    p.out += [f"</{x}>" for x in reversed(p.stack)]
    return "".join(p.out).strip() or None


#: Texts that are Python objects at once, and characters of them beyond which fewer are.
AT_ONCE, MUCH = 64, 1 << 20


def by_pieces(column: pa.Array, arrow: pa.DataType, f: Callable[[str], object]) -> pa.Array:
    """f of every text but null, of few texts at once, so that a batch isn't held as objects."""
    step = max(1, min(AT_ONCE, MUCH * len(column) // max(1, column.nbytes)))
    made = [pa.array([None if x is None else f(x) for x in column.slice(k, step).to_pylist()], arrow) for k in range(0, len(column), step)]
    return pa.concat_arrays(made) if made else pa.array([], arrow)


def _mapped(kind: str, arrow: pa.DataType, f) -> object:
    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return by_pieces(column, arrow, f)

    return run


def visible_text(c: Column) -> Column:
    """Text outside styles and scripts, blanks collapsed."""
    return _mapped("string", pa.string(), lambda x: _squeezed(read(x).texts))(c)


def image_refs(c: Column) -> Column:
    """Image references in the order of the document, unresolved."""
    return _mapped("array<string>", pa.list_(pa.string()), lambda x: read(x).images)(c)


def preserved_body(c: Column) -> Column:
    return _mapped("string", pa.string(), preserved)(c)


def well_formed(c: Column) -> Column:
    return _mapped("string", pa.string(), repaired)(c)


def resolve_href(base: Column, href: Column) -> Column:
    @F.arrow_udf("string")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else resolved(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    return run(base, href)


def pdf_html(blocks: Column) -> Column:
    """Paragraphs of a PDF page's blocks (x0, y0, kind, text): text blocks from top to bottom, then left to right, to a tenth.

    Tenths are those of the binary value, ties to even. An empty paragraph if there is no text.
    """
    from quirelake.functions import text

    tenth = lambda x: F.signum(x) * text.rounded(x, 1)
    own = F.filter(blocks, lambda b: b["kind"] == 0)
    placed = F.array_sort(F.transform(own, lambda b, i: F.struct(tenth(b["y0"]).alias("y"), tenth(b["x0"]).alias("x"), i.alias("i"), text.norm_ws(b["text"]).alias("t"))))
    shown = F.filter(placed, lambda b: b["t"] != "")
    made = F.array_join(F.transform(shown, lambda b: F.concat(F.lit("<p>"), text.escape(b["t"]), F.lit("</p>"))), "\n")
    return F.when(made == "", F.lit("<p></p>")).otherwise(made)
