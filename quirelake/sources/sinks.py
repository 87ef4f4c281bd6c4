"""Results as files: recognised pages, reports, books."""

from __future__ import annotations

import io
import itertools
import json
import os
import shutil
import struct
import subprocess
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import escape
from pathlib import Path
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import metrics, text

_OPF = """<?xml version="1.0" encoding="utf-8"?>
<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">{id}</dc:identifier><dc:title>{title}</dc:title><dc:language>{lang}</dc:language></metadata><manifest>{items}</manifest><spine toc="ncx">{spine}</spine></package>"""
_NCX = """<?xml version="1.0" encoding="utf-8"?>
<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{id}"/></head><docTitle><text>{title}</text></docTitle><navMap>{points}</navMap></ncx>"""
_CONTAINER = """<?xml version="1.0"?>
<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>"""


def screened(ocr: DataFrame) -> DataFrame:
    """Recognised pages with their repetition (three decimals), whether they are degenerate, and no text if they are."""
    ratio = metrics.repetition_ratio(F.coalesce("text", F.lit("")))
    own = ocr.withColumn("_ratio", ratio)
    out = own.withColumn("degenerate", metrics.is_degenerate(F.col("_ratio"))).withColumn("text", metrics.gated(F.col("text"), F.col("_ratio")))
    return out.withColumn("repetition_ratio", text.rounded(F.col("_ratio"), 3) / F.lit(1000.0)).drop("_ratio")


def write_ocr(ocr: DataFrame, path: str) -> None:
    """Recognised pages, a folder a book."""
    ocr.write.mode("overwrite").partitionBy("book").parquet(path)


def write_json(value: object, path: str) -> None:
    """One value as indented JSON, characters beyond ASCII as they are; for small results on the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def written(
    out: IO[bytes], book: str, title: str, pages: list[tuple[str, str]], images: list[str], nav: str | bytes, xhtml: Iterable[tuple[str, str | bytes]], pictures: Iterable[tuple[str, bytes]], lang: str = "en", identifier: str | None = None
) -> None:
    """Writes a book as EPUB 3: pages are (file, title) in order; what is in the files is taken one by one."""
    ident = identifier or f"urn:quirelake:{book}"
    kinds = {n: text.MEDIA.get(n.rsplit(".", 1)[-1].lower(), "image/png") for n in images}
    items = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>']
    items += [f'<item id="p{i}" href="{escape(f)}" media-type="application/xhtml+xml"/>' for i, (f, _) in enumerate(pages)]
    items += [f'<item id="i{i}" href="images/{escape(n)}" media-type="{k}"/>' for i, (n, k) in enumerate(kinds.items())]
    spine = "".join(f'<itemref idref="p{i}"/>' for i in range(len(pages)))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, data: str | bytes, how: int = zipfile.ZIP_DEFLATED) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, how)

        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", _CONTAINER)
        put("OEBPS/content.opf", _OPF.format(id=escape(ident), title=escape(title), lang=lang, items="".join(items), spine=spine))
        del items, spine
        put("OEBPS/nav.xhtml", nav)
        points = "".join(f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{escape(f)}"/></navPoint>' for i, (f, t) in enumerate(pages))
        put("OEBPS/toc.ncx", _NCX.format(id=escape(ident), title=escape(title), points=points))
        del points
        for f, data in xhtml:
            put(f"OEBPS/{f}", data)
        for n, data in pictures:
            put(f"OEBPS/images/{n}", data)


def epub(book: str, title: str, nav: str, pages: list[tuple[str, str, str]], images: dict[str, bytes], lang: str = "en", identifier: str | None = None) -> bytes:
    """A book as EPUB 3: pages are (file, title, xhtml) in order."""
    out = io.BytesIO()
    written(out, book, title, [p[:2] for p in pages], list(images), nav, ((f, x) for f, _, x in pages), images.items(), lang, identifier)
    return out.getvalue()


def scratch() -> str | None:
    """A folder of the executor for temporary files."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


#: Rows of a book that are Python objects at once.
AT_ONCE = 64
#: Kinds of a book's rows in the order in which they are written.
_TITLE, _NAV, _PAGE, _PICTURE = range(4)


def _book(rows: Iterator[dict], lang: str, identifier: str | None) -> pa.RecordBatch:
    """The file of the book whose rows these are: first without, then with what is in its files."""
    title, pages, images, first = None, [], {}, None
    for r in rows:
        if r["part"]:
            first = r
            break
        if r["kind"] == _TITLE:
            title = title or r["title"]
        elif r["kind"] == _PAGE:
            pages.append((r["name"], r["title"]))
        elif r["kind"] == _PICTURE:
            images[r["name"]] = None
        book = r["book"]
    rest = itertools.chain([first], rows)
    ahead = next(rest)
    nav: str | bytes = ""
    while ahead is not None and ahead["kind"] < _PAGE:
        if ahead["kind"] == _NAV and nav == "":
            nav = ahead["data"]
        ahead = next(rest, None)

    def files(kind: int) -> Iterator[tuple[str, bytes]]:
        nonlocal ahead
        last = None
        while ahead is not None and ahead["kind"] == kind:
            if kind == _PAGE or ahead["name"] != last:  # the first picture of a name counts
                yield ahead["name"], ahead["data"]
            last, ahead = ahead["name"], next(rest, None)

    with tempfile.NamedTemporaryFile(dir=scratch()) as out:
        written(out, book, title or book, pages, list(images), nav, files(_PAGE), files(_PICTURE), lang, identifier)
        out.flush()
        own = pa.memory_map(out.name).read_buffer()
    content = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(struct.pack("<2i", 0, own.size)), own])
    return pa.RecordBatch.from_arrays([pa.array([book], pa.string()), content], ["book", "content"])


def epubs(docs: DataFrame, navs: DataFrame, images: DataFrame | None = None, lang: str = "en", titles: DataFrame | None = None, identifier: str | None = None) -> DataFrame:
    """book and content of every book, made where its pages are.

    docs: book, index, file, title, xhtml; navs: book, nav; images: book, name,
    content, of which the first of a name counts; titles: book, title, else a
    book is called as its folder. A book is built in one task, which holds the
    names of its files; its archive grows on disk, and Spark sorts what goes into
    it, names before contents.
    """
    base = docs.select("book", "index", F.lit(_PAGE).alias("kind"), F.col("file").alias("name"), "title", F.encode(F.col("xhtml"), "UTF-8").alias("data"))
    extra = navs.select("book", F.lit(0).alias("index"), F.lit(_NAV).alias("kind"), F.lit("nav.xhtml").alias("name"), F.lit("").alias("title"), F.encode(F.col("nav"), "UTF-8").alias("data"))
    every = base.unionByName(extra)
    if titles is not None:
        named = titles.select("book", F.lit(0).alias("index"), F.lit(_TITLE).alias("kind"), F.lit("").alias("name"), "title", F.lit(None).cast("binary").alias("data"))
        every = every.unionByName(named.join(docs.select("book").distinct(), "book", "left_semi"))
    if images is not None:
        every = every.unionByName(images.select("book", F.lit(0).alias("index"), F.lit(_PICTURE).alias("kind"), "name", F.lit("").alias("title"), F.col("content").alias("data")))
    parts = every.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("data", F.when(F.col("part") == 1, F.col("data")))
    placed = parts.repartition("book").sortWithinPartitions("book", "part", "kind", "index", "name", "title")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(0, b.num_rows, AT_ONCE) for r in b.slice(i, AT_ONCE).to_pylist())
        for _, own in itertools.groupby(rows, lambda r: r["book"]):
            yield _book(own, lang, identifier)

    return placed.mapInArrow(build, "book string, content binary")


def save(books: DataFrame, folder: str) -> None:
    """Each book as a file in a folder that all executors share."""

    def put(rows: Iterator) -> None:
        for r in rows:
            Path(folder, f"{r['book']}.epub").write_bytes(bytes(r["content"]))

    Path(folder).mkdir(parents=True, exist_ok=True)
    books.foreachPartition(put)


@dataclass(frozen=True)
class Checked:
    ok: bool
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    note: str = ""


def epubcheck(path: str, jar: str | None = None) -> Checked:
    """What EPUBCheck says of a file, or what is missing to call it; jar, else $EPUBCHECK_JAR, is its archive."""
    java, jar = shutil.which("java"), jar or os.environ.get("EPUBCHECK_JAR")
    if java is None:
        return Checked(False, note="EPUBCheck needs java")
    if not jar or not Path(jar).exists():
        return Checked(False, note="EPUBCheck's archive isn't there; name it by EPUBCHECK_JAR")
    done = subprocess.run([java, "-jar", jar, "--json", "-", path], capture_output=True, text=True, check=False)
    return judged(done.stdout, done.returncode, done.stderr)


def judged(report: str, code: int = 0, complaint: str = "") -> Checked:
    """A report's messages by severity; one that can't be read counts by the exit code."""
    try:
        said = json.loads(report).get("messages", [])
    except ValueError:
        return Checked(code == 0, note=complaint.strip()[:500])
    of = lambda *kinds: tuple(m["message"] for m in said if m.get("severity") in kinds)
    errors = of("ERROR", "FATAL")
    return Checked(not errors, errors, of("WARNING"))
