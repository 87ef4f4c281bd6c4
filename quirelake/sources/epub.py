"""EPUB files as tables of spine documents, images and covers.

Files are read whole by Spark's binaryFile source, one row a file; archives are
opened where the rows are. A file that is no archive or has no package document
gives one row with an error.
"""

from __future__ import annotations

import posixpath
import tempfile
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import text
from quirelake.operators import markup, routing
from quirelake.sources import sinks

DOCUMENTS = "book string, spine_pos int, idref string, href string, text_len int, images array<string>, present array<boolean>, page_html string, error string"
#: Bytes that are sent at once.
PIECE = 4 << 20
CONTAINER = "META-INF/container.xml"


def package_path(archive: zipfile.ZipFile) -> str:
    """Path of the first package document that the container names."""
    for e in ElementTree.fromstring(archive.read(CONTAINER)).iter():
        if markup.local_name(e.tag) == "rootfile" and e.get("full-path"):
            return e.get("full-path")
    raise ValueError("the container names no package document")


def elements(archive: zipfile.ZipFile, path: str) -> Iterator[ElementTree.Element]:
    """Elements of a file as they begin; none is kept after its end."""
    held: list[ElementTree.Element] = []
    with archive.open(path) as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                yield e
                held.append(e)
            else:
                held.pop()
                if held:
                    held[-1].remove(e)


def package(archive: zipfile.ZipFile, path: str) -> tuple[dict[str, dict], list[str], str | None]:
    """Manifest items by id, spine references in order, id of the cover item (from the last meta element, else the first property)."""
    items: dict[str, dict] = {}
    spine: list[str] = []
    by_meta = by_property = None
    for e in elements(archive, path):
        name = markup.local_name(e.tag)
        if name == "item" and e.get("id") and e.get("href"):
            items[e.get("id")] = {"href": markup.resolved(path, e.get("href")), "type": e.get("media-type", "")}
            if by_property is None and "cover-image" in e.get("properties", "").split():
                by_property = e.get("id")
        elif name == "itemref" and e.get("idref"):
            spine.append(e.get("idref"))
        elif name == "meta" and e.get("name") == "cover" and e.get("content"):
            by_meta = e.get("content")
    return items, spine, by_meta or by_property


def spine_rows(content: IO[bytes]) -> Iterator[tuple]:
    """(spine_pos, idref, href, text_len, images, present, page_html) of the documents that can be read; present tells which images the archive holds.

    All documents are looked through before the first is given, so a broken file
    gives none; their markup is read again one by one and never held together.
    """
    with zipfile.ZipFile(content) as archive:
        names = set(archive.namelist())
        items, spine, _ = package(archive, package_path(archive))
        shown = lambda href: archive.read(href).decode("utf-8", "replace")
        rows = []
        for pos, idref in enumerate(spine):
            href = items.get(idref, {}).get("href")
            if href not in names:
                continue
            found = markup.read(shown(href))
            images = [markup.resolved(href, x) for x in found.images]
            rows.append((pos, idref, href, len(" ".join("".join(found.texts).split())), images, [x in names for x in images]))
        del items, spine
        for row in rows:
            yield *row, shown(row[2])


def files(spark: SparkSession, path: str) -> DataFrame:
    """book, path and content of every file at a path or glob."""
    return spark.read.format("binaryFile").load(path).select(text.slug(F.col("path")).alias("book"), "path", "content")


def _spooled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, IO[bytes]]]:
    """Each book and its file, put together from pieces (book, n, piece) in order; on disk, if it has more than one."""
    book = content = None
    for b in batches:
        for k in range(b.num_rows):
            if b.column("n")[k].as_py() == 0:
                if content is not None:
                    yield book, content
                    content.close()
                book, content = b.column("book")[k].as_py(), tempfile.SpooledTemporaryFile(PIECE, dir=sinks.scratch())
            content.write(b.column("piece")[k].as_buffer())
    if content is not None:
        yield book, content
        content.close()


def _pieces(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists of about PIECE bytes of their text and pictures."""
    own, size = [], 0
    for r in rows:
        own.append(r)
        size += 100 + sum(len(x) for x in r if isinstance(x, str | bytes))
        if size >= PIECE:
            yield own
            own, size = [], 0
    if own:
        yield own


def _rows(df: DataFrame, schema: str, kinds: list[pa.DataType], f) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book, content in _spooled(batches):
            for own in _pieces(f(book, content)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own, strict=True), kinds, strict=True)], names)

    content = F.coalesce("content", F.lit(b""))
    cuts = F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.length(content) - 1) / PIECE).cast("int"))
    return df.select("book", F.posexplode(F.transform(cuts, lambda k: F.substring(content, k * PIECE + 1, F.lit(PIECE)))).alias("n", "piece")).mapInArrow(run, schema)


def documents(epubs: DataFrame) -> DataFrame:
    """A row for each spine document of each file."""

    def rows(book: str, content: IO[bytes]) -> Iterator[tuple]:
        try:
            yield from ((book, *r, None) for r in spine_rows(content))
        except (zipfile.BadZipFile, ValueError, KeyError, ElementTree.ParseError) as e:
            yield book, None, None, None, 0, [], [], None, f"{type(e).__name__}: {e}"

    s = pa.string()
    return _rows(epubs, DOCUMENTS, [s, pa.int32(), s, s, pa.int32(), pa.list_(s), pa.list_(pa.bool_()), s, s], rows)


def covers(epubs: DataFrame) -> DataFrame:
    """book and image of every declared cover."""

    def rows(book: str, content: IO[bytes]) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(content) as archive:
                items, _, cover = package(archive, package_path(archive))
                if cover in items:
                    yield book, items[cover]["href"]
        except (zipfile.BadZipFile, ValueError, KeyError, ElementTree.ParseError):
            return  # documents() tells of it

    return _rows(epubs, "book string, image string", [pa.string()] * 2, rows)


def images(epubs: DataFrame) -> DataFrame:
    """book, image and content of every image in the files."""
    suffixes = tuple("." + x for x in text.MEDIA)

    def rows(book: str, content: IO[bytes]) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(content) as archive:
                for name in archive.namelist():
                    if posixpath.splitext(name)[1].lower() in suffixes:
                        yield book, name, archive.read(name)
        except zipfile.BadZipFile:
            return

    return _rows(epubs, "book string, image string, content binary", [pa.string(), pa.string(), pa.binary()], rows)


def manifest(documents: DataFrame, covers: DataFrame) -> DataFrame:
    """The page manifest of spine documents, with the preserved body (text_html) of those that are kept as text."""
    pages = routing.classify(documents.where("error IS NULL"), covers)
    return pages.withColumn("text_html", markup.preserved_body(F.col("page_html"))).drop("page_html")


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """The page manifest of all books at a path."""
    epubs = files(spark, path)
    return manifest(documents(epubs), covers(epubs))
