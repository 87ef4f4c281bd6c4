"""PDF files as page tables, by whichever PDF reader is at hand.

No reader is part of this library. A reader is a function that takes the bytes
of a file, and whether all pages go to recognition, and yields a page at a time;
:func:`fitz_reader` uses PyMuPDF where it is installed.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text
from quirelake.operators import markup, routing

PAGES = "book string, index int, text string, rotation int, n_images int, coverage double, blocks array<struct<x0:double,y0:double,kind:int,text:string>>, bitmap binary, extension string"
DPI = 300


@dataclass(frozen=True)
class PdfPage:
    """A page as a reader finds it; bitmap is its picture, with the extension of its kind, if the page has too little text."""

    text: str
    rotation: int
    n_images: int
    coverage: float
    blocks: tuple[tuple[float, float, int, str], ...] = ()
    bitmap: bytes | None = None
    extension: str = "png"


Reader = Callable[[bytes, bool], Iterator[PdfPage]]


def fitz() -> ModuleType:
    for name in ("pymupdf", "fitz"):
        try:
            return importlib.import_module(name)
        except ImportError:
            continue
    raise ImportError("reading PDF files needs PyMuPDF")


def fitz_reader(content: bytes, force_ocr: bool = False) -> Iterator[PdfPage]:
    """Pages by PyMuPDF. A page that goes to recognition is its only image, taken as it is, if that covers it and isn't rotated; else it is rendered."""
    with fitz().open(stream=content, filetype="pdf") as doc:
        for page in doc:
            said, shown = page.get_text("text"), page.get_images(full=True)
            area = abs(page.rect.width * page.rect.height)
            try:
                covered = max((abs(r.width * r.height) / area for r in page.get_image_rects(shown[0][0])), default=0.0) if len(shown) == 1 and area else 0.0
            except Exception:  # noqa: BLE001 - an image that can't be placed is rendered with its page
                covered = 0.0
            blocks = tuple((b[0], b[1], b[6], b[4]) for b in page.get_text("blocks"))
            bitmap, kind = None, "png"
            if force_ocr or len(" ".join(said.split())) < routing.LEAST_PDF_TEXT:
                if page.rotation == 0 and len(shown) == 1 and covered > routing.COVERAGE:
                    found = doc.extract_image(shown[0][0])
                    bitmap, kind = found["image"], (found.get("ext") or "png").lower()
                else:
                    bitmap = page.get_pixmap(dpi=DPI).tobytes("png")
            yield PdfPage(said, page.rotation, len(shown), covered, blocks, bitmap, kind)


def pages(pdfs: DataFrame, reader: Reader = fitz_reader, force_ocr: bool = False) -> DataFrame:
    """A row for each page of each file (book, content)."""
    block = pa.list_(pa.struct([("x0", pa.float64()), ("y0", pa.float64()), ("kind", pa.int32()), ("text", pa.string())]))
    kinds = {"text": pa.string(), "rotation": pa.int32(), "n_images": pa.int32(), "coverage": pa.float64(), "blocks": block, "bitmap": pa.binary(), "extension": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for book, content in zip(b.column("book").to_pylist(), b.column("content"), strict=True):
                for k, p in enumerate(reader(content.as_py(), force_ocr)):  # a page at a time: pictures are large
                    own = {n: getattr(p, n) for n in kinds} | {"blocks": [dict(zip(("x0", "y0", "kind", "text"), x, strict=True)) for x in p.blocks]}
                    yield pa.RecordBatch.from_arrays([pa.array([book], pa.string()), pa.array([k], pa.int32()), *(pa.array([own[n]], kind) for n, kind in kinds.items())], ["book", "index", *kinds])

    return pdfs.select("book", "content").mapInArrow(run, PAGES)


def _image(read: DataFrame) -> Column:
    return F.concat(text.page_stem(F.col("index")), F.lit("."), F.coalesce("extension", F.lit("png")))


def manifest(read: DataFrame, force_ocr: bool = False) -> DataFrame:
    """Page rows of read pages, in the form of :func:`quirelake.operators.routing.classify`, with the markup of those that have text."""
    length = F.length(text.norm_ws(F.col("text")))
    kind = routing.classify_pdf(length, force_ocr)
    none, pictured = F.array().cast("array<string>"), (kind == "image") & F.col("bitmap").isNotNull()
    stored = F.when(pictured, F.array(_image(read))).otherwise(none)
    return read.select(
        "book",
        "index",
        F.concat(F.lit("pdfpage-"), (F.col("index") + 1).cast("string")).alias("idref"),
        F.lit("").alias("href"),
        kind.alias("type"),
        length.alias("text_len"),
        stored.alias("images"),
        stored.alias("extracted_images"),
        F.when(kind == "text", markup.pdf_html(F.col("blocks"))).alias("text_html"),
    )


def images(read: DataFrame) -> DataFrame:
    """book, image and content of the pictures of pages."""
    return read.where("bitmap IS NOT NULL").select("book", _image(read).alias("image"), F.col("bitmap").alias("content"))
