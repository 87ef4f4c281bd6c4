"""Page and navigation documents of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text
from quirelake.operators import structure


def pagebreak(number: Column) -> Column:
    n = number.cast("string")
    return F.concat(F.lit('<span epub:type="pagebreak" role="doc-pagebreak" id="page-'), n, F.lit('" aria-label="'), n, F.lit('"></span>'))


#: What hides a text from the eye, but not from a search.
ASIDE = "left:-9999px;position:absolute;"


def xhtml(title: Column, body: Column, lang: str) -> Column:
    head = f'''<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns:epub="http://www.idpf.org/2007/ops" xmlns="http://www.w3.org/1999/xhtml" xml:lang="{lang}" lang="{lang}"><head><title>'''
    return F.concat(F.lit(head), text.escape(title), F.lit("</title></head><body>"), body, F.lit("</body></html>"))


def page_document(mode: Column, title: Column, body: Column, number: Column, image: Column, ocr_text: Column, lang: str = "en") -> Column:
    """XHTML of an output page.

    A facsimile is the image over hidden text; where the image is missing, its
    text in paragraphs that are seen; all else is the body, or an empty paragraph.
    """
    empty = F.lit("")
    mark = F.when(number.isNotNull(), pagebreak(number)).otherwise(empty)
    said = F.coalesce(ocr_text, empty)
    under = F.when(said == "", empty).otherwise(F.concat(F.lit(f'<div class="ocr-text" aria-hidden="false" style="{ASIDE}">'), text.escape(said), F.lit("</div>")))
    picture = F.concat(F.lit('<section epub:type="page"><img style="max-width:100%;" src="images/'), text.escape(image), F.lit('" alt="'), text.escape(title), F.lit('"/>'), under, F.lit("</section>"))
    own = F.coalesce(F.nullif(body, empty), F.lit("<p></p>"))
    facsimile = mode == "facsimile"
    inner = F.when(facsimile & (F.coalesce(image, empty) != ""), picture).otherwise(F.concat(F.lit("<section>"), F.when(facsimile & (said != ""), structure.paragraphs_to_xhtml(said)).otherwise(own), F.lit("</section>")))
    return xhtml(title, F.concat(mark, inner), lang)


def nav_documents(docs: DataFrame, lang: str = "en") -> DataFrame:
    """book and nav: contents of every book and, if any page has a number, the hidden list of pages; docs have book, index, title, page_number, file."""
    item = F.concat(F.lit('<li><a href="'), F.col("file"), F.lit('">'), text.escape(F.col("title")), F.lit("</a></li>"))
    n = F.col("page_number").cast("string")
    numbered = F.when(F.col("page_number").isNotNull(), F.concat(F.lit('<li><a href="'), F.col("file"), F.lit("#page-"), n, F.lit('">'), n, F.lit("</a></li>")))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col("index"), c.alias("x"))))), lambda s: s["x"]), "")
    own = docs.groupBy("book").agg(listed(item).alias("toc"), listed(numbered).alias("pages"))
    pages = F.when(F.col("pages") == "", F.lit("")).otherwise(F.concat(F.lit('<nav hidden="" epub:type="page-list"><ol>'), F.col("pages"), F.lit("</ol></nav>")))
    toc = F.concat(F.lit('<nav id="toc" epub:type="toc"><h1>Contents</h1><ol>'), F.col("toc"), F.lit("</ol></nav>"))
    return own.select("book", xhtml(F.lit("Navigation"), F.concat(toc, pages), lang).alias("nav"))
