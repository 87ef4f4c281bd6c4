"""From a manifest and recognised pages to finished books, and rewrites of pages behind the check of their fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import metrics, text
from quirelake.operators import engines, layout, markup, render, routing, structure
from quirelake.sources import sinks

#: What a build needs of recognised pages (book, index) besides text and mean_conf.
OCR = f"book string, index int, text string, mean_conf double, layout {engines.LAYOUT}"


def reading(pages: DataFrame, ocr: DataFrame, floor: float = routing.CONF_FLOOR) -> DataFrame:
    """Output pages with their text, which is without running lines, and body (null for facsimiles).

    Running lines are looked for on image pages only. Blocks, if the engine knew
    them, make the body of a reflowable page, else its cleaned text does; text
    pages keep the markup that they came with.
    """
    shown = ocr.select("book", "index", "text", "mean_conf", "layout").join(pages.where("type = 'image'").select("book", "index"), ["book", "index"], "left_semi")
    clean = layout.without_running_lines(shown)
    docs = routing.routed(pages, clean, floor, ("text", "layout", "text_html", "extracted_images"))
    plain = structure.cleaned_body(engines.blocks(F.col("layout")), F.col("text"))
    kept = routing.body_source(F.col("text_html"), F.lit(None).cast("string"))
    body = F.when(F.col("mode") == "reflowable", plain).when(F.col("mode") == "preserved", kept)
    return docs.withColumn("body", body).withColumn("image", routing.page_image(F.col("extracted_images"))).withColumn("held", F.lit(False)).drop("layout", "text_html", "extracted_images")


def judged(docs: DataFrame, candidates: DataFrame, limits: metrics.Fidelity = metrics.Fidelity()) -> DataFrame:
    """Reflowable pages with the rewrites (book, index, candidate) that are faithful; the others are held and keep their body."""
    made = candidates.select("book", "index", "candidate", F.lit(True).alias("asked"))
    joined = docs.join(made, ["book", "index"], "left")
    verdict = metrics.verdict(F.col("text"), F.col("candidate"), limits)
    asked = (F.col("mode") == "reflowable") & F.coalesce("asked", F.lit(False))
    judged = joined.withColumn("_ok", F.when(asked, verdict["ok"]))
    body = F.when(asked, routing.fallback(F.col("_ok"), F.col("candidate"), F.col("body"))).otherwise(F.col("body"))
    return judged.withColumn("body", body).withColumn("held", asked & ~F.coalesce("_ok", F.lit(False))).select(docs.columns)


def rewrites(found: DataFrame) -> DataFrame:
    """book, index and candidate of the answers of a model, as well-formed markup; null where nothing is left of one."""
    return found.select("book", "index", markup.well_formed(F.col("candidate")).alias("candidate"))


def titles(pages: DataFrame, sources: DataFrame | None = None, given: str | None = None) -> DataFrame:
    """book and title: the given one, else the name of the file (sources: book, path) without its ending."""
    own = pages.select("book").distinct()
    if sources is not None:
        own = own.join(sources.groupBy("book").agg(F.min("path").alias("path")), "book", "left")
    else:
        own = own.withColumn("path", F.lit(None).cast("string"))
    return own.select("book", routing.title(F.lit(given), F.col("path"), F.lit(None).cast("string")).alias("title"))


def written(docs: DataFrame, images: DataFrame | None = None, names: DataFrame | None = None, lang: str = "en", identifier: str | None = None) -> DataFrame:
    """book and content of the EPUB file of every book; images: book, name, content of the pictures that are shown."""
    whole = docs.withColumn("file", F.concat(text.page_stem(F.col("index")), F.lit(".xhtml")))
    xhtml = render.page_document(F.col("mode"), F.col("title"), F.col("body"), F.col("page_number"), F.col("image"), F.col("ocr_text"), lang)
    made = whole.withColumn("xhtml", xhtml)
    if images is not None:  # only those of facsimiles
        shown = docs.where("mode = 'facsimile' AND image IS NOT NULL").select("book", F.col("image").alias("name")).distinct()
        images = images.join(shown, ["book", "name"], "left_semi")
    return sinks.epubs(made, render.nav_documents(made, lang), images, lang, names, identifier)
