"""What becomes of a page: its class, its way into the book, its number and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text

PAGE_TYPES = ("text", "image", "mixed", "cover", "empty")
RECOGNISED = ("image", "cover")
TEXT_PER_IMAGE = 200
LEAST_TEXT = 12
LEAST_PDF_TEXT = 24
COVERAGE = 0.80
CONF_FLOOR = 0.80


def classify(documents: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """Manifest rows of spine documents (book, spine_pos, idref, href, text_len, images and, if there, present).

    A document of images with little text gives a row for each of its images that
    is present in the archive (present: a flag an image; all are, if it is
    missing); else it is text, mixed or empty. Images that are absent count for
    the class. Positions are numbered over the whole book. Covers are the images
    that covers (book, image) names, and the only image of a document that comes
    first, has next to no text and is called cover or title. The markup of
    documents (page_html), if there, stays with those that are kept as text.
    """
    n = F.size("images")
    pictured = (n > 0) & (F.col("text_len") < TEXT_PER_IMAGE * n)
    there = F.col("present") if "present" in documents.columns else F.transform("images", lambda _: F.lit(True))
    shown = F.struct(F.lit(None).cast("string").alias("images"), F.lit(True).alias("present"))
    one = F.when(pictured, F.arrays_zip("images", there.alias("present"))).otherwise(F.array(shown))
    html = [F.when(~pictured, F.col("page_html")).alias("page_html")] if "page_html" in documents.columns else []
    rows = documents.select("book", "spine_pos", "idref", "href", "text_len", "images", *html, pictured.alias("pictured"), F.posexplode(one).alias("image_pos", "one"))
    rows = rows.where("one.present").withColumn("image", F.col("one.images")).drop("one")
    if covers is None:
        rows = rows.withColumn("listed", F.lit(False))
    else:
        known = covers.select(F.col("book").alias("_book"), F.col("image").alias("_image"), F.lit(True).alias("listed")).distinct()
        rows = rows.join(known, (F.col("book") == F.col("_book")) & (F.col("image") == F.col("_image")), "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rows = rows.withColumn("index", F.row_number().over(Window.partitionBy("book").orderBy("spine_pos", "image_pos")) - 1)
    named = F.lower(F.coalesce("href", F.lit("")))
    by_place = (F.col("index") == 0) & (F.size("images") == 1) & (F.col("text_len") < LEAST_TEXT) & (named.contains("cover") | named.contains("title"))
    kind = (
        F.when(F.col("pictured"), F.when(F.col("listed") | by_place, F.lit("cover")).otherwise(F.lit("image")))
        .when(F.col("text_len") >= LEAST_TEXT, F.when(F.size("images") > 0, F.lit("mixed")).otherwise(F.lit("text")))
        .otherwise(F.lit("empty"))
    )
    none = F.array().cast("array<string>")
    kept = F.when(F.col("pictured"), F.array("image")).when(F.col("text_len") >= LEAST_TEXT, F.col("images")).otherwise(none)
    stored = F.when(F.col("pictured"), F.array(output_name(F.col("index"), F.col("image")))).otherwise(none)
    length = F.when(F.col("pictured") & (F.col("image_pos") > 0), F.lit(0)).otherwise(F.col("text_len"))
    html = [F.when(kind.isin("text", "mixed"), F.col("page_html")).alias("page_html")] if "page_html" in documents.columns else []
    return rows.select("book", "index", "idref", "href", kind.alias("type"), length.alias("text_len"), kept.alias("images"), stored.alias("extracted_images"), *html)


def classify_pdf(text_len: Column, force_ocr: bool = False) -> Column:
    return F.when(F.lit(not force_ocr) & (text_len >= LEAST_PDF_TEXT), F.lit("text")).otherwise(F.lit("image"))


def keeps_bitmap(rotation: Column, n_images: Column, coverage: Column) -> Column:
    """Whether a page is one unrotated image, taken as it is instead of rendered."""
    return (rotation == 0) & (n_images == 1) & (coverage > COVERAGE)


def output_name(index: Column, image: Column) -> Column:
    return F.concat(text.page_stem(index), F.lit("_"), text.base_name(image))


def recognised(pages: DataFrame) -> DataFrame:
    """Pages that go to text recognition."""
    return pages.where(F.col("type").isin(*RECOGNISED))


def build_mode(kind: Column, page_text: Column, confidence: Column, floor: float = CONF_FLOOR) -> Column:
    """reflowable, facsimile, preserved or null (left out); an unknown confidence doesn't hold a page back."""
    has_text = text.strip(F.coalesce(page_text, F.lit(""))) != ""
    return (
        F.when(kind == "cover", F.lit("facsimile"))
        .when(kind == "image", F.when(has_text & (confidence.isNull() | (confidence >= floor)), F.lit("reflowable")).otherwise(F.lit("facsimile")))
        .when(kind.isin("text", "mixed"), F.lit("preserved"))
    )


def hidden_text(kind: Column, mode: Column, page_text: Column) -> Column:
    """Text that lies under a facsimile, stripped; none under a cover."""
    own = F.nullif(text.strip(page_text), F.lit(""))
    return F.when((kind == "image") & (mode == "facsimile"), own)


def page_numbers(pages: DataFrame) -> DataFrame:
    """page_number by reading order; empty pages and covers have none and don't count."""
    counts = ~F.col("type").isin("empty", "cover")
    order = Window.partitionBy("book").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("page_number", F.when(counts, F.sum(counts.cast("int")).over(order)))


def routed(pages: DataFrame, ocr: DataFrame, floor: float = CONF_FLOOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """Output pages: book, index, type, mode, page_number, title, ocr_text of pages joined with their recognition (book, index, text, mean_conf).

    keep names further columns of either that are passed on; the text of a page is among them if named.
    """
    own = ocr.select("book", "index", F.col("text").alias("_text"), F.col("mean_conf").alias("_conf"), *(c for c in keep if c in ocr.columns and c != "text"))
    joined = page_numbers(pages).join(own, ["book", "index"], "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    mode = build_mode(F.col("type"), F.col("_text"), F.col("_conf"), floor)
    title = F.when(F.col("type") == "cover", F.lit("Cover")).otherwise(F.concat(F.lit("Page "), F.col("page_number").cast("string")))
    out = joined.where("type <> 'empty'").withColumn("mode", mode)
    more = [F.col("_text").alias("text") if c == "text" else F.col(c) for c in keep]
    return out.select("book", "index", "type", "mode", "page_number", title.alias("title"), hidden_text(F.col("type"), F.col("mode"), F.col("_text")).alias("ocr_text"), *more)


def choose_mode(kind: Column, confidence: Column, held: Column, floor: float = CONF_FLOOR) -> Column:
    """A stricter choice, which also shows held and purely pictorial pages as images."""
    return F.when(kind.isin("cover", "image_only_art") | held | (confidence < floor), F.lit("facsimile")).otherwise(F.lit("reflowable"))


def fallback(ok: Column, rewritten: Column, plain: Column) -> Column:
    """The rewrite if it is faithful, else the text made by rule."""
    return F.when(F.coalesce(ok, F.lit(False)), rewritten).otherwise(plain)


def body_source(text_html: Column, extracted: Column) -> Column:
    return F.coalesce(F.when(text_html != "", text_html), extracted, F.lit("<p></p>"))


def title(given: Column, epub: Column, source_file: Column) -> Column:
    stem = lambda c: F.regexp_replace(text.base_name(c), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.when(given != "", given), stem(F.when(epub != "", epub)), stem(F.when(source_file != "", source_file)), F.lit("book"))


def page_image(extracted_images: Column) -> Column:
    return F.try_element_at(extracted_images, F.lit(1))


def preprocess(asked: Column, engine_default: Column) -> Column:
    return F.coalesce(asked, engine_default)


def structural_checks(pages: DataFrame, books: DataFrame | None = None, most: int = 10) -> DataFrame:
    """A row a book: ok, errors and warnings of its manifest; books (book) adds those without any page.

    Of the pages that are named, each book keeps the first ``most`` of a kind
    before anything is gathered.
    """
    empty, bare = F.col("type") == "empty", F.col("type").isin(*RECOGNISED) & (F.coalesce(F.size("extracted_images"), F.lit(0)) <= 0)
    counts = pages.groupBy("book").agg(F.count("*").alias("n"), F.count_if(empty).alias("empty"), F.count_if(bare).alias("bare"))
    fault = F.when(empty, F.lit("empty")).when(bare, F.lit("bare"))
    first = Window.partitionBy("book", "fault").orderBy("index")
    named = pages.select("book", "index", fault.alias("fault")).where("fault IS NOT NULL").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)
    ten = lambda kind: F.array_join(F.sort_array(F.collect_list(F.when(F.col("fault") == kind, F.col("index")))).cast("array<string>"), ", ")
    lists = named.groupBy("book").agg(ten("empty").alias("empty_ten"), ten("bare").alias("bare_ten"))
    found = counts.join(lists, "book", "left")
    if books is not None:
        found = books.select("book").distinct().join(found, "book", "left").fillna(0, ["n", "empty", "bare"])
    say = lambda n, what, ten: F.concat(F.col(n).cast("string"), F.lit(what), F.col(ten))
    errors = F.array_compact(F.array(F.when(F.col("n") == 0, F.lit("no pages")), F.when(F.col("bare") > 0, say("bare", " pages without image: ", "bare_ten"))))
    warnings = F.array_compact(F.array(F.when(F.col("empty") > 0, say("empty", " empty pages: ", "empty_ten"))))
    return found.select("book", (F.size(errors) == 0).alias("ok"), errors.alias("errors"), warnings.alias("warnings"))
