"""Running headers and footers of books: lines that recur at the edges of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text


def edge_lines(c: Column) -> Column:
    """First and last line of a page, once if they are equal, digits then as #.

    Equality is seen before digits are replaced: a page that begins with "12" and
    ends with "13" gives "#" twice.
    """
    own = text.lines(c)
    both = F.array_compact(F.array(F.try_element_at(own, F.lit(1)), F.try_element_at(own, F.lit(-1))))
    return F.transform(F.array_distinct(both), text.digits_as_hash)


def running_lines(pages: DataFrame, book: str = "book", column: str = "text", min_fraction: float = 0.5) -> DataFrame:
    """(book, line): edge lines of at least max(2, whole part of pages * min_fraction) pages; blank pages count as pages.

    Two lines a page are shuffled, no more.
    """
    need = pages.groupBy(book).agg(F.greatest(F.lit(2), F.floor(F.count("*") * F.lit(min_fraction))).alias("need"))
    counted = pages.select(book, F.explode(edge_lines(F.col(column))).alias("line")).groupBy(book, "line").agg(F.count("*").alias("n"))
    return counted.join(need, book).where("n >= need").select(book, "line")


def strip_lines(c: Column, running: Column) -> Column:
    """A page without the lines that are running ones, wherever they stand; line breaks become line feeds."""
    body = F.regexp_replace(text.unix_lines(c), "\\n\\z", "")
    kept = F.filter(F.split(body, "\n"), lambda x: ~F.array_contains(running, text.digits_as_hash(text.strip(x))) | (text.strip(x) == ""))
    return F.array_join(kept, "\n")


def without_running_lines(pages: DataFrame, book: str = "book", column: str = "text", min_fraction: float = 0.5) -> DataFrame:
    """Pages with the running lines of their book left out of the text.

    The lines of a book are one array, joined by book; Spark broadcasts them
    only if they are small.
    """
    found = running_lines(pages, book, column, min_fraction).groupBy(F.col(book).alias("_book")).agg(F.collect_list("line").alias("_running"))
    joined = pages.join(found, pages[book].eqNullSafe(found["_book"]), "left")
    running = F.coalesce("_running", F.array().cast("array<string>"))
    return joined.withColumn(column, strip_lines(F.col(column), running)).select(pages.columns)
