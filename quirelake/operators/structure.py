"""Blocks of a page from recognised lines and layout regions, and their markup."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text

BLOCK = "array<struct<type:string,text:string,level:int,html:string>>"
DROPPED = ("PageHeader", "PageFooter")
FIGURES = ("Picture", "Figure")
KINDS = {
    "SectionHeader": "heading",
    "Title": "heading",
    "ListItem": "list",
    "Footnote": "footnote",
    "Code": "code",
    "Equation": "code",
    "Table": "table",
}
DEFAULT = "Text"


def int_box(polygon: Column) -> Column:
    """Bounding box of a polygon of [x, y] points, cut to whole numbers; zeros if it has no points."""
    return F.when(F.coalesce(F.size(polygon), F.lit(0)) <= 0, F.array(*[F.lit(0)] * 4)).otherwise(F.transform(box(polygon), lambda x: x.cast("int")))


def box(polygon: Column) -> Column:
    """Bounding box of a polygon: left, top, right, bottom."""
    side = lambda k, f: f(F.transform(polygon, lambda point: point[k]))
    return F.array(side(0, F.array_min), side(1, F.array_min), side(0, F.array_max), side(1, F.array_max)).cast("array<double>")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.get(F.transform(F.array(c), f), 0)


def label_at(x: Column, y: Column, regions: Column) -> Column:
    """Label of the first region, in list order, that holds a point; edges count as inside."""
    inside = lambda r: (r["box"][0] <= x) & (x <= r["box"][2]) & (r["box"][1] <= y) & (y <= r["box"][3])
    return F.coalesce(F.try_element_at(F.filter(regions, inside), F.lit(1))["label"], F.lit(DEFAULT))


def label_of(line_box: Column, regions: Column) -> Column:
    """Label of the first region, in list order, that holds the centre of a line; edges count as inside."""
    return label_at((line_box[0] + line_box[2]) / 2, (line_box[1] + line_box[3]) / 2, regions)


def labelled(lines: DataFrame, regions: DataFrame, page: list[str], line: str, region: str) -> DataFrame:
    """lines (page, line, box) with the label of the first region (page, region, box, label) that holds their centre.

    An equi-join by page with the containment as a further condition: a page has
    few regions.
    """
    r = regions.select(*(F.col(c).alias(f"_{c}") for c in page), F.col(region).alias("_region"), F.col("box").alias("_box"), F.col("label").alias("_label"))
    x, y = (F.col("box")[0] + F.col("box")[2]) / 2, (F.col("box")[1] + F.col("box")[3]) / 2
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in page))
    holds = (F.col("_box")[0] <= x) & (x <= F.col("_box")[2]) & (F.col("_box")[1] <= y) & (y <= F.col("_box")[3])
    met = lines.join(r, same & holds, "left")
    first = F.min_by(F.col("_label"), F.col("_region")).alias("label")
    keys = [*page, line]
    labels = met.groupBy(*keys).agg(first).select(*keys, F.coalesce("label", F.lit(DEFAULT)).alias("label"))
    return lines.join(labels, keys)


def kind_of(label: Column) -> Column:
    out = F.lit("paragraph")
    for name, kind in KINDS.items():
        out = F.when(label == name, F.lit(kind)).otherwise(out)
    return out


def block(label: Column, own: Column, html: Column | None = None) -> Column:
    """One block of a label and its text; only headings have a level."""
    kind = kind_of(label)
    none = F.lit(None).cast("string")
    return F.struct(kind.alias("type"), own.alias("text"), F.when(kind == "heading", F.lit(2)).alias("level"), (none if html is None else html).alias("html"))


def islands(lines: DataFrame, page: list[str], line: str) -> DataFrame:
    """Lines (text, label) merged into blocks: page, block_no, label, text.

    Blank lines don't count, figures are text, neighbours of one label merge by a
    space; headers and footers are dropped only after that, so they part what
    stands on either side of them.
    """
    own = lines.where(text.strip(F.col("text")) != "").withColumn("label", F.when(F.col("label").isin(*FIGURES), F.lit(DEFAULT)).otherwise(F.col("label")))
    order = Window.partitionBy(*page).orderBy(line)
    new = F.when(F.lag("label").over(order).eqNullSafe(F.col("label")), F.lit(0)).otherwise(F.lit(1))
    numbered = own.withColumn("_new", new).withColumn("block_no", F.sum("_new").over(order))
    kept = numbered.where(~F.col("label").isin(*DROPPED))
    parts = F.array_sort(F.collect_list(F.struct(F.col(line).alias("at"), F.col("text").alias("text"))))
    joined = F.array_join(F.transform(parts, lambda x: x["text"]), " ")
    merged = kept.groupBy(*page, "block_no", "label").agg(text.without_inline_tags(joined).alias("text"))
    return merged.where("text <> ''")


def build_blocks(lines: DataFrame, page: list[str], line: str) -> DataFrame:
    """page and blocks: the islands of each page as an array of blocks in their order."""
    own = islands(lines, page, line).withColumn("block", block(F.col("label"), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "block")))
    return own.groupBy(*page).agg(F.transform(ordered, lambda x: x["block"]).alias("blocks"))


def line_blocks(lines: Column, regions: Column) -> Column:
    """The blocks of one page within a row, from its lines (text, box) in reading order and its regions (box, label).

    As :func:`islands` and :func:`build_blocks` make them of tables of lines. A
    line is labelled once, and the lines of a block are cut out between the
    places where labels change, so the work grows with the lines.
    """
    every = F.coalesce(lines, F.array().cast("array<struct<text:string,box:array<double>>>"))
    solid = F.filter(every, lambda x: text.strip(F.coalesce(x["text"], F.lit(""))) != "")
    centred = F.transform(solid, lambda x: F.struct(x["text"].alias("text"), ((x["box"][0] + x["box"][2]) / 2).alias("x"), ((x["box"][1] + x["box"][3]) / 2).alias("y")))
    found = F.transform(centred, lambda x: F.struct(x["text"].alias("text"), label_at(x["x"], x["y"], regions).alias("label")))
    named = F.transform(found, lambda x: F.struct(x["text"].alias("text"), F.when(x["label"].isin(*FIGURES), F.lit(DEFAULT)).otherwise(x["label"]).alias("label")))

    def cut(own: Column) -> Column:
        first = lambda x, i: F.when((i == 0) | (F.get(own, i - 1)["label"] != x["label"]), i)
        return bound(F.filter(F.transform(own, first), lambda i: i.isNotNull()), lambda starts: runs(own, starts))

    def runs(own: Column, starts: Column) -> Column:
        size = lambda i, k: F.coalesce(F.get(starts, k + 1), F.size(own)) - i
        joined = lambda i, k: F.array_join(F.transform(F.slice(own, i + 1, size(i, k)), lambda x: x["text"]), " ")
        made = F.transform(starts, lambda i, k: F.struct(F.get(own, i)["label"].alias("label"), text.without_inline_tags(joined(i, k)).alias("text")))
        return F.filter(made, lambda x: ~x["label"].isin(*DROPPED) & (x["text"] != ""))

    return F.transform(bound(named, cut), lambda x: block(x["label"], x["text"])).cast(BLOCK)


def served_blocks(items: Column) -> Column:
    """Blocks of a served engine's items (label, html, reading_order, skipped), in reading order.

    The text is that of the markup without tags; tables keep their markup, text
    in what is taken for a picture is prose, blocks without text are left out.
    """
    indexed = F.transform(items, lambda x, i: F.struct(F.coalesce(x["reading_order"], F.lit(0)).alias("order"), i.alias("at"), x.alias("item")))
    ordered = F.transform(F.array_sort(indexed), lambda x: x["item"])
    label = lambda x: F.coalesce(F.when(x["label"].isin("", *FIGURES), F.lit(DEFAULT)).otherwise(x["label"]), F.lit(DEFAULT))
    kept = F.filter(ordered, lambda x: ~label(x).isin(*DROPPED) & ~F.coalesce(x["skipped"], F.lit(False)))
    html = lambda x: F.coalesce(x["html"], F.lit(""))
    made = F.transform(kept, lambda x: block(label(x), text.without_inline_tags(html(x)), F.when((label(x) == "Table") & (html(x) != ""), x["html"])))
    return F.filter(made, lambda x: (x["text"] != "") | x["html"].isNotNull())


def paragraphs_to_xhtml(c: Column) -> Column:
    """A paragraph element for each stretch between blank lines; an empty one if there is none."""
    parts = F.filter(F.transform(F.split(c, "\n\n"), text.strip), lambda x: x != "")
    made = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("<p>"), text.escape(x), F.lit("</p>"))), "\n")
    return F.when(F.size(parts) == 0, F.lit("<p></p>")).otherwise(made)


def blocks_to_xhtml(blocks: Column) -> Column:
    """Markup of a page's blocks, an element a line; consecutive list items share a list, figures are left out."""
    nothing = F.lit("")

    def tagged(x: Column) -> Column:
        own, wrap = text.escape(x["text"]), lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
        level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(x["level"], F.lit(2)))).cast("string")
        table = F.when(F.coalesce(x["html"], nothing) != "", x["html"]).otherwise(wrap('<div class="ocr-table"><p>', own, "</p></div>"))
        return (
            F.when(x["type"] == "heading", F.concat(F.lit("<h"), level, F.lit(">"), own, F.lit("</h"), level, F.lit(">")))
            .when(x["type"] == "list", wrap("<li>", own, "</li>"))
            .when(x["type"] == "footnote", wrap('<aside epub:type="footnote"><p>', own, "</p></aside>"))
            .when(x["type"] == "code", wrap("<pre>", own, "</pre>"))
            .when(x["type"] == "table", table)
            .otherwise(wrap("<p>", own, "</p>"))
        )

    def piece(x: Column, opened: Column) -> Column:
        item, figure = x["type"] == "list", x["type"] == "figure"
        close = F.when(~item & opened, F.lit("</ul>")).otherwise(nothing)
        line = F.when(item & opened, nothing).otherwise(F.lit("\n"))
        begin = F.when(item & ~opened, F.lit("<ul>")).otherwise(nothing)
        return F.concat(close, F.when(figure, nothing).otherwise(F.concat(line, begin, tagged(x))))

    def joined(own: Column) -> Column:
        opened = lambda i: F.when(i == 0, F.lit(False)).otherwise(F.get(own, i - 1)["type"] == "list")
        last = F.when(F.get(own, F.size(own) - 1)["type"] == "list", F.lit("</ul>")).otherwise(nothing)
        return bound(F.transform(own, lambda x, i: piece(x, opened(i))), lambda pieces: F.when(~F.exists(pieces, lambda p: p.isNull()), F.concat(F.array_join(pieces, ""), last)))

    out = F.regexp_replace(bound(blocks, joined), "\\A\\n", "")
    return bound(out, lambda x: F.when(F.coalesce(x, nothing) == "", F.lit("<p></p>")).otherwise(x))


def cleaned_body(blocks: Column, page_text: Column) -> Column:
    """Markup of a recognised page: its blocks if it has any, else its cleaned text in paragraphs."""
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, blocks_to_xhtml(blocks)).otherwise(paragraphs_to_xhtml(text.clean_page(page_text)))
