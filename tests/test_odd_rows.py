"""Queries on rows that the tables of the tests don't have."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import metrics
from quirelake.operators import structure
from quirelake.plans import catalog
from tests import oracle


def documents(spark, folder, texts: list[str | None]) -> str:
    rows = [(k, x, "en", f"s{k % 2}", 1) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.coalesce(1).write.parquet(f"{folder}/written")
    next(folder.glob("written/part-*.parquet")).rename(folder / "documents.parquet")
    return str(folder)


def test_blank_pages_have_no_edge_lines(spark, tmp_path):
    sf_dir = documents(spark, tmp_path, ["a\nb", "", "  ", "\n \n", None, "one", " q\n\n"])
    oracle.same(spark, catalog.QUERIES["w5_edge_lines"], catalog.ORACLES["w5_edge_lines"], sf_dir)
    found = catalog.QUERIES["w5_edge_lines"](spark, sf_dir).orderBy("doc_id").collect()
    assert [r.edges for r in found] == ["a|b", None, None, None, None, "one|one", "q|q"]


def test_short_and_long_texts_count_alike(spark):
    long = " ".join(f"w{k % 37} Ä{k % 11}" for k in range(900))
    pairs = [("a b b", "b b b c"), ("", "x"), ("x", ""), (None, "x y"), ("x", None), ("--", "!!"), (long, long + " w1 new"), ("İi ß", "i̇I SS"), (long[:50], long)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    rates = [[r.insertion_rate for r in metrics.insertion_rates(df, "k", "a", "b", most).orderBy("k").collect()] for most in (-1, 20, 1000, 1 << 30)]
    assert rates[0] == rates[1] == rates[2] == rates[3] and rates[0][:6] == [0.5, 1.0, 0.0, 1.0, 0.0, 0.0]
    found = [[tuple(r) for r in metrics.repetition_ratios(df, "k", "b", most).orderBy("k").collect()] for most in (-1, 20, 1 << 30)]
    assert found[0] == found[1] == found[2] and [r[1] for r in found[0]][:6] == [4, 1, 0, 2, 0, 0]
    assert found[0][6][2] == 82 / 1802


def test_pairs_of_one_source_are_spread(spark, tmp_path):
    sf_dir = documents(spark, tmp_path, [f"a {k}" for k in range(400)])
    own = catalog.paired(spark, sf_dir)
    assert "RepartitionByExpression" in own._jdf.queryExecution().optimizedPlan().toString()
    assert own.count() == 398


def test_blocks_of_a_page_take_one_pass(spark):
    box = lambda y: [0.0, float(y), 1.0, float(y)]
    labels = ["Title", "PageHeader", "ListItem", "Figure", None]
    regions = [(box(k), x) for k, x in enumerate(labels)]
    page = [("a", 0), ("b", 0), (" ", 1), (None, 1), ("c<i>", 0), ("h", 1), ("d", 0), ("l", 2), ("m", 2), ("f", 3), ("g", 4), ("p", 9), ("<b></b>", 1), ("<b></b>", 2), ("n", 2)]
    many = [(f"w{k}", 2 * (k % 2)) for k in range(3000)]
    rows = [(k, [(t, box(y)) for t, y in x], regions) for k, x in enumerate((page, [], [(" ", 0)], many))] + [(4, None, None), (5, [("x", None), ("y", box(0))], None)]
    df = spark.createDataFrame(rows, "k int, lines array<struct<text:string,box:array<double>>>, regions array<struct<box:array<double>,label:string>>")
    made = df.select("k", structure.line_blocks(F.col("lines"), F.col("regions")).alias("blocks")).select("k", "blocks", structure.blocks_to_xhtml(F.col("blocks")).alias("xhtml")).orderBy("k")
    found = made.collect()
    assert [(b.type, b.text) for b in found[0].blocks] == [("heading", "a b c"), ("heading", "d"), ("list", "l m"), ("paragraph", "f g p"), ("list", "n")]
    assert found[0].xhtml == "<h2>a b c</h2>\n<h2>d</h2>\n<ul><li>l m</li></ul>\n<p>f g p</p>\n<ul><li>n</li></ul>"
    assert [r.xhtml for r in found[1:3]] + [found[4].xhtml] == ["<p></p>"] * 3 and found[4].blocks == []
    assert found[3].xhtml == "\n".join(f"<h2>w{k}</h2>" if k % 2 == 0 else f"<ul><li>w{k}</li></ul>" for k in range(3000))
    assert found[5].xhtml == "<p>x y</p>"
    assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()  # a fold copies what it has made for every block


def test_a_text_page_of_twelve_characters_stays_in_its_book(spark, tmp_path):
    sf_dir = documents(spark, tmp_path, ["a longer page here", "The shor.", "The sho.", "scanned here", "The shor."])
    oracle.same(spark, catalog.QUERIES["k7_book_to_book"], catalog.ORACLES["k7_book_to_book"], sf_dir)
