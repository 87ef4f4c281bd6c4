"""Books whose contents are far more than what may be held while they are written and read."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from quirelake.operators import markup
from quirelake.sources import epub, sinks

PAGES, SIZE = 300, 100_000


def rows(pages: int = PAGES):
    text = lambda k: random.Random(k).randbytes(SIZE // 2).hex()
    one = lambda part, kind, k, name, data: {"book": "b", "part": part, "kind": kind, "index": k, "name": name, "title": "t", "data": data}
    for part in (0, 1):
        yield one(part, sinks._NAV, 0, "nav.xhtml", b"<html/>" if part else None)
        for k in range(pages):
            yield one(part, sinks._PAGE, k, f"p{k}.xhtml", f"<html><body><p>{text(k)}</p></body></html>".encode() if part else None)
        for name in ("a.png", "a.png", "b.png"):
            yield one(part, sinks._PICTURE, 0, name, name.encode() if part else None)


def test_a_book_is_written_and_read_without_holding_it(tmp_path):
    sinks._book(rows(1), "en", None)  # imports what it needs
    tracemalloc.start()
    made = sinks._book(rows(), "en", None)
    assert tracemalloc.get_traced_memory()[1] < PAGES * SIZE / 4
    (tmp_path / "b.epub").write_bytes(made.column("content")[0].as_buffer())
    del made
    tracemalloc.reset_peak()
    n = 0
    with open(tmp_path / "b.epub", "rb") as f:
        for pos, _, href, length, *_, page in epub.spine_rows(f):
            assert (pos, href, length) == (n, f"OEBPS/p{n}.xhtml", SIZE) and len(page) > SIZE
            n += 1
    assert n == PAGES
    assert tracemalloc.get_traced_memory()[1] < PAGES * SIZE / 4
    tracemalloc.stop()


def test_archives_of_several_pieces_and_broken_ones(spark, monkeypatch):
    monkeypatch.setattr(epub, "PIECE", 64)
    text = [(f"b{k % 2}", k, f"p{k}.xhtml", "t", f"<html><body><p>{'word ' * (k + 1)}</p></body></html>") for k in range(9)]
    docs = spark.createDataFrame(text, "book string, index int, file string, title string, xhtml string")
    pictures = spark.createDataFrame([("b1", "x.png", bytearray(b"1")), ("b1", "y.png", bytearray(range(200)))], "book string, name string, content binary")
    books = sinks.epubs(docs, docs.selectExpr("book", "'<html/>' AS nav").distinct(), pictures)
    broken = spark.createDataFrame([("none", None), ("empty", bytearray()), ("no archive", bytearray(b"x" * 300))], "book string, content binary")
    found = epub.documents(books.unionByName(broken)).collect()
    assert sorted((r.book, r.spine_pos, r.text_len) for r in found if r.error is None) == sorted((f"b{k % 2}", k // 2, 5 * (k + 1) - 1) for k in range(9))
    assert {r.book for r in found if r.error} == {"none", "empty", "no archive"}
    assert {(r.image, bytes(r.content)) for r in epub.images(books).collect()} == {("OEBPS/images/x.png", b"1"), ("OEBPS/images/y.png", bytes(range(200)))}


def test_a_batch_of_markup_is_not_held_as_objects():
    text = ["<p>" + random.Random(k).randbytes(5000).hex() + "</p>" if k % 7 else None for k in range(3000)] + ["", "<p>" + "é " * 600_000]
    column = pa.array(text, pa.string())
    want = [None if x is None else markup._squeezed(markup.read(x).texts) for x in text]
    del text
    tracemalloc.start()
    found = markup.by_pieces(column.slice(2), pa.string(), lambda x: markup._squeezed(markup.read(x).texts))
    assert tracemalloc.get_traced_memory()[1] < column.nbytes / 2
    tracemalloc.stop()
    assert found.to_pylist() == want[2:]
    assert markup.by_pieces(column.slice(0, 0), pa.string(), len).to_pylist() == []
