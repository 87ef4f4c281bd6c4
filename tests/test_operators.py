from __future__ import annotations

import io
import sys
import types
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelake import cli
from quirelake.operators import client, engines, images, layout, markup, render, report, routing, structure
from quirelake.plans import book as book_plan
from quirelake.plans import cache, durable
from quirelake.sources import config, epub, pdf, sinks
from quirelake.streaming import landing


def test_running_lines(spark):
    pages = [("b", i, t) for i, t in enumerate(["Head\nx\n1", "Head\ny\n2", "Head\r\nz\n3", "", "other"])] + [("c", 0, "12\nx\n13"), ("c", 1, "z")]
    df = spark.createDataFrame(pages, "book string, index int, text string")
    assert {tuple(r) for r in layout.running_lines(df).collect()} == {("b", "Head"), ("b", "#"), ("c", "#")}
    out = {(r.book, r["index"]): r.text for r in layout.without_running_lines(df).collect()}
    assert out["b", 2] == "z" and out["c", 0] == "x" and out["b", 4] == "other" and out["b", 3] == ""
    assert layout.without_running_lines(df.limit(0)).count() == 0


def test_blocks(spark):
    lines = [("Title", "A <b>title</b>"), ("Text", "one"), ("PageHeader", "head"), ("Text", "two"), ("Figure", "three"), ("Text", " "), ("ListItem", "i"), ("ListItem", "j"), ("Footnote", "f & g"), ("Code", "c")]
    df = spark.createDataFrame([(0, i, t, lab) for i, (lab, t) in enumerate(lines)], "page int, line int, text string, label string")
    made = structure.build_blocks(df, ["page"], "line")
    blocks = made.first().blocks
    assert [(b.type, b.text, b.level) for b in blocks] == [("heading", "A title", 2), ("paragraph", "one", None), ("paragraph", "two three", None), ("list", "i j", None), ("footnote", "f & g", None), ("code", "c", None)]
    xhtml = made.select(structure.blocks_to_xhtml(F.col("blocks")).alias("x")).first().x
    assert xhtml == '<h2>A title</h2>\n<p>one</p>\n<p>two three</p>\n<ul><li>i j</li></ul>\n<aside epub:type="footnote"><p>f &amp; g</p></aside>\n<pre>c</pre>'
    own = spark.createDataFrame([([("list", "a", None, None), ("list", "b", None, None), ("figure", "x", None, None), ("table", "t", None, "<table/>"), ("heading", "h", 9, None)],), ([],)], f"blocks {structure.BLOCK}")
    assert [r.x for r in own.select(structure.blocks_to_xhtml(F.col("blocks")).alias("x")).collect()] == ["<ul><li>a</li><li>b</li></ul>\n<table/>\n<h6>h</h6>", "<p></p>"]


def test_first_region_wins(spark):
    lines = spark.createDataFrame([(0, 0, [0.0, 0.0, 2.0, 2.0]), (0, 1, [8.0, 8.0, 9.0, 9.0])], "page int, line int, box array<double>")
    regions = spark.createDataFrame([(0, 1, [0.0, 0.0, 9.0, 3.0], "Late"), (0, 0, [1.0, 1.0, 3.0, 3.0], "First")], "page int, region int, box array<double>, label string")
    got = {r.line: r.label for r in structure.labelled(lines, regions, ["page"], "line", "region").collect()}
    assert got == {0: "First", 1: "Text"}


def test_classify(spark):
    rows = [
        (0, "Cover.xhtml", 5, ["i.png"], [True]), (1, "h", 199, ["Title.png"], [True]), (2, "h", 200, ["i.png"], [True]), (3, "h", 12, [], []), (4, "h", 11, [], []), (5, "h", 399, ["j.png", "gone.png", "k.png"], [True, False, True]),
        (6, "h", 249, ["l.png", "gone.png"], [True, False]), (7, "h", 3, ["gone.png"], [False]),
    ]
    df = spark.createDataFrame([("b", p, "id", h, n, i, t, f"<p>{p}</p>") for p, h, n, i, t in rows], "book string, spine_pos int, idref string, href string, text_len int, images array<string>, present array<boolean>, page_html string")
    got = routing.classify(df).orderBy("index").collect()
    assert [(r["index"], r.type, r.text_len) for r in got] == [(0, "cover", 5), (1, "image", 199), (2, "mixed", 200), (3, "text", 12), (4, "empty", 11), (5, "image", 399), (6, "image", 0), (7, "image", 249)]
    assert got[6].extracted_images == ["page_0007_k.png"] and got[2].extracted_images == [] and got[2].images == ["i.png"]
    assert [r.page_html for r in got] == [None, None, "<p>2</p>", "<p>3</p>", None, None, None, None]
    whole = routing.classify(df.drop("present", "page_html")).orderBy("index").collect()
    assert len(whole) == 11 and whole[6].images == ["gone.png"]
    none, books = spark.createDataFrame([], "book string, type string, extracted_images array<string>, index int"), spark.createDataFrame([("b",)], "book string")
    bad = routing.structural_checks(none, books).first()
    assert not bad.ok and bad.errors == ["no pages"]
    many = spark.createDataFrame([(b, "empty" if i % 2 else "image", [], i) for b in "ab" for i in range(40)], none.schema)
    found = {r.book: r for r in routing.structural_checks(many).collect()}
    assert found["a"].warnings == ["20 empty pages: " + ", ".join(map(str, range(1, 20, 2)))] and found["b"].errors == ["20 pages without image: " + ", ".join(map(str, range(0, 20, 2)))]


def test_routing(spark):
    kinds = ["cover", "image", "image", "image", "image", "empty", "text", "mixed"]
    pages = spark.createDataFrame([("b", i, t) for i, t in enumerate(kinds)], "book string, index int, type string")
    ocr = spark.createDataFrame([("b", 1, " x\n", 0.79), ("b", 2, "x", 0.80), ("b", 3, "x", None), ("b", 4, " ", 0.99)], "book string, index int, text string, mean_conf double")
    got = routing.routed(pages, ocr).orderBy("index").collect()
    assert [(r.mode, r.page_number) for r in got] == [("facsimile", None), ("facsimile", 1), ("reflowable", 2), ("reflowable", 3), ("facsimile", 4), ("preserved", 5), ("preserved", 6)]
    assert [r.ocr_text for r in got] == [None, "x", None, None, None, None, None]


def test_reports(spark):
    scores = spark.createDataFrame([("a", 0.1, 0.2, 0.0), ("b", 0.1, 0.5, 0.1), ("c", 0.4, 0.1, 0.0)], "engine string, cer double, wer double, insertion_rate double")
    assert {r.engine: r.best for r in report.engine_report(scores).collect()} == {"a": True, "b": True, "c": False}
    pages = spark.createDataFrame([("b", i) for i in range(10)], "book string, index int")
    assert [r["index"] for r in report.stride_sample(pages, 4).orderBy("index").collect()] == [int(i * (10 / 4)) for i in range(4)]
    assert report.stride_sample(pages, 20).count() == 10


def test_markup(spark):
    page = "<html><body><style>x</style><h2>T</h2><ul><li>a <p>b</p></li></ul><h5>s</h5>tail<img src='i.png'/><svg><image xlink:href='j.png'/></svg></body></html>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    got = df.select(markup.visible_text(F.col("html")).alias("v"), markup.image_refs(F.col("html")).alias("i"), markup.preserved_body(F.col("html")).alias("b")).collect()
    assert got[0].v == "Ta bstail" and got[0].i == ["i.png", "j.png"]
    assert got[0].b == "<h2>T</h2>\n<p>a b</p>\n<p>b</p>\n<p>s</p>"
    assert tuple(got[1]) == (None, None, None) and got[2].b == "<p></p>"
    assert markup.resolved("OEBPS/text/p.xhtml", "../i/a%20b.png#f") == "OEBPS/i/a%20b.png#f"
    assert markup.repaired("<p>a<b>c</p>d &lt; e\n") == "<p>a<b>c</b></p>d &lt; e"
    assert markup.repaired("<p> </p>") == "<p> </p>" and markup.repaired(" ") is None and markup.repaired(None) is None


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{i}" href="{h}"{p}/>' for i, h, p in [("c", "c.xhtml", ""), ("p", "p.xhtml", ""), ("t", "t.xhtml", ""), ("ic", "i/c.png", ' properties="cover-image"')])
        z.writestr("O/c.opf", f'<package xmlns="urn:p"><metadata><meta name="cover" content="ic"/></metadata><manifest>{items}</manifest><spine><itemref idref="c"/><itemref idref="p"/><itemref idref="missing"/><itemref idref="t"/></spine></package>')
        z.writestr("O/c.xhtml", '<html><body><img src="i/c.png"/></body></html>')
        z.writestr("O/p.xhtml", '<html><body><img src="i/p.png"/><img src="i/none.png"/></body></html>')
        z.writestr("O/t.xhtml", "<html><body><h1>Heading</h1><p>A paragraph of text.</p></body></html>")
        z.writestr("O/i/c.png", b"cover text")
        z.writestr("O/i/p.png", b"page text here")
    return out.getvalue()


def test_epub_there_and_back(spark, tmp_path):
    (tmp_path / "My Book.epub").write_bytes(book())
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    files = epub.files(spark, str(tmp_path / "*.epub"))
    got = epub.ingest(spark, str(tmp_path / "*.epub")).orderBy("index").collect()
    assert [(r.book, r.type) for r in got] == [("My_Book", "cover"), ("My_Book", "image"), ("My_Book", "text")]
    assert epub.documents(files).where("error IS NOT NULL").count() == 1
    assert epub.images(files).count() == 2
    docs = spark.createDataFrame([("b", 0, "p1.xhtml", "One & two", "<html/>"), ("b", 1, "p2.xhtml", "Two", "<html/>")], "book string, index int, file string, title string, xhtml string")
    navs = render.nav_documents(docs.withColumn("page_number", F.col("index") + 1))
    pictures = spark.createDataFrame([("b", "i.png", bytearray(b"1")), ("b", "i.png", bytearray(b"1"))], "book string, name string, content binary")
    sinks.save(sinks.epubs(docs, navs, pictures), str(tmp_path / "out"))
    with zipfile.ZipFile(tmp_path / "out" / "b.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.read("OEBPS/images/i.png") == b"1"
        items, spine, _ = epub.package(z, epub.package_path(z))
        assert [items[x]["href"] for x in spine] == ["OEBPS/p1.xhtml", "OEBPS/p2.xhtml"]


def test_pdf_boundary(spark):
    def reader(content, force_ocr):
        yield pdf.PdfPage("A text layer of this page", 0, 0, 0.0, ((9.0, 5.0, 0, "second"), (0.0, 5.0, 0, "first\n one"), (0.0, 0.0, 1, "image")), b"rendered" if force_ocr else None)
        yield pdf.PdfPage("", 0, 1, 0.95, (), b"scan", "jpeg")

    df = spark.createDataFrame([("b", bytearray(b"x"))], "book string, content binary")
    read = pdf.pages(df, reader)
    got = pdf.manifest(read).orderBy("index").collect()
    assert [(r.type, r.idref, r.extracted_images) for r in got] == [("text", "pdfpage-1", []), ("image", "pdfpage-2", ["page_0002.jpeg"])]
    assert got[0].text_html == "<p>first one</p>\n<p>second</p>" and got[1].text_html is None
    assert [(r.image, bytes(r.content)) for r in pdf.images(read).collect()] == [("page_0002.jpeg", b"scan")]
    forced = pdf.manifest(pdf.pages(df, reader, True), True).orderBy("index").collect()
    assert [r.extracted_images for r in forced] == [["page_0001.png"], ["page_0002.jpeg"]]


class Rect:
    def __init__(self, width, height):
        self.width, self.height = width, height


def test_pages_of_pdf_by_a_stand_in(monkeypatch):
    """One image that covers an upright page is taken as it is, all else is rendered; text pages have no picture."""

    class Page:
        def __init__(self, said, rotation, images, cover):
            self.said, self.rotation, self.images, self.cover, self.rect = said, rotation, images, cover, Rect(10, 10)

        def get_text(self, kind):
            return self.said if kind == "text" else [(0, 1.5, 9, 2, self.said, 0, 0)]

        def get_images(self, full):
            return self.images

        def get_image_rects(self, ref):
            if self.cover is None:
                raise ValueError("odd image")
            return [Rect(10, self.cover)]

        def get_pixmap(self, dpi):
            return types.SimpleNamespace(tobytes=lambda kind: f"{kind}{dpi}".encode())

    class Doc(list):
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None
        extract_image = lambda self, ref: {"image": b"own", "ext": "JPG"}

    own = [Page("x" * 24, 0, [(1,)], 10), Page("few", 0, [(1,)], 9), Page("", 0, [(1,)], 8), Page("", 90, [(1,)], 10), Page("", 0, [(1,), (2,)], 10), Page("", 0, [(1,)], None)]
    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda stream, filetype: Doc(own)))
    got = list(pdf.fitz_reader(b"x"))
    assert [(p.bitmap, p.extension) for p in got] == [(None, "png"), (b"own", "jpg"), *[(b"png300", "png")] * 4]
    assert next(pdf.fitz_reader(b"x", True)).bitmap == b"own"
    monkeypatch.delitem(sys.modules, "pymupdf")
    with pytest.raises(ImportError):
        list(pdf.fitz_reader(b"x"))


def test_engines_and_cache(spark, tmp_path):
    class Faulty(engines.FakeEngine):
        def recognise(self, image):
            if image == b"bad":
                raise OSError("broken")
            return super().recognise(image)

    df = spark.createDataFrame([(1, bytearray(b"good one")), (2, bytearray(b"bad"))], "id int, content binary")
    got = {r.id: r for r in engines.run_engine(df, Faulty, ["id"]).collect()}
    assert got[1].text == "good one" and got[1].words[0].text == "good" and got[2].error == "OSError: broken"
    with pytest.raises(ValueError):
        engines.get_engine("nothing")
    with pytest.raises(NotImplementedError):
        engines.get_engine("paddle")
    seen = spark.sparkContext.accumulator(0)
    work = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b")], "key string, text string")

    def compute(w):
        seen.add(w.count())
        return w.select("key", F.upper("text").alias("said"))

    for _ in range(2):
        out = cache.through_cache(work, str(tmp_path / "cache"), compute, "key string, said string")
        assert sorted(r.said for r in out.collect()) == ["A", "A", "B"]
    assert seen.value == 2
    cache.through_cache(work, str(tmp_path / "cache"), compute, "key string, said string", force=True).count()
    assert seen.value == 4


def test_failures_are_tried_again(spark, tmp_path):
    """An error isn't kept in the cache's stead of a result, and a later error doesn't hide an earlier result."""
    work = spark.createDataFrame([("k1",), ("k2",)], "key string")
    schema = "key string, said string, error string"
    run = lambda bad, force=False: {r.key: (r.said, r.error, r.cached) for r in cache.through_cache(work, str(tmp_path / "c"), lambda w: w.select("key", F.when(~F.col("key").isin(bad), F.col("key")).alias("said"), F.when(F.col("key").isin(bad), F.lit("down")).alias("error")), schema, force=force).collect()}
    assert run(["k2"]) == {"k1": ("k1", None, False), "k2": (None, "down", False)}
    assert run([]) == {"k1": ("k1", None, True), "k2": ("k2", None, False)}
    assert run(["k1", "k2"], True) == {"k1": ("k1", None, True), "k2": ("k2", None, True)}


def test_rewrites(spark):
    work = spark.createDataFrame([(1, "a"), (2, None), (3, "bad")], "key int, text string")

    def model():
        def say(x):
            if x == "bad":
                raise OSError("no answer")
            return x.upper()

        return say

    got = {r.key: (r.candidate, r.error) for r in engines.rewrite(work, model, ["key"]).collect()}
    assert got == {1: ("A", None), 2: ("", None), 3: (None, "OSError: no answer")}


def stand_in(monkeypatch, name, **members):
    own = types.ModuleType(name)
    own.__dict__.update(members)
    for k in range(1, name.count(".") + 1):
        parent = name.rsplit(".", k)[0]
        if parent not in sys.modules:
            monkeypatch.setitem(sys.modules, parent, types.ModuleType(parent))
    monkeypatch.setitem(sys.modules, name, own)
    return own


@pytest.fixture
def pillow(monkeypatch):
    picture = lambda data: types.SimpleNamespace(data=data.read(), convert=lambda mode: (mode, data.getvalue()))
    stand_in(monkeypatch, "PIL.Image", open=picture)


def test_tesseract(monkeypatch, pillow):
    data = {"text": ["Two", " ", "words", "?", "odd"], "conf": ["90", "50", 70, -1, "x"], "left": [1, 0, 5, 0, 0], "top": [2, 0, 2, 0, 0], "width": [3, 0, 4, 0, 0], "height": [4, 0, 4, 0, 0]}
    stand_in(monkeypatch, "pytesseract", Output=types.SimpleNamespace(DICT="dict"), image_to_data=lambda page, output_type: data, image_to_string=lambda page: "Two words\n")
    got = engines.get_engine("tesseract").recognise(b"x")
    assert got.text == "Two words\n" and got.mean_conf == pytest.approx(0.8)
    assert [(w.text, w.bbox) for w in got.words] == [("Two", (1, 2, 4, 6)), ("words", (5, 2, 9, 6))]


def surya_modules(monkeypatch, version, **parts):
    monkeypatch.setattr(engines.importlib.metadata, "version", lambda name: version)
    for module, members in parts.items():
        stand_in(monkeypatch, f"surya.{module}", **members)


def test_surya_in_the_process(monkeypatch, pillow, spark):
    line = lambda t, y, c: types.SimpleNamespace(text=t, polygon=[[0, y], [9, y], [9, y + 1], [0, y + 1]], confidence=c)
    page = types.SimpleNamespace(text_lines=[line("Head", 0, 0.9), line(" <b>Body</b> ", 5, None), line("of it", 6, 0.7)])
    region = types.SimpleNamespace(polygon=[[0, 0], [9, 2]], label="PageHeader")
    stand_in(monkeypatch, "torch", cuda=types.SimpleNamespace(is_available=lambda: False), float16="half", float32="single")
    surya_modules(
        monkeypatch, "0.17.1",
        foundation={"FoundationPredictor": lambda device, dtype: (device, dtype)}, detection={"DetectionPredictor": lambda device, dtype: "finds"},
        recognition={"RecognitionPredictor": lambda base: lambda pages, **how: [page] * len(pages) if how["sort_lines"] and how["drop_repeated_text"] and not how["math_mode"] else None},
        layout={"LayoutPredictor": lambda base: lambda pages: [types.SimpleNamespace(bboxes=[region])] * len(pages)},
    )
    own = engines.get_engine("marker", config.Config(ocr={"layout": True}))
    got = own.recognise_all([b"x", b"y"])[1]
    assert own.identity() == "surya-0.17-cpu-layout" and got.text == "Head\n<b>Body</b>\nof it" and got.mean_conf == pytest.approx(0.8)
    assert not engines.get_engine("surya").recognise(b"x").lines
    rows = [([(x.text, list(x.box)) for x in got.lines], [(list(x.box), x.label) for x in got.regions], [])]
    df = spark.createDataFrame([(rows[0],)], f"layout {engines.LAYOUT}")
    assert [(b.type, b.text) for b in df.select(engines.blocks(F.col("layout")).alias("b")).first().b] == [("paragraph", "Body  of it")]
    monkeypatch.setattr(engines.importlib.metadata, "version", lambda name: "0.20.0")
    with pytest.raises(RuntimeError):
        engines.get_engine("surya")


def test_served_surya(monkeypatch, pillow, spark):
    block = lambda **k: types.SimpleNamespace(**{"label": "Text", "polygon": [[0, 0], [2, 2]], "confidence": 0.9} | k)
    page = types.SimpleNamespace(blocks=[block(html="<p>second</p>", reading_order=2, confidence=None), block(html="<h1>first</h1>", label="Title", reading_order=1), block(html="no", skipped=True), block(html="bad", error=True, label="PageFooter")])
    settings = types.SimpleNamespace()
    surya_modules(
        monkeypatch, "0.20.3", settings={"settings": settings}, inference={"SuryaInferenceManager": lambda method: method},
        recognition={"RecognitionPredictor": lambda manager: lambda pages, full_page: [page] * len(pages)},
    )
    own = engines.get_engine("surya2", config.Config(ocr={"layout": True, "surya2_model": "m", "surya2_parallel": "4"}))
    got = own.recognise(b"x")
    assert got.text == "first\n\nsecond" and got.mean_conf == pytest.approx(0.9) and len(got.words) == 2
    assert own.identity() == "surya2-0.20-llamacpp-m-6144-layout" and settings.SURYA_MAX_TOKENS_FULL_PAGE == 6144 and settings.SURYA_INFERENCE_PARALLEL == 4
    df = spark.createDataFrame([(([], [], [(x.label, x.html, x.reading_order, x.skipped) for x in got.items]),)], f"layout {engines.LAYOUT}")
    assert [(b.type, b.text) for b in df.select(engines.blocks(F.col("layout")).alias("b")).first().b] == [("heading", "first"), ("paragraph", "second")]
    monkeypatch.setattr(engines.importlib.metadata, "version", lambda name: "0.17.0")
    with pytest.raises(RuntimeError):
        engines.get_engine("surya2")


def test_chat_and_vlm(monkeypatch):
    asked = []

    class OpenAI:
        def __init__(self, base_url, api_key):
            asked.append((base_url, api_key))
            create = lambda **k: asked.append(k) or types.SimpleNamespace(choices=[types.SimpleNamespace(message=types.SimpleNamespace(content="said" if len(asked) < 4 else None))])
            self.chat = types.SimpleNamespace(completions=types.SimpleNamespace(create=create))
            self.models = types.SimpleNamespace(list=lambda: types.SimpleNamespace(data=[types.SimpleNamespace(id="m1")]))

    stand_in(monkeypatch, "openai", OpenAI=OpenAI)
    cfg = config.Config(endpoints={"a": config.Endpoint("a", "http://127.0.0.1:1/v1")}, roles={"vlm_ocr": "a"}, models={"a": {"vlm_ocr": "eye"}})
    own = engines.get_engine("qwen-vl", cfg)
    got = own.recognise(b"image")
    assert got.text == "said" and got.mean_conf is None and own.identity() == "vlm-eye-2048" and not own.wants_preprocess
    assert asked[0] == ("http://127.0.0.1:1/v1", "none") and asked[1]["temperature"] == 0 and asked[1]["max_tokens"] == 2048 and "presence_penalty" not in asked[1]
    assert asked[1]["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,aW1hZ2U="
    chat = client.Chat(cfg.endpoints["a"])
    assert chat.models() == ["m1"] and chat.cleanup("m", "page") == "said" or asked[-1]["messages"][1]["content"] == "page"
    assert chat.say("m", [], presence_penalty=0.5) == "" and asked[-1]["presence_penalty"] == 0.5


def test_image_steps(monkeypatch):
    """The order of the steps and the settings that call for them; without OpenCV an image passes as it is."""
    done = []

    class Image:
        size = (300, 200)

        def save(self, out, kind):
            out.write(b",".join(done) + kind.encode())

        def resize(self, size):
            done.append(b"%dx%d" % size)
            return self

    did = lambda name: lambda image, **k: done.append(name) or image
    stand_in(monkeypatch, "PIL.Image", open=lambda data: Image())
    stand_in(monkeypatch, "PIL.ImageOps", grayscale=did(b"grey"), exif_transpose=did(b"upright"), autocontrast=did(b"auto"))
    stand_in(monkeypatch, "PIL.ImageEnhance", Contrast=lambda image: types.SimpleNamespace(enhance=lambda f: done.append(b"x%.1f" % f) or image))
    monkeypatch.setattr(images, "_tools", lambda: None)
    assert images.prepared({"contrast": 1.5, "deskew": True, "max_side": 150})(b"x") == b"upright,grey,auto,x1.5,150x100PNG"
    done.clear()
    assert images.prepared({"binarize": "otsu"})(b"x") == b"upright,greyPNG"
    assert [images.skew(x) for x in (-0.2, -2.0, -89.9, -88.0, 1.0)] == pytest.approx([0, 2.0, 0, -2.0, -1.0])
    assert images.size_within(10, 20, 20) == (10, 20) and images.size_within(4000, 10, 1000) == (1000, 2)


def test_build_with_rewrites(spark, tmp_path):
    pages = spark.createDataFrame(
        [("b", 0, "cover", ["c.png"], None), ("b", 1, "image", ["p.png"], None), ("b", 2, "image", ["q.png"], None), ("b", 3, "text", [], "<h1>Own</h1>"), ("b", 4, "image", ["r.png"], None), ("b", 5, "empty", [], None)],
        "book string, index int, type string, extracted_images array<string>, text_html string",
    )
    lines = ([("A heading", [0.0, 0.0, 9.0, 1.0]), ("Body text", [0.0, 5.0, 9.0, 6.0])], [([0.0, 0.0, 9.0, 2.0], "Title")], [])
    ocr = [("b", 0, "Run\nThe cover", 0.99, None), ("b", 1, "Run\nA heading\nBody text", 0.9, lines), ("b", 2, "Run\nOnly plain\ntext here", None, None), ("b", 4, "Run\nunsure", 0.2, None)]
    docs = book_plan.reading(pages, spark.createDataFrame(ocr, book_plan.OCR))
    got = {r["index"]: r for r in docs.collect()}
    assert got[1].body == "<h2>A heading</h2>\n<p>Body text</p>" and got[2].body == "<p>Only plain text here</p>" and got[3].body == "<h1>Own</h1>"
    assert (got[0].title, got[0].ocr_text, got[4].mode, got[4].ocr_text, 5 in got) == ("Cover", None, "facsimile", "unsure", False)
    said = spark.createDataFrame([("b", 1, "<h1>A heading</h1><p>Body text</p>"), ("b", 2, "<p>Something else entirely, made up</p>"), ("b", 3, "<p>x</p>")], "book string, index int, candidate string")
    judged = {r["index"]: r for r in book_plan.judged(docs, book_plan.rewrites(said)).collect()}
    assert judged[1].body == "<h1>A heading</h1><p>Body text</p>" and not judged[1].held
    assert judged[2].held and judged[2].body == got[2].body and judged[3].body == "<h1>Own</h1>" and not judged[3].held
    held = book_plan.judged(docs, book_plan.rewrites(spark.createDataFrame([("b", 2, " ")], said.schema)))
    assert report.routing_summary(held).first().held == 1
    shown = spark.createDataFrame([("b", n, bytearray(b"1")) for n in ("c.png", "p.png", "r.png")], "book string, name string, content binary")
    names = book_plan.titles(pages, spark.createDataFrame([("b", "x/My.Book.epub")], "book string, path string"))
    made = book_plan.written(docs, shown, names, "de", "urn:isbn:1").first().content
    with zipfile.ZipFile(io.BytesIO(bytes(made))) as z:
        package = z.read("OEBPS/content.opf").decode()
        assert "<dc:title>My.Book</dc:title>" in package and "<dc:language>de</dc:language>" in package and "urn:isbn:1" in package
        assert {x for x in z.namelist() if "images/" in x} == {"OEBPS/images/c.png", "OEBPS/images/r.png"}
        assert 'lang="de"' in z.read("OEBPS/page_0002.xhtml").decode() and '<span epub:type="pagebreak"' in z.read("OEBPS/page_0003.xhtml").decode()


def test_checks_and_reports(tmp_path, monkeypatch):
    found = sinks.judged('{"messages": [{"severity": "ERROR", "message": "e"}, {"severity": "FATAL", "message": "f"}, {"severity": "WARNING", "message": "w"}, {"severity": "INFO", "message": "i"}]}')
    assert not found.ok and found.errors == ("e", "f") and found.warnings == ("w",)
    assert sinks.judged("{}").ok and sinks.judged("no json", 1, " broken ").note == "broken" and sinks.judged("no json", 0).ok
    monkeypatch.delenv("EPUBCHECK_JAR", raising=False)
    assert "EPUBCHECK_JAR" in sinks.epubcheck("x.epub").note
    sinks.write_json({"ä": [1]}, str(tmp_path / "a/b.json"))
    assert (tmp_path / "a/b.json").read_text(encoding="utf-8") == '{\n  "ä": [\n    1\n  ]\n}'
    table = report.report_table([{"engine": "a", "n": 2, "cer": 0.12345, "wer": 0.5, "insertion_rate": 0.0, "best": True}, {"engine": "b", "error": "init: none"}]).split("\n")
    assert table[2] == "a           |  2 | 0.123 | 0.500 | 0.000  | best" and table[3].endswith("| init: none")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "My Book.epub").write_bytes(book())
    out = str(tmp_path / "work")
    cli.main(["ingest", str(tmp_path / "My Book.epub"), "--out", out])
    cli.main(["ocr", "--engine", "fake", "--out", out])
    cli.main(["build", "--out", out, "--title", "Given"])
    with zipfile.ZipFile(f"{out}/output/My_Book.epub") as z:
        texts = "".join(z.read(x).decode() for x in z.namelist() if x.endswith(("xhtml", "opf")))
    assert "A paragraph of text." in texts and "<h1>Heading</h1>" in texts and "<dc:title>Given</dc:title>" in texts
    (tmp_path / "gold.json").write_text('{"1": "page text here"}')
    capsys.readouterr()
    cli.main(["eval", "--out", out, "--gold", str(tmp_path / "gold.json"), "--engines", "fake,fake-noisy,tesseract"])
    said = capsys.readouterr().out
    assert "fake        |  1 | 0.000" in said and "init: No module" in said
    with pytest.raises(SystemExit):
        cli.main(["ingest", "x.txt", "--out", out])


def test_config_and_gold(spark, tmp_path, monkeypatch):
    (tmp_path / "config.toml").write_text('root = "books"\n[endpoints.a]\nurl = "http://127.0.0.1:1"\n[endpoints.b]\nurl = "u"\n[endpoints.b.models]\nocr = "m"\n[fidelity]\ncer = 0.2\n')
    own = config.load(str(tmp_path / "config.toml"))
    assert own.role_endpoint("ocr").name == "b" and own.model("ocr") == "m" and own.fidelity.cer == 0.2 and own.root == str(tmp_path / "books")
    monkeypatch.setenv(config.VARIABLE, "x.toml")
    assert str(config.config_path()) == "x.toml" and str(config.config_path("y.toml")) == "y.toml"
    (tmp_path / "gold.json").write_text('{"1": "one", "2": "zwei"}')
    assert sorted(tuple(r) for r in config.read_gold(spark, str(tmp_path / "gold.json")).collect()) == [(1, "one"), (2, "zwei")]


def test_landing_stream(spark, tmp_path):
    pages = spark.createDataFrame([("b", 0, "a-\nb c"), ("b", 1, "x " * 40)], landing.PAGES)
    pages.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        landing.take_up(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {(r.text, r.degenerate) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("ab c", False), ("", True)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_durable_tables(spark):
    df = durable.written(spark.range(5).toDF("n"), "numbers")
    assert df.count() == 5
    durable.discard(df)
