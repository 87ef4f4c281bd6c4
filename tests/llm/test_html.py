from __future__ import annotations

import math
import re
from xml.etree import ElementTree

import pytest

from quirelake.llm import html

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><div><a href="/1">one</a> <a href="/2">two</a></div>
<div><p>A long paragraph of real text, with a <a href="x">link</a> and more of it after that.</p><p>Another one that is fairly long as well.</p></div>
<div><span>short</span></div></body></html>"""


def brute(page):
    """By the definitions, over a strict XML tree, with a recount for every element."""
    root = ElementTree.fromstring(re.sub(r"<(style|title)>.*?</\1>", "", page))
    body = root.find("body")
    texts = lambda e, inside=False: [(x, inside or e.tag == "a") for x in [e.text]] + [y for c in e for y in texts(c, inside or e.tag == "a") + [(c.tail, inside or e.tag == "a")]]
    size = lambda x: len(" ".join((x or "").split()))

    def counts(e):
        t = texts(e)
        return sum(size(x) for x, _ in t), sum(size(x) for x, link in t if link), len(list(e.iter())) - 1, len([x for x in e.iter("a") if x is not e])

    c_b, lc_b, _, _ = counts(body)

    def density(e):
        c, lc, t, lt = counts(e)
        if not c:
            return 0.0
        inner = math.log(c / max(1, c - lc) * lc + lc_b / max(1, c_b) * c + math.e)
        return c / max(1, t) * (math.log(c / max(1, lc) * max(1, t) / max(1, lt), inner) if inner > 1 else 1)

    every = list(body.iter())
    sums = [sum(density(c) for c in e) for e in every]
    best = max(range(len(every)), key=lambda i: (sums[i], -i))
    return " ".join("".join(every[best].itertext()).split()), sums[best]


def test_matches_definitions():
    text, total = brute(PAGE)
    got = html.extract(PAGE)
    assert "".join(got[0].split()) == "".join(text.split())
    assert got[1] == "div" and got[2] == pytest.approx(total)


def test_forgiving_parser():
    tags, parents, inside = html.parse("<ul><li>a<li>b</ul><p><b>x<br><p>y</i><!-- <p> --><script>1<2</script> 3 < 4 &amp; <a")
    assert tags == ["#page", "ul", "li", "li", "p", "b", "br", "p", "script"]
    assert parents == [-1, 0, 1, 1, 0, 4, 5, 0, 0][:7] + [0, 7]
    assert html.text_of(0, tags, inside) == "a\nb\nx\ny 3 < 4 & <a"


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    rows = [(1, None), (2, ""), (3, "no tags at all"), (4, PAGE), (4, PAGE), (5, deep), (6, "<p>" + "word " * 200_000), (7, "<a " * 300), (None, "<body><script>x</script></body>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, html string, text string, n_chars long")
    out = [tuple(x) for x in html.extracted(pages).collect()]
    assert len(out) == len(rows)
    got = {x[0]: x for x in out}
    assert got[1][1:] == (None, None, 0.0, 0) and got[2][1] == "" and got[None][1] == ""
    assert got[3][1] == "no tags at all" and got[5][1] == "deep text" and got[6][4] == 999_999
    assert sum(x == got[4] for x in out) == 2
    assert html.extracted(pages.limit(0)).count() == 0


def test_several_content_blocks():
    menu = "<div>" + "".join(f'<a href="/{i}">item {i}</a> ' for i in range(12)) + "</div>"
    block = lambda name, n: f"<section>{''.join(f'<p>{name} paragraph {i} ' + 'with a good deal of running text ' * 6 + '</p>' for i in range(n))}</section>"
    page = f"<html><body>{menu}<div>{block('first', 6)}{menu}{block('second', 5)}</div>{menu}</body></html>"
    text, tag, _ = html.extract(page)
    lines = text.split("\n")
    assert tag == "section" and "item" not in text
    assert [x.split()[0] for x in lines] == ["first"] * 6 + ["second"] * 5


def random_page(seed):
    """A well-formed page of nested containers, links and runs of text."""
    import random

    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet,", "of", "and"]) for _ in range(n))

    def element(depth):
        tag = r.choice(["div", "section", "span", "article", "td"] if depth < 4 else ["b", "span"])
        inner = "".join(r.choice([lambda: words(r.randint(1, 40)), lambda: f'<a href="/{r.randint(1, 9)}">{words(r.randint(1, 5))}</a>', lambda: element(depth + 1) if depth < 5 else words(2)])() for _ in range(r.randint(1, 5)))
        return f"<{tag}>{inner}</{tag}>"

    return "<html><body>" + "".join(element(0) for _ in range(r.randint(1, 5))) + "</body></html>"


def test_random_pages_match_definitions():
    """The element of the greatest sum and its sum, by a recount for every element."""
    for seed in range(200):
        page = random_page(seed).replace("<td>", "<x-td>").replace("</td>", "</x-td>")
        text, total = brute(page)
        tags, parents, inside = html.parse(page)
        density, sums, body = html.densities(tags, parents, inside)
        best, _ = html.content(parents, density, sums, body)
        assert max(sums[body:]) == pytest.approx(total) and sums[best] == pytest.approx(total)
        assert "".join(html.text_of(best, tags, inside).split()) == "".join(text.split())


def test_slashes_and_unquoted_values():
    tags, parents, inside = html.parse("<body><a href=http://x.y/>link</a> <div/>in it</div><br/><svg><path d=1 /><g/>t</svg><p title='a>b' class=c/d>p</p><img src=a/>")
    assert tags == ["#page", "body", "a", "div", "br", "svg", "path", "g", "p", "img"]
    assert parents == [-1, 0, 1, 1, 1, 1, 5, 5, 1, 1] and inside[2] == ["link"] and inside[3] == ["in it"] and inside[8] == ["p"]


def test_ties_take_the_first(spark):
    half = "<div><p>The same words here.</p><p>And the same again.</p></div>"
    pages = spark.createDataFrame([(1, f"<body>{half}{half}</body>"), (1, f"<body>{half}{half}</body>")], "page_id long, html string")
    out = [tuple(x) for x in html.extracted(pages).collect()]
    assert out[0] == out[1]
    tags, parents, inside = html.parse(f"<body>{half}{half}</body>")
    density, total, body = html.densities(tags, parents, inside)
    assert html.content(parents, density, total, body)[0] == min(i for i in range(len(total)) if total[i] == max(total))


def test_query_extracts_every_page(spark):
    """Each page of a table by itself, in plain Python."""
    from quirelake.llm import queries

    folder = "/root/testdata/sf0.001"
    want = {r.page_id: html.extract(r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.tag, r.density_sum) for r in queries.op3_html(spark, folder).collect()}
    assert got == want and all(x[0] for x in want.values())
