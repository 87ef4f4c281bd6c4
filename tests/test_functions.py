from __future__ import annotations

import hashlib
import html
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelake.functions import metrics, text

ODD = ["", " ", "a", "a  b\x1cc ", "ab-\ncd", "a-\nb-\nc", "é-\nü", "x\r\ny\x85z w\n", "12\nx\n13", "One.\nTwo\nthree\n\n\nFour “q”\nfive", "\n\n a \n \n b\t\n", "<p>Hi &amp;lt; &lt;b&gt;</p>", "_x__9²½", "\n"]


def mapped(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.o for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def noise(seed, n, alphabet="ab.\n -\t!"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(n)]


def rejoined(t):
    """By going over lines one by one."""
    out = []
    for part in re.split(r"\n\s*\n", "\n".join(t.splitlines())):
        own = ""
        for line in (x.strip() for x in part.split("\n")):
            if line:
                own = line if not own else own + ("\n" if own[-1] in ".!?\"'’”)]" else " ") + line
        if own:
            out.append(own)
    return "\n\n".join(out)


def test_blanks_tokens_and_lines(spark):
    values = ODD + noise(1, 200)
    assert mapped(spark, text.norm_ws, values) == [" ".join(v.split()) for v in values]
    assert mapped(spark, text.split_ws, values) == [v.split() for v in values]
    assert mapped(spark, text.strip, values) == [v.strip() for v in values]
    assert mapped(spark, text.tokens, values) == [[x.lower() for x in re.findall(r"[^\W_]+", v)] for v in values]
    assert mapped(spark, text.lines, values) == [[x.strip() for x in v.splitlines() if x.strip()] for v in values]
    assert mapped(spark, text.dehyphenate, values) == [re.sub(r"(\w+)-\n(\w+)", r"\1\2", v) for v in values]
    assert mapped(spark, text.norm_ws, [None]) == [None]


def test_rejoin_paragraphs(spark):
    values = ODD + noise(2, 1500)
    assert mapped(spark, text.rejoin_paragraphs, values) == [rejoined(v) for v in values]


def test_markup_and_keys(spark):
    assert mapped(spark, text.escape, ["<a b='\"'>&", "x"]) == [html.escape(x) for x in ["<a b='\"'>&", "x"]]
    assert mapped(spark, text.markup_text, ["<p>a&amp;lt;b</p> <i>c</i>"]) == ["a&lt;b c"]
    full = ["<p>caf&eacute; &copy; &amp;lt; x</p>", "plain", None]
    assert mapped(spark, text.markup_text_all, full) == ["café © &lt; x", "plain", None]
    params = {"z": 1, "a": "é"}
    want = hashlib.sha256(b"content" + json.dumps(params, sort_keys=True).encode() + b"model" + b"v1").hexdigest()[:16]
    assert mapped(spark, lambda c: text.cache_key(c, params, "model", "v1"), ["content"]) == [want]
    assert mapped(spark, text.slug, ["/a/My Book (1).epub", "___.pdf", "a.b.epub"]) == ["My_Book_1", "book", "a.b"]
    assert mapped(spark, text.format_score, [None, 0.125, 0.8], "double") == ["n/a", "0.12", "0.80"]
    assert mapped(spark, text.media_type, ["a/b.JPG", "c", "d.svg"]) == ["image/jpeg", "image/png", "image/svg+xml"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def rate(n, a, b):
    return n / len(a) if a else float(bool(b))


@pytest.fixture(scope="module")
def pairs(spark):
    r = random.Random(4)
    rows = [("", ""), ("", "x"), ("x", ""), ("é 😀", "e 😀"), ("A b c", "a b c")]
    rows += [tuple(" ".join(r.choice(["on", "by", "The", "a,", "é"]) for _ in range(r.randint(0, 8))) for _ in range(2)) for _ in range(150)]
    return rows, spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, b string")


def test_measures(pairs):
    rows, df = pairs
    a, b = F.col("a"), F.col("b")
    got = df.select("i", metrics.cer(a, b).alias("cer"), metrics.wer(a, b).alias("wer"), metrics.length_delta(a, b).alias("delta"), metrics.insertion_rate(a, b).alias("ins"), metrics.agreement(a, b).alias("agree")).orderBy("i").collect()
    by_groups = {x.i: x.insertion_rate for x in metrics.insertion_rates(df, "i", "a", "b").collect()}
    for (x, y), g in zip(rows, got, strict=True):
        p, q = " ".join(x.split()), " ".join(y.split())
        assert g.cer == pytest.approx(rate(edits(p, q), p, q))
        assert g.wer == pytest.approx(rate(edits(x.split(), y.split()), x.split(), y.split()))
        assert g.delta == pytest.approx(rate(abs(len(q) - len(p)), p, q))
        t, u = ([w.lower() for w in re.findall(r"[^\W_]+", v)] for v in (x, y))
        surplus = sum((Counter(u) - Counter(t)).values())
        assert g.ins == by_groups[g.i] == pytest.approx(surplus / len(u) if u else 0)
        s, v = " ".join(sorted(t)), " ".join(sorted(u))
        table = [[0] * (len(v) + 1) for _ in range(len(s) + 1)]
        for m in range(len(s)):
            for n in range(len(v)):
                table[m + 1][n + 1] = table[m][n] + 1 if s[m] == v[n] else max(table[m][n + 1], table[m + 1][n])
        want = 1.0 if not s and not v else 0.0 if not s or not v else 2 * table[-1][-1] / (len(s) + len(v))
        assert g.agree == pytest.approx(want)


def test_repetition_and_gate(spark):
    values = ["a " * 19, "a " * 20, "a " * 7 + "".join(f"w{i} " for i in range(13)), "a " * 8 + "".join(f"w{i} " for i in range(12)), "", "A a " * 10]
    want = [0.0, 1.0, 0.35, 0.4, 0.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    rows = df.select("i", metrics.repetition_ratio(F.col("t")).alias("r")).orderBy("i").collect()
    assert [x.r for x in rows] == pytest.approx(want)
    grouped = metrics.repetition_ratios(df, "i", "t").orderBy("i").collect()
    assert [x.repetition_ratio for x in grouped] == pytest.approx(want)
    assert mapped(spark, lambda c: metrics.gated(c, metrics.repetition_ratio(c)), values) == [v if w <= 0.35 else "" for v, w in zip(values, want, strict=True)]


def test_verdicts(spark):
    df = spark.createDataFrame([("the same text", "<p>the same text</p>"), ("one two three", "<p>one two three four five</p>"), ("a", "")], "a string, b string")
    got = [r.v for r in df.select(metrics.verdict(F.col("a"), F.col("b")).alias("v")).collect()]
    assert [g.ok for g in got] == [True, False, False]
    assert [g.reasons for g in got] == [[], ["cer", "insertion", "length_delta"], ["cer", "length_delta"]]
    df = spark.createDataFrame([(0.85, None), (0.5, 0.8), (0.5, 0.79), (None, None)], "g double, c double")
    got = [r.v for r in df.select(metrics.consensus(F.col("g"), F.col("c")).alias("v")).collect()]
    assert [(g.trusted, g.reason) for g in got] == [(True, "agreement 0.85"), (True, "confidence 0.80"), (False, "agreement 0.50, confidence 0.79"), (False, "agreement n/a, confidence n/a")]
