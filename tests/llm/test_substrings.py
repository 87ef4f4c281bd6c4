from __future__ import annotations

import random
from collections import Counter

import pytest

from quirelake.llm import substrings


def brute(texts, width):
    seen: Counter = Counter()
    words = [(t or "").lower().split() for t in texts]
    for w in words:
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for k, w in enumerate(words):
        spans: list = []
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1:] = [i + width, spans[-1][2] + 1]
                else:
                    spans.append([i, i + width, 1])
        out += [(k, *s) for s in spans]
    return out


def make(spark, texts):
    return spark.createDataFrame([(i, t, 1, b"", 2) for i, t in enumerate(texts)], "doc_id long, text string, part int, data binary, batch long")


@pytest.mark.parametrize("size", [1, 2000, 1 << 22])
def test_matches_brute_force(spark, size):
    r = random.Random(size)
    passages = [[f"p{k}x{r.randint(0, 9)}" for _ in range(r.randint(5, 20))] for k in range(6)]
    texts: list = [None, "", "x", "a " * 300, "a " * 20]
    for _ in range(150):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(words))
            words[at:at] = r.choice(passages)
        texts.append(" ".join(words))
    texts += texts[-3:]
    out = substrings.repeated(make(spark, texts), 5, size)
    assert sorted(tuple(x) for x in out.collect()) == sorted(brute(texts, 5))


def test_empty_table_and_null_ids(spark):
    assert substrings.repeated(make(spark, []), 5).count() == 0
    docs = make(spark, ["a b c d e f"] * 2).selectExpr("cast(null as long) doc_id", "text")
    assert [tuple(x) for x in substrings.repeated(docs, 5).collect()] == [(None, 0, 6, 2)] * 2


def test_parts_follow_the_input(spark):
    """However many parts and whatever the batches, the same intervals; a table without statistics has some parts as well."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert substrings.parts_of(docs, 1 << 40) == 4 and substrings.parts_of(docs, 1 << 16) > 4
    assert substrings.parts_of(spark.createDataFrame([(1, "a")], "doc_id long, text string").distinct(), 1 << 40) == 4
    rows = [sorted(map(tuple, substrings.repeated(docs, batch_bytes=size, part_bytes=part).collect())) for size, part in ((1 << 14, 1 << 16), (6 << 20, 1 << 40))]
    assert rows[0] == rows[1] and rows[0]


def test_very_long_texts_and_extra_columns(spark):
    own = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, own, "x", 3), (2, own + " end", "y", 4), (3, "w " * 70_000, None, None)], "doc_id long, text string, batch string, part int")
    got = sorted(map(tuple, substrings.repeated(docs).collect()))
    assert got == [(1, 0, 60_000, 59_951), (2, 0, 60_000, 59_951), (3, 0, 70_000, 69_951)]
