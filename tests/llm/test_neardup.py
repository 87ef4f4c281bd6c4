from __future__ import annotations

import random

from quirelake.llm import neardup


def sets(text):
    w = (text or "").split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows, least):
    """Groups by all pairs of exact Jaccard similarity."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    own = {}
    for i, t in rows:
        own.setdefault(i, []).append(sets(t))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(a and b and len(a & b) / len(a | b) >= least for a in own[i] for b in own[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    sizes: dict = {}
    for i in ids:
        sizes.setdefault(find(i), []).append(i)
    return {i: g for g, m in sizes.items() if len(m) > 1 for i in m}


def make(spark, rows):
    return spark.createDataFrame([(i, t, 7, "n") for i, t in rows], "doc_id long, text string, node long, group_id string")


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randint(0, 3000)
    rows = []
    for i in range(60):
        base = [word() for _ in range(r.randint(20, 200))]
        for _ in range(r.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(len(base) // 40):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    big = [word() for _ in range(120)]
    for _ in range(150):  # more than a small node
        copy = list(big)
        for _ in range(3):
            copy[r.randrange(len(copy))] = word()
        rows.append((len(rows), " ".join(copy)))
    return rows


def test_groups_match_all_pairs(spark):
    rows = corpus()
    got = {x.doc_id: x.group_id for x in neardup.groups(make(spark, rows)).collect()}
    want = brute(rows, 0.6)
    assert sum(got.get(i) == g for i, g in want.items()) >= 0.98 * len(want)
    assert not set(got) - set(brute(rows, 0.45))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, ""), (4, "one"), (5, "One!"), (6, "a b"), (7, "a b c d"), (None, "one"), (None, "one"), (8, "x y z q"), (8, "x y z q"), (9, "word " * 50_000), (10, "word " * 49_999)]
    docs = make(spark, rows)
    got = {x.doc_id: (x.group_id, x.keep) for x in neardup.groups(docs).collect()}
    assert got == {4: (4, True), 5: (4, False), 9: (9, True), 10: (9, False)}
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((x.doc_id or 0) for x in out.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert neardup.groups(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200)], "a long, b long")
    got = {x.doc_id: x.group_id for x in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 200: 100}


def test_trees_follow_the_recall():
    """Of the branching process, drawn at random level by level."""
    assert neardup.Params().trees == 6
    assert neardup.Params(recall=0.99).trees > neardup.Params(recall=0.9).trees
    r, p = random.Random(4), neardup.Params(recall=0.9)

    def together(level):
        if level == 0:
            return True
        count = int(1 / p.similarity) + (r.random() < 1 / p.similarity % 1)
        return any(r.random() < p.similarity and together(level - 1) for _ in range(count))

    met = sum(any(together(p.levels) for _ in range(p.trees)) for _ in range(4000)) / 4000
    assert 0.89 < met < 0.97


def test_query_matches_all_pairs(spark):
    """The query over a table against groups by exact similarity of all pairs."""
    import re

    from quirelake.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+", r.text.lower()))) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {x.doc_id: x.group_id for x in queries.op2_near_duplicates(spark, folder).collect()}
    want = brute(rows, 0.65)
    assert len(want) > 10 and sum(got.get(i) == g for i, g in want.items()) >= 0.95 * len(want)
    assert not set(got) - set(brute(rows, 0.45))
