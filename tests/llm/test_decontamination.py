from __future__ import annotations

import random

from quirelake.llm import decontamination

P = decontamination.Params()


def distance(item, words):
    """Least edits of the item to any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(words):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def corpus():
    r = random.Random(2)
    word = lambda: f"w{min(int(r.expovariate(0.02)), 400)}"  # noqa: E731 - some words are very frequent
    items = [[word() for _ in range(r.randint(6, 60))] for _ in range(25)]
    docs = []
    for i in range(150):
        words = [word() for _ in range(r.randint(0, 120))]
        if i % 2:
            leak = list(r.choice(items))
            for _ in range(r.randint(0, int(0.2 * len(leak)))):
                k = r.randrange(len(leak))
                leak[k : k + r.randint(0, 1)] = [f"x{r.randint(0, 10**9)}"] * r.randint(0, 1)
            at = r.randint(0, len(words))
            words[at:at] = leak
        docs.append(words)
    return items, docs


def frames(spark, items, docs):
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, edits int")
    return spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, item_id string, first_word int"), benchmark


def test_recall_against_all_pairs(spark):
    items, docs = corpus()
    want = {(d, i): e for d, w in enumerate(docs) for i, x in enumerate(items) if (e := distance(x, w)) <= int(P.rate * len(x))}
    documents, benchmark = frames(spark, [(i, " ".join(x)) for i, x in enumerate(items)], [(i, " ".join(w)) for i, w in enumerate(docs)])
    for size in (decontamination.SLICE_WORDS, 200):  # in one slice and in many
        got = {(x.doc_id, x.item_id): x.edits for x in decontamination.leaks(documents, benchmark, P, size).collect()}
        assert len(want) > 40
        assert not set(got) - set(want)
        assert len(got) >= 0.95 * len(want)
        kept = {x.doc_id for x in decontamination.without_leaks(documents, benchmark, P, size).collect()}
        assert kept == set(range(len(docs))) - {d for d, _ in got}


def test_odd_rows(spark):
    item = "one two three four five six seven eight"
    items = [(1, item), (1, item), (2, item.upper()), (3, None), (4, ""), (5, "too few words"), (None, "a b c d e f g")]
    docs = [(1, None), (2, ""), (3, f"x {item}! y"), (3, f"x {item}! y"), (4, "too few words"), (None, "a b c d e f g"), (5, "filler " * 30_000 + item)]
    documents, benchmark = frames(spark, items, docs)
    got = sorted((str(x.doc_id), str(x.item_id), x.first_word, x.edits) for x in decontamination.leaks(documents, benchmark).collect())
    assert got == sorted([("3", "1", 1, 0)] * 2 + [("3", "2", 1, 0)] * 2 + [("4", "5", 0, 0), ("None", "None", 0, 0), ("5", "1", 30_000, 0), ("5", "2", 30_000, 0)])
    out = decontamination.without_leaks(documents, benchmark)
    assert out.columns == documents.columns and sorted(x.doc_id for x in out.collect()) == [1, 2]
    assert decontamination.leaks(documents, benchmark.limit(0)).count() == 0
    assert decontamination.without_leaks(documents, benchmark.limit(0)).count() == len(docs)
    assert decontamination.leaks(documents.limit(0), benchmark).count() == 0


def test_edits_wherever_they_are(spark):
    r = random.Random(6)
    items = [[f"w{r.randint(0, 3000)}" for _ in range(n)] for n in (30, 59, 120, 200) for _ in range(5)]
    docs = []
    for x in items:
        most, noise = int(P.rate * len(x)), [f"x{r.randint(0, 10**9)}" for _ in range(40)]
        cut = sorted(r.sample(range(len(x)), len(x) - most))
        more = list(x)
        for _ in range(most):
            more.insert(r.randint(1, len(more) - 1), f"x{r.randint(0, 10**9)}")
        docs += [noise + x[:3] + x[3 + most :] + noise, x[most:] + noise, noise + x[:-most] + noise, noise + [x[i] for i in cut] + noise, noise + more + noise]
    documents, benchmark = frames(spark, [(i, " ".join(x)) for i, x in enumerate(items)], [(i, " ".join(w)) for i, w in enumerate(docs)])
    got = {(x.doc_id, x.item_id): x.edits for x in decontamination.leaks(documents, benchmark).collect()}
    assert got == {(i, i // 5): distance(items[i // 5], w) for i, w in enumerate(docs)}
    assert decontamination.without_leaks(documents, benchmark).count() == 0


def test_short_items_and_stock_phrases(spark):
    """Items below six words leak by exact copies only; phrases that many items share lead to no false leak and hide none."""
    stock = "this is what they often say"
    items = [(1, "yes"), (2, "no way"), (3, "a b c"), *((10 + k, f"{stock} about subject{k} and again {stock} of number{k}") for k in range(40))]
    docs = [(1, "Well, yes!"), (2, "no, way"), (3, "no such way"), (4, "x a b c x"), (5, "a b"), (6, f"{stock} " * 50), (7, f"{stock} about subject7 and again {stock} of number7"), (8, f"so {stock} about subject8 and then {stock} of number8")]
    documents, benchmark = frames(spark, items, docs)
    got = {(x.doc_id, x.item_id): (x.first_word, x.edits) for x in decontamination.leaks(documents, benchmark).collect()}
    want = {(d, i): e for d, t in docs for i, x in items if (e := distance(x.split(), t.lower().replace(",", "").replace("!", "").split())) <= int(P.rate * len(x.split()))}
    assert {k: e for k, (_, e) in got.items()} == want
    assert got[1, 1] == (1, 0) and got[2, 2] == (0, 0) and got[4, 3] == (1, 0) and got[7, 17] == (0, 0)
