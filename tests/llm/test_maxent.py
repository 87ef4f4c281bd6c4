from __future__ import annotations

import math
import pickle
import random

import numpy as np
import pytest

from quirelake.llm import _text, maxent


def sentences(seed, n):
    """A first-order chain over few words: the last word tells much about the next."""
    r = random.Random(seed)
    step = {f"w{i}": [f"w{(3 * i + k) % 50}" for k in range(3)] for i in range(50)}
    out = []
    for _ in range(n):
        w = ["w0"]
        while len(w) < 60:
            w.append(r.choice(step[w[-1]]))
        out.append(" ".join(w))
    return out


def make(spark, texts):
    return spark.createDataFrame([(i, t, 3, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words long, h long")


@pytest.fixture(scope="module")
def model(spark):
    return maxent.trained(make(spark, sentences(1, 1500)))


def test_probabilities_of_all_words_sum_to_one(model):
    bounds = np.array([0, 5])
    context = np.array([3, 7, 990, 1000, 1])
    features = maxent.history(context, bounds)[-1:]
    every = np.arange(maxent.WORDS)
    total = np.exp(maxent.log_probabilities(model, every, np.repeat(features, len(every), axis=0))).sum()
    assert abs(total - 1) < 1e-3


def test_held_out_perplexity(spark, model):
    out = maxent.scored(make(spark, sentences(2, 100)), model).collect()
    perplexity = math.exp(-sum(x.log_prob for x in out) / sum(x.n_words for x in out))
    assert perplexity < 6  # 3 at best, 50 without history
    shuffled = [" ".join(random.Random(i).sample(t.split(), 60)) for i, t in enumerate(sentences(2, 100))]
    worse = maxent.scored(make(spark, shuffled), model).collect()
    assert sum(x.log_prob for x in worse) < 1.5 * sum(x.log_prob for x in out)


def test_batches_match_word_by_word(spark, model):
    texts = sentences(3, 3) + ["zzz unseen w1", "w1"]
    out = {x.doc_id: x.log_prob for x in maxent.scored(make(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        ids = maxent.word_ids(_text.word_hashes(t), model.words, model.ids)
        log = 0.0
        for k in range(len(ids)):
            features = maxent.history(ids[: k + 1], np.array([0, k + 1]))
            log += float(maxent.log_probabilities(model, ids[k : k + 1], features[-1:])[0])
        assert abs(log - out[i]) < 1e-3 * max(1, abs(log))


def test_odd_rows(spark, model):
    docs = make(spark, [None, "", "w1 " * 30_000, "w1", "w1"])
    out = {x.doc_id: x for x in maxent.scored(docs, model).collect()}
    assert out[0].n_words == 0 and out[0].log_prob == 0 and math.isnan(out[1].perplexity)
    assert out[2].n_words == 30_000 and out[3].log_prob == out[4].log_prob
    empty = maxent.trained(docs.limit(0))
    assert maxent.scored(docs.limit(0), empty).count() == 0


def test_every_word_has_its_share(spark):
    r = random.Random(4)
    words = [f"v{i}" for i in range(3000) for _ in range(2 + 300 // (i + 1))] + [f"once{i}" for i in range(500)]
    r.shuffle(words)
    docs = make(spark, [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)])
    model = maxent.trained(docs)
    assert len(model.words) == 3000  # all but those that occur once
    every = sorted(set(words)) + [f"unseen{i}" for i in range(20)]
    out = {every[x.doc_id]: x.log_prob for x in maxent.scored(make(spark, every), model).collect()}
    assert sum(math.exp(out[w]) for w in set(words)) < 1.001  # not a whole slot's probability for each of its words
    mean = lambda start, some: sum(out[f"{start}{i}"] for i in some) / len(some)
    assert mean("v", range(20)) > mean("v", range(1000, 3000)) + 1
    assert mean("v", range(1000, 3000)) > mean("unseen", range(20))


def test_tree_follows_counts():
    counts = np.array([1 << min(i // 40, 20) for i in range(5000)])
    parent, branch, prior = maxent.tree(counts)
    model = maxent.Model(None, None, np.zeros(0), parent, branch, prior, np.zeros((16, maxent.LANES), np.float32))
    log = maxent.log_probabilities(model, np.arange(5000), np.zeros((5000, 3), np.uint64))
    assert np.allclose(np.exp(log), counts / counts.sum(), rtol=1e-3)


def test_probabilities_match_plain_python(spark, model):
    """Word by word with integers and floats of Python, from the paths, hashes and weights alone."""
    full, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = ((x ^ x >> 33) * 0xFF51AFD7ED558CCD) & full
        x = ((x ^ x >> 33) * 0xC4CEB9FE1A85EC53) & full
        return x ^ x >> 33

    n, bits = len(model.parent) - len(model.prior), len(model.table).bit_length() - 1
    texts = sentences(5, 4) + ["w1", "w1 unseen words w2"]
    out = {x.doc_id: x.log_prob for x in maxent.scored(make(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        ids = [int(x) for x in maxent.word_ids(_text.word_hashes(t), model.words, model.ids)]
        log = 0.0
        for k, word in enumerate(ids):
            one, two = (ids[k - j] if k >= j else maxent.START + j for j in (1, 2))
            seen = [mix((one << 2) + 2), mix((((two << 30) + one) << 2) + 3), mix(((two + (1 << 60)) << 2) & full)]
            at = word
            while True:
                node, branch = int(model.parent[at]), int(model.branch[at])
                rows = [(((h ^ mix(node + 1)) * odd) & full) >> (64 - bits) for h in seen]
                z = [float(model.prior[node][b]) + sum(float(model.table[r][b]) for r in rows) for b in range(maxent.BRANCHES)]
                log += z[branch] - math.log(sum(math.exp(max(-60.0, x)) for x in z))
                if node == 0:
                    break
                at = n + node
            if word >= n - len(model.within):
                log += float(model.within[word - (n - len(model.within))])
        assert abs(log - out[i]) < 1e-3 * max(1, abs(log))


def test_gradient_matches_differences():
    """Of the summed loss of a batch, by small changes of every weight."""
    r, n = np.random.default_rng(2), maxent.BRANCHES
    table = r.normal(size=(6, maxent.LANES))
    rows, target = r.integers(0, 6, (3, 20)), r.integers(0, n, 20)
    prior = np.append(r.normal(size=(20, n)), np.full((20, 1), -1e9), axis=1)

    def loss(w):
        z = prior[:, :n] + sum(w[x, :n] for x in rows)
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(20), target]).sum()

    want = np.zeros((6, n))
    for at in np.ndindex(6, n):
        d = np.zeros(table.shape)
        d[at] = 1e-5
        want[at] = (loss(table + d) - loss(table - d)) / 2e-5
    learner = maxent.Learner(table, 1.0)
    learner.table[:, n] = 1e12  # so that a step is a millionth of the gradient
    learner.step(rows, prior, target)
    np.testing.assert_allclose((table - learner.table)[:, :n] * 1e6, want, atol=1e-3)


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_rows_that_repeat_within_a_batch(kind):
    """Gradients and their squares against plain loops: rows met once, many times, by several features, and in shared slots."""
    r, n = np.random.default_rng(7), maxent.BRANCHES
    table = np.append(r.normal(size=(2 * maxent.SLOTS, n)), np.zeros((2 * maxent.SLOTS, 1)), axis=1).astype(kind)
    rows = r.integers(0, len(table), (3, 300))
    rows[:, :40] = r.integers(0, 9, (3, 40))
    rows[1, 50:60] = rows[0, 60:70] + maxent.SLOTS * np.where(rows[0, 60:70] < maxent.SLOTS, 1, -1)
    target = r.integers(0, n, 300)
    prior = np.append(r.normal(size=(300, n)), np.full((300, 1), -1e9), axis=1).astype(kind)
    z = prior[:, :n] + sum(table[x, :n] for x in rows)
    error = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    error[np.arange(300), target] -= 1
    total, want = np.full(len(table), maxent.LITTLE), table[:, :n].astype(float)
    for x in rows:
        for at, e in zip(x, error, strict=True):
            total[at] += (e * e).sum()
    for x in rows:
        for at, e in zip(x, error, strict=True):
            want[at] -= 0.1 * e / math.sqrt(total[at])
    learner = maxent.Learner(table, 0.1)
    learner.step(rows, prior, target)
    np.testing.assert_allclose(learner.table[:, :n], want, atol=1e-4)
    np.testing.assert_allclose(learner.table[:, n], total, rtol=1e-3)


def test_last_places_of_rows():
    """Against a dictionary, with rows met once and many times, most of which share few slots, and again after larger and smaller batches."""
    r = np.random.default_rng(8)
    learner = maxent.Learner(np.zeros((1 << 16, maxent.LANES), np.float32), 0.1)
    learner.slots = np.empty(64, np.int32)
    learner._hold(5000)
    for n in (5000, 1, 0, 700):
        rows = r.integers(0, 1 << 16, n)
        rows[::3] = r.integers(0, 40, len(rows[::3]))
        last = {row: i for i, row in enumerate(rows.tolist())}
        assert learner.last(rows).tolist() == [last[row] for row in rows.tolist()]


def test_rows_of_tables_lie_in_one_line_of_the_cache(model):
    """Of the table that is trained and of the one that tasks unpickle to score; their content is the same."""
    size = maxent.LANES * model.table.itemsize
    there = pickle.loads(pickle.dumps(model))
    np.testing.assert_array_equal(there.table, model.table)
    assert there.parent.tolist() == model.parent.tolist()
    odd = np.frombuffer(bytearray(64 * size + 4), np.float32, offset=4).reshape(-1, maxent.LANES)
    for table in (there.table, maxent.aligned(odd), *(maxent.Learner(x, 0.1).table for x in (odd, there.table))):
        assert table.ctypes.data % maxent.ALIGNED == 0 and maxent.ALIGNED % size == 0


def test_words_are_looked_up_once(spark):
    """Ids that are read again are those of the texts, and give the same scores; a column of the same name is not read."""
    texts = [*sentences(6, 40), None, "", "w1", "w1 once é once", "x " * 200_000]
    docs = spark.createDataFrame([(f"d{i // 2}", t, b"1234") for i, t in enumerate(texts)], "doc_id string, text string, ids binary")
    model = maxent.trained(docs)
    found = {}
    known = maxent.coded(docs, model).toArrow()
    at = 0
    for b in known.to_batches():
        for first, own, bounds in maxent.runs(b.select(["ids"]), model):
            for i in range(len(bounds) - 1):
                found[at + first + i] = own[bounds[i] : bounds[i + 1]].tolist()
        at += len(b)
    assert found == {i: maxent.word_ids(_text.word_hashes(t), model.words, model.ids).tolist() for i, t in enumerate(texts)}
    one, two = (sorted((r.doc_id, r.n_words, r.log_prob) for r in x.collect()) for x in (maxent.scored(docs, model), maxent.scores(docs)))
    assert [x[:2] for x in one] == [x[:2] for x in two] and len(one) == len(texts)
    np.testing.assert_allclose([x[2] for x in one], [x[2] for x in two], rtol=1e-3, atol=1e-6)


def test_ties_and_repeated_rows(spark):
    """Words of equal count get ids by hash, whatever the order of rows; repeated rows count as often as they occur."""
    texts = ["b a", "a b", "d c", "c d"] * 30
    one, two = maxent.trained(make(spark, texts)), maxent.trained(make(spark, texts[::-1]))
    np.testing.assert_array_equal(one.words, two.words)
    np.testing.assert_array_equal(one.ids, two.ids)
    assert one.parent.tolist() == two.parent.tolist()
    out = {x.doc_id: x.log_prob for x in maxent.scored(make(spark, ["a", "b", "c", "d"]), one).collect()}
    assert max(out.values()) - min(out.values()) < 2
