from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import quality


def make(seed, n):
    """Clean, insulting and junk texts of invented words; all that is trusted is clean."""
    r = random.Random(seed)
    syllables = ["on", "ti", "er", "sha", "ble", "and", "the", "is", "wh", "re"]
    bad = ["moron", "scum", "trash", "idiot"]
    rows, truth = [], {}
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(15, 120))]
        kind = r.choices(["clean", "toxic", "junk"], [8, 1, 1])[0]
        if kind == "toxic":
            for _ in range(r.randint(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        text = " ".join(words)
        if kind == "junk":
            text = "!! ".join(words).upper()
        rows.append((i, text, "x", 1.0))
        truth[i] = kind
    return rows, truth


@pytest.fixture(scope="module")
def corpus(spark):
    rows, truth = make(1, 4000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, score double")
    labels = [(i, int(k != "junk"), int(k == "toxic"), "y") for i, k in truth.items() if i % 3 == 0]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), truth


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    out = quality.classify(docs, labels).where("doc_id % 3 <> 0").collect()
    kept = {k: np.mean([r.keep for r in out if truth[r.doc_id] == k]) for k in ("clean", "toxic", "junk")}
    assert kept["clean"] > 0.97 and kept["toxic"] < 0.05 and kept["junk"] < 0.05


def test_prior_is_estimated(corpus):
    docs, labels, truth = corpus
    model = quality.trained(docs, labels)
    clean = np.mean([k == "clean" for k in truth.values()])
    assert abs(model.prior - clean) < 0.08


def test_prior_of_known_mixture():
    r = np.random.default_rng(0)
    positive = r.normal(2, 1, 4000)
    mixed = np.concatenate([r.normal(2, 1, 6000), r.normal(-3, 1, 4000)])
    count = lambda x: np.bincount(quality._binned(x), minlength=quality.BINS)
    assert abs(quality.estimated_prior(count(mixed), count(positive)) - 0.6) < 0.05


def test_gradient_matches_differences():
    """Of the risk with its clipped part, by small changes of every weight."""
    r = np.random.default_rng(1)
    slots = np.arange(quality.BUCKETS)
    texts = lambda n: (np.arange(n + 1) * 3, r.integers(0, 6, 3 * n))
    positive, unlabelled = texts(40), texts(50)
    for bias in (0.5, -2.0):
        p = quality.Params(batch=40, rate=1.0)
        model = quality.Model(slots, r.normal(size=6), bias, 0.6)
        learner = quality.Learner(model, positive, p, 0)
        learner.past[:] = 1e12  # so that a step is a millionth of the gradient
        rows = np.arange(40)
        learner.random = type("R", (), {"integers": staticmethod(lambda *a: rows)})()

        def risk(w):
            z = [w[-1] - np.array([w[:-1][o[i:j]].sum() for i, j in zip(q[:-1], q[1:], strict=True)]) for q, o in (positive, unlabelled)]
            return 0.6 * np.logaddexp(0, -z[0]).mean() + max(0, np.logaddexp(0, z[1]).mean() - 0.6 * np.logaddexp(0, z[0]).mean())

        before = learner.w.copy()
        want = np.array([(risk(before + d) - risk(before - d)) / 2e-5 for d in np.eye(7) * 1e-5])
        learner.step(*unlabelled, np.arange(50))
        np.testing.assert_allclose((before - learner.w) * 1e6, want, atol=1e-3)


def test_odd_rows(spark, corpus):
    docs, labels, _ = corpus
    odd = spark.createDataFrame([(None, "some text", "x", 0.0), (-1, None, "x", 0.0), (-2, "", "x", 0.0), (-3, "word " * 100_000, "x", 0.0), (-4, "same", "x", 0.0), (-4, "same", "x", 0.0)], docs.schema)
    out = quality.classify(docs.unionAll(odd), labels.unionAll(spark.createDataFrame([(None, 1, 0, "y"), (-1, 1, None, "y"), (-2, None, None, "y")], labels.schema)))
    got = [r for r in out.collect() if r.doc_id is None or r.doc_id < 0]
    assert len(got) == 6 and all(np.isfinite(r.score) for r in got)
    same = [r.score for r in got if r.doc_id == -4]
    assert same[0] == same[1]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.classify(docs, labels.limit(0)).where("NOT keep").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_sample_is_bounded_and_ids_may_be_text(spark, corpus):
    docs, labels, truth = corpus
    good = next(i for i, k in truth.items() if k == "clean" and i % 3 == 0)
    copies = docs.where(f"doc_id = {good}").select("doc_id", "text", "id", "score", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("k"))
    many = docs.unionAll(copies.select("doc_id", F.concat("text", F.lit(" "), "k"), "id", "score"))
    p = quality.Params(max_positives=200)
    assert quality.positives(many, labels, p).count() == 200
    assert len(quality._packed(quality.positives(many, labels, p))[0]) == 201
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), labels.selectExpr("concat('d', doc_id) AS doc_id", "quality", "toxic")
    kept = {r.doc_id for r in quality.classify(*named).where("keep").collect()}
    assert np.mean([f"d{i}" in kept for i, k in truth.items() if k == "clean"]) > 0.97


def test_query_on_held_out_labels(spark):
    """The whole query over a table, held against labels: clean documents stay, most toxic and junk ones go."""
    from quirelake.llm import queries

    folder = "/root/testdata/sf0.1"
    kept = queries.op10_quality(spark, folder).where("keep").select("doc_id", "keep")
    out = spark.read.parquet(f"{folder}/labels.parquet").join(kept, "doc_id", "left").fillna(False, "keep").collect()
    share = lambda f: np.mean([r.keep for r in out if f(r)])
    assert share(lambda r: r.quality == 1 and r.toxic == 0) > 0.985
    assert share(lambda r: r.toxic == 1) < 0.2 and share(lambda r: r.quality == 0) < 0.15


def test_mean_of_the_later_steps():
    learner = quality.Learner(quality.Model(np.arange(quality.BUCKETS), np.zeros(3), 0.0, 0.6), (np.array([0, 1]), np.array([0])), quality.Params(), 0)
    seen = []
    for _ in range(21):
        learner.step(np.array([0, 2]), np.array([0, 1]), np.arange(1))
        seen.append(learner.w.copy())
        n = len(seen)
        first = max(1, (1 << (n + 1).bit_length() - 1) // 2)  # the run before the last one begins here
        np.testing.assert_allclose(learner.mean(), np.mean(seen[first - 1 :], axis=0))
