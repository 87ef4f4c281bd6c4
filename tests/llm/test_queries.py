from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import packing, quality, queries, secrets
from quirelake.plans import durable
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_registry_has_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_matches_stage_by_stage(spark):
    """The rows of run() against decisions of the stages taken one by one in plain Python."""
    import corpus_pipeline

    table = lambda n: spark.read.parquet(f"{oracle.SF_DIR}/{n}.parquet")
    docs = {r.doc_id: r for r in table("documents").collect()}
    keep = {r.doc_id for r in quality.classify(table("documents"), table("labels")).where("keep").collect()}
    left = {i: r for i, r in docs.items() if i in keep}
    words = {i: r.text.lower().split() for i, r in left.items()}
    runs = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, w in words.items()}
    for i in sorted(left):
        near = {j for j in left if j < i and len(runs[i] & runs[j]) / len(runs[i] | runs[j]) >= 0.6}
        if near:
            left.pop(i)
    items = [" ".join(r.text.lower().split()) for r in table("benchmark").collect()]
    left = {i: r for i, r in left.items() if not any(x in " ".join(words[i]) for x in items)}
    out = corpus_pipeline.run(spark, oracle.SF_DIR).collect()
    assert {r.doc_id for r in out} == set(left)
    masked = {r.doc_id: r.text for r in secrets.redacted(table("documents")).collect()}
    size: dict = {}
    for r in out:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    assert size == {i: len(masked[i].split()) for i in left}
    full: dict = {}
    for r in out:
        full[r.window_id] = full.get(r.window_id, 0) + r.n_tokens
    assert all(full[w] == packing.WINDOW for w in list(sorted(full))[:-1])


CLASHING = ("score", "keep", "group_id", "rep", "whole", "node", "n", "part", "window_id", "item_id", "_id", "id")


def odd(spark, docs):
    """Documents with nulls, empty and very long texts, repeats, and columns named like those that stages use."""
    own = docs.limit(40)
    some = [(None, "a text without an id", None, None, None), (-1, None, "en", "s", 0), (-2, "", "en", None, 0), (-3, "word " * 60_000, "en", "s", None), (-4, "twice the same row of words here", "en", "s", 1), (-4, "twice the same row of words here", "en", "s", 1), (None, None, None, None, None)]
    every = own.unionAll(spark.createDataFrame(some, own.schema))
    for c in CLASHING:
        every = every.withColumn(c, F.lit("x"))
    return durable.written(every, "odd")


def test_stages_take_odd_rows(spark):
    import corpus_pipeline

    docs = odd(spark, spark.read.parquet(f"{oracle.SF_DIR}/documents.parquet"))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), oracle.SF_DIR)
        assert empty.count() == 0 and empty.columns == columns
        docs = durable.written(stage(spark, docs, oracle.SF_DIR), name)
        assert docs.columns == columns and docs.count() <= before
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(-4) <= 1
    last = corpus_pipeline.STAGES[-1][1]
    out = last(spark, docs, oracle.SF_DIR).collect()
    assert sum(r.n_tokens for r in out) == sum(len((r.text or "").split()) for r in docs.collect())
    assert last(spark, docs.limit(0), oracle.SF_DIR).count() == 0


def test_stages_without_labels_or_benchmark(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{oracle.SF_DIR}/documents.parquet").limit(30)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{oracle.SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality-classifier"](spark, docs, str(tmp_path)).count() == 30
    assert stages["benchmark-decontamination"](spark, docs, str(tmp_path)).count() == 30
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_neighbours_against_all_pairs(spark):
    """The query over a table: recall of the exact nearest of every row whose id is divisible by 50."""
    folder = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(t.embedding.to_list()).astype(np.float32)
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    score = x @ x.T
    np.fill_diagonal(score, -9)
    want = {i: set(t.vec_id[np.argsort(-s)[:10]]) for i, s in zip(t.vec_id, score, strict=True)}
    got: dict = {}
    for r in queries.op4_neighbours(spark, folder).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == {i for i in want if i % 50 == 0}
    assert np.mean([len(got[i] & want[i]) / 10 for i in got]) > 0.9


def test_decontamination_against_all_windows(spark):
    """The query over a table: edit distances of all items to all texts that share a word triple with them."""
    from tests.llm.test_decontamination import P, distance

    cut = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+", (t or "").lower())
    triples = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    read = lambda n: spark.read.parquet(f"{oracle.SF_DIR}/{n}.parquet").collect()
    items = {r.item_id: cut(r.text) for r in read("benchmark")}
    known = {i: triples(w) for i, w in items.items()}
    want = {}
    for r in read("documents"):
        words = cut(r.text)
        own = triples(words)
        for i, w in items.items():
            if own & known[i] and (e := distance(w, words)) <= int(P.rate * len(w)):
                want[r.doc_id, i] = e
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op8_decontamination(spark, oracle.SF_DIR).collect()}
    assert got == want and want


def test_every_document_is_scored(spark):
    """The query over a table: every document has a finite score, from which its perplexity follows."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {r.doc_id: r for r in queries.op7_lm_scores(spark, folder).collect()}
    assert set(out) == {r.doc_id for r in docs.collect()}
    assert all(math.isfinite(r.log_prob) and r.log_prob <= 0 for r in out.values())
    assert all(abs(math.exp(-r.log_prob / r.n_words) - r.perplexity) < 1e-6 * r.perplexity for r in out.values() if r.n_words)
