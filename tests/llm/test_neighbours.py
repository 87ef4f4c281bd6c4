from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from quirelake.llm import neighbours


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], "vec_id long, embedding array<float>, id long, score double")


def exact(ids, x, k):
    x = x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    score = x @ x.T
    np.fill_diagonal(score, -9)
    return {i: {ids[j] for j in np.argsort(-score[r], kind="stable")[:k]} for r, i in enumerate(ids)}


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_recall(spark, limit):
    n, p = (1500, neighbours.Params()) if limit else (300, neighbours.Params(degree=12, trees=2, leaf=40, bucket=100, beam_per_bit=5))
    x = np.random.default_rng(3).normal(size=(n, 24)).astype(np.float32)
    ids = [7 * i - 50 for i in range(n)]
    out = neighbours.neighbours(make(spark, list(zip(ids, x.tolist(), strict=True))), p=replace(p, broadcast_bytes=limit)).collect()
    want = exact(ids, x, 10)
    got: dict = {}
    for r in out:
        got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == set(ids) and all(len(g) == 10 for g in got.values())
    assert np.mean([len(got[i] & want[i]) / 10 for i in ids]) > 0.95


def test_both_searches_give_the_same_rows(spark):
    x = np.random.default_rng(8).normal(size=(400, 16)).astype(np.float32)
    df, p = make(spark, list(enumerate(x.tolist()))), neighbours.Params(degree=10, trees=2, leaf=40, bucket=100, beam_per_bit=3)
    rows = [{(r.id, r.rank, r.neighbour) for r in neighbours.neighbours(df, p=replace(p, broadcast_bytes=limit)).collect()} for limit in (64 << 20, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == 4000


def test_all_that_gather_at_a_hub_meet():
    """By every pair, whatever the number of members and blocks."""
    r = np.random.default_rng(1)
    n, degree = neighbours.BLOCK + 300, 4
    x = r.normal(size=(n, 8)).astype(np.float32)
    u, fresh, least = r.permutation(5 * n)[:n], r.random(n) < 0.1, r.normal(size=n).astype(np.float32)
    got: dict = {}
    for a, b, s in neighbours._met(u, fresh, least, x, degree):
        for i, j, k in zip(a, b, s, strict=True):
            got.setdefault(i, {})[j] = max(k, got.get(i, {}).get(j, -9))
    score = x @ x.T
    for i in range(n):
        may = [j for j in range(n) if j != i and (fresh[i] or fresh[j]) and score[i, j] > least[i]]
        want = {u[j] for j in sorted(may, key=lambda j: -score[i, j])[:degree]}
        assert set(sorted(got.get(u[i], {}), key=lambda j: -got[u[i]][j])[:degree]) == want


def test_hubs_and_large_buckets(spark):
    """Vectors of very unlike lengths of their common part, so some are neighbours to many; a bucket beyond its bound."""
    r = np.random.default_rng(4)
    x = (r.normal(size=(3000, 24)) * np.exp(r.normal(size=(3000, 1))) + 0.7).astype(np.float32)
    out = neighbours.neighbours(make(spark, list(enumerate(x.tolist()))), p=neighbours.Params(bucket=100, leaf=100)).collect()
    want, got = exact(list(range(3000)), x, 10), {}
    for o in out:
        got.setdefault(o.id, set()).add(o.neighbour)
    assert np.mean([len(got[i] & want[i]) / 10 for i in want]) > 0.95
    same = [(i, [1.0, 2.0]) for i in range(900)] + [(i, [2.0, -1.0]) for i in range(900, 903)]
    found = neighbours.neighbours(make(spark, same), p=neighbours.Params(bucket=50, leaf=40, degree=10)).collect()
    assert sum(o.id < 900 for o in found) == 9000 and all(o.similarity > 0.999 for o in found if o.id < 900)
    assert sum(o.id >= 900 for o in found) >= 6  # which have no edge to the others


def test_ids_as_text(spark):
    df = spark.createDataFrame([("7", [1.0, 0.0]), ("8", [1.0, 0.1]), ("x", [1.0, 0.2])], "vec_id string, embedding array<float>")
    assert {(r.id, r.neighbour) for r in neighbours.neighbours(df).collect()} == {(7, 8), (8, 7)}


def test_odd_rows(spark):
    one = [1.0, 0.0]
    rows = [(1, one), (1, one), (2, one), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [1.0, float("nan")]), (8, [1.0, 2.0, 3.0]), (None, one), (9, [0.0, 2.0])]
    out = neighbours.neighbours(make(spark, rows)).collect()
    got = {(r.id, r.rank): (r.neighbour, r.similarity) for r in out}
    assert got[1, 1] == (2, 1.0) and got[2, 1] == (1, 1.0) and got[9, 1] == (1, 0.0)
    assert {r.id for r in out} == {1, 2, 3, 9} and len(out) == 12
    assert neighbours.neighbours(make(spark, rows[:1])).count() == 0
    assert neighbours.neighbours(make(spark, [])).count() == 0
