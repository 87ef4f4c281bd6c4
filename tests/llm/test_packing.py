from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest

from quirelake.llm import packing


def brute(rows, weights, window):
    """Deficit round-robin, one round after the other, with exact fractions."""
    queues: dict = {}
    for doc_id, source, text in rows:
        n = len((text or "").split())
        if n:
            queues.setdefault(source, []).append((doc_id, n))
    names = sorted(queues, key=lambda x: (x is not None, x or ""))
    for q in queues.values():
        q.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    flat = {s: [(d, i) for d, n in queues[s] for i in range(n)] for s in names}
    weight = {s: weights.get(s, 1) for s in names}
    total = sum(map(len, flat.values()))
    step = window * max(1, -(-sum(weight.values()) // (window * min(weight.values(), default=1)))) if names else window
    level = {s: Fraction(0) for s in names}  # tokens granted so far, with fractions
    taken = dict.fromkeys(names, 0)
    stream = []
    while len(stream) < total:
        left = Fraction(min(step, total - len(stream)))
        while left:  # grant shares; a queue that runs dry leaves its share to the others
            live = [s for s in names if level[s] < len(flat[s])]
            part = min([left / sum(weight[s] for s in live), *((len(flat[s]) - level[s]) / weight[s] for s in live)])
            for s in live:
                level[s] += part * weight[s]
                left -= part * weight[s]
        carry = Fraction(0)  # the fraction left by a source is handed to the next one
        for s in names:
            before = carry
            carry = (before + level[s]) % 1
            serve = int(before + level[s] - carry)
            stream += [(s, *x) for x in flat[s][taken[s] : serve]]
            taken[s] = serve
    return [(i // window, i % window, s, d, k) for i, (s, d, k) in enumerate(stream)]


def spread(out):
    return [
        (x.window_id, x.window_start + k, x.source, x.doc_id, x.doc_start + k) for x in out for k in range(x.n_tokens)
    ]


def make(spark, rows):
    schema = "doc_id long, source string, text string, window_id string, n long, part string"
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)


@pytest.mark.parametrize("seed", range(4))
def test_matches_sequential_rounds(spark, seed):
    r = random.Random(seed)
    names = [None, "a", "b", "c", "hot"][: r.randint(1, 5)]
    rows = [(i, r.choice([*names, "hot"]), " ".join("w" * r.randint(0, 12)) or r.choice([None, "", " \n"])) for i in range(120)]
    rows.append((500, "hot", " ".join("w" * 400)))
    weights = {s: r.randint(1, 5) for s in names}
    window = r.choice([3, 8, 64])
    out = packing.packed(make(spark, rows), weights, window).collect()
    assert sorted(spread(out), key=lambda x: x[:2]) == brute(rows, weights, window)
    assert all(x.n_tokens > 0 and x.window_start + x.n_tokens <= window for x in out)


def test_mixture_is_held_in_every_window(spark):
    rows = [(i, s, " ".join("w" * (5 + i % 37))) for i in range(300) for s in ("a", "b", "c")]
    out = packing.packed(make(spark, rows), {"a": 6, "b": 3, "c": 1}, 100).collect()
    share: dict = {}
    for x in out:
        share.setdefault(x.window_id, {}).setdefault(x.source, []).append(x.n_tokens)
    for w in range(40):
        assert [sum(share[w][s]) for s in "abc"] == [60, 30, 10]


def test_many_sources(spark):
    """Each with a stretch or two of its own; some run dry together."""
    r = random.Random(9)
    rows = [(i, f"s{r.randrange(400)}", " ".join("w" * r.randint(1, 9))) for i in range(1500)]
    weights = {f"s{k}": 1 + k % 3 for k in range(400)}
    out = packing.packed(make(spark, rows), weights, 16).collect()
    assert sorted(spread(out), key=lambda x: x[:2]) == brute(rows, weights, 16)


def test_look_ups_take_logarithmic_steps():
    """Against sums over all sources, at any number of served tokens and for sources in their order."""
    r = np.random.default_rng(3)
    mix = packing.Mixture(r.integers(1, 10**6, 300), r.integers(1, 9, 300), 2048)
    phases = mix.phases()
    rank, begin, dry, left = phases
    served = packing.Served(mix, phases, 5)
    for source in (5, 6, 40, 299):
        served.move(source)
        at = r.integers(0, int(mix.totals.sum()) + 1, 50)
        own, before = served.bounds(at)
        for g, o, b in zip(at.tolist(), own.tolist(), before.tolist(), strict=True):
            k = int(np.searchsorted(begin, g, "right")) - 1
            upto = lambda i: sum(int(mix.totals[j]) for j in range(i) if rank[j] < k) + sum(int(mix.weights[j]) for j in range(i) if rank[j] >= k) * (g - int(dry[k])) // int(left[k])  # noqa: E731, B023
            assert (o, b) == (upto(source + 1) - upto(source), upto(source))


def test_odd_rows(spark):
    """Null ids and repeats, packed in order: every token has a place of its own; a very long text fills windows."""
    rows = [(None, "a", "x y"), (None, "a", "x"), (1, "a", "p q"), (1, "a", "p q"), (2, "a", "w " * 70_000), (3, "b", None), (4, None, "z")]
    out = packing.packed(make(spark, rows), window=64).collect()
    got = sorted((x.window_id, x.window_start, x.n_tokens) for x in out)
    at = 0
    for window, start, n in got:
        assert (window, start) == divmod(at, 64) and start + n <= 64
        at += n
    assert at == 2 + 1 + 2 + 2 + 70_000 + 1
    assert sum(x.n_tokens for x in out if x.doc_id is None) == 3 and sum(x.n_tokens for x in out if x.doc_id == 1) == 4
    assert {x.source for x in out if x.doc_id == 4} == {None}


def test_odd_tables(spark):
    assert packing.packed(make(spark, []), window=4).count() == 0
    rows = [(None, "a", "x y"), (1, "a", "x"), (1, "a", "x"), (1, None, "p q r")]
    out = packing.packed(make(spark, rows), window=4).collect()
    assert sum(x.n_tokens for x in out) == 7
    with pytest.raises(ValueError):
        packing.packed(make(spark, rows), {"a": 0})
