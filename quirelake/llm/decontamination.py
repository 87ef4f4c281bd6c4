"""Benchmark decontamination by edit distance over words.

A document leaks an item of n words if, from some word on, a stretch of it is
within floor(rate * n) word edits of the item. The search:

1. Words are hashed. Windows of the length of an item can only match if they
   hold n - 2 - 3 * edits of its word triples at least (each edit spoils three),
   so the windows with fewer triples of any item are passed over. This bound is
   exact, and it leaves few windows of few documents. An item and a text are
   only met if they share one of the item's 3 * edits + 1 rarest triples, which
   a leak can't miss all of; so stock phrases of many items lead to nothing.
   Items of one or two words, which have no triple, are looked up as they are.
2. Every remaining window is embedded by CGK random walks (Chakraborty,
   Goldenberg and Koucky, 2016): at step j the word under the pointer is
   emitted and the pointer moves on by a random bit of (j, word), so strings
   that are close by edits are close by Hamming distance. Items are embedded by
   the same walks.
3. Bit-sampling LSH: a table is keyed by a few sampled steps of a walk. Tables
   are repeated, some to a walk; window and item of a common key are a candidate
   pair. Most leaks are met here, which tells how few edits are to be beaten.
4. Every candidate pair is verified by its exact edit distance.
5. All windows that the triple bound leaves for a text and an item, at the edits
   found so far or at the limit, are verified too, so no leak is missed
   wherever its edits are, and the edits and the first word are the least.

Plan: one scan of the documents, no shuffle. The benchmark is broadcast in
slices of at most ``SLICE_WORDS`` words; one that is larger is searched in
several passes, each with a slice.

Since all windows are verified, the recall is that of a comparison of every text
with every item; the tables only settle early how few edits are to be beaten.

Defined results. Null and empty texts leak nothing. Items that are null or have
fewer than ``least_words`` words are not searched for; those of up to six words
leak by an exact copy only, since no edit is allowed. Items of the same text are all reported; repeated rows of the benchmark are
searched once, repeated documents are each reported. Null doc_id and item_id
are kept as they are. Columns other than those named are not read by
:func:`leaks` and are passed on by :func:`without_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirelake.llm import _text

SLICE_WORDS = 2_000_000
_U = np.uint64
_BITS = 22


@dataclass(frozen=True)
class Params:
    rate: float = 0.15
    least_words: int = 1
    walks: int = 5
    tables: int = 4
    samples: int = 2
    seed: int = 11


class Items:
    """A slice of the benchmark, indexed."""

    def __init__(self, ids: list, words: list[np.ndarray], p: Params) -> None:
        self.p, self.ids = p, ids
        self.words = words
        self.size = np.array([len(x) for x in words], np.int64)
        self.edits = np.floor(p.rate * self.size).astype(np.int64)
        self.need = np.maximum(1, self.size - 2 - 3 * self.edits)
        self.own = [np.unique(_text.rolling(x, 3)) for x in words]
        owner = np.repeat(np.arange(len(words)), [len(x) for x in self.own])
        flat = np.concatenate(self.own)
        self.triples, back, common = np.unique(flat, return_inverse=True, return_counts=True)
        # of each item, the rarest triples; at most 3 * edits can be missing from a leak
        order = np.lexsort((flat, common[back], owner))
        nth = np.arange(len(flat)) - np.searchsorted(owner, owner)
        order = order[nth <= 3 * self.edits[owner]]
        order = order[np.argsort(flat[order], kind="stable")]
        self.rare, self.owner = flat[order], owner[order]
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in (1, 2):
            of = np.flatnonzero(self.size == n)
            if len(of):
                key = np.array([_text.rolling(words[i], n)[0] for i in of], np.uint64)
                order = np.argsort(key, kind="stable")
                self.short.append((n, key[order], of[order]))
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(flat >> _U(64 - _BITS)).astype(np.int64)] = True
        # items of like length share walks, over windows of the shortest of them
        step = np.floor(np.log(np.maximum(1, self.size)) / np.log(1.25)).astype(np.int64)
        step[self.size < 3] = -1
        self.classes: list[tuple] = []
        for k in np.unique(step[step >= 0]):
            own = np.flatnonzero(step == k)
            n = int(self.size[own].min())
            padded = np.stack([words[i][:n] for i in own])
            keys = self.keys(padded)
            flat = keys.ravel()
            order = np.argsort(flat, kind="stable")
            longest = int((self.size[own] + self.edits[own]).max())
            self.classes.append((n, longest, int(self.need[own].min()), flat[order], own[order % len(own)], own))

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """LSH keys of windows of words: a row for each table, a column for each window."""
        p, (m, n) = self.p, windows.shape
        random = np.random.default_rng([p.seed, n])
        steps = max(2, int(1.5 * n))
        out = np.empty((p.walks * p.tables, m), np.uint64)
        row = np.arange(m)
        padded = np.concatenate([windows, np.zeros((m, 1), np.uint64)], axis=1)
        for walk in range(p.walks):
            salt = random.integers(1, 1 << 63, steps, dtype=np.uint64) * _U(2) + _U(1)
            emitted = np.empty((steps, m), np.uint64)
            at = np.zeros(m, np.int64)
            for j in range(steps):
                word = padded[row, at]
                emitted[j] = word
                at = np.minimum(n, at + ((word * salt[j]) >> _U(63)).astype(np.int64))
            for t in range(p.tables):
                picked = np.sort(random.choice(steps, min(p.samples, steps), replace=False))
                key = np.full(m, walk * p.tables + t + 1, np.uint64)
                for j in picked:
                    key = _text.mix(key * _U(0x9E3779B97F4A7C15) + emitted[j])
                out[walk * p.tables + t] = key
        return out


def distances(items: list[np.ndarray], stretches: list[np.ndarray], most: int) -> np.ndarray:
    """Least edit distance of each item to any prefix of its stretch, all pairs at once; only distances up to ``most`` are exact.

    Cells further than ``most`` off the diagonal can't be on a path that short, so a row of the table has 2 * most + 1 cells.
    """
    n, width = max(map(len, items)), 2 * most + 1
    a = np.zeros((len(items), n), np.uint64)
    b = np.zeros((len(items), n + width), np.uint64)
    size_a, size_b = np.array([len(x) for x in items]), np.array([len(x) for x in stretches])
    for i, (x, y) in enumerate(zip(items, stretches, strict=True)):
        a[i, : len(x)] = x
        b[i, most : most + len(y)] = y
    lane, far = np.arange(width), n + width
    row = np.broadcast_to(np.where(lane >= most, lane - most, far), (len(items), width)).astype(np.int32)
    out = np.full(len(items), far, np.int32)
    for i in range(n):
        # lane d of row i + 1 is column i + 1 + d - most
        column = i + 1 + lane - most
        new = row + (a[:, i : i + 1] != b[:, i : i + width])
        new[:, column < 1] = far
        new[:, column == 0] = i + 1
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - lane, axis=1) + lane  # insertions
        done = size_a == i + 1
        if done.any():
            out[done] = np.where(column <= size_b[done, None], row[done], far).min(axis=1)
    return out


def expanded(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with left[i] <= j < right[i]."""
    size = right - left
    i = np.repeat(np.arange(len(left)), size)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size - left, size)


def search(column: pa.Array, items: Items) -> list[tuple[int, int, int, int]]:
    """(row, item, first word, edits) of the leaks of a column of texts, the best for each row and item."""
    count = len(items.ids)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    likely: list[np.ndarray] = []  # place in held * count + item, where the text has enough triples of the item
    common: list[np.ndarray] = []  # and where those triples are
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for t in _text.tokenised(column):
        for n, short, of in items.short:
            grams = _text.rolling(t.hashes, n)
            at, own = expanded(*(np.searchsorted(short, grams, side) for side in ("left", "right")))
            doc = np.searchsorted(t.bounds, at, "right") - 1
            within = at + n <= t.bounds[doc + 1]
            for d, x, first in zip(doc[within].tolist(), of[own[within]].tolist(), (at - t.bounds[doc])[within].tolist(), strict=True):
                best.setdefault((t.first + d, x), (0, first))
        triples = _text.rolling(t.hashes, 3)
        at = np.flatnonzero(items.filter[(triples >> _U(64 - _BITS)).astype(np.int64)])
        doc = np.searchsorted(t.bounds, at, "right") - 1
        at, doc = (x[at + 3 <= t.bounds[doc + 1]] for x in (at, doc))
        if len(at):
            known = items.triples[np.minimum(np.searchsorted(items.triples, triples[at]), len(items.triples) - 1)] == triples[at]
            at, doc = at[known], doc[known]
        hit, own = expanded(*(np.searchsorted(items.rare, triples[at], side) for side in ("left", "right")))
        key = np.unique(doc[hit] * count + items.owner[own])
        low, high = (np.searchsorted(doc, key // count, side) for side in ("left", "right"))
        kept = []
        for k, (d, x) in enumerate(zip(key // count, key % count, strict=True)):
            if high[k] - low[k] < items.need[x]:
                continue
            mine = at[low[k] : high[k]]
            mine = mine[np.isin(triples[mine], items.own[x])]
            if len(mine) >= items.need[x]:
                common.append(mine - t.bounds[d])
                kept.append(k)
        key = key[kept]
        docs = np.unique(key // count)
        likely.append((len(held) + np.searchsorted(docs, key // count)) * count + key % count)
        for d in docs:
            low, high = t.bounds[d], t.bounds[d + 1]
            held.append((t.first + int(d), t.hashes[low:high], at[doc == d] - low))
    allowed = np.concatenate([np.zeros(0, np.int64), *likely])
    for n, longest, need, keys, owner, members in items.classes:
        docs = np.unique(allowed[np.isin(allowed % max(1, count), members)] // max(1, count))
        windows, place, first = [], [], []
        for i in docs:
            _, words, at = held[i]
            before = np.zeros(len(words) + longest + 1, np.int64)
            before[at + 1] = 1
            before = np.cumsum(before)
            # triples that begin within the longest stretch that an item of the class can match
            good = np.flatnonzero(before[np.arange(len(words)) + max(0, longest - 2)] - before[: len(words)] >= need)
            padded = np.concatenate([words, np.zeros(n, np.uint64)])
            windows.append(padded[good[:, None] + np.arange(n)])
            place.append(np.full(len(good), i))
            first.append(good)
        if not windows:
            continue
        windows, place, first = (np.concatenate(x) for x in (windows, place, first))
        for low in range(0, len(windows), 4096):
            own = items.keys(windows[low : low + 4096]).ravel()
            hit, at = expanded(*(np.searchsorted(keys, own, side) for side in ("left", "right")))
            pair = np.unique((low + hit % min(4096, len(windows) - low)) * count + owner[at])
            pair = pair[np.isin(place[pair // count] * count + pair % count, allowed)]
            for k in range(0, len(pair), 2048):
                w, x = pair[k : k + 2048] // count, pair[k : k + 2048] % count
                stretches = [held[place[i]][1][first[i] : first[i] + items.size[j] + items.edits[j]] for i, j in zip(w, x, strict=True)]
                found = distances([items.words[j] for j in x], stretches, int(items.edits[x].max()))
                for i in np.flatnonzero(found <= items.edits[x]):
                    key, value = (held[place[w[i]]][0], int(x[i])), (int(found[i]), int(first[w[i]]))
                    best[key] = min(best.get(key, value), value)
    todo = [np.zeros((0, 4), np.int64)]
    for pair, at in zip(allowed.tolist(), common, strict=True):
        i, x = divmod(pair, count)
        most = best.get((held[i][0], x), (int(items.edits[x]),))[0]
        need, length = max(1, int(items.size[x]) - 2 - 3 * most), int(items.size[x]) - 2 + most
        # first words of the stretches that have enough triples of the item
        low, high = np.maximum(0, at[need - 1 :] - length + 1), at[: len(at) - need + 1] + 1
        start = np.unique(expanded(low, np.maximum(low, high))[1])
        todo.append(np.column_stack([np.full((len(start), 3), (most, i, x)), start]))
    rest = np.concatenate(todo)
    rest = rest[np.lexsort((items.size[rest[:, 2]], rest[:, 0]))]
    for k in range(0, len(rest), 2048):
        most, w, x, start = rest[k : k + 2048].T
        stretches = [held[i][1][a : a + items.size[j] + m] for m, i, j, a in rest[k : k + 2048]]
        found = distances([items.words[j] for j in x], stretches, int(most.max()))
        for i in np.flatnonzero(found <= most):
            key, value = (held[w[i]][0], int(x[i])), (int(found[i]), int(start[i]))
            best[key] = min(best.get(key, value), value)
    return [(r, x, start, e) for (r, x), (e, start) in sorted(best.items())]


def slices(benchmark: DataFrame, p: Params, size: int = SLICE_WORDS) -> Iterator[Items]:
    """The benchmark as indexed slices; read a slice at a time."""
    ids: list = []
    words: list[np.ndarray] = []
    held = 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        own = _text.word_hashes(r["text"])
        if len(own) < p.least_words:
            continue
        if words and held + len(own) > size:
            yield Items(ids, words, p)
            ids, words, held = [], [], 0
        ids.append(r["item_id"])
        words.append(own)
        held += len(own)
    if words:
        yield Items(ids, words, p)


def leaks(documents: DataFrame, benchmark: DataFrame, p: Params = Params(), size: int = SLICE_WORDS) -> DataFrame:
    """doc_id, item_id, first_word (from 0) and edits of each leaked item of each document."""
    sc = documents.sparkSession.sparkContext
    doc_type, item_type = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, first_word int, edits int"
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = documents.sparkSession.createDataFrame([], schema)
    for k, items in enumerate(slices(benchmark, p, size)):
        shared = sc.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = search(b.column("text"), shared.value)
                if found:
                    row, item, first, edits = zip(*found, strict=True)
                    ids = b.column("doc_id")
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row)), pa.array([shared.value.ids[x] for x in item], item_arrow), pa.array(first, pa.int32()), pa.array(edits, pa.int32())],
                        ["doc_id", "item_id", "first_word", "edits"],
                    )

        part = documents.select("doc_id", "text").mapInArrow(run, schema)
        out = part if k == 0 else out.unionAll(part)
    return out


def _clean(shared: Broadcast):
    """Whether texts leak no item of a broadcast slice."""

    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        out = np.ones(len(column), bool)
        out[[r for r, *_ in search(column, shared.value)]] = False
        return pa.array(out)

    return clean


def without_leaks(documents: DataFrame, benchmark: DataFrame, p: Params = Params(), size: int = SLICE_WORDS) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    for items in slices(benchmark, p, size):
        clean = _clean(documents.sparkSession.sparkContext.broadcast(items))
        documents = documents.where(clean(F.col("text")))
    return documents
