"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its runs of three words, summarised by the minwise
tokens of 128 hash functions; the share of functions on which two documents
agree estimates their Jaccard similarity (Christiani, Pagh and Sivertsen, 2018,
run their join over the same summary). The join grows trees. A node holds
documents; it selects 1 / similarity of the functions on average, at random by
its path, and each document goes on to the children named by its minwise tokens
at those. So two documents of the sought similarity share one child a node on
average, and dissimilar ones soon part. A node of at most ``small`` documents is
compared exhaustively, all others branch again; at the last level every node is
compared. Trees are independent, and as many are grown as give the target recall.

Comparing a node that is too large to list its pairs goes document by document;
pairs that are known to be in one group are skipped, which can't change groups.
Copies of one document, which no branching parts, so cost one comparison each.
Documents with the same words are put together before, by one hash, and only
one of them enters the trees.

Groups are the connected components of the similar pairs, by alternating large
and small stars (Kiveris et al., 2014), each step a written table.

Plan: texts are read once; summaries of about 600 bytes a document are written.
Level tables hold (node, doc_id); nodes of one document end there. Only
documents that share a node are joined with their summaries.

Defined results. doc_id is an integer. Texts without words (null, empty) are duplicates of nothing.
Texts of one or two words are the set of that one run. Rows of a null doc_id are
in no group, and :func:`one_of_each` keeps them all. Rows that agree in doc_id
and text are one document, of which :func:`one_of_each` keeps one; rows that
agree in doc_id only stand or fall together. Of each group the least doc_id
stays. Columns other than doc_id and text are not read by :func:`groups`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm import _text
from quirelake.plans import durable

_U = np.uint64


@dataclass(frozen=True)
class Params:
    """similarity is what the trees are grown for; pairs whose estimate reaches least are similar.

    recall is the least share of the pairs of that similarity that are to share
    a node of the last level in some tree.
    """

    similarity: float = 0.6
    least: float = 0.55
    functions: int = 128
    shingle: int = 3
    recall: float = 0.95
    small: int = 48
    levels: int = 5
    seed: int = 3

    @property
    def trees(self) -> int:
        """As many as reach the recall: two documents go on together to a number of children that is a branching process."""
        mean, s = 1 / self.similarity, self.similarity
        low, odd = math.floor(mean), mean - math.floor(mean)
        parted = 0.0  # share of pairs that are parted before some level
        for _ in range(self.levels):
            one = 1 - s + s * parted
            parted = (1 - odd) * one**low + odd * one ** (low + 1)
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(parted)))


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, n, dtype=np.uint64)


def multipliers(p: Params) -> np.ndarray:
    return _random(p.seed, p.functions).astype(np.uint32) | np.uint32(1)


def chosen(path: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """For each path, functions at random without repetition: (row of path, function)."""
    mean = 1 / p.similarity
    coin = (_text.mix(path ^ _U(0x51ED27)) >> _U(11)).astype(np.float64) / (1 << 53)
    count = np.floor(mean).astype(int) + (coin < mean - np.floor(mean))
    most = int(np.ceil(mean))
    first = (_text.mix(path + _U(0x1234567)) % _U(p.functions)).astype(np.int64)
    stride = (_text.mix(path + _U(0x89ABCDE)) % _U(p.functions // 2)).astype(np.int64) * 2 + 1  # odd: visits all of them, of which there are 2**k
    picked = (first[:, None] + np.arange(most) * stride[:, None]) % p.functions
    row, nth = np.nonzero(np.arange(most) < count[:, None])
    return row, picked[row, nth]


def children(path: np.ndarray, summary: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The children of documents (rows of summary) at nodes: (row, path of child)."""
    row, function = chosen(path, p)
    token = summary[row, function].astype(np.uint64)
    return row, _text.mix(path[row] * _U(0x9E3779B97F4A7C15) + (token << _U(8)) + function.astype(np.uint64))


def summarised(t: _text.Tokens, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with words, a hash of all words of each, and minwise tokens."""
    size = np.diff(t.bounds)
    rows = np.flatnonzero(size)
    up, down = _text.powers(len(t.hashes) + 1)
    total = np.zeros(len(t.hashes) + 1, np.uint64)
    np.cumsum(t.hashes * up[: len(t.hashes)], out=total[1:])
    low, high = t.bounds[rows], t.bounds[rows + 1]
    whole = _text.mix((total[high] - total[low]) * down[low] + size[rows].astype(np.uint64))
    # a run begins at every word but the last two; a shorter text is one run
    start = np.ones(len(t.hashes), bool)
    for k in range(1, p.shingle):
        start[np.maximum(low, high - k)] = False
    start[low] = True
    at = np.flatnonzero(start)
    end = np.minimum(at + p.shingle, high[np.searchsorted(high, at, "right")])
    runs = (_text.mix((total[end] - total[at]) * down[at]) >> _U(32)).astype(np.uint32)
    first = np.searchsorted(at, low)
    out = np.empty((len(rows), p.functions), np.uint32)
    for i, a in enumerate(multipliers(p)):
        out[:, i] = np.minimum.reduceat(runs * a, first) if len(rows) else 0
    return rows, whole, out


def summaries(documents: DataFrame, p: Params) -> DataFrame:
    """doc_id, whole (hash of all words), roots (nodes of the first level), summary."""
    roots = _text.mix(np.arange(1, p.trees + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95) + _U(p.seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for t in _text.tokenised(b.column("text")):
                rows, whole, summary = summarised(t, p)
                n = len(rows)
                nodes = [children(np.full(n, r), summary, p)[1].reshape(-1, n).T if n else np.zeros((0, 1), np.uint64) for r in roots]
                nodes = np.concatenate(nodes, axis=1) if n else np.zeros((0, 1), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows + t.first)), pa.array(whole.view(np.int64)), _lists(nodes.view(np.int64)), _lists(summary.view(np.int32))],
                    ["doc_id", "whole", "roots", "summary"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    known = documents.select("doc_id", "text").where("doc_id IS NOT NULL")
    return known.mapInArrow(run, f"doc_id {kind}, whole long, roots array<long>, summary array<int>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def branched(p: Params):
    """mapInArrow: (node, doc_id, summary) to the children's (node, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                summary = b.column("summary").flatten().to_numpy().view(np.uint32).reshape(len(b), -1)
                row, node = children(b.column("node").to_numpy().view(np.uint64), summary, p)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b.column("doc_id").take(pa.array(row))], ["node", "doc_id"])

    return run


def similar_in_node(summary: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs that connect all similar documents of a large node: every pair is compared unless a path joins it already."""
    n = len(summary)
    group = np.arange(n)
    out = []
    for i in range(n):
        others = np.flatnonzero(group != group[i])
        if not len(others):
            break  # all in one group
        others = others[others > i]
        near = others[(summary[others] == summary[i]).sum(axis=1) >= least]
        met, first = np.unique(group[near], return_index=True)
        if len(met):
            out += [(i, int(j)) for j in near[first]]
            group[np.isin(group, met)] = group[i]
    return out


def compared(p: Params):
    """mapInArrow over rows sorted by node: (node, doc_id, summary) to similar pairs (a, b)."""
    least = int(np.ceil(p.least * p.functions))

    def pairs(node: np.ndarray, ids: np.ndarray, summary: np.ndarray) -> Iterator[np.ndarray]:
        cut = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
        size = np.diff(cut)
        for k in np.flatnonzero(size > p.small):
            own = slice(cut[k], cut[k + 1])
            found = similar_in_node(summary[own], least)
            if found:
                yield ids[own][np.array(found)]
        few = np.flatnonzero((size > 1) & (size <= p.small))
        for m in np.unique(size[few]):
            i, j = np.triu_indices(m, 1)
            begin = cut[few[size[few] == m]]
            left, right = (begin[:, None] + i).ravel(), (begin[:, None] + j).ravel()
            for low in range(0, len(left), 16384):
                a, b = left[low : low + 16384], right[low : low + 16384]
                near = (summary[a] == summary[b]).sum(axis=1) >= least
                yield np.stack([ids[a[near]], ids[b[near]]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done(parts: list) -> Iterator[pa.RecordBatch]:
            if parts:
                found = [np.zeros((0, 2), np.int64), *pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                both = np.concatenate(found)
                both = np.unique(np.sort(both[both[:, 0] != both[:, 1]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for b in batches:
            if not len(b):
                continue
            node = b.column("node").to_numpy()
            part = (node, b.column("doc_id").to_numpy(), b.column("summary").flatten().to_numpy().reshape(len(b), -1))
            if held and held[-1][0][-1] != node[0]:
                yield from done(held)
                held = []
            last = int(np.searchsorted(-(node == node[-1]).astype(int)[::-1], 0))  # rows of the last node, which may go on
            if last < len(node):
                yield from done([*held, tuple(x[:-last] for x in part)])
                held = []
            held.append(tuple(x[-last:] for x in part))
        yield from done(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(doc, least) of all connected documents but the least ones; edges are (a, b) with a < b."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = durable.written(edges, "edges")
    now = state(edges)
    while now[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u").select("m", F.col("v").alias("u")).where("m < u").distinct()
        least = large.withColumn("least", F.min("m").over(Window.partitionBy("u")))
        small = least.select(F.col("least").alias("a"), F.explode(F.array("u", "m")).alias("b")).where("a < b").distinct()
        following = durable.written(small, "edges")
        then = state(following)
        durable.discard(edges)
        edges = following
        if then == now:
            break
        now = then
    return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("group_id"))


def groups(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, group_id (the least doc_id of the group) and keep of every document that has near duplicates."""
    known = durable.written(summaries(documents, p), "summaries")
    same = Window.partitionBy("whole")
    copies = known.select("doc_id", "whole").withColumn("rep", F.min("doc_id").over(same)).where("doc_id > rep").select("doc_id", "rep").distinct()
    copies = durable.written(copies, "copies")
    nodes = known.select("doc_id", "roots").join(copies.select("doc_id"), "doc_id", "left_anti").select(F.explode("roots").alias("node"), "doc_id")
    compare, levels = None, []
    for level in range(1, p.levels + 1):
        counted = nodes.distinct() if level == 1 else nodes
        counted = counted.withColumn("n", F.count("*").over(Window.partitionBy("node"))).where("n > 1")
        counted = durable.written(counted, f"level-{level}")
        levels.append(counted)
        last = level == p.levels
        ready = counted.select("node", "doc_id") if last else counted.where(F.col("n") <= p.small).select("node", "doc_id")
        compare = ready if compare is None else compare.unionAll(ready)
        if last:
            break
        go_on = counted.where(F.col("n") > p.small).select("node", "doc_id")
        if go_on.isEmpty():
            break
        kind = documents.schema["doc_id"].dataType.simpleString()
        nodes = go_on.join(known.select("doc_id", "summary"), "doc_id").select("node", "doc_id", "summary").mapInArrow(branched(p), f"node long, doc_id {kind}").distinct()
    rows = compare.join(known.select("doc_id", "summary"), "doc_id").select("node", F.col("doc_id").cast("long").alias("doc_id"), "summary")
    pairs = rows.repartition("node").sortWithinPartitions("node", "doc_id").mapInArrow(compared(p), "a long, b long")
    edges = pairs.unionAll(copies.select(F.col("rep").cast("long").alias("a"), F.col("doc_id").cast("long").alias("b"))).distinct()
    found = components(edges)
    for t in [known, copies, *levels]:  # the edges are written by now
        durable.discard(t)
    ends = found.unionAll(found.select(F.col("group_id").alias("doc_id"), "group_id").distinct())
    kind = documents.schema["doc_id"].dataType
    return ends.select(F.col("doc_id").cast(kind), F.col("group_id").cast(kind), (F.col("doc_id") == F.col("group_id")).alias("keep"))


def one_of_each(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents without those that have a near duplicate of lesser doc_id, with all their columns."""
    gone = groups(documents, p).where("NOT keep").select("doc_id")
    known = documents.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(documents.columns)
    return known.dropDuplicates(["doc_id", "text"]).unionAll(documents.where("doc_id IS NULL"))
