"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

Building (Dong, Moses and Li, 2011). Each vector starts with its nearest within
the leaves of a few random-projection trees. Then, again and again, every node w
gathers its neighbours and those whose neighbour it is, and introduces them to
each other: of two that meet, each may enter the other's list. Only pairs that
hold a fresh edge meet. A round is a join of edges with vectors, a grouping by w
and a merge by node; it ends when few lists change.

Searching. A query keeps a beam of the nearest nodes seen and expands the best
``expand`` whose edges (in both directions) it has not followed yet, until all
of the beam is expanded. A query that is a row of the table starts at its own node.

Plan: rounds send each vector as 8-bit codes to the nodes that gather it; the
similarities of results are of the full vectors. All that gather at a node meet,
however many they are, in blocks of rows. A bucket of the first trees that is
too large for a task is divided at random, in each tree anew. If vectors and
edges fit ``broadcast_bytes`` the graph is broadcast for the search; a larger one
is searched by rounds of joins of the beams with edges and vectors. Both take
the same steps and give the same rows, but for rounding in the last place.

Defined results. Null ids, null or empty vectors, vectors with a null, NaN or infinity and
those whose length isn't the most frequent one (the least of equals) are left
out, as queries and as neighbours. Ids are integers, or strings that are: others are null. Of rows with one id the first in the order of
their vectors counts. A zero vector has similarity 0 to all. Neighbours are
ranked by similarity, then id; a vector is not its own neighbour, equal vectors
of other ids are. Fewer than k others give as many, as do fewer that the graph
connects with a row. An empty table gives no rows. Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.plans import durable

ROW = "id long, near array<long>, score array<float>, fresh array<boolean>"
UPDATE = "id long, near array<long>, score array<float>"


@dataclass(frozen=True)
class Params:
    """The beam of a search holds beam_per_bit * log2(rows) nodes, and k at least."""

    k: int = 10
    degree: int = 32
    trees: int = 6
    leaf: int = 512
    bucket: int = 8192
    rounds: int = 8
    least_change: float = 0.05
    beam_per_bit: int = 9
    seed: int = 5
    broadcast_bytes: int = 64 << 20
    expand: int = 8

    def beam(self, n: int) -> int:
        return max(self.k + 1, int(self.beam_per_bit * np.log2(max(2, n))))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and unit vector of the rows that count."""
    own = df.select(F.expr(f"try_cast(`{id_col}` AS BIGINT)").alias("id"), F.col(vector_col).cast("array<float>").alias("vec"))
    own = own.where(F.col("id").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    common = own.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    own = own.where(F.size("vec") == (common[0]["dims"] if common else 0))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("vec"))).where("nth = 1").drop("nth")
    return own.select("id", "vec").mapInArrow(_units, "id long, vec array<float>")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _matrix(b.column("vec"), np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = (x / np.where(norm > 0, norm, 1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([b.column("id"), _lists(list(x), pa.float32())], ["id", "vec"])


def _matrix(column: pa.Array, dtype: type = np.float32) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1) if n else np.zeros((0, 1), dtype)


def _lists(x: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(x) if x else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(y) for y in x])]), pa.int32()), pa.array(flat, kind))


def _split(column: pa.Array, dtype: type) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), offsets[1:-1]) if len(column) else []


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        own = b.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != own[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(own, own[-1])) if (np.diff(own) >= 0).all() else int(np.flatnonzero(np.diff(own))[-1]) + 1
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _cuts(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])


def leaves(x: np.ndarray, rows: np.ndarray, most: int, random: np.random.Generator) -> list[np.ndarray]:
    """Halves by random projections, again and again, until at most ``most`` rows are left."""
    todo, out = [rows], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        a, b = random.choice(own, 2, replace=False)
        side = x[own] @ (x[a] - x[b])
        order = np.argsort(side, kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


def _best(ids: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best by score, then id."""
    return np.lexsort((ids, -score))[:n]


def planted(p: Params, tree: int) -> Callable:
    """mapInArrow over (bucket, id, vec) sorted by bucket: nearest within the leaves of one tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "bucket"):
            t = t.combine_chunks()
            every, x, key = t["id"].to_numpy(), _matrix(t["vec"].combine_chunks()), t["bucket"].to_numpy()
            random = np.random.default_rng([p.seed, tree, int(key[0]) & 0xFFFFFFFF])
            cut = _cuts(key)
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                for own in leaves(x, np.arange(i, j), p.leaf, random):
                    if len(own) < 2:
                        continue
                    score = x[own] @ x[own].T
                    np.fill_diagonal(score, -9)
                    n = min(p.degree, len(own) - 1)
                    top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                    size = pa.array(np.arange(len(own) + 1) * n, pa.int32())
                    near = pa.ListArray.from_arrays(size, pa.array(every[own][top].ravel()))
                    value = pa.ListArray.from_arrays(size, pa.array(np.take_along_axis(score, top, 1).ravel().astype(np.float32)))
                    yield pa.RecordBatch.from_arrays([pa.array(every[own]), near, value], ["id", "near", "score"])

    return run


def merged(p: Params) -> Callable:
    """mapInArrow over (id, near, score, fresh) sorted by id: the best of all lists of each id.

    fresh is null in updates; an edge that some old list has keeps its mark, taken as no longer fresh.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "id"):
            t = t.combine_chunks()
            key = t["id"].to_numpy()
            near, score = (_split(t[c].combine_chunks(), k) for c, k in (("near", np.int64), ("score", np.float32)))
            old = t["fresh"].is_valid().to_numpy()
            cut = _cuts(key)
            out_near, out_score, out_fresh = [], [], []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                ids = np.concatenate(near[i:j])
                value = np.concatenate(score[i:j])
                known = np.repeat(old[i:j], [len(x) for x in near[i:j]])
                order = np.lexsort((~known, ids))
                first = order[np.flatnonzero(np.diff(ids[order], prepend=-(1 << 62)))]
                first = first[ids[first] != key[i]]
                top = first[_best(ids[first], value[first], p.degree)]
                out_near.append(ids[top])
                out_score.append(value[top])
                out_fresh.append(~known[top])
            yield pa.RecordBatch.from_arrays([pa.array(key[cut[:-1]]), _lists(out_near, pa.int64()), _lists(out_score, pa.float32()), _lists(out_fresh, pa.bool_())], ["id", "near", "score", "fresh"])

    return run


BLOCK = 512


def _met(u: np.ndarray, fresh: np.ndarray, least: np.ndarray, x: np.ndarray, degree: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, other, similarity) of the best that each u meets at one node and that may enter its list, in blocks of rows.

    Where no edge is fresh on either side, two have met before.
    """
    new = np.flatnonzero(fresh)
    for low in range(0, len(u), BLOCK):
        own = np.arange(low, min(low + BLOCK, len(u)))
        for rows, others in ((own[fresh[own]], slice(None)), (own[~fresh[own]], new)):
            if not len(rows) or not len(u[others]):
                continue
            score = x[rows] @ x[others].T
            score[(score <= least[rows][:, None]) | (u[rows][:, None] == u[others][None, :])] = -9
            if score.shape[1] > degree:
                top = np.argpartition(-score, degree - 1, axis=1)[:, :degree]
                score, other = np.take_along_axis(score, top, 1), u[others][top]
            else:
                other = np.broadcast_to(u[others], score.shape)
            a, b = np.nonzero(score > -9)
            yield u[rows[a]], other[a, b], score[a, b]


def introduced(p: Params) -> Callable:
    """mapInArrow over (w, u, fresh, least, code) sorted by w: better neighbours for the u that meet at a w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "w"):
            t = t.combine_chunks()
            w, u, fresh, least = (t[c].to_numpy() for c in ("w", "u", "fresh", "least"))
            codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.int8)
            x = codes.reshape(len(w), -1).astype(np.float32) / 127
            cut = _cuts(w)
            found = [part for i, j in zip(cut[:-1], cut[1:], strict=True) for part in _met(u[i:j], fresh[i:j], least[i:j], x[i:j], p.degree)]
            if not found:
                continue
            a, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
            # one list for each u that met someone, without repeated pairs
            order = np.lexsort((-score, b, a))
            a, b, score = a[order], b[order], score[order]
            new = np.ones(len(a), bool)
            new[1:] = (np.diff(a) != 0) | (np.diff(b) != 0)
            a, b, score = a[new], b[new], score[new]
            order = np.lexsort((-score, a))
            a, b, score = a[order], b[order], score[order]
            cut = _cuts(a) if len(a) else np.zeros(1, np.int64)
            rank = np.arange(len(a)) - np.repeat(cut[:-1], np.diff(cut))
            a, b, score = (x[rank < p.degree] for x in (a, b, score))
            cut = _cuts(a) if len(a) else np.zeros(1, np.int64)
            size = pa.array(cut, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[cut[:-1]]), pa.ListArray.from_arrays(size, pa.array(b)), pa.ListArray.from_arrays(size, pa.array(score.astype(np.float32)))], ["id", "near", "score"]
            )

    return run


def bucketed(known: DataFrame, p: Params, tree: int, bits: int, dims: int) -> DataFrame:
    """bucket, id and vec: vectors by the sides of random planes that they lie on; large buckets are divided by a hash of the id."""
    planes = np.random.default_rng([p.seed, tree, 0]).normal(size=(bits, dims)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side = _matrix(b.column("vec")) @ planes.T > 0 if len(b) else np.zeros((0, bits), bool)
            yield pa.RecordBatch.from_arrays([pa.array(side @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(b), np.int64)), b.column("id"), b.column("vec")], ["bucket", "id", "vec"])

    own = known.select("id", "vec").mapInArrow(run, "bucket long, id long, vec array<float>")
    most = 8 * p.bucket
    large = own.groupBy(F.col("bucket").alias("_bucket")).count().where(F.col("count") > most)
    if large.isEmpty():
        return own
    part = F.pmod(F.xxhash64("id", F.lit(tree)), F.ceil(F.col("count") / p.bucket))
    split = own.join(large, F.col("bucket") == F.col("_bucket"), "left")
    return split.select(F.when(F.col("count").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", part)).alias("bucket"), "id", "vec")


def _merge(lists: DataFrame, p: Params) -> DataFrame:
    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(merged(p), ROW)


def graph(known: DataFrame, p: Params) -> DataFrame:
    """The neighbour graph of (id, vec): id, near, score, fresh."""
    n = known.count()
    dims = known.select(F.size("vec")).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(1, n) / p.bucket))))
    lists = None
    for tree in range(p.trees):
        one = bucketed(known, p, tree, bits, dims).repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(planted(p, tree), UPDATE)
        lists = one if lists is None else lists.unionAll(one)
    now = durable.written(_merge(lists.withColumn("fresh", F.lit(None).cast("array<boolean>")), p), "graph")
    codes = F.transform("vec", lambda x: F.round(x * 127).cast("tinyint"))
    coded = known.select("id", codes.alias("code")).mapInArrow(_bytes, "id long, code binary")
    coded = durable.written(coded, "codes")
    for _ in range(p.rounds):
        change = now.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if change <= p.least_change * n * p.degree:
            break
        edge = now.select("id", F.explode(F.arrays_zip("near", "fresh")).alias("e"))
        forward = edge.select(F.col("id").alias("w"), F.col("e.near").alias("u"), F.col("e.fresh").alias("fresh"))
        members = forward.unionAll(forward.select(F.col("u").alias("w"), F.col("w").alias("u"), "fresh"))
        least = F.when(F.size("near") < p.degree, F.lit(-9.0)).otherwise(F.array_min("score"))
        info = now.select(F.col("id").alias("u"), least.cast("float").alias("least")).join(coded.withColumnRenamed("id", "u"), "u")
        met = members.join(info, "u").select("w", "u", "fresh", "least", "code").repartition("w").sortWithinPartitions("w", F.desc("fresh"))
        updates = met.mapInArrow(introduced(p), UPDATE).withColumn("fresh", F.lit(None).cast("array<boolean>"))
        now, before = durable.written(_merge(updates.unionAll(now), p), "graph"), now
        durable.discard(before)
    durable.discard(coded)
    return now


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _matrix(b.column("code"), np.int8)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in x] if len(b) else [], pa.binary())], ["id", "code"])


def adjacency(g: DataFrame) -> DataFrame:
    """id and the nodes of its edges in either direction."""
    edge = g.select("id", F.explode("near").alias("to"))
    both = edge.unionAll(edge.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct()
    return both.groupBy("id").agg(F.collect_list("to").alias("to"))


def beam_search(x: np.ndarray, bounds: np.ndarray, to: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams (nodes, similarities) of queries, whose entries are the nodes to begin at."""
    n = len(queries)
    nodes = np.full((n, beam), -1)
    score = np.full((n, beam), -9.0, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    nodes[:, 0], done[:, 0] = entry, False
    score[:, 0] = np.einsum("qd,qd->q", queries, x[entry])
    seen[np.arange(n), entry] = True
    while not done.all():
        # the best nodes of each beam that aren't expanded
        open_score = np.where(done, -99, score)
        k = min(expand, beam)
        best = np.argpartition(-open_score, k - 1, axis=1)[:, :k]
        q, at = np.nonzero(np.take_along_axis(~done, best, 1))
        at = best[q, at]
        done[q, at] = True
        node = nodes[q, at]
        # their neighbours that the query hasn't seen, each once
        size = bounds[node + 1] - bounds[node]
        edge = np.arange(size.sum()) + np.repeat(bounds[node] - (np.cumsum(size) - size), size)
        q, v = np.repeat(q, size), to[edge]
        new = ~seen[q, v]
        key = np.unique(q[new] * len(x) + v[new])
        q, v = key // len(x), key % len(x)
        if not len(q):
            continue
        seen[q, v] = True
        value = np.empty(len(q), np.float32)
        for low in range(0, len(q), 16384):
            some = slice(low, low + 16384)
            value[some] = np.einsum("kd,kd->k", queries[q[some]], x[v[some]])
        which, first, count = np.unique(q, return_index=True, return_counts=True)
        row, place = np.repeat(np.arange(len(which)), count), np.arange(len(q)) - np.repeat(first, count)
        offered, ids = np.full((len(which), count.max()), -9, np.float32), np.full((len(which), count.max()), -1)
        offered[row, place], ids[row, place] = value, v
        every, ids = np.concatenate([score[which], offered], axis=1), np.concatenate([nodes[which], ids], axis=1)
        mark = np.concatenate([done[which], offered <= -9], axis=1)
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        score[which], nodes[which], done[which] = (np.take_along_axis(y, top, 1) for y in (every, ids, mark))
    return nodes, score


def _answer(every: np.ndarray, query: np.ndarray, nodes: list[np.ndarray], score: list[np.ndarray], k: int) -> pa.RecordBatch:
    ids, near, value, rank = [], [], [], []
    for q, x, s in zip(query, nodes, score, strict=True):
        x, s = x[s > -9], s[s > -9]
        own = every[x] if len(every) else x
        x, s = own[own != q], s[own != q]
        top = _best(x, s, k)
        ids.append(np.full(len(top), q))
        near.append(x[top])
        value.append(s[top])
        rank.append(np.arange(1, len(top) + 1))
    cat = lambda y, k: pa.array(np.concatenate(y) if y else np.zeros(0), k)
    return pa.RecordBatch.from_arrays([cat(ids, pa.int64()), cat(rank, pa.int32()), cat(near, pa.int64()), cat(value, pa.float32())], ["id", "rank", "neighbour", "similarity"])


RESULT = "id long, rank int, neighbour long, similarity float"


def neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", p: Params = Params()) -> DataFrame:
    """id, rank, neighbour and similarity: the k nearest others of every row."""
    spark = df.sparkSession
    known = durable.written(vectors(df, id_col, vector_col), "vectors")
    n = known.count()
    if n < 2:
        return spark.createDataFrame([], RESULT)
    built = graph(known, p)
    edges = durable.written(adjacency(built), "adjacency")
    durable.discard(built)
    dims = known.select(F.size("vec")).first()[0]
    size = n * (dims * 4 + 8) + edges.agg(F.sum(F.size("to"))).first()[0] * 4
    return _searched(known, edges, p) if size <= p.broadcast_bytes else _joined(known, edges, p, p.beam(n))


def _searched(known: DataFrame, edges: DataFrame, p: Params) -> DataFrame:
    """Search in a broadcast graph, whose size was checked."""
    t = known.orderBy("id").toArrow()
    every, x = t["id"].to_numpy(), _matrix(t["vec"].combine_chunks())
    lists = edges.orderBy("id").toArrow()
    flat = _split(lists["to"].combine_chunks(), np.int64)
    size = np.zeros(len(every), np.int64)
    size[np.searchsorted(every, lists["id"].to_numpy())] = [len(y) for y in flat]
    to = np.searchsorted(every, np.concatenate([np.zeros(0, np.int64), *flat])).astype(np.int32)
    shared = known.sparkSession.sparkContext.broadcast((every, x, np.concatenate([[0], np.cumsum(size)]), to))
    block, beam = max(16, min(512, (32 << 20) // len(every))), p.beam(len(every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, x, bounds, to = shared.value
        for b in batches:
            ids = b.column("id").to_numpy()
            for low in range(0, len(ids), block):
                own = ids[low : low + block]
                at = np.searchsorted(every, own)
                nodes, score = beam_search(x, bounds, to, x[at], at, beam, p.expand)
                yield _answer(every, own, list(nodes), list(score), p.k)

    parts = max(1, known.sparkSession.sparkContext.defaultParallelism * 4)
    return known.select("id").repartition(parts, "id").mapInArrow(run, RESULT)


STATE = "q long, vec array<float>, nodes array<long>, score array<float>, done array<boolean>, now array<long>"


def advanced(p: Params, beam: int) -> Callable:
    """mapInArrow over the beams of queries and the vectors that they are offered (null in beams), sorted by q with beams first: the next beams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "q"):
            t = t.combine_chunks()
            q, v = t["q"].to_numpy(), t["v"].fill_null(-1).to_numpy()
            state = np.flatnonzero(t["v"].is_null().to_numpy())
            own = t.take(pa.array(state))
            vec, nodes, score, done = (_split(own[c].combine_chunks(), k) for c, k in (("vec", np.float32), ("nodes", np.int64), ("score", np.float32), ("done", bool)))
            offers = np.zeros((len(t), 1), np.float32)
            if len(state) < len(t):
                rows = np.flatnonzero(t["v"].is_valid().to_numpy())
                offers = np.zeros((len(t), len(vec[0])), np.float32)
                offers[rows] = _matrix(t["offer"].combine_chunks().take(pa.array(rows)))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for k, (low, high) in enumerate(zip(state, np.append(state[1:], len(q)), strict=True)):
                mine, value, over = nodes[k], score[k], done[k]
                if high > low + 1:
                    ids, first = np.unique(v[low + 1 : high], return_index=True)
                    first = first[~np.isin(ids, mine)]
                    said = np.einsum("kd,d->k", offers[low + 1 + first], vec[k])
                    mine, value, over = np.append(mine, v[low + 1 + first]), np.append(value, said), np.append(over, np.zeros(len(first), bool))
                top = _best(mine, value, beam)
                mine, value, over = mine[top], value[top], over[top]
                now = np.flatnonzero(~over)[: p.expand]
                over[now] = True
                for x, y in zip(out, (mine, value, over, mine[now]), strict=True):
                    x.append(y)
            kinds = (pa.int64(), pa.float32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(q[state]), own["vec"].combine_chunks(), *(_lists(x, k) for x, k in zip(out, kinds, strict=True))], ["q", "vec", "nodes", "score", "done", "now"])

    return run


def _joined(known: DataFrame, edges: DataFrame, p: Params, beam: int) -> DataFrame:
    """Search by joins: every round, each query expands the best nodes of its beam."""
    state = known.select(
        F.col("id").alias("q"), "vec", F.array("id").alias("nodes"), F.array(F.lit(1.0).cast("float")).alias("score"), F.array(F.lit(True)).alias("done"), F.array("id").alias("now")
    )
    target = known.select(F.col("id").alias("v"), "vec")
    state = durable.written(state, "beams")
    while not state.where(F.size("now") > 0).isEmpty():
        ask = state.select("q", F.explode("now").alias("id"), "nodes").join(edges, "id").select("q", F.explode(F.array_except("to", "nodes")).alias("v")).distinct()
        offered = ask.join(target, "v").select("q", "v", F.col("vec").alias("offer"))
        every = state.unionByName(offered, allowMissingColumns=True)
        following = durable.written(every.repartition("q").sortWithinPartitions("q", F.col("v").asc_nulls_first()).mapInArrow(advanced(p, beam), STATE), "beams")
        durable.discard(state)
        state = following

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _answer(np.zeros(0, np.int64), b.column("q").to_numpy(), _split(b.column("nodes"), np.int64), _split(b.column("score"), np.float32), p.k)

    return state.select("q", "nodes", "score").mapInArrow(run, RESULT)
