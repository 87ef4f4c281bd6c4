"""Packing of documents into windows of a fixed number of tokens with a controlled mixture.

Deficit round-robin over one queue a source. In every window (a round) each
source that still has tokens is granted its share of the window, by weight, on
top of the deficit it carries; it serves whole tokens from the head of its
queue, and the fraction that remains is its deficit in the next window. A
fraction left by one source within a round is handed to the next one, so that
the round always fills the window. A source that runs dry leaves its share to
the others. Where a window can't hold a token of every source, a round is as
many windows as can. In short, up to the end of round w, in which
G = (w + 1) * size tokens were served, sources 1..i have served

    floor(sum over j <= i of min(total_j, weight_j * v)),  where the sum over all j is G

The state of the scheduler before any window therefore has a closed form, and a
task that holds a stretch of one queue starts with the deficits that the tasks
before it left, without waiting for them. Documents are cut where a window ends.

Plan: tokens are counted in one scan; everything after it moves (source,
doc_id, tokens) only. Those rows are range-partitioned by (source, doc_id), so
a hot source is spread over many tasks; totals by partition and source give the
token at which each task begins. Sources are the only thing the driver counts and
broadcasts, some hundred bytes each, however many they are.

Defined results. A null source is a queue of its own, before all others. Null
and empty texts have no tokens and appear in no window. A null doc_id comes
first in its queue; repeated rows are packed as often as they occur, rows equal
in source and doc_id in the order of their lengths. The last window may be
short. An empty table gives no windows. Columns other than doc_id, source and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.plans import durable

WINDOW = 2048
MAX_WEIGHT = 10_000
TOKEN = r"[^ \t\n\r]+"


def token_count(text: Column) -> Column:
    """Runs of characters between blanks: each starts after a blank or at the start."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


@dataclass(frozen=True)
class Mixture:
    """Totals and integer weights of the sources, in their order."""

    totals: np.ndarray
    weights: np.ndarray
    window: int

    def phases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rank in which each source runs dry; served tokens at which each phase begins; by phase, tokens of the dry and weight of the others."""
        order = sorted(range(len(self.totals)), key=lambda i: (int(self.totals[i]) / int(self.weights[i]), i))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        dry = np.concatenate([[0], np.cumsum(self.totals[order])])[:-1]
        left = int(self.weights.sum()) - np.concatenate([[0], np.cumsum(self.weights[order])])[:-1]
        begin = [0]
        for k, i in enumerate(order[:-1]):  # served when source i runs dry, rounded up: exact at whole tokens
            begin.append(int(dry[k]) + -(-int(self.totals[i]) * int(left[k]) // int(self.weights[i])))
        return rank, np.array(begin, np.int64), dry, left

    def round(self) -> int:
        """Tokens of a round: a multiple of the window that grants each source a token at least."""
        return self.window * max(1, -(-int(self.weights.sum()) // (self.window * int(self.weights.min()))))


class Served:
    """What the sources up to one have served, for one source after the other.

    The two sums of the formula, over the sources that have run dry and those
    that haven't, are prefix sums by rank of the sources seen so far. They are
    kept in binary indexed trees, so the next source and a look-up take steps of
    the logarithm of the sources.
    """

    def __init__(self, mix: Mixture, phases: tuple, source: int) -> None:
        self.mix, (self.rank, self.begin, self.dry, self.left) = mix, phases
        n = len(self.rank)
        self.seen = source  # sources below this one are in the trees
        self.weight = int(mix.weights[:source].sum())
        own = np.zeros((2, n + 1), np.int64)
        own[:, self.rank[:source] + 1] = mix.totals[:source], mix.weights[:source]
        own = np.cumsum(own, axis=1)
        at = np.arange(n + 1)
        self.trees = own - own[:, at - (at & -at)]

    def move(self, source: int) -> None:
        """Take in the sources up to, but without, this one."""
        for i in range(self.seen, source):
            at = int(self.rank[i]) + 1
            while at < self.trees.shape[1]:
                self.trees[0, at] += self.mix.totals[i]
                self.trees[1, at] += self.mix.weights[i]
                at += at & -at
            self.weight += int(self.mix.weights[i])
        self.seen = source

    def bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that the source to come and all before it have served when ``at`` were served in all."""
        k = np.searchsorted(self.begin, at, "right") - 1
        dry, gone, node = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), k.copy()
        while node.any():
            dry += self.trees[0, node]
            gone += self.trees[1, node]
            node &= node - 1
        whole, rest = np.divmod(at - self.dry[k], self.left[k])
        part = lambda dry, weight: dry + weight * whole + weight * rest // self.left[k]
        total, weight, later = int(self.mix.totals[self.seen]), int(self.mix.weights[self.seen]), self.rank[self.seen] >= k
        before = part(dry, self.weight - gone)
        return part(dry + np.where(later, 0, total), self.weight - gone + np.where(later, weight, 0)) - before, before


def _stretch(served: Served, first: int, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of consecutive documents of the source to come, whose first token has number ``first`` in its queue."""
    mix = served.mix
    last, total, step = first + int(sizes.sum()), int(mix.totals.sum()), mix.round()
    rounds = -(-total // step)

    def bounds(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return served.bounds(np.minimum(w * step, total))

    def windows_of(tokens: np.ndarray) -> np.ndarray:  # the last window that begins at or before each token
        low, high = np.zeros(len(tokens), np.int64), np.full(len(tokens), rounds)
        while (high - low > 1).any():
            mid = (low + high) // 2
            fits = bounds(mid)[0] <= tokens
            low, high = np.where(fits, mid, low), np.where(fits, high, mid)
        return low

    begin, end = windows_of(np.array([first, last - 1]))
    w = np.arange(begin, end + 2)
    edge, before = bounds(w)
    ends = first + np.cumsum(sizes)
    starts = ends - sizes
    cuts = np.unique(np.concatenate([starts, edge[(edge > first) & (edge < last)]]))
    doc = np.searchsorted(ends, cuts, "right")
    upto = np.append(cuts[1:], last)
    at = np.searchsorted(edge, cuts, "right") - 1
    # within a round, sources follow each other in their order
    place = w[at] * step + np.diff(before)[at] + cuts - edge[at]
    return _windowed(place, doc, cuts - starts[doc], upto - cuts, mix.window)


def _windowed(place: np.ndarray, doc: np.ndarray, doc_start: np.ndarray, n: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Segments cut where a window ends; place: number of the first token among all that are packed."""
    pieces = (place + n - 1) // window - place // window + 1
    row = np.repeat(np.arange(len(place)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.maximum(place[row], (place[row] // window + nth) * window)
    end = np.minimum(place[row] + n[row], (start // window + 1) * window)
    return {"doc": doc[row], "window_id": start // window, "window_start": start % window, "doc_start": doc_start[row] + start - place[row], "n_tokens": end - start}


def packed(documents: DataFrame, weights: Mapping[str | None, int] | None = None, window: int = WINDOW, default_weight: int = 1, tokens: Column | None = None) -> DataFrame:
    """Segments: window_id, window_start, doc_id, source, doc_start, n_tokens.

    weights: integers from 1 to MAX_WEIGHT by source; others get default_weight.
    """
    spark = documents.sparkSession
    weights = dict(weights or {})
    if not all(1 <= x <= MAX_WEIGHT for x in [*weights.values(), default_weight]):
        raise ValueError(f"weights go from 1 to {MAX_WEIGHT}")
    counted = tokens if tokens is not None else token_count(F.col("text"))
    slim = documents.select("source", "doc_id", counted.cast("long").alias("n")).where("n > 0")
    slim = durable.written(slim, "packing-tokens")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = slim.repartitionByRange(parts, "source", "doc_id").sortWithinPartitions("source", "doc_id", "n")
    ranged = durable.written(ranged.withColumn("part", F.spark_partition_id()), "packing-queues")
    durable.discard(slim)
    sums = ranged.groupBy("source", "part").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    names = sorted({r["source"] for r in sums}, key=lambda x: (x is not None, x or ""))
    place = {x: i for i, x in enumerate(names)}
    total = np.zeros(len(names), np.int64)
    begin: dict[tuple[int, int], int] = {}
    for r in sorted(sums, key=lambda r: (place[r["source"]], r["part"])):
        i = place[r["source"]]
        begin[i, r["part"]] = int(total[i])
        total[i] += r["n"]
    mixture = Mixture(total, np.array([weights.get(x, default_weight) for x in names], np.int64), window)
    shared = spark.sparkContext.broadcast((mixture, mixture.phases() if names else (), place, begin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, phases, place, begin = shared.value
        done: dict[tuple[int, int], int] = {}
        served: Served | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            part = t["part"].to_numpy()
            key = np.fromiter((place[x] for x in t["source"].to_pylist()), np.int64, len(part))
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
            for i, j in zip([0, *cut], [*cut, len(part)], strict=True):
                if i == j:
                    continue
                mine = (int(key[i]), int(part[i]))
                sizes = t["n"].to_numpy()[i:j]
                if served is None or mine[0] < served.seen:
                    served = Served(mix, phases, mine[0])
                served.move(mine[0])
                out = _stretch(served, begin[mine] + done.get(mine, 0), sizes)
                done[mine] = done.get(mine, 0) + int(sizes.sum())
                doc = pa.array(out.pop("doc") + i)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(out[c]) for c in ("window_id", "window_start")), b.column("doc_id").take(doc), b.column("source").take(doc), *(pa.array(out[c]) for c in ("doc_start", "n_tokens"))],
                    ["window_id", "window_start", "doc_id", "source", "doc_start", "n_tokens"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"window_id long, window_start long, doc_id {kind}, source string, doc_start long, n_tokens long"
    # one task a queue partition, rows in their written order
    return _by_part(ranged).mapInArrow(run, schema)


def _by_part(ranged: DataFrame) -> DataFrame:
    """Each range's rows together and in order, however its files were split or joined for reading."""
    return ranged.repartition(int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "source", "doc_id", "n")
