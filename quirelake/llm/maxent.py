"""Language-model scoring by a hashed maximum-entropy model.

Every word that occurs at least twice has a probability of its own. The words
are the leaves of a Huffman tree of ``BRANCHES`` branches a node, whose nodes
are classes of words of like frequency, classes of classes and so on, and

    P(word | history) = product over the nodes of the path of P(branch | node, history)

with a softmax over the branches of every node. A frequent word has a few nodes
above it, a rare one more, so the mean work a word follows the entropy
of the words and not their number. Words that occur once share leaves by hash,
as many as the root of the number of the others; a leaf of k such words gives
each of them 1 / (k + 1) of its probability and leaves as much to unseen words.

Each softmax is log-linear: a bias, which is the logarithm of the share that a
branch has in the counts and so needs no training, and three features of the
history: the last word, the last two words (a bigram) and the word before the
last (a skip). Features, with the node, are hashed to rows of a table of
weights, at least as many as there are leaves.

The ids of all words are looked up once and written in the shared folder, for
training and scoring to read. Training is one pass a round over every word of
the corpus: tasks, two a core, start from the broadcast weights and take minibatch gradient steps, scaled by
past gradients; the tables they end with are averaged row by row, each row
weighted by the squares of the gradients that a task has seen there. Tables go
to the sums, which Spark makes in blocks of rows, in half precision. Scoring gathers the rows of a batch of
words in numpy.

What is gathered from the corpus are counts of every distinct word and the
weights of every task; the driver receives the words that occur at least twice
and one set of weights, and both follow the input, as does what is broadcast.

Defined results. Null and empty texts have no words; their log probability is 0
and their perplexity is NaN. Repeated rows count as often as they occur. Words
of equal count are ranked by hash, and an unseen word scores as one that occurs
once in its leaf. An empty table gives no rows. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import _text
from quirelake.plans import durable

_U = np.uint64
BRANCHES = 7
LANES = BRANCHES + 1  # of a row of weights, a power of two; in the last one, the squares of its gradients
SHIFT = LANES.bit_length() - 1
_ONES, _ALL, _LANES = np.ones(LANES, np.float32), np.ones((LANES, LANES), np.float32), np.arange(LANES)
LEAST = 2  # occurrences of a word that has a leaf of its own
RARE = 64  # leaves that words of fewer occurrences share, at least
WORDS = 1024  # leaves of the tree, at least
START = 1 << 29  # stands for words before the beginning of a text
LITTLE = 1e-4
BLOCK_ROWS = 1 << 14  # rows of a table that are averaged together
HIGH = 60.0  # bound of logits
SLOTS = 1 << 17  # in which rows of a batch that occur again are looked for; a power of two
ALIGNED = 64  # bytes of a line of the cache
SCORED = 2048  # words that are scored at once; the arrays of so many stay in the cache


@dataclass(frozen=True)
class Params:
    rows: int = 1 << 14  # of the table, at least; else as many as leaves or up to twice as many
    rounds: int = 2
    batch: int = 2048
    rate: float = 0.1


def aligned(array: np.ndarray) -> np.ndarray:
    """A copy whose rows of LANES numbers begin at multiples of their size, so that none lies in more lines of the cache than it must."""
    raw = np.empty(array.nbytes + ALIGNED, np.uint8)
    start = -raw.ctypes.data % ALIGNED
    out = raw[start : start + array.nbytes].view(array.dtype.type).reshape(array.shape)  # of the dtype object that numpy's fast sums in place ask for; unpickled arrays have another
    out[...] = array
    return out


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # hashes of the words with a leaf of their own, sorted
    ids: np.ndarray
    within: np.ndarray  # log probability of a word in each shared leaf
    parent: np.ndarray  # node above each leaf, then above each node; the root is node 0
    branch: np.ndarray
    prior: np.ndarray  # log shares of the branches of each node
    table: np.ndarray  # rows of weights

    def __setstate__(self, state: dict) -> None:  # in a task, where a model is unpickled
        self.__dict__.update(state, table=aligned(state["table"]))

    @cached_property
    def above(self) -> np.ndarray:
        """Parent and branch in one number."""
        return (self.parent << SHIFT) + self.branch


def leaves(words: int) -> tuple[int, int]:
    """Number of the first shared leaf and of shared leaves for so many words with leaves of their own."""
    return max(words, WORDS - RARE), max(RARE, 1 << (words.bit_length() // 2))


def vocabulary(documents: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of at least LEAST occurrences: hashes, sorted, and ids by falling frequency; counts of all leaves, and of words in each shared leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

        for b in batches:
            for t in _text.tokenised(b.column("text")):
                held.append(t.hashes)
                size += len(t.hashes)
                if size > 2_000_000:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    found = durable.written(documents.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    own = found.where(F.col("n") >= LEAST).toArrow()
    words, n = own["h"].to_numpy().view(np.uint64), own["n"].to_numpy()
    first, shared = leaves(len(words))
    slot = F.col("h").bitwiseAND(shared - 1)
    rest = found.where(F.col("n") < LEAST).groupBy(slot.alias("slot")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).toArrow()
    durable.discard(found)
    counts, members = np.zeros(first + shared, np.int64), np.zeros(shared, np.int64)
    ranked = np.lexsort((words.view(np.int64), -n))
    counts[: len(words)] = n[ranked]
    counts[first + rest["slot"].to_numpy()] = rest["n"].to_numpy()
    members[rest["slot"].to_numpy()] = rest["words"].to_numpy()
    ids = np.empty(len(words), np.int32)
    ids[ranked] = np.arange(len(words))
    order = np.argsort(words)
    return words[order], ids[order], counts, members


def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman tree over leaves: node above each leaf and node, branch of it, and log shares of the branches of each node."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    weight, sums, below = np.maximum(counts[order], 0.5).tolist(), [], []
    leaf = node = 0
    while n - leaf + len(sums) - node > 1:
        total = 0
        for _ in range(BRANCHES if sums else (n - 2) % (BRANCHES - 1) + 2):
            if leaf < n and (node == len(sums) or weight[leaf] <= sums[node]):
                below.append(leaf)
                total += weight[leaf]
                leaf += 1
            else:
                below.append(n + node)
                total += sums[node]
                node += 1
        sums.append(total)
    # the node made last is the root
    nodes, below = len(sums), np.array(below)
    first = (n - 2) % (BRANCHES - 1) + 2
    cut = np.maximum(0, np.arange(nodes) * BRANCHES - BRANCHES + first)
    own = np.repeat(np.arange(nodes), np.diff(np.append(cut, len(below))))
    branch_of = np.arange(len(below)) - cut[own]
    prior = np.full((nodes, LANES), -1e9, np.float32)
    prior[nodes - 1 - own, branch_of] = np.log(np.array(weight + sums)[below] / np.array(sums)[own])
    inner = below >= n
    item = np.where(inner, n + nodes - 1 - (below - n), order[np.where(inner, 0, below)])
    parent, branch = np.zeros(n + nodes, np.int32), np.zeros(n + nodes, np.int8)
    parent[item], branch[item] = nodes - 1 - own, branch_of
    return parent, branch, prior


def paths(model: Model, ids: np.ndarray, batch: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of some words, with the place of the word in it, node and branch of every step from the root, level by level."""
    n = len(model.parent) - len(model.prior)
    cut = np.arange(0, len(ids) + batch, batch)
    who, at, levels = np.arange(len(ids)), ids, []
    while len(who):
        above = np.take(model.above, at)
        levels.append((who, above, np.searchsorted(who, cut)))
        on = np.flatnonzero(above >= LANES)
        who, at = np.take(who, on), (np.take(above, on) >> SHIFT) + n
    for i, low in enumerate(cut[:-1].tolist()):
        where, above = (np.concatenate([x[k][x[2][i] : x[2][i + 1]] for x in levels]) for k in (0, 1))
        where -= low
        yield slice(low, low + batch), where, above >> SHIFT, above & (LANES - 1)


def word_ids(hashes: np.ndarray, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    first, shared = leaves(len(words))
    one, back = np.unique(hashes, return_inverse=True)  # sorted, the search stays within the cache
    found = (first + (one & _U(shared - 1)).astype(np.int64)).astype(np.int64)
    if len(words):
        at = np.minimum(np.searchsorted(words, one), len(words) - 1)
        found = np.where(words[at] == one, ids[at], found)
    return found[back]


def coded(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and the ids of the words of every document."""
    shared = documents.sparkSession.sparkContext.broadcast((model.words, model.ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in _text.tokenised(b.column("text")):
                own, ends = word_ids(t.hashes, *shared.value).astype(np.int32), (t.bounds * 4).astype(np.int64)
                ids = pa.Array.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer(ends), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(t.first, len(t)), ids.cast(pa.binary())], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def runs(b: pa.RecordBatch, model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids of the words of runs of documents, with the first row and the bounds of each; from their texts, or their ids where these are known."""
    if "ids" in b.schema.names:
        for first, piece in _text.slices(b.column("ids").cast(pa.large_binary()), _text.CHUNK_BYTES // 2):
            data, ends = _text.raw(piece)
            yield first, data.view(np.int32).astype(np.int64), ends // 4
    else:
        for t in _text.tokenised(b.column("text")):
            yield t.first, word_ids(t.hashes, model.words, model.ids), t.bounds


def history(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed features of the words before each word of documents, one column each."""
    back = []
    for k in (1, 2):
        word = np.full(len(ids), START + k, np.int64)  # before the beginning
        word[k:] = ids[:-k] if k < len(ids) else ids[:0]
        for j in range(k):
            starts = bounds[:-1] + j
            word[starts[starts < bounds[1:]]] = START + k
        back.append(word.astype(np.uint64))
    one, two = back
    kinds = [(one << _U(2)) + _U(2), (((two << _U(30)) + one) << _U(2)) + _U(3), (two + _U(1 << 60)) << _U(2)]
    return np.stack([_text.mix(x) for x in kinds], axis=1)


def rows_of(features: np.ndarray, nodes: np.ndarray, rows: int) -> np.ndarray:
    """Rows of the table, of which there are a power of two, for features of histories at nodes: one line for each feature."""
    own = np.bitwise_xor(features.T, _text.mix(nodes.astype(np.uint64) + _U(1)), order="C")
    own *= _U(0x9E3779B97F4A7C15)
    own >>= _U(65 - rows.bit_length())
    return own.view(np.int64)


def exponents(table: np.ndarray, rows: np.ndarray, prior: np.ndarray, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logits of each history, prior and sums of its rows, and their exponentials; prior is overwritten, met gets the rows."""
    z = prior
    for i, own in enumerate(rows):
        z += np.take(table, own, axis=0, out=None if met is None else met[i], mode="clip")
    z[:, BRANCHES] = -HIGH  # no branch
    np.minimum(z, HIGH, out=z)
    np.maximum(z, -HIGH, out=z)
    return z, np.exp(z)


def log_probabilities(model: Model, ids: np.ndarray, features: np.ndarray) -> np.ndarray:
    """log P(word | history) of each word."""
    out = np.zeros(len(ids))
    for some, where, node, branch in paths(model, ids, SCORED):
        z, e = exponents(model.table, rows_of(np.take(features[some], where, axis=0), node, len(model.table)), np.take(model.prior, node, axis=0))
        log = z.ravel()[np.arange(0, z.size, LANES) + branch] - np.log(e @ _ONES)
        out[some] = np.bincount(where, log, minlength=len(out[some]))
    first = len(model.parent) - len(model.prior) - len(model.within)
    shared = ids >= first
    out[shared] += model.within[ids[shared] - first]
    return out


class Learner:
    """Gradient steps on a table, each scaled by the gradients that its row has had."""

    def __init__(self, table: np.ndarray, rate: float) -> None:
        self.table, self.rate = aligned(table), rate
        self.table[:, BRANCHES] = LITTLE
        self.slots = np.empty(min(len(table), SLOTS), np.int32)
        self.pair = np.complex64 if table.itemsize == 4 else np.complex128  # two numbers that are summed at once
        self._hold(0)

    def _hold(self, size: int) -> None:
        self.met, self.sums = (aligned(np.empty((size, LANES), self.table.dtype)) for _ in range(2))
        self.place = np.arange(size, dtype=np.int32)

    def last(self, rows: np.ndarray) -> np.ndarray:
        """For each of some rows the last place at which it occurs."""
        place = self.place[: len(rows)]
        slot = rows & (len(self.slots) - 1)
        self.slots[slot] = place
        last = np.take(self.slots, slot)
        left = np.flatnonzero(last != place)
        left = np.take(left, np.flatnonzero(np.take(rows, np.take(last, left)) != np.take(rows, left)))
        while len(left):  # other rows have their slot
            some = np.take(slot, left)
            self.slots[some] = left
            last[left] = found = np.take(self.slots, some)
            left = np.take(left, np.flatnonzero(np.take(rows, found) != np.take(rows, left)))
        return last

    def step(self, rows: np.ndarray, prior: np.ndarray, target: np.ndarray) -> None:
        if len(self.place) < rows.size:
            self._hold(rows.size + rows.size // 4)
        met, sums = self.met[: rows.size], self.sums[: rows.size]
        _, error = exponents(self.table, rows, prior, met.reshape(*rows.shape, LANES))
        error /= error @ _ALL  # the sum in every lane
        flat = error.ravel()
        flat[np.arange(0, error.size, LANES) + target] -= 1
        error[:, BRANCHES] = 0
        error[:, BRANCHES] = np.square(error) @ _ONES
        sums.reshape(*rows.shape, LANES)[...] = error
        # all gradients of a row are summed at its last place, which is the last that is written
        rows = rows.ravel()
        last = self.last(rows)
        place = np.flatnonzero(last != self.place[: len(rows)])
        pairs = sums.view(self.pair)
        wide = pairs.shape[1]
        np.add.at(pairs.ravel(), (np.take(last, place).astype(np.int64)[:, None] * wide + _LANES[:wide]).ravel(), np.take(pairs, place, axis=0).ravel())
        total = met[:, BRANCHES] + sums[:, BRANCHES]
        sums *= (self.rate / np.sqrt(total))[:, None]
        met -= sums
        met[:, BRANCHES] = total
        whole = f"V{LANES * met.itemsize}"
        np.put(self.table.view(whole), rows, met.view(whole), mode="clip")


def trained(documents: DataFrame, p: Params = Params()) -> Model:
    """Vocabulary and weights from every word of the corpus."""
    model, known = _trained(documents, p)
    durable.discard(known)
    return model


def scores(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents scored by a model of all of them; their words are looked up once."""
    model, known = _trained(documents, p)
    return scored(known, replace(model, words=model.words[:0], ids=model.ids[:0]))


def _trained(documents: DataFrame, p: Params) -> tuple[Model, DataFrame]:
    words, ids, counts, members = vocabulary(documents)
    rows = max(p.rows, 1 << len(counts).bit_length())
    model = Model(words, ids, -np.log1p(members), *tree(counts), np.zeros((rows, LANES), np.float32))
    known = durable.written(coded(documents, model), "ids")
    for _ in range(p.rounds):
        model = _round(known, model, p)
    return model, known


def _round(known: DataFrame, model: Model, p: Params) -> Model:
    sc = known.sparkSession.sparkContext
    shared = sc.broadcast(replace(model, words=model.words[:0], ids=model.ids[:0]))
    size = min(BLOCK_ROWS, len(model.table))
    blocks = len(model.table) // size

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, learner = shared.value, None
        for b in batches:
            for _, own, bounds in runs(b, model):
                learner = learner or Learner(model.table, p.rate)
                features = history(own, bounds)
                for some, where, node, branch in paths(model, own, p.batch):
                    seen = np.take(features[some], where, axis=0)
                    learner.step(rows_of(seen, node, len(model.table)), np.take(model.prior, node, axis=0), branch)
        for i in range(blocks if learner else 0):
            own = slice(i * size, (i + 1) * size)
            part = learner.table[own].copy()
            part[:, BRANCHES] = np.sqrt(part[:, BRANCHES] - np.float32(LITTLE))  # within the range of half precision
            part = part.astype(np.float16).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.binary())], ["block", "data"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                own = np.frombuffer(data.as_buffer(), np.float16).reshape(size, LANES).astype(np.float64)
                own[:, BRANCHES:] **= 2
                own[:, :BRANCHES] *= own[:, BRANCHES:]
                total[block] = total[block] + own if block in total else own
        for block, x in total.items():
            x[:, :BRANCHES] /= np.where(x[:, BRANCHES:] > 0, x[:, BRANCHES:], 1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["block", "data"])

    schema = "block int, data binary"
    learnt = known.select("ids").coalesce(2 * sc.defaultParallelism).mapInArrow(learn, schema)
    found = learnt.repartitionById(blocks, "block").mapInArrow(mean, schema).toArrow()
    shared.unpersist()
    table = model.table.copy()
    for block, data in zip(found["block"].to_pylist(), found["data"], strict=True):
        own = np.frombuffer(data.as_buffer(), np.float32).reshape(size, -1)
        met = own[:, BRANCHES] > 0  # other rows stay as they are
        table[block * size : (block + 1) * size][met] = own[met]
    return replace(model, table=table)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_prob (natural) and perplexity of every document, from its text or the ids of :func:`coded`."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for first, own, bounds in runs(b, model):
                total = np.append(0.0, np.cumsum(log_probabilities(model, own, history(own, bounds))))
                log = total[bounds[1:]] - total[bounds[:-1]]
                n = np.diff(bounds)
                with np.errstate(invalid="ignore", divide="ignore"):
                    perplexity = np.exp(-log / n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, len(n)), pa.array(n, pa.int64()), pa.array(log), pa.array(perplexity, from_pandas=False)], ["doc_id", "n_words", "log_prob", "perplexity"]
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text" if "text" in documents.columns else "ids").mapInArrow(run, f"doc_id {kind}, n_words long, log_prob double, perplexity double")
