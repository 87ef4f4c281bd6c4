"""Repeated passages: Rabin-Karp hashes of every window of words, counted over the whole corpus.

Every run of ``width`` words of every document is hashed; a window whose hash
occurs again, anywhere, is repeated. Repeated windows of a document that overlap
or touch merge into maximal removal intervals.

Plan: texts are read once. Documents go through in batches, each with a number
of its own; a batch sends each of its window hashes (8 bytes) with its place
among the windows of the batch (2 bytes as a rule) to the task that counts that
part of the hashes, packed into one row for each such task. What returns to a
batch are the places of repeated windows; a table of the batch's documents, sent
once, turns them into intervals. Nothing is broadcast or collected. Two
different windows take each other for repeats with a chance of n / 2**64 each.

The number of parts follows the bytes that are read, so what a task holds stays
the same as the input grows; a batch grows with them, so that its rows stay
worth sending.

Batches are numbered by partition and order, so a lost task must read the same
rows again: documents should be a stored table, as is usual, rather than the
outcome of an unordered shuffle.

Defined results. Null and empty texts and those of fewer words than the width
have no windows. A null doc_id is kept as null; repeated rows repeat each
other's windows and are each reported. Columns other than doc_id (an integer)
and text are not read. Words are as in :mod:`quirelake.llm._text`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quirelake.llm import _text

WIDTH = 50
BATCH_BYTES = 6 << 20
PART_BYTES = 512 << 20
WORTH = 64  # windows that a batch sends to a part in the mean, at least
_U = np.uint64


def _row(part: list, batch: list, kind: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(batch, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["part", "batch", "kind", "data"])


def _packed(places: np.ndarray) -> bytes:
    """Rising numbers as a byte that tells the width, then their steps."""
    step = np.diff(places, prepend=0)
    size = next(k for k in (1, 2, 4) if not len(step) or step.max() < 1 << 8 * k)
    return bytes([size]) + step.astype(f"<u{size}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64))


def windows_of(t: _text.Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows within documents, in order, and how many each document has."""
    count = np.maximum(0, np.diff(t.bounds) - width + 1)
    hashes = _text.rolling(t.hashes, width)
    first = np.repeat(t.bounds[:-1] - (np.cumsum(count) - count), count)
    return hashes[first + np.arange(len(first))], count


def sent(width: int, parts: int, size: int):
    """mapInArrow: (doc_id, text) to rows for the counting tasks (kind 1) and the batch's table (kind 0)."""

    def flush(batch: int, held: list) -> Iterator[pa.RecordBatch]:
        hashes, count, ids = _join(held)
        part = ((hashes >> _U(40)) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(-1, ids.tobytes() + count.astype("<i8").tobytes())]
        for k in range(parts):
            own = order[cut[k] : cut[k + 1]]
            if len(own):
                places = _packed(own)
                rows.append((k, len(own).to_bytes(4, "little") + hashes[own].tobytes() + places))
        kinds = [int(k >= 0) for k, _ in rows]
        to = [k if k >= 0 else batch % parts for k, _ in rows]
        yield _row(to, [batch] * len(rows), kinds, [d for _, d in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, held_bytes = [], 0
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            valid = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            for t in _text.tokenised(b.column("text")):
                own = slice(t.first, t.first + len(t))
                held.append((*windows_of(t, width), ids[own], valid[own]))
                held_bytes += len(t.data)
                if held_bytes >= size:
                    yield from flush(number, held)
                    number, held, held_bytes = number + 1, [], 0
        if held:
            yield from flush(number, held)

    return run


def _join(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, count, ids, valid = (np.concatenate(x) for x in zip(*held, strict=True))
    fit = count > 0
    return hashes, count[fit], np.stack([ids[fit], valid[fit]])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over one part of the hashes: places of repeated windows by batch."""
    owners, hashes, places = [], [], []
    for b in batches:
        for batch, kind, data in zip(b.column("batch").to_pylist(), b.column("kind").to_pylist(), b.column("data"), strict=True):
            data = data.as_buffer().to_pybytes()
            if not kind:
                yield _row([0], [batch], [0], [data])
                continue
            n = int.from_bytes(data[:4], "little")
            owners.append(batch)
            hashes.append(np.frombuffer(data, np.uint64, n, 4))
            places.append(data[4 + 8 * n :])
    if not owners:
        return
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in hashes])])
    every = np.concatenate(hashes)
    del hashes
    order = np.argsort(every)
    every = every[order]
    same = np.zeros(len(every) + 1, bool)
    same[1:-1] = every[1:] == every[:-1]
    del every
    again = np.sort(order[same[1:] | same[:-1]])
    cut = np.searchsorted(again, bounds)
    for i, batch in enumerate(owners):
        own = again[cut[i] : cut[i + 1]] - bounds[i]
        if len(own):
            yield _row([0], [batch], [1], [_packed(_unpacked(places[i])[own])])


def intervals(places: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, windows) of merged windows; places rise."""
    before = np.concatenate([[0], np.cumsum(count)])
    doc = np.searchsorted(before, places, "right") - 1
    start = places - before[doc]
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(start) > width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    return doc[first], start[first], start[last] + width, last - first + 1


def merged(width: int):
    def run(table: pa.Table) -> pa.Table:
        kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
        known = next(d for k, d in zip(kinds, data, strict=True) if not k)
        known = np.frombuffer(known, "<i8").reshape(3, -1)
        hits = [np.zeros(0, np.int64), *(_unpacked(d) for k, d in zip(kinds, data, strict=True) if k)]
        doc, start, end, windows = intervals(np.sort(np.concatenate(hits)), known[2], width)
        ids = pa.array(known[0][doc], mask=known[1][doc] == 0)
        return pa.table({"doc_id": ids, "start_word": pa.array(start, pa.int64()), "end_word": pa.array(end, pa.int64()), "n_windows": pa.array(windows, pa.int64())})

    return run


def parts_of(documents: DataFrame, part_bytes: int) -> int:
    """How many tasks count the hashes: as many as shuffle partitions, or more where each would get over ``part_bytes``.

    A word has some 7 bytes of text and one window, of which 10 bytes are sent, so
    files of usual compression send three times the bytes that the plan reads.
    """
    spark = documents.sparkSession
    size = int(str(documents.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # a plan without statistics says more
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * size // part_bytes) if known else 1)


def repeated(documents: DataFrame, width: int = WIDTH, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) and n_windows of every maximal interval of repeated windows."""
    parts = parts_of(documents, part_bytes)
    batch_bytes = max(batch_bytes, 7 * WORTH * parts)
    rows = "part int, batch long, kind int, data binary"
    found = (
        documents.select("doc_id", "text")
        .mapInArrow(sent(width, parts, batch_bytes), rows)
        .repartitionById(parts, "part")
        .mapInArrow(counted, rows)
    )
    return found.groupBy("batch").applyInArrow(merged(width), "doc_id long, start_word long, end_word long, n_windows long")
