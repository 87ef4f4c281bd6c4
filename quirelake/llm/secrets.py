"""Secret scan: sliding-window Shannon entropy per character class.

For each class of characters (hexadecimal, capitals with digits, Base64) the candidate strings are the
maximal runs of its characters that fill a window. The window slides over each
candidate; counts of its characters are kept by adding one character and
dropping one, and with them the sum of c * log2(c), from which the entropy
follows. All candidates of a batch advance together. Windows at or above the
threshold of the class merge into findings, without the windows that overlap a
match of the allow list: what is allowed hides nothing beside it.

The scan is one pass without a shuffle. Texts without any run as long as the
shortest window are told apart in the JVM and never reach Python.

Defined results. Null and empty texts hold no secrets; a null stays null.
Repeated rows give their findings once each; a string may be found in several classes, and of equal
windows all count. Very long candidates are cut into
overlapping pieces, with the same windows. Columns other than doc_id and text
are not read by :func:`findings` and are passed on by :func:`redacted`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import _text

PIECE = 4096
MASK = "[secret]"


@dataclass(frozen=True)
class CharClass:
    name: str
    alphabet: str
    window: int
    least: float


#: Windows of random digits have 3.3 bits in the first class and 3.9 in the second, with deviations of 0.2 and
#: 0.15; the limits are four of them lower. The third holds words as well, so its limit is higher.
CLASSES = (
    CharClass("hex", "0123456789abcdefABCDEF", 16, 2.5),
    CharClass("capitals", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 3.3),
    CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.1),
)
#: Candidates that look random to a counter of characters and are no secrets.
ALLOWED = (
    r"^[0-9]+$",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(?i)example|placeholder|changeme|xxxx",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)


def entropies(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int, letters: int) -> np.ndarray:
    """Entropy of the window that begins at each position; -1 where none does."""
    out = np.full(len(codes), -1.0)
    if not len(starts):
        return out
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    weigh = np.arange(window + 2) * np.log2(np.maximum(1, np.arange(window + 2)))
    counts = np.zeros((len(starts), letters), np.int32)
    total = np.zeros(len(starts))
    row = np.arange(len(starts))
    for t in range(int(lengths[0])):
        m = int(np.searchsorted(-lengths, -t, "left"))
        if t >= window:
            gone = codes[starts[:m] + t - window]
            c = counts[row[:m], gone]
            total[:m] += weigh[c - 1] - weigh[c]
            counts[row[:m], gone] = c - 1
        new = codes[starts[:m] + t]
        c = counts[row[:m], new]
        total[:m] += weigh[c + 1] - weigh[c]
        counts[row[:m], new] = c + 1
        if t >= window - 1:
            out[starts[:m] + t - window + 1] = np.log2(window) - total[:m] / window
    return out


def _pieces(starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    s, n = [starts], [np.minimum(ends - starts, PIECE)]
    for i in np.flatnonzero(ends - starts > PIECE):
        more = np.arange(starts[i] + PIECE - window + 1, ends[i] - window + 1, PIECE - window + 1)
        s.append(more)
        n.append(np.minimum(ends[i] - more, PIECE))
    return np.concatenate(s), np.concatenate(n)


def scan(piece: pa.Array, classes: tuple[CharClass, ...], allowed: re.Pattern) -> Iterator[tuple[int, str, int, int, float]]:
    """Row, class, first byte, end byte and highest entropy of each finding, in order within a class."""
    data, offsets = _text.raw(piece)
    for k in classes:
        kind = np.zeros(256, bool)
        codes = np.zeros(256, np.int64)
        kind[list(k.alphabet.encode())] = True
        codes[list(k.alphabet.encode())] = np.arange(len(k.alphabet))
        starts, ends = _text.runs(data, offsets, kind)
        fit = ends - starts >= k.window
        starts, ends = starts[fit], ends[fit]
        lengths = ends - starts
        base = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        at = np.repeat(starts - base[:-1], lengths) + np.arange(base[-1])
        found = entropies(codes[data[at]], *_pieces(base[:-1], base[1:], k.window), k.window, len(k.alphabet))
        for i in range(len(starts)):
            own = found[base[i] : base[i + 1]]
            high = np.flatnonzero(own >= k.least)
            if not len(high):
                continue
            for m in allowed.finditer(data[starts[i] : ends[i]].tobytes().decode("ascii")):
                high = high[(high >= m.end()) | (high + k.window <= m.start())]
            if not len(high):
                continue
            for part in np.split(high, np.flatnonzero(np.diff(high) > k.window) + 1):
                row = int(np.searchsorted(offsets, starts[i], "right")) - 1
                first = int(starts[i] + part[0])
                yield row, k.name, first, int(starts[i] + part[-1]) + k.window, float(own[part].max())


def _prefilter(classes: tuple[CharClass, ...]) -> str:
    letters = re.escape("".join(sorted(set("".join(k.alphabet for k in classes)))))
    return f"[{letters}]{{{min(k.window for k in classes)}}}"


def findings(documents: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, kind, start and n_chars (in characters), entropy and a masked form of every finding."""
    allowed = re.compile("|".join(f"(?:{x})" if not x.startswith("(?i)") else f"(?i:{x[4:]})" for x in allow) or r"(?!)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            rows: list[tuple] = []
            for first, piece in _text.slices(_text.large(b.column("text"))):
                data, offsets = _text.raw(piece)
                for row, kind, start, end, entropy in scan(piece, classes, allowed):
                    before = data[offsets[row] : start].tobytes().decode()
                    rows.append((first + row, kind, len(before), end - start, entropy, data[start : start + 4].tobytes().decode() + "*" * (end - start - 4)))
            if rows:
                at, kinds, starts, sizes, high, masked = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(kinds), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(high), pa.array(masked)],
                    ["doc_id", "kind", "start", "n_chars", "entropy", "masked"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").where(F.col("text").rlike(_prefilter(classes))).mapInArrow(run, f"doc_id {kind}, kind string, start int, n_chars int, entropy double, masked string")


def redacted(documents: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """All documents, with every finding replaced by a mask; n_chars, if there, follows the new text."""
    allowed = re.compile("|".join(f"(?:{x})" if not x.startswith("(?i)") else f"(?i:{x[4:]})" for x in allow) or r"(?!)")

    @F.arrow_udf("string")
    def masked(column: pa.Array) -> pa.Array:
        out: dict[int, list[tuple[int, int]]] = {}
        texts = _text.large(column)
        for first, piece in _text.slices(texts):
            _, offsets = _text.raw(piece)
            for row, _, start, end, _ in scan(piece, classes, allowed):
                out.setdefault(first + row, []).append((start - int(offsets[row]), end - int(offsets[row])))
        result = [None] * len(column)
        for row, spans in out.items():
            text, at, parts = texts[row].as_py().encode(), 0, []
            for start, end in sorted(spans):
                if start >= at:
                    parts += [text[at:start], MASK.encode()]
                at = max(at, end)
            result[row] = b"".join([*parts, text[at:]]).decode()
        return pa.array(result, pa.string())

    suspect = F.when(F.col("text").rlike(_prefilter(classes)), F.col("text"))
    out = documents.withColumn("text", F.coalesce(masked(suspect), F.col("text")))
    if "n_chars" in documents.columns:
        changed = F.length("text").cast(documents.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").contains(MASK), changed).otherwise(F.col("n_chars")))
    return out.select(documents.columns)
