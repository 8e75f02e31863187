"""Vectorised text helpers used inside Arrow tasks.

A word is a run of bytes outside ASCII white space (``[^\\x20\\x09-\\x0D]+``).
Texts are handled as the UTF-8 bytes of an Arrow column, in slices of whole
documents of about ``SLICE_BYTES`` (one longer document makes its own slice),
so a task's memory follows the slice and the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``BATCH_ROWS`` rows at most:
    with texts in them, Spark's default of 10,000 rows takes hundreds of MB of
    executor memory outside the heap and as much again in Python."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_table(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = _BASE if kind == "up" else _BASE_INVERSE
        have = np.empty(max(n, SLICE_BYTES + 1), U64)
        have[0] = 1
        have[1:] = step
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


@dataclass
class Slice:
    """Rows ``[lo, hi)`` of a batch: their bytes, and row offsets into them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole-document slices of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Slice(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def word_spans(s: Slice, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and ``first``: document i of the
    slice holds words ``first[i]:first[i + 1]``.  ``cuts`` flags bytes before
    which a word is cut in two."""
    if not len(s.data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(s.rows + 1, np.int64)
    inside = ~SPACE[s.data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = s.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(s.data))]
    opens[edges] |= inside[edges]
    closes[edges - 1] |= inside[edges - 1]
    if cuts is not None:
        opens |= cuts
        closes[:-1] |= cuts[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, s.offsets).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by differences of one running polynomial."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _power_table("up", len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power_table("down", len(data))[starts] + (ends - starts).astype(U64))


_MULTIPLIERS = [U64(int(m)) for m in mix(np.arange(1, 33, dtype=U64) * _BASE) | U64(1)]


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` consecutive words that stay within a
    document, and ``first`` for them; ``size`` is 32 at most."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if len(words) < size:
        return np.zeros(0, U64), at
    n = len(words) - size + 1
    h = words[:n] * _MULTIPLIERS[0]
    for k in range(1, size):
        h = h + words[k:k + n] * _MULTIPLIERS[k]
    # word positions from which a whole window fits into the document
    keep = np.arange(at[-1], dtype=np.int64) + np.repeat(first[:-1] - at[:-1], counts)
    return mix(h[keep]), at


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true flags between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
