"""Arrow batches as byte arrays, and hashes of all their words or windows at once.

A prefix sum of ``table[byte] * BASE**i`` modulo 2**64 gives the polynomial hash of any
span as one subtraction and one product with an inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once; a longer document is a chunk of its own.
CHUNK = 2 << 20
BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_powers = (np.ones(1, _U), np.ones(1, _U))

_draw = np.random.default_rng(20240229)
TABLE = _draw.integers(1, 1 << 63, 256, dtype=_U) | _U(1)
FOLDED = TABLE.copy()
FOLDED[65:91] = TABLE[97:123]  # A-Z hash as a-z

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
OUTSIDE = WHITE.copy()
OUTSIDE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n."""
    global _powers
    if len(_powers[0]) < n:
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            row = np.full(n, base, _U)
            row[0] = 1
            both.append(np.cumprod(row, dtype=_U))
        _powers = tuple(both)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def prefix(codes: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Prefix sums whose differences are span hashes; one longer than ``codes``."""
    out = np.zeros(len(codes) + 1, _U)
    np.cumsum(table[codes] * powers(len(codes) + 1)[0][:-1], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans; the length is part of the hash."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` bytes."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, _U)
    return mix((sums[width:] - sums[:-width]) * powers(len(sums))[1][:n])


def pieces(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text, and their texts; null is empty."""
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a space after each, and the start of each (one more at the end)."""
    codes = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return codes, offsets


def words(texts: list[bytes], outside: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the case-folded words of all texts in order, and the first word of each text."""
    codes, offsets = joined(texts)
    off = outside[codes]
    change = np.flatnonzero(off[1:] != off[:-1]) + 1
    if not off[0]:
        change = np.concatenate([[0], change])
    starts, ends = change[0::2], change[1::2]
    hashes = spans(prefix(codes, FOLDED), starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per text; ``bounds`` as from ``words``."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the checksum of the id, as text, leaves ``part`` modulo ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """About ``per_class`` ids per label (at most twice as many in all likelihood), by the hash of the id.

    The result has a proven size bound only up to the number of labels, so callers keep
    those few; it is what the classifiers are fitted on.
    """
    share = (F.xxhash64(F.col("doc_id")) / F.lit(2.0**64) + F.lit(0.5)).cast("double")
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (share < F.lit(min(1.0, per_class / n))))
    return rows.where(keep).limit(2 * per_class * max(1, len(counts)))
