"""Vectorised text kernels shared by the operators of this subpackage.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; the split is therefore the same
on UTF-8 bytes as on code points.  All hashing is done with NumPy over the byte buffer of an Arrow
column, in slices of bounded size, so that memory doesn't follow the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one call of a kernel handles at a time (a longer document is one slice).
SLICE_BYTES = 1_000_000
#: Bytes that are hashed at once; a longer buffer is cut at white space.
PIECE_BYTES = 500_000

_U = np.uint64
_C1, _C2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), on a copy."""
    x = x ^ (x >> _U(30))
    x *= _C1
    x ^= x >> _U(27)
    x *= _C2
    x ^= x >> _U(31)
    return x


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow.get(0)
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        for key, base in ((0, _P), (1, _P_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _pow[key] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and the first word of each document (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first = np.zeros(n, dtype=bool)
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _C2)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = False, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with ``second``, of an independent family."""
    table = _BYTE2 if second else _BYTE
    if lower:
        table = table[LOWER]
    if len(data) <= PIECE_BYTES:
        return _hash_piece(data, starts, ends, table)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + PIECE_BYTES, side="right")))
        out[i:j] = _hash_piece(data[at : ends[j - 1]], starts[i:j] - at, ends[i:j] - at, table)
        i = j
    return out


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, body = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts record batches into slices of about SLICE_BYTES of text, with bytes and offsets of each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = column(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def per_doc(ptr: np.ndarray) -> np.ndarray:
    """The document of each word, from the first word of each document."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in [ptr[i], ptr[i+1])."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions whose n words pass the end are left out."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, (n * int(_C1)) & (2**64 - 1), dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + m]) * _P
        out ^= out >> _U(29)
    return mix(out)
