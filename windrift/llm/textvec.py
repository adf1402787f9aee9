"""Vectorised kernels over Arrow string columns, used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel takes at a time (a longer single text goes alone), and rows.
SLICE_BYTES, SLICE_ROWS = 1 << 21, 4096

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
COEF = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POW = np.ones(1, np.uint64)
#: Bytes whose spans are hashed together, and the inverse powers of the base at their starts.
_BLOCK = 1 << 16
_INVERSE = np.cumprod(np.append(np.uint64(1), np.full(_BLOCK - 1, pow(int(_BASE), -1, 1 << 64), np.uint64)), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        full = np.full(max(n, 2 * len(_POW), 256), _BASE)
        full[0] = 1
        _POW = np.cumprod(full, dtype=np.uint64)
    return _POW


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def slices(col: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """(first row, bytes, offsets from 0) of runs of rows within the limits."""
    data, offsets = strings(col)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def span_hashes(kept: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs of ``kept`` that start at ``first``; they tile it."""
    if not len(first):
        return np.zeros(0, np.uint64)
    ends = np.append(first[1:], len(kept))
    lens = ends - first
    if not lens.all():
        pos = np.arange(len(kept)) - np.repeat(first, lens)
        h = np.add.reduceat(_BYTE[kept] * _powers(int(lens.max()))[pos], first)
        return mix(h ^ (lens.astype(np.uint64) * COEF[0]))
    h, i = np.empty(len(first), np.uint64), 0
    while i < len(first):  # powers go on through a block; dividing by that of its start makes a span's begin at 1
        lo = int(first[i])
        j = max(i + 1, int(np.searchsorted(first, lo + _BLOCK)))
        part, at = kept[lo:int(ends[j - 1])], first[i:j] - lo
        h[i:j] = np.add.reduceat(_BYTE[part] * _powers(len(part))[:len(part)], at) * _INVERSE[at]
        i = j
    return mix(h ^ (lens.astype(np.uint64) * COEF[0]))


def byte_table(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: White space of the word contract; A-Z folded.
SPACE = byte_table([0x20, *range(0x09, 0x0E)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, fold: np.ndarray | None = FOLD):
    """(hash, first byte, last byte + 1) of each word and the words of each row."""
    b = data if fold is None else fold[data]
    keep = ~separator[b]
    n = len(b)
    before = np.zeros(n + 1, bool)
    before[1:] = keep
    before[offsets] = False
    start = keep & ~before[:n]
    first = np.flatnonzero(start)
    hashes = span_hashes(b[keep], np.flatnonzero(start[keep]))
    counts = np.diff(np.searchsorted(first, offsets))
    lens = np.diff(np.append(np.flatnonzero(start[keep]), int(keep.sum())))
    return hashes, first, first + lens, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each row; how many in each row).  A
    row of fewer words has its whole sequence as one shingle, a row of none has none."""
    ends = np.cumsum(counts)
    starts = ends - counts
    rows = np.repeat(np.arange(len(counts)), counts)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    at = np.arange(len(hashes)) - starts[rows] if len(hashes) else np.zeros(0, np.int64)
    for j in range(size):
        inside = at + j < counts[rows]
        total += np.where(inside, padded[j:j + len(hashes)] * COEF[j + 1], np.uint64(0))
    total += np.minimum(counts[rows], size).astype(np.uint64) * COEF[9]
    valid = at <= np.maximum(counts[rows] - size, 0)
    s, r = mix(total[valid]), rows[valid]
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[new], np.bincount(r[new], minlength=len(counts))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first byte of each) of valid UTF-8 bytes."""
    lead = np.flatnonzero(data.view(np.int8) >= -64)
    try:
        return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.int32).copy(), lead
    except UnicodeDecodeError:
        pass
    b = data[lead].astype(np.int32)
    out = b.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    for size, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
        m = np.flatnonzero((b >= low) & (b < high))
        if len(m):
            v = b[m] & bits
            for j in range(1, size):
                v = (v << 6) | (padded[lead[m] + j] & 0x3F)
            out[m] = v
    return out, lead


def ranges(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of first[i] .. first[i] + lens[i] - 1."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - lens), lens)


def binary_column(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a 2-d uint8 array."""
    n, w = rows.shape
    offsets = np.arange(0, (n + 1) * w, w, dtype=np.int32)[:n + 1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()),
                                                  pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
