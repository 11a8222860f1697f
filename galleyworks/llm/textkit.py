"""Word and shingle hashes of Arrow text columns in numpy, a few MB of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
CHUNK = 1 << 19
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    _WORD[_c] = True
_WORD[128:] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x moves every bit of the result."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^n-1 and their inverses modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, CHUNK).bit_length()
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def free_name(df, *wanted: str) -> list[str]:
    """Names for internal columns that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, rows) with at most `most` bytes of text each, one row at least; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(column):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        yield a, b, column.slice(a, b - a)
        a = b


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string array without nulls, and its len+1 offsets."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a run of ASCII letters, digits, underscores and bytes of other characters."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = _WORD[data]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, w[1:]
    starts = np.flatnonzero(w & (~before | cut[:-1]))
    ends = np.flatnonzero(w & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from one prefix sum over all bytes."""
    if not len(starts):
        return np.zeros(0, U)
    p, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every `width`-word shingle of the lowercased texts; a text of fewer words has one of all its words."""
    data, offsets = flat(pc.utf8_lower(column))
    starts, ends, row = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    n = np.bincount(row, minlength=len(column)) if len(row) else np.zeros(len(column), np.int64)
    first = np.cumsum(n) - n
    c = [U(pow(_P, 3 * k + 1, 1 << 64)) for k in range(width)]
    with np.errstate(over="ignore"):
        if len(h) >= width:
            whole = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
            s = np.zeros(len(whole), U)
            for k in range(width):
                s += h[whole + k] * c[k]
            rows, out = row[whole], mix(s)
        else:
            rows, out = np.zeros(0, np.int64), np.zeros(0, U)
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            s = np.zeros(len(short), U)
            for k in range(width - 1):
                there = n[short] > k
                s[there] += h[first[short[there]] + k] * c[k]
            rows, out = np.concatenate([rows, short]), np.concatenate([out, mix(s + n[short].astype(U))])
    order = np.lexsort((out, rows))
    return rows[order], out[order]


def counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs of sorted ones, and how often each came."""
    if not len(rows):
        return rows, hashes, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])]))
    return rows[new], hashes[new], np.diff(np.append(new, len(rows)))
