"""Word shingles of texts as 64-bit hashes, computed for a whole Arrow batch at once.

Words are runs of anything but ASCII white space, after lower-casing A-Z.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is used below

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15 | 5)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_JOIN = U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A sum of powers modulo 2^64 can be the same for two regular strings of some thousand bytes: longer words get a digest.
LONG_WORD = 256
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    if which not in _powers or len(_powers[which]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each begins (and the end); null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    got = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return got, at - at[0]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first word of each text (and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = starts[:-1][starts[:-1] < n]
    first[edge] = solid[edge]
    begin = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = starts[1:-1]
    ends = ends[(ends > 0) & (ends <= n)] - 1
    last[ends] = solid[ends]
    end = np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power("up", _BASE, n), out=sums[1:])
    h = (sums[end] - sums[begin]) * _power("down", _BASE_INV, n)[begin]
    h = mix(h + (end - begin).astype(np.uint64) * _JOIN)
    for k in np.flatnonzero(end - begin >= LONG_WORD).tolist():
        h[k] = int.from_bytes(blake2b(_LOWER[data[begin[k] : end[k]]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(begin, starts)


def shingle_sets(column: pa.Array, size: int = 5):
    """For each text the sorted distinct hashes of its ``size``-word shingles.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    data, starts = text_bytes(column)
    words, at = word_hashes(data, starts)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        rolled = rolled * _JOIN + words[j : j + len(rolled)]
    rolled = mix(rolled ^ U(size))
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            whole = U(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * _JOIN + w
            yield mix(np.array([whole ^ U(b - a)]))
        else:
            yield np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """Parts of a batch with about ``most`` bytes of text each (a longer text is one part)."""
    size = pa.compute.binary_length(batch.column(text).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
    a = total = 0
    for i, n in enumerate(size):
        if total and total + n > most:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += int(n)
    if a < batch.num_rows:
        yield batch.slice(a)
