"""Word and shingle hashes of whole texts in numpy, a few megabytes of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix, spans

STEP = 1 << 20
_U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
#: Words of more bytes are hashed byte by byte, not eight bytes a step.
_LONG = 256
_PLACE = mix(np.arange(7, 7 + 16, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)
_BASE = 0x9FB21C651E98DF25
_powers = {_BASE: np.ones(1, _U)}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """Powers of an odd number modulo 2**64, n of them at least."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 1 << 16), _U(base))
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base]


#: Its powers undo those of the base.
INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the rows in data, lower-cased, and for each row the number of its first word (n+1 numbers)."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(at), np.int64)
    # white space is \x20 and \x09-\x0D; plain arithmetic is faster here than a table's look-ups
    inside = (data != 32) & (data - np.uint8(9) > 4)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    size = last - first
    lower = np.zeros(len(data) + 8, np.uint8)
    lower[: len(data)] = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    # eight bytes from any place on, read as one number; of a word's last ones, what lies behind it is shifted out
    eights = np.ascontiguousarray(np.ndarray(len(data) + 1, "<u8", lower, strides=(1,)))
    hashes = mix(eights[first] << ((8 - np.minimum(size, 8)).astype(_U) << _U(3)))
    on, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(on):
        left = size[on] - done
        hashes[on] = mix(hashes[on] * _U(_BASE) + (eights[first[on] + done] << ((8 - np.minimum(left, 8)).astype(_U) << _U(3))))
        on, done = on[left > 8], done + 8
    if len(on := np.flatnonzero(size > _LONG)):
        # running sums of bytes times powers; a word's part of them, brought back to the powers from 0
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[lower[: len(data)]] * powers(len(data))[: len(data)], out=total[1:])
        hashes[on] = (total[last[on]] - total[first[on]]) * powers(len(data), INVERSE)[first[on]]
    return mix(hashes + size.astype(_U)), np.searchsorted(first, at)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row in order, and n+1 places. A row of fewer words has its whole sequence as one; a row without words has none."""
    n = np.diff(counts)
    sizes = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(out_at[-1], _U)
    if not len(out):
        return out, out_at
    full = len(words) - k + 1
    if full > 0:
        total = words[:full] * _PLACE[0]
        for j in range(1, k):
            total += words[j : j + full] * _PLACE[j]
        total = mix(total + _U(k))
        long = n >= k
        lens = sizes[long]
        src = np.repeat(counts[:-1][long] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        out[np.repeat(long, sizes)] = total[src]
    for m in range(1, k):
        at = np.flatnonzero(n == m)
        out[out_at[at]] = mix((words[counts[at, None] + np.arange(m)] * _PLACE[:m]).sum(axis=1, dtype=_U) + _U(m))
    return out, out_at


def sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes, for every row."""
    for a, b in spans(at, STEP):
        words, counts = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a])
        hashes, places = shingles(words, counts, k)
        for i in range(b - a):
            yield a + i, np.unique(hashes[places[i] : places[i + 1]])
