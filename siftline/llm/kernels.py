"""numpy kernels over Arrow text buffers: word hashing, shingles and ragged arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER ** i and its inverse modulo 2**64 for i < n, grown by doubling."""
    size = max(PIECE, 1 << (max(n, 1) - 1).bit_length())
    if size in _powers:
        return _powers[size]
    up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
    with np.errstate(over="ignore"):
        for out, base in ((up, MULTIPLIER), (down, INVERSE)):
            out[0], have = 1, 1
            while have < size:
                step = np.uint64(pow(int(base), have, 1 << 64))
                out[have : 2 * have] = out[:have] * step
                have *= 2
    if size == PIECE:
        _powers[size] = up, down
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0:
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[start:end]; equal bytes hash alike wherever they stand."""
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_in(raw: np.ndarray, space: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one buffer."""
    gap = space[_LOWER[raw] if lower else raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def pieces(raw: np.ndarray, space: np.ndarray = _SPACE) -> Iterator[tuple[int, int]]:
    """Cut a long buffer into runs of about PIECE bytes that end at white space, so no word is cut."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + PIECE)
        while end < n:
            gaps = np.flatnonzero(space[raw[end : end + PIECE]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(n, end + PIECE)
        yield at, end
        at = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of every text and the word offsets of the texts.

    Texts are handled in runs of about PIECE bytes, so a batch of very long texts needs little more than its own size.
    """
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, last in runs(offsets):
        lo, hi = offsets[first], offsets[last]
        if last - first == 1 and hi - lo > PIECE:
            for a, b in pieces(raw[lo:hi], space):
                part = _LOWER[raw[lo + a : lo + b]]
                s, e = words_in(part, space, False)
                hashes.append(span_hashes(part, s, e))
                counts[first] += len(s)
            continue
        part = _LOWER[raw[lo:hi]]
        cut = offsets[first : last + 1] - lo
        gap = space[part]
        starts = ~gap
        starts[1:] &= gap[:-1]
        inner = cut[:-1][cut[:-1] < len(part)]
        starts[inner] = ~gap[inner]
        ends = ~gap
        ends[:-1] &= gap[1:]
        last_of = cut[1:][(cut[1:] > 0)] - 1
        ends[last_of] = ~gap[last_of]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        hashes.append(span_hashes(part, s, e))
        counts[first:last] = np.diff(np.searchsorted(s, cut))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(counts)))


def runs(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Groups of consecutive texts of about limit bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k consecutive words; with fewer words, the whole sequence as one; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - size + 1, np.uint64(size))
        for j in range(size):
            acc = mix(acc * MULTIPLIER + words[j : n - size + 1 + j])
    return np.unique(acc)
