"""UTF-8 word and shingle hashing in numpy.

Works on the raw UTF-8 bytes of an Arrow string column, so a batch of documents is
tokenised and hashed without creating one Python object per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from fathomline.functions.text import FAR_SPACES, NEAR_SPACES

#: Bytes handled at once by the vectorised hashers; longer words enlarge their own piece.
PIECE = 1 << 21

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: One random 64-bit value for each byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

#: Separators of words: space and the ASCII controls tab to carriage return.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_SPACES = [c.encode() for c in NEAR_SPACES + FAR_SPACES]
_NEAR_SPACE = np.isin(np.arange(256), [x[0] for x in _SPACES if len(x) == 1])


def ascii_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are in SEPARATOR."""
    return SEPARATOR[data]


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space of any script, as functions/text splits at it."""
    out = _NEAR_SPACE[data]
    for lead in {x[0] for x in _SPACES if len(x) > 1}:
        at = np.flatnonzero(data == lead)
        for space in (x for x in _SPACES if len(x) > 1 and x[0] == lead and len(at)):
            hits = at[at <= len(data) - len(space)]
            for i, byte in enumerate(space):
                hits = hits[data[hits + i] == byte]
            for i in range(len(space)):
                out[hits + i] = True
    return out


#: A-Z to a-z on bytes; every other byte is kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, PIECE + 1)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def byte_runs(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive rows of about `most` bytes of text; a longer text is a run of its own."""
    offsets = utf8(column)[0]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def word_spans(offsets: np.ndarray, data: np.ndarray, space: Callable[[np.ndarray], np.ndarray] = ascii_space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words in order; document d has words first[d] to first[d+1]-1."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (ascending, not overlapping); equal bytes, equal hash."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


_STEP = [np.uint64(int(x)) for x in mix(np.arange(11, 43, dtype=np.uint64))]


def runs_of(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs inside documents and the number of runs of each document."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), counts
    ends = np.cumsum(counts)
    at = np.arange(total) + np.repeat(first[:-1] - (ends - counts), counts)
    x = np.full(total, np.uint64(k))
    for i in range(k):
        x = mix(x * _STEP[0] + hashes[at + i] + _STEP[1])
    return x, counts


def shingle_sets(column: pa.Array, k: int, space: Callable[[np.ndarray], np.ndarray] = ascii_space) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its k-word shingles.

    Words are maximal runs of bytes that are no space, A-Z lower-cased. A text with fewer
    than k words has its whole word sequence as one shingle; without words it has none.
    """
    offsets, data = utf8(column)
    data = LOWER[data]
    starts, ends, first = word_spans(offsets, data, space)
    hashes = span_hashes(data, starts, ends)
    runs, counts = runs_of(hashes, first, k)
    cut = np.concatenate([[0], np.cumsum(counts)])
    words = np.diff(first)
    out = []
    for d in range(len(words)):
        if counts[d]:
            found = np.sort(runs[cut[d] : cut[d + 1]])  # several times as fast as np.unique
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif words[d]:
            out.append(runs_of(hashes, first[d : d + 2], int(words[d]))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def window_sets(column: pa.Array, k: int, window: int, step: int, space: Callable[[np.ndarray], np.ndarray] = ascii_space) -> tuple[list[np.ndarray], np.ndarray]:
    """(sets, windows): for each window of each text what shingle_sets() has for a text of its words, and the number of windows of each text.

    Windows begin at every step-th word; the last is the first that reaches the end. A text without words has none.
    """
    offsets, data = utf8(column)
    data = LOWER[data]
    starts, ends, first = word_spans(offsets, data, space)
    hashes = span_hashes(data, starts, ends)
    runs, counts = runs_of(hashes, first, k)
    cut = np.cumsum(counts) - counts
    words = np.diff(first)
    windows = np.where(words == 0, 0, 1 + np.maximum(-((window - words) // step), 0))
    out = []
    for d in np.flatnonzero(windows):
        for at in range(0, windows[d] * step, step):
            n = min(window, words[d] - at)
            if n >= k:
                found = np.sort(runs[cut[d] + at : cut[d] + at + n - k + 1])
                out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
            else:
                out.append(runs_of(hashes, first[d] + np.array([at, at + n]), int(n))[0])
    return out, windows
