"""Hashes of words and of byte windows, for whole batches of texts at once.

Used inside tasks only: a batch of texts comes as one run of UTF-8 bytes with
offsets, and all arithmetic is on 64-bit words that wrap around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=_U)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n <= 1 << 22:
            _powers[base] = known
    return known[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``window`` takes the hash of any stretch of bytes."""
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTES[data] * _power(_BASE, len(data)), out=sums[1:])
    return sums


def window(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end); equal bytes have equal hashes."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start] + (end - start).astype(_U))


def chunks(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of stretches of about
    ``size`` bytes; a text is never split, null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, ink_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one more) of the words: runs
    of bytes that are no white space, or that ``ink_of`` marks."""
    ink = ~SPACE[data] if ink_of is None else ink_of[data]
    head = np.ones(len(data) + 1, dtype=bool)
    head[1:-1] = ~ink[:-1]
    head[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(ink & head[:-1])
    stop = np.ones(len(data), dtype=bool)
    stop[:-1] = ~ink[1:]
    last = offsets[1:] - 1
    stop[last[last >= 0]] = True
    ends = np.flatnonzero(ink & stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of letters: A-Z, a-z and all of other scripts.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, ink_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z in lower case, and the first word of each
    text and one more."""
    starts, ends, firsts = word_bounds(data, offsets, ink_of)
    return window(prefix_sums(LOWER[data]), starts, ends), firsts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``n`` words of each text; with
    fewer words all of them are one run; without words there is none."""
    hashes, firsts = word_hashes(data, offsets)
    turn = [_U((2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64) for i in range(n)]
    runs = np.zeros(max(0, len(hashes) - n + 1), dtype=_U)
    for i in range(n):
        runs += hashes[i : i + len(runs)] * turn[i]
    runs = mix(runs)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            short = mix((hashes[a:b] * np.array(turn[: b - a], dtype=_U)).sum(keepdims=True) + _U(b - a))
            out.append(mix(short))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out
