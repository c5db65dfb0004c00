"""Tokens of whole batches of texts, for use inside tasks.

The same tokens as ``functions.text`` gives as column expressions.  Texts are
cut at white space by Arrow, and each distinct piece of a stretch is put into
lower case and freed of punctuation once.  White space ends a word for case
mapping too, so a piece alone gives what it gives inside its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mediaspark.config import LOW_SIGNAL_WORDS
from mediaspark.functions.text import PUNCTUATION_AND_DASHES

#: Bytes of texts that are cut at once.
STRETCH = 4 << 20
_DROPPED = str.maketrans("", "", PUNCTUATION_AND_DASHES)
_PUNCTUATION = f"[{re.escape(PUNCTUATION_AND_DASHES)}]"
_U = np.uint64


def stretches(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of stretches of about ``STRETCH`` bytes; a text is never split."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(texts):
        before = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, before + STRETCH, side="right")))
        yield row, texts.slice(row, end - row)
        row = end


def _plain(pieces: pa.Array) -> pa.Array:
    """Pieces in lower case, without punctuation."""
    marked = pc.match_substring_regex(pieces, _PUNCTUATION)
    ascii_only = pc.string_is_ascii(pieces)
    out = pc.ascii_lower(pieces)
    both = pc.and_(ascii_only, marked)
    out = pc.replace_with_mask(out, both, pc.replace_substring_regex(out.filter(both), _PUNCTUATION, ""))
    # case mapping of other scripts depends on neighbours
    other = pc.invert(ascii_only)
    return pc.replace_with_mask(out, other, pa.array([w.lower().translate(_DROPPED) for w in pieces.filter(other).to_pylist()], pa.string()))


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number, names): the tokens of texts in order, repeats kept, as
    numbers of their distinct names.  Null has none."""
    cut = pc.utf8_split_whitespace(texts.cast(pa.string()))
    coded = cut.flatten().dictionary_encode()
    named = _plain(coded.dictionary).dictionary_encode()
    row = np.repeat(np.arange(len(cut)), cut.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    number, names = named.indices.to_numpy()[coded.indices.to_numpy()], named.dictionary
    kept = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[number] if len(names) else np.zeros(0, dtype=bool)
    return row[kept], number[kept], names


def counts(names: pa.Array, number: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """How often every name occurs."""
    n = np.bincount(number, minlength=len(names))
    at = np.flatnonzero(n)
    return names.take(pa.array(at)), pa.array(n[at], pa.int64())


def count_in_match(names: pa.Array) -> np.ndarray:
    """Which tokens count in a keyword match."""
    kept = pc.and_(pc.greater(pc.utf8_length(names), 1), pc.invert(pc.is_in(names, value_set=pa.array(LOW_SIGNAL_WORDS))))
    return kept.to_numpy(zero_copy_only=False)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=_U)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def word_ids(names: pa.Array) -> np.ndarray:
    """64-bit hashes of names; equal names have equal ids, wherever they are worked out."""
    names = names.cast(pa.large_binary())
    ends = np.frombuffer(names.buffers()[1], dtype=np.int64)[names.offset : names.offset + len(names) + 1]
    if not len(names) or ends[-1] == ends[0]:
        return _mix(np.zeros(len(names), dtype=_U)).view(np.int64)
    data = np.frombuffer(names.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    start, end = ends[:-1] - ends[0], ends[1:] - ends[0]
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTES[data] * _powers(_BASE, len(data)), out=sums[1:])
    back = _powers(pow(_BASE, -1, 2**64), len(data) + 1)
    return _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(_U)).view(np.int64)


def distinct_ids(row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of a row once, by rows and ids."""
    order = np.lexsort((ids, row))
    row, ids = row[order], ids[order]
    first = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])) if len(row) else np.zeros(0, dtype=bool)
    return row[first], ids[first]
