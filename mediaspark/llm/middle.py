"""Fill-in-the-middle texts, cut through a learned rank index.

Cuts are given in code points, texts are UTF-8 bytes.  The byte offset of every
code-point boundary of a stretch of texts is a rising sequence, and the index
of a boundary's rank is a few line segments: a segment starts at a boundary,
its slope is a fixed-point number, and no offset in it lies further than
``ERROR`` bytes from the line.  What is left of each offset after the
prediction is stored in one byte.  A cut at a rank is its segment's prediction
plus the stored rest, which is the exact offset.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import let
from mediaspark.llm.words import chunks

#: Bytes by which a prediction may miss; rests fit a signed byte.
ERROR = 127
#: Fraction bits of a slope.
_BITS = 20

# fixed values: the markers before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class RankIndex:
    """Offsets by rank, as line segments with rests.

    A segment grows to twice its length while the line through its ends stays
    within ``error`` of all offsets, and halves if its first length is too
    long; the next one starts with the length of the last.
    """

    def __init__(self, offsets: np.ndarray, error: int = ERROR, first: int = 4096):
        starts, bases, slopes, rests = [], [], [], []
        at, length, n = 0, first, len(offsets)
        while at < n:
            fit = self._fit(offsets[at : at + length], error)
            while fit is None:
                length = max(1, length // 2)
                fit = self._fit(offsets[at : at + length], error)
            while at + length < n and (longer := self._fit(offsets[at : at + 2 * length], error)) is not None:
                length, fit = 2 * length, longer
            starts.append(at)
            bases.append(int(offsets[at]))
            slopes.append(fit[0])
            rests.append(fit[1])
            at += length
        self.starts, self.bases, self.slopes = (np.array(x, dtype=np.int64) for x in (starts, bases, slopes))
        self.rests = np.concatenate(rests) if rests else np.zeros(0, np.int8)

    @staticmethod
    def _fit(part: np.ndarray, error: int) -> tuple[int, np.ndarray] | None:
        slope = (int(part[-1] - part[0]) << _BITS) // max(1, len(part) - 1)
        rest = part - part[0] - ((np.arange(len(part)) * slope) >> _BITS)
        return (slope, rest.astype(np.int8)) if -error <= rest.min() and rest.max() <= error else None

    def __call__(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of the boundaries with these ranks."""
        segment = np.searchsorted(self.starts, ranks, side="right") - 1
        predicted = self.bases[segment] + (((ranks - self.starts[segment]) * self.slopes[segment]) >> _BITS)
        return predicted + self.rests[ranks]


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits that depend on the key and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, rate: int = 90, suffix_first: int = 20,
) -> DataFrame:
    """One row per input row: key, n (code points), form, prefix_chars,
    middle_chars, output.

    Of 100 documents ``rate`` are reordered, and of 100 of these
    ``suffix_first`` start with their suffix (form ``spm``), the others with
    their prefix (``psm``).  A text that is empty or holds a marker stays
    ``plain``, with null cuts.

    A null text is empty; a null key draws as an empty one; the rows that
    repeat a key draw alike; an empty table gives no rows; other columns are
    not read.  A text is cut as a whole, whatever its length.
    """
    kind = docs.schema[key].dataType.simpleString()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    marker = re.compile(b"|".join(re.escape(m) for m in marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                h1, h2, h3, h4 = (batch.column(i).slice(a, b - a).to_numpy() for i in range(2, 6))
                raw = data.tobytes()
                # every boundary of a code point, and the end
                bounds = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                index = RankIndex(bounds)
                first = np.searchsorted(bounds, offsets)
                n = first[1:] - first[:-1]
                cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
                low, high = index(first[:-1] + cuts[0]), index(first[:-1] + cuts[1])
                plain = (n == 0) | (h3 % 100 >= rate)
                for m in marker.finditer(raw):
                    owner = int(np.searchsorted(offsets, m.start(), side="right")) - 1
                    # two texts may make a marker between them, which is none
                    plain[owner] |= m.end() <= offsets[owner + 1]
                suffixed = ~plain & (h4 % 100 < suffix_first)
                out = []
                for i, (p, q) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                    s, e = int(offsets[i]), int(offsets[i + 1])
                    if plain[i]:
                        out.append(raw[s:e])
                    elif suffixed[i]:
                        out.append(b"".join([marks[1], raw[q:e], marks[0], raw[s:p], marks[2], raw[p:q]]))
                    else:
                        out.append(b"".join([marks[0], raw[s:p], marks[1], raw[q:e], marks[2], raw[p:q]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(np.where(plain, "plain", np.where(suffixed, "spm", "psm"))),
                        pa.array(cuts[0], pa.int64(), mask=plain), pa.array(cuts[1] - cuts[0], pa.int64(), mask=plain), pa.array(out, pa.binary()).view(pa.string()),
                    ],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    draws = [h.alias(f"h{i}") for i, h in enumerate(_draws(F.col(key), seed))]
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"), *draws)
    out = rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.  A marker begins with a sign that
    it holds once, and the text holds none, so that the markers stand where the
    first match of each is."""
    parts = lambda p, m, s: F.concat(*[F.get(p, i) for i in m], F.get(p, s))
    any_mark = "|".join((PREFIX, SUFFIX, MIDDLE))
    psm = let(F.split(output, any_mark, -1), lambda p: parts(p, (1, 3), 2))
    spm = let(F.split(output, any_mark, -1), lambda p: parts(p, (2, 3), 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
