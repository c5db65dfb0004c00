"""Importance resampling towards a target, with a word automaton.

Features of a text are its runs of one to three words, hashed into buckets by
the CRC of their bytes.  No run is ever spelled out:

* A dictionary of distinct words is an Aho-Corasick automaton whose patterns
  are words between two delimiters.  Each carries its CRC, the CRC with a space
  in front, and its length.  One scan of the text emits these payloads.
* CRCs are linear: the CRC of a run is that of its front, moved on by as many
  zero bytes as the rest has, XOR that of the rest.  So neighbouring payloads
  give the CRCs of all runs, and these their buckets.

A pattern has delimiters at its ends only, so every failure link leads to the
state behind a delimiter or to the dead state that waits for the next one.  The
scan steps through a dense table for thousands of stretches of text at a time.
Every task grows its own dictionary from the words that it meets again, up to
``STATES``; the CRC of a word outside it is computed from its bytes, so that
results do not depend on the dictionary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import running, stored
from mediaspark.llm.words import chunks, prefix_sums, window

#: States of a task's automaton (a row of 4 bytes per symbol each, some 30 MB).
STATES = 1 << 17
#: Stretches of text that are scanned at a time.
LANES = 4096

_SPACE = 32
#: What each byte counts as: A-Z in lower case, all but letters, digits and non-ASCII bytes as a space.
_SIGN = np.full(256, _SPACE, dtype=np.uint8)
_SIGN[48:58] = np.arange(48, 58)
_SIGN[97:123] = _SIGN[65:91] = np.arange(97, 123)
_SIGN[128:] = np.arange(128, 256)


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _byte_table()


def _moved(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The registers ``c`` after the move that a (4, 256) table describes."""
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


class Shifts:
    """Moves CRC registers on by numbers of zero bytes."""

    NEAR = 64

    def __init__(self):
        one = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        near = [one]
        for _ in range(self.NEAR):
            near.append((near[-1] >> 8) ^ _CRC[near[-1] & 255])
        self.near = np.stack(near)
        self.powers = [self.near[1]]

    def _power(self, i: int) -> np.ndarray:
        while len(self.powers) <= i:
            self.powers.append(_moved(self.powers[-1], self.powers[-1]))
        return self.powers[i]

    def __call__(self, c: np.ndarray, by: np.ndarray) -> np.ndarray:
        few = np.minimum(by, self.NEAR)
        out = self.near[few, 0, c & 255] ^ self.near[few, 1, (c >> 8) & 255] ^ self.near[few, 2, (c >> 16) & 255] ^ self.near[few, 3, c >> 24]
        rest = by - few
        bit = 0
        while (rest >> bit).any():
            at = np.flatnonzero((rest >> bit) & 1)
            out[at] = _moved(self._power(bit), out[at])
            bit += 1
        return out


def crc_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRCs of stretches of bytes, one byte of each at a time."""
    order = np.argsort(starts - ends, kind="stable")
    at, sizes = starts[order], (ends - starts)[order]
    c = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right") if len(sizes) else ()
    for j, k in enumerate(live):
        c[:k] = (c[:k] >> 8) ^ _CRC[(c[:k] ^ data[at[:k] + j]) & 255]
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


class WordAutomaton:
    """An Aho-Corasick automaton of delimited words with payloads."""

    DEAD, OPEN = 0, 1

    def __init__(self, words: list[bytes], states: int = STATES):
        used = np.zeros(256, dtype=bool)
        used[np.frombuffer(b"".join(words), dtype=np.uint8)] = True
        self.symbol = np.zeros(256, dtype=np.int64)  # 0: in no word
        self.symbol[used] = np.arange(2, 2 + used.sum())
        self.symbol[_SPACE] = 1
        width = 2 + int(used.sum())
        edges: dict[int, int] = {}
        word_of: list[int] = [-1, -1]
        self.words: list[bytes] = []
        for word in words:
            if len(word_of) + len(word) > states:
                break
            at = self.OPEN
            for sign in word:
                step = at * width + int(self.symbol[sign])
                at = edges.get(step, -1)
                if at < 0:
                    at = edges[step] = len(word_of)
                    word_of.append(-1)
            word_of[at] = len(self.words)
            self.words.append(word)
        go = np.zeros(len(word_of) * width, dtype=np.int32)
        if edges:
            go[np.fromiter(edges.keys(), np.int64)] = np.fromiter(edges.values(), np.int32)
        go[np.arange(len(word_of)) * width + 1] = self.OPEN
        self.go, self.width, self.word_of = go, width, np.array(word_of, dtype=np.int32)
        self.crc = np.array([zlib.crc32(w) for w in self.words], dtype=np.uint32)
        self.spaced = np.array([zlib.crc32(b" " + w) for w in self.words], dtype=np.uint32)

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the pattern that ends behind each of the words of
        ``data``, -1 for none.  A delimiter stands before and behind each."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.int64)
        # stretches begin with the delimiter before a word
        heads = np.unique(np.searchsorted(starts, np.linspace(0, len(data), min(LANES, n), endpoint=False)))
        heads = heads[heads < n]
        begin = starts[heads] - 1
        end = np.append(begin[1:], ends[-1]) + 1
        order = np.argsort(begin - end, kind="stable")
        begin, sizes = begin[order], (end - begin)[order]
        live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
        symbols = self.symbol[data]
        # the state before each delimiter tells which word it ends
        before = np.zeros(len(data) + 1, dtype=np.int32)
        state = np.zeros(len(begin), dtype=np.int64)
        for j, k in enumerate(live):
            at = begin[:k] + j
            before[at] = state[:k]
            state[:k] = self.go[state[:k] * self.width + symbols[at]]
        return self.word_of[before[ends]].astype(np.int64)


class Runs:
    """Buckets of the word runs of stretches of texts; holds a task's automaton."""

    def __init__(self, buckets: int, longest: int = 3, states: int = STATES):
        self.buckets, self.longest, self.states = buckets, longest, states
        self.shifts, self.automaton, self.open = Shifts(), WordAutomaton([]), True
        self.space = np.uint32(zlib.crc32(b" "))

    def _grow(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Takes up the words that these unknown ones repeat, frequent ones first."""
        hashes = window(prefix_sums(data), starts, ends)
        _, at, n = np.unique(hashes, return_index=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 1]
        known = len(self.automaton.words)
        if 2 * len(order) < known:
            return
        words = self.automaton.words + [data[starts[i] : ends[i]].tobytes() for i in at[order].tolist()]
        self.automaton = WordAutomaton(words, self.states)
        self.open = len(self.automaton.words) == len(words)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each length of runs the first word of each and its bucket; and
        the first word of each text and one more."""
        # a delimiter before each text and behind the last
        data = np.insert(_SIGN[data], offsets, _SPACE)
        ink = np.concatenate([[False], data != _SPACE])
        starts, ends = np.flatnonzero(ink[1:] & ~ink[:-1]), np.flatnonzero(~ink[1:] & ink[:-1])
        firsts = np.searchsorted(starts, offsets + np.arange(len(offsets)))
        found = self.automaton.scan(data, starts, ends)
        sizes = ends - starts
        new = np.flatnonzero(found < 0)
        crc, spaced = np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.uint32)
        if len(self.automaton.words):
            crc, spaced = self.automaton.crc[found], self.automaton.spaced[found]
        if len(new):
            crc[new] = crc_of(data, starts[new], ends[new])
            spaced[new] = self.shifts(np.full(len(new), self.space), sizes[new]) ^ crc[new]
            if self.open:
                self._grow(data, starts[new], ends[new])
        last = np.repeat(firsts[1:], firsts[1:] - firsts[:-1])
        word = np.arange(len(starts))
        out, run = [(word, crc.astype(np.int64) % self.buckets)], crc
        for more in range(1, self.longest):
            # words that have one more behind them in their text
            kept = word + more < last[word]
            word, run = word[kept], run[kept]
            run = self.shifts(run, sizes[word + more] + 1) ^ spaced[word + more]
            out.append((word, run.astype(np.int64) % self.buckets))
        return out, firsts


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how often the runs of all texts fall into each bucket that
    has any; every task sums up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, n = Runs(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), 4 << 20):
                for _, at in runs(data, offsets)[0]:
                    n += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], names=["bucket", "n"])

    parts = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for all buckets: thousandths of the log ratio of the
    bucket's smoothed share of the target to that of the documents."""
    held = bucket_counts(target, target_text, buckets).select("bucket", F.col("n").alias("t"), F.lit(0).cast("long").alias("s"))
    held = held.unionByName(bucket_counts(docs, text, buckets).select("bucket", F.lit(0).cast("long").alias("t"), F.col("n").alias("s")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("s"))
    held = stored(held.unionByName(every).groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("s").alias("s")), "buckets")
    totals = held.agg(F.sum("t").alias("t"), F.sum("s").alias("s")).first()
    d = lambda c: c.cast("double")
    ratio = d(F.col("t") + 1) * d(F.lit(totals["s"] + buckets)) / (d(F.col("s") + 1) * d(F.lit(totals["t"] + buckets)))
    return held.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def _noise(key: Column, seed: int) -> Column:
    """A Gumbel variable in thousandths that depends on the key and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance_ranks(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text",
    percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000,
) -> DataFrame:
    """One row per input row: key, n_words, n_features, weight, score, rank.

    ``weight`` sums the gains of the row's features, ``score`` adds noise, and
    ``rank`` counts from 1 in falling order of the score (ties to the smaller
    key) among the rows with ``least_words`` words, up to ``percent`` percent of
    these; it is null for all others.

    Null texts and texts without words have no features and weight 0; a null
    key draws its noise as an empty one and comes before others in ties;
    repeated rows are rows of their own; an empty table gives no rows, an empty
    target holds nothing; other columns are not read.

    The gains are one number per bucket, which is all that the driver sees.
    """
    gain = np.zeros(buckets, dtype=np.int64)
    for row in bucket_gains(docs, target, text, target_text, buckets).collect():
        gain[row["bucket"]] = row["gain"]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(buckets)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1), 4 << 20):
                found, firsts = runs(data, offsets)
                words = firsts[1:] - firsts[:-1]
                weight, features = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for first, at in found:
                    bounds = np.searchsorted(first, firsts)
                    sums = np.concatenate([[0], np.cumsum(gain[at])])[bounds]
                    weight += sums[1:] - sums[:-1]
                    features += bounds[1:] - bounds[:-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words, pa.int64()), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    rows = stored(rows.withColumn("score", F.col("weight") + _noise(F.col("id"), seed)), "weights")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = running(able.withColumn("falling", -F.col("score")), ["falling", "id"], {"rank": F.lit(1).cast("long")}, "ranked")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.drop("falling").unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(key), "n_words", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, by key (rows that repeat a drawn
    key stay together); nulls, empty tables and other columns as above."""
    drawn = importance_ranks(docs, target, text, key, **options).where("rank is not null").select(F.col(key).alias("_drawn_key")).distinct()
    return docs.join(drawn.hint("merge"), F.col(key).eqNullSafe(F.col("_drawn_key")), "left_semi")
