"""Quality classifier from a weak-label model.

Overlapping heuristic labellers vote on every document, in two questions: is it
of good quality, is it toxic.  Votes are 1, 0 (no opinion) and -1.  Expectation
maximisation over the counts of all vote patterns estimates how often each
labeller votes what on either side, and with it the posterior of each pattern.
The posteriors of a bounded sample train a hashed linear scorer per question,
whose features are the document's votes and words; its score decides.

One toxic labeller needs a word list.  It is learned from the labelled rows:
words that a fair share of the toxic texts has and almost no other text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import stored
from mediaspark.llm.words import LETTERS, chunks, mix, word_hashes

#: Labelled rows from which the word list is learned, and rows that train the scorer: those with the smallest hashes.
LABELLED_ROWS, TRAINING_ROWS = 20_000, 6_000
#: Size of the hashed feature space.
SPACE_BITS = 15

QUALITY = ("symbols", "capitals", "shouting", "cells", "repeats", "sentences", "word_length")
TOXIC = ("listed", "density", "gazetteer")
# Common insults.
GAZETTEER = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "bastard", "idiota", "idioten", "estúpido", "imbécil")
#: First guess of the share of objections among a labeller's votes: on documents that are fine, and on those with the
#: kind of fault that the labeller knows.
FINE, POOR = 0.005, 0.8


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _UPPER, _SHOUT, _CELL, _STOP = _table("#$%&*^~=<>{}[]\\/@_"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("!"), _table("|"), _table(".?!")
_GAZETTEER = None


def _listed_words() -> np.ndarray:
    global _GAZETTEER
    if _GAZETTEER is None:
        raw = [w.encode() for w in GAZETTEER]
        data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
        _GAZETTEER = np.sort(word_hashes(data, np.array([0, len(data)]), LETTERS)[0])
    return _GAZETTEER


def _in(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _vote(value: np.ndarray, fine: float, poor: float) -> np.ndarray:
    return np.where(value > poor, -1, np.where(value < fine, 1, 0)).astype(np.int8)


def votes(data: np.ndarray, offsets: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(votes, one row per text and one column per labeller; word hashes; first
    word of each text and one more)."""
    hashes, firsts = word_hashes(data, offsets, LETTERS)
    size = np.maximum(1.0, np.diff(offsets))
    n_words = np.diff(firsts).astype(np.float64)
    words = np.maximum(1.0, n_words)
    count = lambda t: _sums(t[data], offsets)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    inner = firsts[:-1][firsts[:-1] < len(hashes)]
    same[inner] = False
    letters = np.maximum(1.0, count(LETTERS))
    per_stop = words / np.maximum(1.0, count(_STOP))
    length = letters / words
    toxic, known = _in(listed, hashes), _in(_listed_words(), hashes)
    rate = _sums(toxic, firsts) / words
    columns = [
        _vote(count(_SYMBOL) / size, 0.005, 0.03), _vote(count(_UPPER) / letters, 0.15, 0.3), _vote(count(_SHOUT) / words, 0.03, 0.2), _vote(count(_CELL) / words, 0.01, 0.08),
        _vote(_sums(same, firsts) / words, 0.05, 0.3), np.where((per_stop >= 2) & (per_stop <= 80), 1, np.where(per_stop > 400, -1, 0)), np.where((length > 2) & (length < 15), 1, -1),
        np.where(rate > 0, -1, 1), np.where(rate > 1e-4, -1, np.where(rate > 0, 0, 1)), np.where(_sums(known, firsts) > 0, -1, 1),
    ]
    out = np.stack(columns, axis=1).astype(np.int8)
    out[n_words < 3, : len(QUALITY)] = 0  # too short for an opinion
    return out, hashes, firsts


def word_list(docs: DataFrame, labels: DataFrame, text: str, key: str, share: float = 0.01, odds: float = 20.0) -> np.ndarray:
    """Hashes of the words that at least ``share`` of the toxic labelled texts
    have, and at most 1/``odds`` of that share of the others, from at most
    ``LABELLED_ROWS`` labelled rows.  Texts with equal ends count once, lest
    the words of one often copied text look typical."""
    sample = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), (F.col("toxic") > 0).alias("toxic"))
    sample = sample.orderBy(F.xxhash64("_key"), "_key").limit(LABELLED_ROWS)
    # at most LABELLED_ROWS rows
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key").groupBy(F.xxhash64(F.expr("right(_text, 80)"))).agg(F.min("_text").alias("text"), F.max("toxic").alias("toxic"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(0)):
                hashes, firsts = word_hashes(data, offsets, LETTERS)
                found = [np.unique(hashes[x:y]) for x, y in zip(firsts[:-1], firsts[1:], strict=True)]
                flags = np.repeat(np.array(batch.column(1).slice(a, b - a).to_pylist(), dtype=bool), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(flags)], names=["word", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(words, "word bigint, toxic boolean")
    n = rows.agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("o")).first()
    counts = seen.groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("o"))
    bar = max(6.0, share * n["t"])
    rare = F.col("o") / max(1, n["o"]) * odds <= F.col("t") / max(1, n["t"])
    found = counts.where((F.col("t") >= bar) & rare).select("word").collect()
    return np.sort(np.array([r["word"] for r in found], dtype=np.int64).view(np.uint64))


def posteriors(counts: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """The probability that a pattern of votes is fine, by expectation
    maximisation.

    A document is fine or has one kind of fault per labeller.  Given that, the
    labellers err independently; their shares of objections on either kind are
    estimated, from first guesses that count as 20 votes.  A vote of 0 is no
    evidence.
    """
    if not counts:
        return {}
    cast = np.array(list(counts), dtype=np.int64)
    against, voted = cast < 0, cast != 0
    n = np.array(list(counts.values()), dtype=np.float64)
    k = cast.shape[1]
    guess = np.full((k + 1, k), FINE)
    guess[np.arange(1, k + 1), np.arange(k)] = POOR
    share, kinds = guess.copy(), np.array([0.8, *[0.2 / k] * k])
    for _ in range(rounds):
        logs = np.log(kinds)[:, None] + np.log(share) @ against.T + np.log(1 - share) @ (voted & ~against).T
        belief = np.exp(logs - logs.max(axis=0))
        belief /= belief.sum(axis=0)
        weight = belief * n
        kinds = (weight.sum(axis=1) + np.array([8, *[2 / k] * k])) / (n.sum() + 10)
        share = (weight @ against + 20 * guess) / (weight @ voted + 20)
    return dict(zip(counts, belief[0], strict=True))


def _features(row_votes: np.ndarray, words: np.ndarray, side: slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: its votes with weight 1, its distinct words
    with a joint weight of 1."""
    size = np.uint64((1 << SPACE_BITS) - 1)
    cast = (row_votes[side].astype(np.int64) + 2 + 10 * np.arange(side.start, side.stop))[row_votes[side] != 0]
    own = mix(cast.astype(np.uint64)) & size
    distinct = np.unique(words)
    place = np.concatenate([own, mix(distinct) & size]).astype(np.int32)
    weight = np.concatenate([np.ones(len(own)), np.full(len(distinct), 1 / max(1.0, np.sqrt(len(distinct))))])
    return place, weight


_SIDES = (slice(0, len(QUALITY)), slice(len(QUALITY), len(QUALITY) + len(TOXIC)))


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights on soft targets by full gradient steps with per-weight
    scaling; the last weight is the bias."""
    n = len(rows)
    place = np.concatenate([p for p, _ in rows]) if n else np.zeros(0, np.int32)
    value = np.concatenate([v for _, v in rows]) if n else np.zeros(0)
    owner = np.repeat(np.arange(n), [len(p) for p, _ in rows])
    weights, scale = np.zeros((1 << SPACE_BITS) + 1), np.full((1 << SPACE_BITS) + 1, 1e-8)
    for _ in range(rounds if n else 0):
        z = np.bincount(owner, value * weights[place], minlength=n) + weights[-1]
        miss = target - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        step = np.append(np.bincount(place, value * miss[owner], minlength=1 << SPACE_BITS), miss.sum()) / n - decay * weights
        scale += step * step
        weights += 0.5 * step / np.sqrt(scale)
    return weights


class Scorer:
    """The learned word list and the weights of both questions."""

    def __init__(self, listed: np.ndarray, weights: list[np.ndarray]):
        self.listed, self.weights = listed, weights

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(p_quality, p_toxic) of each text."""
        out = []
        for a, b, data, offsets in chunks(texts):
            cast, hashes, firsts = votes(data, offsets, self.listed)
            z = np.zeros((2, b - a))
            for i in range(b - a):
                for q, side in enumerate(_SIDES):
                    place, value = _features(cast[i], hashes[firsts[i] : firsts[i + 1]], side)
                    z[q, i] = self.weights[q][place] @ value + self.weights[q][-1]
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        p = np.concatenate(out, axis=1) if out else np.zeros((2, 0))
        return p[0], 1 - p[1]


def train_scorer(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Scorer:
    """Fits the label model on the votes of all rows and the scorers on a
    bounded sample of them."""
    spark = docs.sparkSession
    listed = spark.sparkContext.broadcast(word_list(docs, labels, text, key))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                cast, hashes, firsts = votes(data, offsets, listed.value)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes))])
                mark = mix(sums[firsts[1:]] - sums[firsts[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(list(cast.astype(np.int32)), pa.list_(pa.int32())), pa.array(mark.view(np.int64))], names=["votes", "mark"])

    cast = stored(rows.select("text").mapInArrow(vote, "votes array<int>, mark bigint"), "votes")
    counts = {tuple(r["votes"]): r["count"] for r in cast.groupBy("votes").count().collect()}
    belief = []
    for side in _SIDES:
        part: dict[tuple[int, ...], int] = {}
        for v, n in counts.items():
            part[v[side]] = part.get(v[side], 0) + n
        belief.append(posteriors(part))
    # the texts that train: a fixed number, half of them among those with an objection
    objected = F.exists("votes", lambda v: v < 0)
    bars = [r["m"] for poor in (True, False) for r in cast.where(objected == poor).select("mark").distinct().orderBy("mark").limit(TRAINING_ROWS // 2).agg(F.max("mark").alias("m")).collect()]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                cast, hashes, firsts = votes(data, offsets, listed.value)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes))])
                mark = mix(sums[firsts[1:]] - sums[firsts[:-1]]).view(np.int64)
                chosen = [i for i in range(len(mark)) if (bar := bars[0 if (cast[i] < 0).any() else 1]) is not None and mark[i] <= bar]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark[chosen]), pa.array([cast[i].astype(np.int32) for i in chosen], pa.list_(pa.int32())), pa.array([np.unique(hashes[firsts[i] : firsts[i + 1]]).view(np.int64) for i in chosen], pa.list_(pa.int64()))],
                    names=["mark", "votes", "words"],
                )

    sample = rows.select("text").mapInArrow(gather, "mark bigint, votes array<int>, words array<bigint>").groupBy("mark").agg(F.max("votes").alias("votes"), F.max("words").alias("words"))
    # at most TRAINING_ROWS rows, a few at a time
    taken = [(np.array(r["votes"], dtype=np.int8), np.array(r["words"], dtype=np.int64).view(np.uint64)) for r in sample.orderBy("mark").toLocalIterator()]
    fitted = []
    for side, known in zip(_SIDES, belief, strict=True):
        target = np.array([known[tuple(int(x) for x in v[side])] for v, _ in taken])
        fitted.append(_fit([_features(v, w, side) for v, w in taken], target).astype(np.float32))
    return Scorer(listed.value, fitted)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per input row: key, p_quality, p_toxic, accepted.

    A row is accepted if ``p_quality`` is at least ``threshold`` and ``p_toxic``
    below it.  Null and empty texts get the votes of a text that is too short
    for an opinion; repeated rows are rows of their own; without labelled rows
    the learned word list is empty; labels of null keys or values are left out;
    an empty table gives no rows; other columns are not read.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(train_scorer(docs, labels, text, key))
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, toxic = scorer.value(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(toxic)], names=["id", "p_quality", "p_toxic"])

    scored = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(score, f"id {kind}, p_quality double, p_toxic double")
    accepted = (F.col("p_quality") >= threshold) & (F.col("p_toxic") < threshold)
    return scored.select(F.col("id").alias(key), "p_quality", "p_toxic", accepted.alias("accepted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    scorer = docs.sparkSession.sparkContext.broadcast(train_scorer(docs, labels, text, key))
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, toxic = scorer.value(batch.column(place))
            yield batch.filter(pa.array((good >= threshold) & (toxic < threshold)))

    return docs.mapInArrow(keep, docs.schema)
