"""Mixing documents to target domain weights by soft membership.

A naive Bayes classifier over hashed words, counted from a labelled table,
gives every document a posterior over domains.  Each document gets a rate, the
number of times it is to be seen, such that the expected tokens per domain (the
sum of rate x tokens x posterior) meet the targets: least squares over
nonnegative rates, each domain weighed by its size, with a slight pull towards
1 that settles which of many solutions is taken.

Projected gradient steps need one vector of domain totals per round, an
ordinary aggregate.  A document's rate follows from its posterior and the
vectors of the rounds before, so rates are computed where the row is and
never written between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import stored
from mediaspark.llm.words import LETTERS, chunks, mix, word_bounds, word_hashes

#: Labelled rows from which the classifier counts: those with the smallest hashes.
LABELLED_ROWS = 20_000
#: Size of the hashed vocabulary.
BUCKETS = 1 << 14
#: A text speaks with as much weight as this many of its words at most, which keeps memberships soft.
EVIDENCE = 30.0
PULL, ROUNDS, CLOSE = 1e-5, 60, 1e-5


def domain_counts(docs: DataFrame, labelled: DataFrame, text: str, key: str) -> tuple[list, np.ndarray, np.ndarray]:
    """(domains, their labelled texts, word counts by domain and bucket).

    ``labelled``: key, domain; rows without either are left out."""
    sample = labelled.where(F.col(key).isNotNull() & F.col("domain").isNotNull()).select(F.col(key).alias("_key"), "domain").orderBy(F.xxhash64("_key"), "_key", "domain").limit(LABELLED_ROWS)
    # at most LABELLED_ROWS rows
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(sample), "_key").select("domain", "text")
    kind = labelled.schema["domain"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                hashes, firsts = word_hashes(data, offsets, LETTERS)
                bucket = (mix(hashes) % np.uint64(BUCKETS)).astype(np.int32)
                owner = np.repeat(np.arange(b - a), np.diff(firsts))
                pairs, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
                at = pa.array(pairs // BUCKETS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(at), pa.array((pairs % BUCKETS).astype(np.int32)), pa.array(n)], names=["domain", "bucket", "n"])

    found = rows.mapInArrow(count, f"domain {kind}, bucket int, n bigint").groupBy("domain", "bucket").agg(F.sum("n").alias("n"))
    texts = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(texts)
    place = {d: i for i, d in enumerate(domains)}
    table = np.zeros((len(domains), BUCKETS))
    for r in found.collect():  # at most domains x BUCKETS rows
        table[place[r["domain"]], r["bucket"]] = r["n"]
    return domains, np.array([texts[d] for d in domains], dtype=float), table


def memberships(docs: DataFrame, labelled: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[list, DataFrame]:
    """(domains, table): one row per input row with id, tokens (words between
    white space) and p, the posterior by domain.  A text without words has the
    prior; without labelled rows there is one domain, null."""
    domains, texts, table = domain_counts(docs, labelled, text, key)
    if not domains:
        domains, texts, table = [None], np.ones(1), np.zeros((1, BUCKETS))
    logs = np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    model = docs.sparkSession.sparkContext.broadcast((np.log(texts / texts.sum()), logs))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, logs = model.value
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                hashes, firsts = word_hashes(data, offsets, LETTERS)
                bucket = (mix(hashes) % np.uint64(BUCKETS)).astype(np.int64)
                n = np.diff(firsts)
                sums = np.concatenate([np.zeros((len(prior), 1)), np.cumsum(logs[:, bucket], axis=1)], axis=1)
                each = (sums[:, firsts[1:]] - sums[:, firsts[:-1]]) * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))
                z = each.T + prior
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                _, _, spaced = word_bounds(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(spaced).astype(np.int64)), pa.array(list(p), pa.list_(pa.float64()))], names=["id", "tokens", "p"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return domains, rows.mapInArrow(run, f"id {kind}, tokens bigint, p array<double>")


def tempered_targets(totals: np.ndarray, power: float = 0.7) -> np.ndarray:
    """Token targets with shares in proportion to ``totals ** power``, large
    enough that no domain has to shrink."""
    share = np.where(totals > 0, totals, 1.0) ** power * (totals > 0)
    share /= max(share.sum(), 1e-300)
    grown = totals[totals > 0] / share[totals > 0]
    return share * (grown.max() if len(grown) else 0.0)


def _rate(directions: list[np.ndarray]) -> Column:
    """The rate after steps along the given directions, from 1."""
    if not directions:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in d]) for d in directions])
    dot = lambda d: F.aggregate(F.zip_with("p", d, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(steps, F.lit(1.0), lambda r, d: F.greatest(F.lit(0.0), r - dot(d) - F.lit(PULL) * (r - 1)))


def fit_rates(members: DataFrame, width: int, targets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Column]:
    """(targets, reached totals, rate).  ``members``: tokens, p."""

    def totals(rate: Column) -> np.ndarray:
        # summed as exact decimals, so that the order of addition doesn't matter
        part = lambda k: F.sum((rate * F.col("tokens") * F.get("p", F.lit(k))).cast("decimal(38,9)")).cast("double")
        row = members.agg(*[F.coalesce(part(k), F.lit(0.0)).alias(f"k{k}") for k in range(width)]).first()
        return np.array([row[f"k{k}"] for k in range(width)])

    first = totals(F.lit(1.0))
    wanted = tempered_targets(first) if targets is None else np.asarray(targets, dtype=float)
    scale = np.where(first > 0, first, np.inf)
    reached, directions = first, []
    for _ in range(ROUNDS):
        miss = (reached - wanted) / scale
        if np.abs(miss).max(initial=0.0) < CLOSE:
            break
        directions.append(miss)
        reached = totals(_rate(directions))
    return wanted, reached, _rate(directions)


def mixture(docs: DataFrame, labelled: DataFrame, text: str = "text", key: str = "doc_id", targets: dict | None = None) -> DataFrame:
    """One row per input row: key, tokens, domain, membership, rate, copies.

    ``targets`` are tokens by domain; without them the domains' shares are
    tempered and none shrinks.  ``domain`` is the likeliest domain and
    ``membership`` its posterior; ``rate`` is rounded to three places;
    ``copies`` is the rate rounded down, or up with the probability of the rest,
    which the key's hash decides.  Null and empty texts have no tokens and the
    prior; repeated rows are rows of their own; an empty table gives no rows.
    """
    domains, members = memberships(docs, labelled, text, key)
    members = stored(members, "memberships")
    wanted = None if targets is None else np.array([targets.get(d, 0.0) for d in domains])
    _, _, rate = fit_rates(members, len(domains), wanted)
    best = F.array_position("p", F.array_max("p")).cast("int")
    drawn = F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1_000_000)) / 1_000_000
    named = F.element_at(F.array(*[F.lit(d) for d in domains]), best)
    out = members.select("id", "tokens", named.alias("domain"), F.array_max("p").alias("membership"), F.round(rate, 3).alias("rate"))
    copies = F.floor("rate") + F.when(drawn < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.select(F.col("id").alias(key), "tokens", "domain", "membership", "rate", copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    plan = stored(mixture(docs, labelled, text, key, **options).groupBy(key).agg(F.max("copies").alias("_copies")), "copies")
    again = docs.join(plan.withColumnRenamed(key, "_mixed"), F.col(key).eqNullSafe(F.col("_mixed"))).drop("_mixed")
    return again.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).drop("_copy", "_copies")
