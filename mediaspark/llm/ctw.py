"""Language-model scores by context-tree weighting.

A text is scored byte by byte, each byte bit by bit.  A bit's contexts are the
bits before it in its byte together with the last 0 to ``depth`` bytes of the
same text; every context holds how often either bit followed in training and
predicts by the Krichevsky-Trofimov estimate.  The weighted probability of all
training bits below a context is the mean of its own estimate and the product
of its longer contexts', so that a context's weight against its longer ones is
known from the counts alone.  A prediction mixes the estimates of all depths
with these weights.

Counts of byte runs are gathered over the whole corpus.  Contexts with the same
last bytes are one branch of the tree, and its runs meet in one task, which sums
up the branch and so knows all that the shorter contexts need of it; those have
few bytes, so their number is bounded, and their mixtures are sent back to the
branches.  Runs of held-out texts take part with no count of their own; a
context that training lacks leaves the prediction to the next shorter one.  What
comes out is the cost of every distinct run by the whole tree.  Costs of frequent
runs and counts of frequent words are sent to the tasks, all others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import stored
from mediaspark.llm.words import chunks, mix, word_hashes

#: Contexts of a model in memory, and byte runs whose cost it keeps (34 and 26 bytes each); scores of a table rest on neither.
CONTEXTS, READY = 1 << 21, 1 << 20
#: Frequent byte runs whose costs are sent to the tasks (up to 52 bytes each in a worker).
RUNS = 1 << 21
#: Bytes of the contexts at which branches begin; all shorter ones are summed up at one place (at most 2^24 nodes, by their bytes).
BRANCH = 3
#: Runs that a task holds at a time, as far as branches end.
_HELD = 1 << 18
#: Frequent words whose counts are sent to the tasks (16 bytes each).
FREQUENT = 1 << 19
#: Stands for the end of a text among word hashes.
_END = np.uint64(0x5E1F0E4D)


def runs(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(runs, offsets): for each byte of each text and for a zero byte after
    it, the byte (lowest) and the ``depth`` bytes before it, zeros before the
    start."""
    count = len(offsets) - 1
    bounds = offsets + np.arange(count + 1)
    body = np.zeros(len(data) + count, dtype=np.uint64)
    ink = np.ones(len(body), dtype=bool)
    ink[bounds[1:] - 1] = False
    body[ink] = data
    into = np.arange(len(body)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = body.copy()
    for d in range(1, depth + 1):
        out[d:] |= np.where(into[d:] >= d, body[:-d], np.uint64(0)) << np.uint64(8 * d)
    return out, bounds


def _lgamma(x, log: Callable = F.log):
    """ln gamma for x > 0, by Stirling's series from x + 8 on."""
    y = x + 8
    series = (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    for i in range(8):
        series = series - log(x + i)
    return series


def _estimate(n0, n1, log: Callable = F.log):
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones, of columns or arrays."""
    return _lgamma(n0 + 0.5, log) + _lgamma(n1 + 0.5, log) - _lgamma(n0 + n1 + 1.0, log) - math.log(math.pi)


def tree(grams: DataFrame, depth: int) -> DataFrame:
    """(node, n0, n1, weight): all contexts.  ``node`` packs the context's
    bytes, the bits before in the byte behind a leading one, and its length;
    ``weight`` is that of its own estimate against the longer contexts.

    ``grams``: gram, n."""
    bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")
    last = F.col("gram").bitwiseAND(F.lit(255))
    each = grams.select(F.expr("shiftright(gram, 8)").alias("context"), last.alias("last"), "n", bits)
    each = each.select(
        "context", (F.expr("shiftright(256 + last, cast(8 - bit as int))")).alias("prefix"),
        F.expr("shiftright(last, cast(7 - bit as int)) & 1").alias("one"), "n",
    )
    zero = F.sum(F.when(F.col("one") == 0, F.col("n")).otherwise(0)).alias("n0")
    level = each.groupBy("context", "prefix").agg(zero, F.sum(F.when(F.col("one") == 1, F.col("n")).otherwise(0)).alias("n1"))
    level = level.withColumn("own", _estimate(F.col("n0").cast("double"), F.col("n1").cast("double"))).withColumn("mixed", F.col("own")).withColumn("weight", F.lit(1.0))
    out = []
    for d in range(depth, -1, -1):
        level = stored(level.drop("own"), f"contexts-{d}")
        out.append(level.select((F.col("context") * 256 + F.col("prefix") + F.lit(d) * F.lit(1 << 56)).alias("node"), "n0", "n1", "weight"))
        if d:
            shorter = F.col("context").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1)).alias("context")
            level = level.groupBy(shorter, "prefix").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(F.col("mixed").cast("decimal(30,6)")).cast("double").alias("below"))
            level = level.withColumn("own", _estimate(F.col("n0").cast("double"), F.col("n1").cast("double")))
            top = F.greatest("own", "below")
            level = level.withColumn("mixed", top + F.log((F.exp(F.col("own") - top) + F.exp(F.col("below") - top)) / 2))
            level = level.withColumn("weight", F.exp(F.col("own") - F.col("mixed")) / 2).drop("below")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionAll(part)
    return whole


class _Table:
    """Distinct 64-bit keys in open places, at most half of them taken."""

    def __init__(self, keys: np.ndarray):
        self.size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.keys, self.taken = np.zeros(self.size, np.uint64), np.zeros(self.size, bool)
        self.slots = np.zeros(len(keys), np.int64)
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            free = np.flatnonzero(~self.taken[at])
            spot, who = np.unique(at[free], return_index=True)
            placed = free[who]
            self.keys[spot], self.taken[spot], self.slots[left[placed]] = keys[left[placed]], True, spot
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) & (self.size - 1)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & np.uint64(self.size - 1)).astype(np.int64)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the keys, by place."""
        out = np.zeros(self.size, np.float32)
        out[self.slots] = values
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't there."""
        at = self._start(keys)
        out = np.where(self.taken[at], at, -1)
        left = np.flatnonzero(self.taken[at] & (self.keys[at] != keys))
        while len(left):
            here = (out[left] + 1) & (self.size - 1)
            out[left] = np.where(self.taken[here], here, -1)
            left = left[self.taken[here] & (self.keys[here] != keys[left])]
        return out


def _packed(values: np.ndarray) -> bytes:
    """Compressed by byte planes, as most bytes of sorted keys repeat."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 3)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    planes = planes.reshape(np.dtype(kind).itemsize, len(planes) // np.dtype(kind).itemsize)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


class Model:
    """The tree's contexts with weight and estimate.  What a worker has once
    worked out for a byte run it keeps."""

    def __init__(self, depth: int, nodes: np.ndarray, weight: np.ndarray, one: np.ndarray):
        self.depth = depth
        order = np.argsort(nodes)
        self.content = nodes[order].astype(np.uint64), weight[order].astype(np.float32), one[order].astype(np.float32)
        self._build()

    def _build(self) -> None:
        nodes, weight, one = self.content
        self.nodes = _Table(nodes)
        self.weight, self.one = self.nodes.spread(weight), self.nodes.spread(one)
        self.remember(np.zeros(0, np.uint64), np.zeros(0))

    def __getstate__(self) -> tuple:
        return self.depth, [_packed(x) for x in self.content]

    def __setstate__(self, state: tuple) -> None:
        self.depth, packed = state
        self.content = tuple(_unpacked(x, k) for x, k in zip(packed, (np.uint64, np.float32, np.float32), strict=True))
        self._build()

    def remember(self, grams: np.ndarray, costs: np.ndarray) -> None:
        self.seen = grams, costs.astype(np.float32)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.ready = _Table(grams)
        self.costs = self.ready.spread(costs)

    def _keep(self, grams: np.ndarray, costs: np.ndarray) -> None:
        """Notes new runs; the table is made anew when it would double."""
        known, added = len(self.seen[0]), sum(len(g) for g, _ in self.new)
        if known + added >= READY:
            return
        self.new.append((grams, costs.astype(np.float32)))
        if added + len(grams) >= max(known, 1 << 15):
            grams = np.concatenate([self.seen[0], *[g for g, _ in self.new]])
            costs = np.concatenate([self.seen[1], *[c for _, c in self.new]])
            grams, first = np.unique(grams, return_index=True)
            self.remember(grams, costs[first])

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each run's last byte."""
        at = self.ready.find(grams)
        out = self.costs[at].astype(np.float64)
        rest = np.flatnonzero(at < 0)
        if len(rest):
            new, back = np.unique(grams[rest], return_inverse=True)
            costs = self._mixed(new).astype(np.float32).astype(np.float64)  # as they are kept
            out[rest] = costs[back]
            self._keep(new, costs)
        return out

    def _mixed(self, grams: np.ndarray) -> np.ndarray:
        total = np.zeros(len(grams))
        last = grams & np.uint64(255)
        context = grams >> np.uint64(8)
        for bit in range(8):
            prefix = (np.uint64(256) + last) >> np.uint64(8 - bit)
            one = ((last >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            p = np.full(len(grams), np.nan)
            for d in range(self.depth, -1, -1):
                mask = np.uint64((1 << 8 * d) - 1)
                key = (context & mask) * np.uint64(256) + prefix + np.uint64(d << 56)
                at = self.nodes.find(key)
                known = at >= 0
                own, w = self.one[at].astype(np.float64), self.weight[at].astype(np.float64)
                mixed = np.where(np.isnan(p), own, w * own + (1 - w) * p)
                p = np.where(known, mixed, p)
            p = np.where(np.isnan(p), 0.5, p)
            total += np.log10(np.where(one, p, 1 - p))
        return total


def _at_most(df: DataFrame, count: str, rows: int) -> DataFrame:
    """The rows with the largest counts, whole steps of an eighth of a power of
    two of them, at most ``rows``."""
    step = F.floor(8 * F.log2(F.col(count).cast("double"))).cast("int")
    sizes = sorted(((r["s"], r["n"]) for r in df.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, low = 0, None
    for s, n in sizes:
        if total + n > rows:
            break
        total, low = total + n, s
    return df.where(step >= low) if low is not None else df.limit(0)


def counted_runs(rows: DataFrame, depth: int) -> DataFrame:
    """(gram, n, uses): the distinct byte runs of the rows (held_out, text), how
    often they are in training rows and in all."""
    held_bit = np.uint64(1 << 63)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64)
            held.clear()
            grams, train = (keys & ~held_bit).view(np.int64), np.where(keys & held_bit, 0, n)
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(train), pa.array(n)], names=["gram", "n", "uses"])

        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) * held_bit
            for a, b, data, offsets in chunks(batch.column(1), 1 << 20):
                grams, bounds = runs(data, offsets, depth)
                held.append(np.unique(grams | np.repeat(marks[a:b], np.diff(bounds)), return_counts=True))
                if sum(len(k) for k, _ in held) > 1 << 20:
                    yield merged()
        if held:
            yield merged()

    found = rows.select("held_out", "text").mapInArrow(count, "gram bigint, n bigint, uses bigint")
    return stored(found.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")), "grams")


def fit(rows: DataFrame, depth: int) -> Model:
    """A model in memory of the training rows (text), for small tables: its
    most frequent contexts, at most CONTEXTS."""
    nodes = tree(counted_runs(rows.select(F.lit(False).alias("held_out"), "text"), depth), depth).withColumn("n", F.col("n0") + F.col("n1"))
    one = (F.col("n1") + 0.5) / (F.col("n") + 1.0)
    # at most CONTEXTS rows
    kept = _at_most(nodes, "n", CONTEXTS).select("node", F.col("weight").cast("float").alias("weight"), one.cast("float").alias("one")).toArrow()
    return Model(depth, kept.column("node").to_numpy().view(np.uint64), kept.column("weight").to_numpy(), kept.column("one").to_numpy())


def _shorter(nodes: np.ndarray, depth: int) -> np.ndarray:
    """Nodes (context and prefix) of ``depth`` bytes with a byte less."""
    mask = np.uint64((1 << 8 * (depth - 1)) - 1)
    return (nodes >> np.uint64(8) & mask) << np.uint64(8) | nodes & np.uint64(255)


class _Branches:
    """The nodes of ``low`` to ``depth`` bytes, from those of ``depth`` bytes and
    their counts; ``below`` is ln of the product of longer contexts' mixtures."""

    def __init__(self, nodes: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None, depth: int, low: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for d in range(depth, low - 1, -1):
            known = n0 + n1 > 0
            own = np.where(known, _estimate(n0, n1, np.log), 0.0)
            mixed = own if below is None else np.logaddexp(own, below) - math.log(2)
            weight = np.ones(len(nodes)) if below is None else np.exp(own - mixed) / 2
            above, up = np.unique(_shorter(nodes, d), return_inverse=True) if d > low else (nodes, np.arange(len(nodes)))
            self.levels.append((known, (n1 + 0.5) / (n0 + n1 + 1.0), weight, up))
            self.nodes, self.n0, self.n1, self.mixed = nodes, n0, n1, mixed
            if d > low:
                nodes, below = above, np.bincount(up, mixed)
                n0, n1 = np.bincount(up, n0), np.bincount(up, n1)

    def answers(self, sums: np.ndarray, left: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums, left, p) of the nodes of ``depth`` bytes: the mixture of the
        contexts so far, the share left to longer ones, and the answer if this
        is the longest one.  Given are those above the nodes of ``low`` bytes."""
        for i in range(len(self.levels) - 1, -1, -1):
            known, own, weight, up = self.levels[i]
            if i < len(self.levels) - 1:
                sums, left, p = sums[up], left[up], p[up]
            share = left * own
            # below an unknown context all are unknown
            p = np.where(known, sums + share, p)
            sums, left = sums + weight * share, left * (1 - weight)
        return sums, left, p


def _bit_nodes(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, ones), 8 rows each: the node of each bit of the runs' last bytes."""
    shift = np.arange(8, dtype=np.uint64)[:, None]
    last = grams & np.uint64(255)
    return (grams >> np.uint64(8) << np.uint64(8)) | (np.uint64(256) + last) >> (np.uint64(8) - shift), (last >> (np.uint64(7) - shift) & np.uint64(1)).astype(bool)


def run_costs(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, uses, cost): log10 of the probability of each run's last byte by
    the whole tree.

    ``grams``: gram, n, uses; a run with n = 0 changes no estimate."""
    low = min(BRANCH, depth)
    branch = F.expr("shiftright(gram, 8)").bitwiseAND(F.lit((1 << 8 * low) - 1))
    dealt = grams.withColumn("branch", branch).repartition("branch").sortWithinPartitions("branch", "gram")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(grams, n, uses) of whole branches."""
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(4)))
            if sum(len(h[0]) for h in held) >= _HELD:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = int(np.searchsorted(columns[3], columns[3][-1]))
                held = [tuple(c[end:] for c in columns)]
                if end:
                    yield columns[0][:end].view(np.uint64), columns[1][:end], columns[2][:end]
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            if len(columns[0]):
                yield columns[0].view(np.uint64), columns[1], columns[2]

    def built(keys: np.ndarray, n: np.ndarray) -> tuple[_Branches, np.ndarray, np.ndarray]:
        at, ones = _bit_nodes(keys)
        nodes, back = np.unique(at.reshape(-1), return_inverse=True)
        counts = np.tile(n, 8)
        n1 = np.bincount(back, np.where(ones.reshape(-1), counts, 0))
        return _Branches(nodes, np.bincount(back, counts) - n1, n1, None, depth, low), back, ones

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, _ in whole(batches):
            part, _, _ = built(keys, n)
            above, up = np.unique(_shorter(part.nodes, low), return_inverse=True)
            # in millionths, so that sums do not depend on their order
            below = np.zeros(len(above), np.int64)
            np.add.at(below, up, np.rint(part.mixed * 1e6).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(above.view(np.int64)), pa.array(np.bincount(up, part.n0).astype(np.int64)), pa.array(np.bincount(up, part.n1).astype(np.int64)), pa.array(below)],
                names=["node", "n0", "n1", "below"],
            )

    top = None
    if low:
        # contexts of less than BRANCH bytes: their number has a bound, whatever the input
        short = dealt.mapInArrow(tops, "node bigint, n0 bigint, n1 bigint, below bigint").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
        short = short.toArrow()
        order = np.argsort(short.column("node").to_numpy())
        nodes, n0, n1, below = (short.column(c).to_numpy()[order] for c in ("node", "n0", "n1", "below"))
        upper = _Branches(nodes.view(np.uint64), n0.astype(float), n1.astype(float), below / 1e6, low - 1, 0)
        start = len(upper.nodes)
        top = grams.sparkSession.sparkContext.broadcast((nodes.view(np.uint64), *upper.answers(np.zeros(start), np.ones(start), np.full(start, 0.5))))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, uses in whole(batches):
            part, back, ones = built(keys, n)
            if top is None:
                given = np.zeros(len(part.nodes)), np.ones(len(part.nodes)), np.full(len(part.nodes), 0.5)
            else:
                at = np.searchsorted(top.value[0], _shorter(part.nodes, low))
                given = tuple(x[at] for x in top.value[1:])
            p = part.answers(*given)[2][back].reshape(8, -1)
            cost = np.log10(np.where(ones, p, 1 - p)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(uses), pa.array(cost.astype(np.float32))], names=["gram", "uses", "cost"])

    return dealt.mapInArrow(costs, "gram bigint, uses bigint, cost float")


class _Costs:
    """Costs of the runs that are sent to the tasks."""

    def __init__(self, grams: np.ndarray, costs: np.ndarray):
        order = np.argsort(grams)
        self.content = grams[order].astype(np.uint64), costs[order].astype(np.float32)

    def __getstate__(self) -> list[bytes]:
        return [_packed(x) for x in self.content]

    def __setstate__(self, packed: list[bytes]) -> None:
        grams, costs = (_unpacked(x, k) for x, k in zip(packed, (np.uint64, np.float32), strict=True))
        self.table = _Table(grams)
        self.costs = self.table.spread(costs)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(costs, which runs are not here)."""
        at = self.table.find(grams)
        return np.where(at >= 0, self.costs[at], np.float32(0)).astype(np.float64), at < 0


def scores(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = 5) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte.

    Rows whose key's crc32 (as text; null as empty) is 0 modulo 10 are held out,
    the others train.  ``score`` is log10 of the model's probability of the
    text's bytes and its end; ``bits_per_byte`` is the same as a code length.  A
    null or empty text has its end alone; repeated rows are rows of their own
    and count as often in training; without training rows every word is unknown
    and bits are even; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    out = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = docs.select(F.col(key).alias("id"), out.alias("held_out"), F.col(text).alias("text"))
    train = rows.where("not held_out").select("text")
    costs = stored(run_costs(counted_runs(rows, depth), depth), "costs")
    # at most RUNS rows
    sent = _at_most(costs, "uses", RUNS).select("gram", "cost").toArrow()
    model = spark.sparkContext.broadcast(_Costs(sent.column("gram").to_numpy().view(np.uint64), sent.column("cost").to_numpy()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0

        def merged() -> pa.RecordBatch:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "c"])

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), 1 << 20):
                held.append(np.unique(word_hashes(data, offsets)[0], return_counts=True))
                ends += len(offsets) - 1
                if sum(len(k) for k, _ in held) > 1 << 20:
                    yield merged()
        if ends:
            held.append((np.array([_END]), np.array([ends])))
        if held:
            yield merged()

    words = stored(train.mapInArrow(count, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "words")
    whole = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = whole["n"], whole["v"]
    frequent = _at_most(words, "c", FREQUENT).toArrow()
    order = np.argsort(frequent.column("word").to_numpy().view(np.uint64))
    head = spark.sparkContext.broadcast((frequent.column("word").to_numpy().view(np.uint64)[order], frequent.column("c").to_numpy()[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = head.value
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2), 1 << 21):
                grams, bounds = runs(data, offsets, depth)
                ready, missing = model.value.find(grams)
                sums = np.concatenate([[0.0], np.cumsum(ready)])
                missing = np.flatnonzero(missing)
                rare_runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, bounds), pa.int32()), pa.array(grams[missing].view(np.int64)))
                hashes, firsts = word_hashes(data, offsets)
                n = np.diff(firsts) + 1
                hashes = np.insert(hashes, firsts[1:], _END)
                at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                edges = np.append(0, np.cumsum(n))
                part = np.concatenate([[0.0], np.cumsum(np.where(known, np.log10((counts[at] if len(keys) else 0) + 0.1), 0.0))])
                seen = np.append(0, np.cumsum(known))
                rare = [hashes[x:y][~known[x:y]].view(np.int64) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(np.diff(seen[edges]).astype(np.int64)), pa.array(np.diff(part[edges])), pa.array(np.diff(sums[bounds])), pa.array(np.diff(offsets).astype(np.int64)), pa.array(rare, pa.list_(pa.int64())), rare_runs],
                    names=["id", "held_out", "n_tokens", "n_head", "head", "score", "n_bytes", "rare", "rare_runs"],
                )

    scored = rows.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens bigint, n_head bigint, head double, score double, n_bytes bigint, rare array<bigint>, rare_runs array<bigint>")
    # rows may repeat a key: each has a number of its own
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words outside the frequent ones: none of them is in many rows
    rare = scored.select("row", F.explode("rare").alias("word")).join(words.hint("merge"), "word").groupBy("row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("c") + 0.1).cast("decimal(24,12)")).cast("double").alias("tail"))
    # so are the byte runs outside the frequent ones
    runs_of = scored.select("row", F.explode("rare_runs").alias("gram")).join(costs.select("gram", "cost").hint("merge"), "gram")
    runs_of = runs_of.groupBy("row").agg(F.sum(F.col("cost").cast("decimal(24,12)")).cast("double").alias("rest"))
    full = scored.drop("rare", "rare_runs").join(rare, "row", "left").join(runs_of, "row", "left")
    full = full.withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    n_known = F.col("n_head") + F.coalesce("n_rare", F.lit(0))
    unknown = (F.col("n_tokens") - n_known) * math.log10(0.1)
    base = F.col("head") + F.coalesce("tail", F.lit(0.0)) + unknown - F.col("n_tokens") * math.log10(total + 0.1 * (distinct + 1))
    return full.select(
        F.col("id").alias(key), "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
