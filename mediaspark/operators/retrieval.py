"""Keyword retrieval: the best few catalogue entries of every source for a
phrase, ranked by rarity-weighted overlap, first-indexed entry first on ties.

Tokens are compared by 64-bit hashes (word ids), and only words that a phrase
has leave their texts.  Phrases with equal tokens are one token set.  An entry
of a page holds either one word of the set, then it is among the first of that
word and source, or several.  For the latter, entries are put into their order
and cut into blocks, whose number is bounded; a block is one row of postings.
A set visits only blocks that hold two of its words, in rounds, early entries
first and more blocks each time; once its pages are full, only blocks whose
weight can still beat them.  The sets of a block stream past its postings, so
that postings travel once and a set travels as one short row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.functions.scoring import WEIGHT_UNIT, rarity, total_weight
from mediaspark.functions.text import overlap_tokens
from mediaspark.functions.tokens import count_in_match, counts, distinct_ids, pieces, stretches, word_ids
from mediaspark.plans.materialise import written
from mediaspark.plans.skew import hot_join, salted_join, top_per_group

# Least entries of a block, and about how many blocks there may be.  A set makes
# a row, and a page of results, in every block that it reads.
BLOCK_ENTRIES, MAX_BLOCKS = 4096, 100
# Blocks that are open to every set in the first round, and by how much a round
# reaches further than the one before.
FIRST_BLOCKS, FURTHER = 2, 8
# Sets that one task takes past the postings of a block at most, and at least if tasks are few.
SETS_PER_TASK, LEAST_SETS = 2_000_000, 8_192
# Places that are looked up at once.
PROBES = 2_000_000
# A word in one of so many entries of a block at least is looked up in a bitmap.
COMMON = 64
# Bits of the bitmap of the words that sets have: 8 MB, whatever the input.
SLOTS = 1 << 26


def word_frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    """Relative frequency and rarity weight of every token of a corpus."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in stretches(batch.column(0)):
                _, number, names = pieces(part)
                yield pa.RecordBatch.from_arrays([*counts(names, number)], names=["token", "n"])

    found = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    # read for the total and for the words
    found = written(found, "counts")
    total = found.agg(F.sum("n").alias("total"))
    # one-row side: the corpus total
    out = found.join(F.broadcast(total), F.lit(True))
    frequency = F.col("n").cast("double") / F.col("total").cast("double")
    return out.select("token", "n", frequency.alias("frequency"), rarity(frequency).alias("weight"))


def weighted_tokens(phrases: DataFrame, phrase: str, weights: DataFrame) -> DataFrame:
    """(phrase, weighted): distinct phrases with their tokens as a sorted
    array of struct(token, w)."""
    tokens = phrases.select(phrase).distinct().select(phrase, F.explode(overlap_tokens(phrase)).alias("token"))
    # weigh every distinct token once, then bring the weights to the phrases
    needed = tokens.select("token").distinct().join(weights.select("token", "weight"), "token", "left")
    needed = needed.withColumn("w", F.coalesce("weight", F.lit(WEIGHT_UNIT))).select("token", "w")
    joined = salted_join(tokens, needed, ["token"])
    # a group here is the token list of one phrase
    return joined.groupBy(phrase).agg(F.sort_array(F.collect_list(F.struct("token", "w"))).alias("weighted"))


def _nested(values: np.ndarray | pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """Lists of ``values`` by their ascending ``owner`` 0..n-1."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values))


def _flat(lists: pa.Array) -> np.ndarray:
    """The values of all lists, one after the other."""
    return lists.flatten().to_numpy(zero_copy_only=False)


def _owners(lists: pa.Array) -> np.ndarray:
    """The row of every value of the lists."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(keys[0]) - 1, dtype=bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.append(True, new))


def _rank(starts: np.ndarray, n: int) -> np.ndarray:
    """Place inside its run of each of ``n`` rows."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def _ordered(values: pa.Array) -> np.ndarray:
    """Numbers in the order of the values."""
    if pa.types.is_integer(values.type):
        return values.to_numpy(zero_copy_only=False)
    coded = values.dictionary_encode()
    place = np.empty(len(coded.dictionary), dtype=np.int64)
    place[pa.compute.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    return place[coded.indices.to_numpy()]


def coded_sets(sets: DataFrame) -> DataFrame:
    """set_id, words, ws: the word ids and weights of every set.  ``sets``: set_id, weighted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weighted = batch.column("weighted")
            items, owner = weighted.flatten(), _owners(weighted)
            coded = items.field("token").dictionary_encode()
            words = word_ids(coded.dictionary)[coded.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_id"), _nested(words, owner, len(batch)), _nested(items.field("w"), owner, len(batch))], names=["set_id", "words", "ws"]
            )

    return sets.select("set_id", "weighted").mapInArrow(run, "set_id bigint, words array<bigint>, ws array<bigint>")


def known_words(sets: DataFrame):
    """Broadcast bitmap of the words of all sets, of fixed size."""
    slot = F.pmod("word", F.lit(SLOTS)) + 1
    place = [F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit")]
    found = sets.select(F.explode("words").alias("word")).select(*place).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros((SLOTS // 32768, 4096), dtype=np.uint8)
    for r in found.collect():  # at most SLOTS / 32768 rows of 4 KB
        bits[r["bucket"] - 1] = np.frombuffer(r["bits"], dtype=np.uint8)
    return sets.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def coded_entries(entries: DataFrame, known, tokens: bool = False) -> DataFrame:
    """entry, source, words: for every entry the ids of its distinct tokens that count, of
    those that a set may have.  ``entries``: entry, source and text, or else
    the ``tokens`` themselves."""
    kind, column = entries.schema["entry"].dataType.simpleString(), "tokens" if tokens else "text"

    def ids(values: pa.Array) -> pa.Array:
        if tokens:
            coded = values.flatten().dictionary_encode()
            row, number, names = _owners(values), coded.indices.to_numpy(), coded.dictionary
        else:
            row, number, names = pieces(values)
        word = word_ids(names)
        slot = word & (SLOTS - 1)
        asked = (known.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        if not tokens:
            asked &= count_in_match(names)
        mine = asked[number]
        row, word = distinct_ids(row[mine], word[number[mine]])
        return _nested(word, row, len(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column)
            for first, part in [(0, values)] if tokens else stretches(values):
                same = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([same.column("entry"), same.column("source"), ids(part)], names=["entry", "source", "words"])

    return entries.select("entry", "source", column).mapInArrow(run, f"entry {kind}, source string, words array<bigint>")


def posting_blocks(entries: DataFrame, block_entries: int) -> DataFrame:
    """(block, low, words, ends, places, sources, of, entries): one row per block of
    entries: its words, where their places end in the list of places,
    the entries in order and the numbers of their sources.

    ``entries``: entry, source, words, each partition in the order of entries.  Blocks
    are cut inside tasks.
    """
    kind = entries.schema["entry"].dataType.simpleString()

    def block(number: int, rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by("entry").combine_chunks()
        every, source, lists = (rows.column(c).combine_chunks() for c in ("entry", "source", "words"))
        names = source.dictionary_encode()
        word, place = _flat(lists), _owners(lists).astype(np.int32)
        order = np.argsort(word, kind="stable")
        word = word[order]
        starts = _runs(word)
        one = lambda x, t: pa.array([x], pa.list_(t))
        columns = [
            pa.array([number], pa.int64()), every.slice(0, 1), one(word[starts], pa.int64()), one(np.append(starts, len(word))[1:], pa.int32()),
            one(place[order], pa.int32()), one(names.dictionary.to_pylist(), pa.string()), one(names.indices.to_numpy(), pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "low", "words", "ends", "places", "sources", "of", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, n = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            batch = batch.filter(pa.array(batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0))
            while n + len(batch) >= block_entries:
                cut = block_entries - n
                yield block(part + made, pa.Table.from_batches([*held, batch.slice(0, cut)]))
                batch, held, n, made = batch.slice(cut), [], 0, made + 1
            if len(batch):
                held.append(batch)
                n += len(batch)
        if held:
            yield block(part + made, pa.Table.from_batches(held))

    return entries.select("entry", "source", "words").mapInArrow(
        run, f"block bigint, low {kind}, words array<bigint>, ends array<int>, places array<int>, sources array<string>, of array<int>, entries array<{kind}>"
    )


def first_entries(postings: DataFrame, per_page: int, parts: int) -> DataFrame:
    """(word, heads): the first ``per_page`` entries of each source that have a word, as an
    array of (source, entry).  Every block names its first ones, in ``parts`` packs of words."""
    kind = postings.schema["low"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words, ends, places, of = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("words", "ends", "places", "of"))
                sources, entries = (batch.column(c).slice(i, 1).flatten() for c in ("sources", "entries"))
                key = np.repeat(np.arange(len(words)), np.diff(np.append(0, ends))) * len(sources) + of[places]
                order = np.argsort(key, kind="stable")
                heads = order[_rank(_runs(key[order]), len(key)) < per_page]
                word = key[heads] // len(sources)
                pack = words[word] % parts
                order = np.argsort(pack, kind="stable")
                heads, word, pack = heads[order], words[word[order]], pack[order]
                starts = _runs(pack)
                cuts = pa.array(np.append(starts, len(pack)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(word), sources.take(pa.array(of[places[heads]])), entries.take(pa.array(places[heads])))]
                yield pa.RecordBatch.from_arrays([pa.array(pack[starts], pa.int64()), *lists], names=["pack", "words", "sources", "entries"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        word, source, entry = (pa.concat_arrays([c.flatten() for c in table.column(x).chunks]) for x in ("words", "sources", "entries"))
        names, word = source.dictionary_encode(), word.to_numpy()
        of = names.indices.to_numpy()
        order = np.lexsort((_ordered(entry), of, word))
        kept = order[_rank(_runs(word[order], of[order]), len(order)) < per_page]
        starts = _runs(word[kept])
        heads = pa.StructArray.from_arrays([source.take(pa.array(kept)), entry.take(pa.array(kept))], names=["source", "entry"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(kept)), pa.int32()), heads)
        yield pa.RecordBatch.from_arrays([pa.array(word[kept][starts]), lists], names=["word", "heads"])

    named = postings.select("words", "ends", "places", "sources", "of", "entries").mapInArrow(
        name, f"pack bigint, words array<bigint>, sources array<string>, entries array<{kind}>"
    )
    return named.repartition(parts, "pack").mapInArrow(merge, f"word bigint, heads array<struct<source:string,entry:{kind}>>")


def _floors(held: pa.Array, n_sources: int) -> np.ndarray:
    """What has to be beaten on the page of each source, -1 if it has places left."""
    floors = np.full((len(held), n_sources), -1, dtype=np.int64)
    full = held.flatten()
    floors[_owners(held), full.field("of").to_numpy(zero_copy_only=False)] = full.field("m").to_numpy(zero_copy_only=False)
    return floors


class _Block:
    """Postings of one block, and the entries that sets find in them."""

    def __init__(self, row: pa.RecordBatch, per_page: int, names: dict[str, int]) -> None:
        self.words, ends, self.places, source_of = (row.column(c).flatten().to_numpy() for c in ("block_words", "ends", "places", "of"))
        self.entries, self.n_sources = row.column("entries").flatten(), len(names)
        self.source_of = np.array([names[s] for s in row.column("sources").flatten().to_pylist()])[source_of]
        self.per_page, self.size = per_page, len(self.entries)
        self.at = np.append(0, ends).astype(np.int64)
        length = np.diff(self.at)
        word = np.repeat(np.arange(len(self.words)), length)
        # (word, place) as one sorted number
        self.keys = word * self.size + self.places
        # words that many entries have, by a bit for each entry
        common = np.flatnonzero(length * COMMON >= self.size)
        self.common = np.full(len(self.words), -1, dtype=np.int64)
        self.common[common] = np.arange(len(common))
        self.width = -(-self.size // 8) * 8
        held = np.zeros(len(common) * self.width, dtype=bool)
        mine = self.common[word] >= 0
        held[self.common[word[mine]] * self.width + self.places[mine]] = True
        self.bits = np.packbits(held, bitorder="little")

    def has(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the entry at a place has a word."""
        row = self.common[code]
        out = np.zeros(len(code), dtype=bool)
        mine = np.flatnonzero(row >= 0)
        bit = row[mine] * self.width + place[mine]
        out[mine] = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        mine = np.flatnonzero(row < 0)
        probe = code[mine] * self.size + place[mine]
        out[mine] = self.keys[np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)] == probe
        return out

    def matches(self, sets: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A page of every set and source, of the entries with two words of the set that beat its full pages."""
        floors = _floors(sets.column("held"), self.n_sources)
        asked_words, row, w = _flat(sets.column("words")), _owners(sets.column("words")), _flat(sets.column("ws"))
        code = np.minimum(np.searchsorted(self.words, asked_words), len(self.words) - 1)
        held = self.words[code] == asked_words
        held &= np.bincount(row[held], minlength=len(sets))[row] > 1
        code, row, w = code[held], row[held], w[held]
        length = self.at[code + 1] - self.at[code]
        order = np.lexsort((length, row))
        code, row, w, length = code[order], row[order], w[order], length[order]
        heads = _runs(row)
        # a place in two lists is in one besides the longest
        asked = np.where(np.append(row[1:] == row[:-1], False), length, 0) if len(row) else length
        # whole sets at a time, of bounded size together
        piece = np.cumsum(np.add.reduceat(asked, heads)) // PROBES if len(row) else row
        cuts = _runs(piece)
        for first, last in zip(cuts, [*cuts[1:], len(heads)], strict=True) if len(row) else ():
            mine = slice(heads[first], heads[last] if last < len(heads) else len(row))
            found = self._found(code[mine], row[mine], w[mine], asked[mine])
            if len(found[0]):
                yield self._page(sets.column("set_id"), floors, *found)

    def _found(self, code: np.ndarray, row: np.ndarray, w: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, weight) of the places in two lists of a row at least."""
        item = np.repeat(np.arange(len(code)), asked)
        step = np.arange(len(item)) - np.repeat(np.cumsum(asked) - asked, asked)
        place = self.places[self.at[code[item]] + step]
        heads = _runs(row)
        sizes = np.diff(np.append(heads, len(row)))
        head, size = np.repeat(heads, sizes)[item], np.repeat(sizes, sizes)[item]
        n, total = np.ones(len(item), dtype=np.int64), w[item].copy()
        for j in range(sizes.max()):
            other = head + j
            at = np.flatnonzero((j < size) & (other != item))
            at = at[self.has(code[other[at]], place[at])]
            n[at] += 1
            total[at] += w[other[at]]
        kept = np.flatnonzero(n >= 2)
        # a place that several lists of a row ask for is found as often
        _, one = np.unique(row[item[kept]] * self.size + place[kept], return_index=True)
        kept = kept[one]
        return row[item[kept]], place[kept], total[kept]

    def _page(self, names: pa.Array, floors: np.ndarray, row: np.ndarray, place: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        of = self.source_of[place]
        better = total > floors[row, of]
        row, place, total, of = row[better], place[better], total[better], of[better]
        order = np.lexsort((place, -total, of, row))
        row, place, total, of = row[order], place[order], total[order], of[order]
        kept = _rank(_runs(of, row), len(of)) < self.per_page
        columns = [names.take(pa.array(row[kept])), pa.array(of[kept], pa.int32()), self.entries.take(pa.array(place[kept])), pa.array(total[kept], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["set_id", "of", "entry", "matched"])


def _scored(work: DataFrame, postings: DataFrame, per_page: int, names: dict[str, int], blocks: int, n_sets: int) -> DataFrame:
    """(set_id, of, entry, matched): a page of every set and source of the
    entries with two words or more of the set, from every block that the set
    is to read.  ``work``: set_id, words, ws, held, block, read once; ``names``: the numbers
    of the sources; ``blocks``: how many there are; ``n_sets``: how many sets may read one."""
    kind = postings.schema["low"].dataType.simpleString()
    cores = work.sparkSession.sparkContext.defaultParallelism
    # few blocks are copied for several tasks
    several = min(2 * cores // blocks, n_sets // LEAST_SETS)
    chunks = F.lit(max(1, math.ceil(n_sets / SETS_PER_TASK), several)).cast("bigint")
    sets = work.withColumn("chunk", F.pmod(F.xxhash64("set_id"), chunks))
    rows = postings.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    rows = rows.withColumnRenamed("words", "block_words").drop("low")
    # no null lists: Arrow's writer goes over all rows of a batch for each row of them
    lists = {c: t for c, t in rows.dtypes if t.startswith("array") and c not in sets.columns}
    sets = sets.withColumns({c: F.array().cast(t) for c, t in lists.items()})
    both = rows.unionByName(sets, allowMissingColumns=True)
    # several times as many parts as blocks, so that few blocks share one
    parts = max(4 * blocks * max(1, several), cores)
    # the postings of a block come before its sets
    dealt = both.repartition(parts, "block", "chunk").sortWithinPartitions("block", "chunk", F.col("set_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own, block = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "chunk")])
            cuts = _runs(*group).tolist()
            for first, last in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                part = batch.slice(first, last - first)
                if (now := tuple(group[:, first])) != here:
                    here, own, part, block = now, part.slice(0, 1), part.slice(1), None
                if len(part):
                    block = block or _Block(own, per_page, names)
                    yield from block.matches(part.select(["set_id", "words", "ws", "held"]))

    return dealt.mapInArrow(run, f"set_id bigint, of int, entry {kind}, matched bigint")


def _to_read(asked: DataFrame, n_sources: int, start: int, end: int, least: int) -> DataFrame:
    """(set_id, words, ws, held, nth): the blocks from ``start`` to ``end`` that a set reads.

    ``asked``: set_id, words, ws, blocks (bits of the blocks of every word) and
    held, the full pages (number of the source, what has to be beaten).
    """
    columns = ["set_id", "words", "ws", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 4096):
                batch = whole.slice(first, 4096)
                words, blocks = batch.column("words"), batch.column("blocks")
                if not len(batch):
                    continue
                bits = blocks.flatten().flatten().to_numpy(zero_copy_only=False).astype("<i8")
                bits = np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(len(blocks.flatten()), -1)[:, start:end]
                heads = np.append(0, np.cumsum(words.value_lengths().to_numpy()))[:-1]
                n = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
                bound = np.add.reduceat(bits * _flat(batch.column("ws"))[:, None], heads, axis=0)
                # later blocks hold later entries, which lose ties
                at, nth = np.nonzero((n >= least) & (bound > _floors(batch.column("held"), n_sources).min(axis=1)[:, None]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in columns], pa.array(nth + start, pa.int32())], names=[*columns, "nth"])

    return asked.mapInArrow(run, "set_id bigint, words array<bigint>, ws array<bigint>, held array<struct<of:int,m:bigint>>, nth int")


def set_candidates(sets: DataFrame, entries: DataFrame, per_page: int) -> DataFrame:
    """(set_id, firsts, pairs): for every set the entries that can be on its pages: an array of
    (w, heads) with the first entries of each of its words, and an array of (source, entry, matched) of
    entries with several.  An entry may be named several times; its highest weight is the right one.

    ``sets``: set_id, words, ws (word ids and positive weights); ``entries``: entry, source, words; both written.
    """
    kind = entries.schema["entry"].dataType.simpleString()
    n_entries = entries.count()
    size, parts = max(BLOCK_ENTRIES, -(-n_entries // MAX_BLOCKS)), entries.rdd.getNumPartitions()
    # in the order of entries, so that a later block can't win by a tie
    if parts > 1:
        entries, size = entries.repartitionByRange(max(1, -(-n_entries // size)), "entry"), 2 * size
    entries = entries.sortWithinPartitions("entry")
    postings = written(posting_blocks(entries, size), "postings")
    # one row per block; their number is bounded
    blocks = sorted(postings.select("block", "low", "sources").collect(), key=lambda r: (r["low"], r["block"]))
    sources = sorted({s for r in blocks for s in r["sources"]})
    names = {s: i for i, s in enumerate(sources)}
    spark = entries.sparkSession
    numbers = F.broadcast(spark.createDataFrame([(r["block"], i) for i, r in enumerate(blocks)], "block bigint, nth int"))

    words = sets.select("set_id", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("ws").alias("w"))).alias("t")).select("set_id", "t.word", "t.w")
    uses = written(words.groupBy("word").agg(F.count("*").alias("n")), "uses")
    deal = max(4 * len(blocks), spark.sparkContext.defaultParallelism)
    heads = first_entries(postings, per_page, deal)
    firsts = hot_join(words, heads, "word", uses, spread=["set_id"]).groupBy("set_id").agg(F.collect_list(F.struct("w", "heads")).alias("firsts"))
    nothing = F.array().cast(f"array<struct<source:string,entry:{kind},matched:bigint>>")
    if not blocks:
        return firsts.withColumn("pairs", nothing)
    bit = lambda j: F.bit_or(F.when(F.floor(F.col("nth") / 64) == j, F.expr("shiftleft(1L, nth % 64)")).otherwise(F.lit(0).cast("bigint")))
    masks = postings.select("block", F.explode("words").alias("word")).join(numbers, "block").groupBy("word").agg(F.array(*[bit(j) for j in range(-(-len(blocks) // 64))]).alias("blocks"))
    # sets with their words' blocks, one row per set
    asked = hot_join(words, masks, "word", uses, spread=["set_id"]).groupBy("set_id").agg(
        F.collect_list(F.struct("word", "w", "blocks")).alias("t")
    ).select("set_id", F.col("t.word").alias("words"), F.col("t.w").alias("ws"), F.col("t.blocks").alias("blocks"))
    asked = written(asked, "sets")
    n_sets = asked.count()
    best, start, end, least = None, 0, FIRST_BLOCKS, 1
    while start < len(blocks):
        held = F.array().cast("array<struct<of:int,m:bigint>>")
        if best is None:
            floors = asked.withColumn("held", held)
        else:
            full = best.groupBy("set_id", "of").agg(F.min("matched").alias("m"), F.count("*").alias("n")).where(F.col("n") == per_page)
            floors = asked.join(full.groupBy("set_id").agg(F.collect_list(F.struct("of", "m")).alias("held")), "set_id", "left").withColumn("held", F.coalesce("held", held))
        end = min(end, len(blocks))
        work = _to_read(floors, len(sources), start, end, least).join(numbers, "nth").drop("nth")
        opened = postings.join(numbers, "block").where((F.col("nth") >= start) & (F.col("nth") < end)).drop("nth")
        found = _scored(work, opened, per_page, names, end - start, n_sets)
        both = found if best is None else best.unionByName(found)
        best = written(top_per_group(both, ["set_id", "of"], [F.desc("matched"), F.col("entry")], per_page).drop("rank"), "pages")
        # an entry with one word of the set is among that word's first
        start, end, least = end, end * FURTHER, 2
    source = F.get(F.array(*[F.lit(s) for s in sources]), "of").alias("source")
    pairs = best.groupBy("set_id").agg(F.collect_list(F.struct(source, "entry", "matched")).alias("pairs"))
    return firsts.join(pairs, "set_id", "left").withColumn("pairs", F.coalesce("pairs", nothing))


def _pages(found: DataFrame, per_page: int, named: list[str], spare: dict[str, list]) -> DataFrame:
    """``found`` with ``page`` in place of ``firsts`` and ``pairs``: an array of (source, pos, entry, matched), the
    ``per_page`` best entries of every source, each once.  ``named`` sources are filled with their
    ``spare`` entries for all rows, others where they are found."""
    kind = found.select(F.col("pairs")[0]["entry"].alias("entry")).schema["entry"].dataType.simpleString()
    rest = [c for c in found.columns if c not in ("firsts", "pairs")]
    codes = {s: i for i, s in enumerate(sorted({*named, *spare}))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 2048):
                batch = whole.slice(start, 2048)
                firsts, pairs = batch.column("firsts"), batch.column("pairs")
                each = firsts.flatten()
                lists, inner = each.field("heads"), each.field("heads").flatten()
                at = _owners(lists)
                owner = [_owners(firsts)[at], _owners(pairs)]
                matched = [each.field("w").to_numpy(zero_copy_only=False)[at], pairs.flatten().field("matched").to_numpy(zero_copy_only=False)]
                source, entry = [inner.field("source"), pairs.flatten().field("source")], [inner.field("entry"), pairs.flatten().field("entry")]
                type_ = entry[0].type
                coded = pa.concat_arrays(source).dictionary_encode()
                local = dict(codes)
                of = np.array([local.setdefault(s, len(local)) for s in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
                here = np.unique(np.concatenate(owner) * len(local) + of)
                every = np.repeat(np.arange(len(batch)), len(named)) * len(local) + np.tile([local[s] for s in named], len(batch)).astype(np.int64)
                filled = np.union1d(here, every)
                names = list(local)
                held = [spare.get(s, []) for s in names]
                size = np.array([len(h) for h in held], dtype=np.int64)
                n = size[filled % len(local)]
                flat, begin = pa.array([e for h in held for e in h], type_), np.cumsum(size) - size
                place = np.repeat(begin[filled % len(local)] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                owner = np.concatenate([*owner, np.repeat(filled // len(local), n)])
                of = np.concatenate([of, np.repeat(filled % len(local), n)])
                matched = np.concatenate([*matched, np.zeros(n.sum(), dtype=np.int64)]).astype(np.int64)
                entry = pa.concat_arrays([*entry, flat.take(pa.array(place))])
                by = _ordered(entry)
                # an entry once, with its highest weight
                order = np.lexsort((-matched, by, of, owner))
                order = order[_runs(owner[order], of[order], by[order])]
                order = order[np.lexsort((by[order], -matched[order], of[order], owner[order]))]
                pos = _rank(_runs(owner[order], of[order]), len(order))
                order, pos = order[pos < per_page], pos[pos < per_page]
                page = pa.StructArray.from_arrays(
                    [pa.array(names, pa.string()).take(pa.array(of[order])), pa.array(pos + 1, pa.int32()), entry.take(pa.array(order)), pa.array(matched[order])],
                    names=["source", "pos", "entry", "matched"],
                )
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], _nested(page, owner[order], len(batch))], names=[*rest, "page"])

    fields = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in rest)
    return found.select(*rest, "firsts", "pairs").mapInArrow(run, f"{fields}, page array<struct<source:string,pos:int,entry:{kind},matched:bigint>>")


def _numbered(sets: DataFrame) -> DataFrame:
    """Sets with a short id, written, as it must not change between uses."""
    return written(sets.withColumn("set_id", F.monotonically_increasing_id()), "numbered")


def set_pages(sets: DataFrame, entries: DataFrame, per_page: int) -> DataFrame:
    """(set_key, source, entry, matched): the ``per_page`` best entries of every
    token set and source, of those that hold any of its tokens.

    ``sets``: set_key, weighted (array of token and positive weight), one row
    per set; ``entries``: entry, source, tokens.
    """
    sets = _numbered(sets)
    coded = written(coded_sets(sets), "coded")
    held = written(coded_entries(entries, known_words(coded), tokens=True), "entries")
    rows = _pages(set_candidates(coded, held, per_page), per_page, [], {}).select("set_id", F.explode("page").alias("e"))
    return rows.join(sets.select("set_id", "set_key"), "set_id").select("set_key", "e.source", "e.entry", "e.matched")


def search(
    phrases: DataFrame,
    catalogue: DataFrame,
    weights: DataFrame,
    per_page: int = C.PER_PAGE,
    sources: tuple[str, ...] | None = C.PROVIDERS_DEFAULT,
    fill: bool = True,
    entry: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, coded phrases, coded entries).

    Pages: query, total, page (array of source, pos, entry, matched); coded phrases: query, words, ws of
    those that have tokens; coded entries: entry, source, words, of the words that a phrase may have.
    """
    phrases = written(phrases.select("query").distinct(), "queries")
    weighted = weighted_tokens(phrases, "query", weights).select(
        "query", "weighted", F.array_join("weighted.token", " ").alias("set_key"), total_weight("weighted").alias("total")
    )
    weighted = written(weighted, "phrases")
    sets = _numbered(weighted.dropDuplicates(["set_key"]).select("set_key", "weighted"))
    coded = written(coded_sets(sets), "coded")
    named = catalogue.where("source is not null").select(F.col(entry).alias("entry"), "source", F.col(text).cast("string").alias("text"))
    entries = written(coded_entries(named, known_words(coded)), "entries")
    with_set = weighted.select("query", "set_key", "total").join(sets.select("set_id", "set_key"), "set_key").drop("set_key")
    rows = phrases.join(with_set, "query", "left").join(set_candidates(coded, entries, per_page), "set_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("firsts", "pairs")})
    spare: dict[str, list] = {}
    if fill:
        # at most per_page entries per source
        first = top_per_group(entries.select("source", "entry"), ["source"], [F.col("entry")], per_page)
        for r in first.orderBy("source", "rank").collect():
            spare.setdefault(r["source"], []).append(r["entry"])
    pages = _pages(rows.drop("set_id"), per_page, (list(spare) if sources is None else list(sources)) if fill else [], spare)
    pages = pages.withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))
    words = weighted.select("query", "set_key").join(sets.select("set_id", "set_key"), "set_key").join(coded, "set_id").select("query", "words", "ws")
    return pages, words, entries


def retrieve(
    phrases: DataFrame,
    catalogue: DataFrame,
    weights: DataFrame,
    per_page: int = C.PER_PAGE,
    sources: tuple[str, ...] | None = C.PROVIDERS_DEFAULT,
    fill: bool = True,
    entry: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Best entries per (query, source).

    ``phrases`` has a column ``query``; ``catalogue`` has ``source``, an index
    order ``entry`` (unique) and ``text``.  Result: query, source, pos
    (1..per_page), entry, matched and total weight.  With ``fill`` entries
    without any overlap take the free places, in index order; ``sources`` are
    those that are filled, None all of the catalogue's.
    """
    pages, _, _ = search(phrases, catalogue, weights, per_page, sources, fill, entry, text)
    return pages.select("query", "total", F.explode("page").alias("e")).select("query", "e.source", "e.pos", "e.entry", "e.matched", "total")


def clip_phrases(clips: DataFrame) -> DataFrame:
    """Search phrases of every beat: (…, tier, phrase_no, query), tier 1 the
    main keyword, 2 the fallback, 3 the semantic phrases in turn."""
    item = lambda tier, no, query: F.struct(
        F.lit(tier).alias("tier"), F.lit(no).alias("phrase_no"), query.alias("query")
    )
    third = F.transform(
        "phrases",
        lambda p, i: F.struct(F.lit(3).alias("tier"), (i + 1).cast("int").alias("phrase_no"), p.alias("query")),
    )
    items = F.concat(F.array(item(1, 1, F.col("canva_keyword")), item(2, 1, F.col("fallback_keyword"))), third)
    return clips.withColumn("_q", F.explode(items)).select(
        *[c for c in clips.columns if c != "phrases"], "_q.tier", "_q.phrase_no", "_q.query"
    )


def provider_rank(source: str = "source", visual_type: str = "visual_type") -> Column:
    """Place of a source in the search order of a beat's era."""

    def position(order: tuple[str, ...]) -> Column:
        table = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
        return F.try_element_at(table, F.col(source))

    return F.when(F.col(visual_type).isin(*C.HISTORICAL_TYPES), position(C.PROVIDERS_HISTORICAL)).otherwise(
        position(C.PROVIDERS_DEFAULT)
    )


def provider_active(
    source: str = "source",
    category: str = "category",
    categories: tuple = (),
    library: Column | None = None,
    stock: Column | None = None,
) -> Column:
    """Whether a source is searched under the category and the two toggles."""
    library = F.lit(True) if library is None else library
    stock = F.lit(True) if stock is None else stock
    archive_keys = [c.key for c in categories if c.use_archive]
    library_keys = [c.key for c in categories if c.library_path]
    src = F.col(source)
    return (
        ((src != "internet_archive") | F.col(category).isin(*archive_keys))
        & (stock | (src == C.LIBRARY_SOURCE))
        & ((src != C.LIBRARY_SOURCE) | (library & F.col(category).isin(*library_keys)))
    )
