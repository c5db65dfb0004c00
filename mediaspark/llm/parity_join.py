"""Exact Jaccard join of word shingle sets through parity sketches.

Every shingle flips one bit of a sketch, so the Hamming distance of two
sketches is at most the symmetric difference of the sets.  Sets that link have
sizes within a known ratio and a symmetric difference of at most ``d``, which
grows with their size; a size band fixes ``d`` and the number of parts into
which the shingles are dealt, each with the XOR of its shingles' hashes.  With
``d + 1`` parts at least one must be equal.  There are a few more, so that sets
with at most as many empty parts also share one that isn't empty, and need not
meet by empty ones.  Sets meet by equal parts; the
distance of their whole sketches sorts out most that only look alike, and the
rest is verified on the sets.

Equal sets are one class and take part once; a task sketches a set that it has
seen before no second time.  Two sets that link have several parts in common,
``least`` for each of them, so that they also meet if each leaves out its
``least - 1`` most crowded parts.  That takes away most meetings by common
passages, before any sketch is read.  Among the classes that share a
part (near copies may be many) each is compared with a few neighbours in small
sub-groups, which connects most of what is connected.  Only where the links
found leave the members of a part in several components are the members outside
the largest one compared with those of other components, inside the join and by
sketch, each pair in the smallest of its common parts only, so that no group of
near copies is expanded into pairs, let alone once per part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaspark.llm.common import stored, told_apart
from mediaspark.llm.words import chunks, mix, shingle_sets
from mediaspark.operators.dedup import components

#: Ratio of the sizes at which bands begin.
BAND = 1.5
#: The low bits of a part's hash hold its band.
_BAND_MASK = 63


def _bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, differences) of each band.  A pair that links
    lies in the band of its smaller set.  Sizes below those that can differ at
    all need no band: they link only when equal."""
    reach = lambda a: a * 100 // percent  # noqa: E731  the largest partner
    # 100 * i >= p * u with u - i = d and u + i = a + b gives (100 + p) * d <= (100 - p) * (a + b)
    differ = lambda a: (a + reach(a)) * (100 - percent) // (100 + percent)
    low = next(a for a in range(1, 1000) if differ(a) >= 1)
    out = []
    while low <= largest:
        high = max(low, int(low * BAND) - 1)
        out.append((low, reach(high), differ(high)))
        low = high + 1
    return out


def _spare(differences: int) -> int:
    """Parts beyond ``differences + 1``: as many empty ones a set may have
    without meeting by them."""
    return 2 + differences // 8


def _sketch(shingles: np.ndarray, band: int, differences: int, percent: int) -> dict:
    """The parts of the sketch, as hashes to meet by, and for the distance
    parity bits, at least four per difference that is allowed."""
    count = differences + 1 + _spare(differences)
    part = (mix(shingles + np.uint64(1)) % np.uint64(count)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    xors = np.bitwise_xor.reduceat(mix(shingles + np.uint64(3))[order], heads)
    place = part[heads].astype(np.uint64)
    if count - len(heads) > _spare(differences):  # more empty parts than spare ones: they count, too
        empty = np.setdiff1d(np.arange(count, dtype=np.uint64), place)
        place, xors = np.append(place, empty), np.append(xors, np.zeros(len(empty), np.uint64))
    words = max(2, -(-(differences + 1) // 16))
    spread = mix(shingles + np.uint64(2))
    bit = (spread >> np.uint64(6)) % np.uint64(words) * np.uint64(64) + (spread & np.uint64(63))
    parity = np.packbits((np.bincount(bit.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8), bitorder="little")
    hashes = mix(xors ^ mix(place + np.uint64(band << 32))) & ~np.uint64(_BAND_MASK) | np.uint64(band)
    # a set that links has at most so many differences, each in one part; without listed empty parts the others are common
    size = len(shingles)
    most = (size + size * 100 // percent) * (100 - percent) // (100 + percent)
    least = max(1, len(heads) - most) if len(place) == len(heads) else 1
    return {"band": band, "least": least, "parts": hashes.view(np.int64), "sketch": parity.view(np.int64)}


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One hash per set."""
    sums = np.array([int(mix(s).sum(dtype=np.uint64)) ^ len(s) for s in sets], dtype=np.uint64)
    return mix(sums).view(np.int64)


_SKETCH = "size bigint, sig bigint, bands array<struct<band:int,least:int,parts:array<bigint>,sketch:array<bigint>>>"


def sketched(docs: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """(id, mark, size, sig, bands) per row, ``mark`` being a hash of its text;
    of equal sets in a task one has bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = _bands(percent, 1 << 31)
        kind = pa.list_(pa.struct([("band", pa.int32()), ("least", pa.int32()), ("parts", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]))
        seen: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                sets = shingle_sets(data, offsets, words)
                sigs, rows = _signatures(sets), []
                for sig, s in zip(sigs.tolist(), sets, strict=True):
                    rows.append([] if sig in seen else [_sketch(s, i, p, percent) for i, (low, high, p) in enumerate(bands) if low <= len(s) <= high])
                    seen.add(sig)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs), pa.array(rows, kind)],
                    names=["id", "mark", "size", "sig", "bands"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, mark bigint, {_SKETCH}")


def _sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(sig, set) with the sorted shingle hashes of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                sets = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays([pa.array(_signatures(sets)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sig", "set"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "sig bigint, set array<bigint>")


def _near(percent: int):
    """The test of two members' sizes and sketches, as a column of two structs
    (size, sketch)."""

    def test(x, y):
        apart = F.aggregate(F.zip_with(x["sketch"], y["sketch"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
        sizes = F.lit(100) * F.least(x["size"], y["size"]) >= F.lit(percent) * F.greatest(x["size"], y["size"])
        return sizes & ((100 + percent) * apart <= (100 - percent) * (x["size"] + y["size"]))

    return test


def _verified(near: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets link.  ``near`` is stored."""
    wanted = near.select(F.col("a").alias("sig")).union(near.select("b")).distinct()
    ids = stored(wanted.join(classes.select("sig", "id"), "sig"), "verify")
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    _, perhaps = told_apart(named, F.xxhash64("id"), ids, F.xxhash64("id"))
    texts = perhaps.join(ids.select(F.col("id").alias("wanted")), F.expr("id <=> wanted"), "left_semi")
    sets = stored(_sets(texts, "text", words).groupBy("sig").agg(F.max("set").alias("set")), "sets")
    met = near.join(sets.select(F.col("sig").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("sig").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return met.where((100 + percent) * common >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b")


#: Members of a sub-group, and how many of those before it a member is compared with.
SUBGROUP, NEIGHBOURS = 64, 2


def _band(part: str = "part"):
    return F.col(part).bitwiseAND(F.lit(_BAND_MASK)).cast("int")


def _shared(spots: DataFrame) -> DataFrame:
    """(part, sig, n) of the parts that n > 1 classes have; one exchange."""
    once = spots.repartition("part").dropDuplicates(["part", "sig"])
    return once.withColumn("n", F.count("*").over(W.partitionBy("part"))).where("n > 1")


def _members(rows: DataFrame) -> DataFrame:
    """(part, sig, n): the classes of each part, without the most crowded parts
    of each class."""
    spots = rows.select("sig", F.explode(F.flatten("bands.parts")).alias("part")).select("part", "sig")
    first = stored(_shared(spots), "shared")
    needs = rows.select("sig", F.explode(F.arrays_zip(F.col("bands.band").alias("band"), F.col("bands.least").alias("least"))).alias("b")).select("sig", "b.band", "b.least").distinct()
    crowded = W.partitionBy("sig", "band").orderBy(F.col("n").desc(), "part")
    ranked = first.withColumn("band", _band()).withColumn("r", F.row_number().over(crowded))
    kept = ranked.join(needs.hint("merge"), ["sig", "band"]).where("r >= least").select("part", "sig")
    return stored(_shared(kept), "members")


def similar_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(rows, links): every row's class with its set size, and enough links
    between classes to connect all that are connected."""
    rows = stored(sketched(docs, text, key, words, percent), "sketches")
    # classes of equal sets; empty sets link with nothing
    classes = stored(rows.where(F.col("size") > 0).groupBy("sig").agg(F.min("id").alias("id")), "classes")
    members, near = _members(rows), _near(percent)
    # what a comparison needs, of the classes that are left only
    left = members.select("sig").distinct()
    own = rows.join(left, "sig", "left_semi").select("sig", "size", F.explode("bands").alias("s"))
    own = own.select("sig", F.col("s.band").alias("band"), F.struct("size", F.col("s.sketch").alias("sketch")).alias("own"))
    own = stored(own.dropDuplicates(["sig", "band"]), "own")
    side = lambda of, n: of.select(F.col("sig").alias(n), "band", F.col("own").alias(f"own_{n}"))
    # a few neighbours in sub-groups of bounded size
    sub = F.pmod(F.xxhash64("sig"), F.ceil(F.col("n") / SUBGROUP).cast("bigint"))
    order = W.partitionBy("part", "sub").orderBy("sig")
    before = F.array_compact(F.array(*[F.lag("sig", i).over(order) for i in range(1, NEIGHBOURS + 1)]))
    close = members.withColumn("sub", sub).withColumn("before", before)
    pairs = close.select(F.explode("before").alias("a"), F.col("sig").alias("b"), _band().alias("band")).distinct()
    met = pairs.join(side(own, "a"), ["a", "band"]).join(side(own, "b"), ["b", "band"])
    tried = stored(met.where(near(F.col("own_a"), F.col("own_b"))).select("a", "b").distinct(), "near")
    links = stored(_verified(tried, classes, docs, text, key, words, percent), "links")
    found = stored(components(links, "a", "b"), "found")
    # parts whose members the links leave in several components
    clusters = found.select(F.col("id").alias("sig"), "cluster")
    housed = members.select("part", "sig").join(clusters, "sig", "left").withColumn("home", F.coalesce("cluster", "sig"))
    housed = stored(housed.select("part", "sig", "home"), "homes")
    homes = housed.groupBy("part", "home").agg(F.count("*").alias("n"))
    split = homes.groupBy("part").agg(F.max_by("home", F.struct("n", "home")).alias("main"), F.count("*").alias("homes")).where("homes > 1")
    rest = stored(housed.join(split.select("part", "main"), "part").withColumn("band", _band()), "rest")
    parts = rest.groupBy("sig", "band").agg(F.collect_list("part").alias("parts")).join(own, ["sig", "band"])
    parts = parts.select("sig", "band", F.struct("own.size", "own.sketch", "parts").alias("own"))
    rest = stored(rest.join(parts, ["sig", "band"]).select("part", "sig", "home", "main", "own"), "rest-sketches")
    outside = rest.where("home <> main").select("part", F.col("sig").alias("a"), F.col("home").alias("home_a"), F.col("own").alias("own_a"))
    others = rest.select("part", F.col("sig").alias("b"), F.col("home").alias("home_b"), F.col("own").alias("own_b"), "main")
    apart = (F.col("home_a") != F.col("home_b")) & ((F.col("home_b") == F.col("main")) | (F.col("a") < F.col("b")))
    smallest = F.array_min(F.array_intersect("own_a.parts", "own_b.parts")) == F.col("x.part")
    across = outside.alias("x").join(others.alias("y").hint("merge"), (F.col("x.part") == F.col("y.part")) & apart & near(F.col("own_a"), F.col("own_b")) & smallest)
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    again = stored(across.join(tried, ["a", "b"], "left_anti"), "across")
    more = _verified(again, classes, docs, text, key, words, percent)
    return rows.select("id", "mark", "size", "sig"), stored(links.unionByName(more), "all-links")


def similarity_components(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: key, n_shingles, component_id.

    ``component_id`` is the smallest key reachable by links of similarity
    ``percent``/100 or more.  Null and empty texts, and texts of white space,
    have an empty set and link with nothing; repeated rows are rows of one
    class; a null key is never a component's name unless all its members have
    none; an empty table gives no rows; other columns are not read.
    """
    out = _named(docs, text, key, words, percent)
    return out.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), "component_id")


def _named(docs: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """(id, mark, size, cluster, component_id) of every row; an empty set has
    no cluster."""
    rows, links = similar_classes(docs, text, key, words, percent)
    found = stored(components(links, "a", "b"), "components")
    smallest = rows.where(F.col("size") > 0).groupBy("sig").agg(F.min("id").alias("id"))
    named = smallest.join(found.withColumnRenamed("id", "sig"), "sig", "left").withColumn("cluster", F.coalesce("cluster", "sig"))
    names = named.groupBy("cluster").agg(F.min("id").alias("component_id"))
    named = stored(named.join(names, "cluster").select("sig", "cluster", "component_id"), "named")
    # a class may hold a third of all rows: a join of two stored tables, which adaptive execution can split
    full = rows.where(F.col("size") > 0).join(named.hint("merge"), "sig").select("id", "mark", "size", "cluster", "component_id")
    none = F.lit(None).cast("bigint").alias("cluster")
    return full.unionByName(rows.where(F.col("size") == 0).select("id", "mark", "size", none, F.col("id").alias("component_id")))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row
    stays, that with the smallest key, under that key the text with the
    smallest hash.

    Rows are told apart by key and text, so that different texts under one key
    are decided apart, and equal rows are one.  A null key counts as the
    largest.  Rows whose text has no words stay, all of them; an empty table
    gives no rows; all columns are kept, whatever their names.
    """
    found = stored(_named(docs, text, key, words, percent).where("size > 0"), "components-of")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("best")
    stays = found.groupBy("cluster").agg(best).select("cluster", F.col("best.id").alias("stay_id"), F.col("best.mark").alias("stay_mark"))
    judged = found.groupBy("id", "mark", "cluster").agg(F.count("*").alias("n")).join(stays, "cluster")
    judged = judged.select("id", "mark", "n", F.expr("id <=> stay_id and mark = stay_mark").alias("first"))
    judged = stored(judged.where("not first or n > 1").select("id", "mark", "first"), "judged")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_key, own_text = (names[docs.columns.index(c)] for c in (key, text))
    plain = docs.toDF(*names).withColumn("row_mark", F.xxhash64(own_text))
    # rows that need no look stay where they are
    clear, perhaps = told_apart(plain, F.xxhash64(own_key, "row_mark"), judged, F.xxhash64("id", "mark"))
    looked = perhaps.join(judged.hint("merge"), F.col(own_key).eqNullSafe(F.col("id")) & (F.col("row_mark") == F.col("mark")), "left")
    once = looked.where("first").dropDuplicates([own_key, "row_mark"])
    return clear.unionByName(looked.where("first is null").unionByName(once).select(clear.columns)).drop("row_mark").toDF(*docs.columns)
