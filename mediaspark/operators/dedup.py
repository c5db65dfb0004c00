"""Exact and near-duplicate handling of a media library."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaspark.functions.text import caption_slug
from mediaspark.plans.materialise import written
from mediaspark.plans.skew import block_scan, group_rank, salted_join

#: Bytes of the texts on one side of a cell of pairs, pairs that one task takes past them, and pairs of a batch with texts.
CELL_BYTES, CELL_PAIRS, TEXT_PAIRS = 64 << 20, 1_000_000, 512
#: Least cells a side.
LEAST_CELLS = 4


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256))


def exact_duplicates(files: DataFrame) -> DataFrame:
    """Adds ``keep_name``, the first name with the same content, and
    ``duplicate``.  Files without a hash match nothing."""
    firsts = files.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min("name").alias("keep_name"))
    marked = salted_join(files, firsts, ["hash"], "left", spread=["name"])
    marked = marked.withColumn("keep_name", F.coalesce("keep_name", "name"))
    return marked.withColumn("duplicate", F.col("keep_name") != F.col("name"))


def index_plan(files: DataFrame, index: DataFrame) -> DataFrame:
    """What an index run does with every file that is not indexed yet, in the
    order of names: ``duplicate`` of an indexed file or of one that the run has
    indexed before it, ``failed`` if it has no caption, else ``indexed``.

    ``files``: name, hash, optionally caption (without that column every file
    has one), ...; ``index``: name, hash (null where unknown).  A file without
    a caption is not indexed, so later copies of it are no duplicates of it.
    """
    usable = F.col("caption").isNotNull() if "caption" in files.columns else F.lit(True)
    new = files.join(index.select("name"), "name", "left_anti")
    known = index.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min("name").alias("_known"))
    first = new.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min(F.when(usable, F.col("name"))).alias("_first"))
    both = first.join(known, "hash", "left")
    planned = salted_join(new, both, ["hash"], "left", spread=["name"])
    same = F.coalesce("_known", F.when(F.col("_first") < F.col("name"), F.col("_first")))
    planned = planned.withColumn("duplicate_of", same).drop("_known", "_first")
    status = F.when(F.col("duplicate_of").isNotNull(), F.lit("duplicate")).when(usable, F.lit("indexed")).otherwise(F.lit("failed"))
    return planned.withColumn("status", status)


def stale_entries(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select("name"), "name", "left_anti")


def new_files(files: DataFrame, index: DataFrame) -> DataFrame:
    return files.join(index.select("name"), "name", "left_anti")


def split_captions(described: DataFrame, caption: str = "caption") -> tuple[DataFrame, DataFrame]:
    """(usable, failed): rows with and without a caption."""
    return described.where(F.col(caption).isNotNull()), described.where(F.col(caption).isNull())


_LINE = ["folder", "slug", "ext"]
_NUMBERED = r"^(.*)_([2-9]|[1-9][0-9]+)$"


def unique_names(
    files: DataFrame, taken: DataFrame | None = None, caption: str = "caption", order: str = "name"
) -> DataFrame:
    """Adds ``new_name``: caption slug plus extension, with _2, _3, ... where
    the name is taken in its folder, by a file that is there already or that
    comes earlier in ``order``.

    ``files``: folder, ext, a caption and an ordering name that is unique in
    its folder; ``taken``: folder, new_name of names already in use.

    The names of one slug are a line of numbered slots, and the k-th file of a
    line takes its k-th free slot.  A slug that is itself another's numbered
    name (``road_2``) claims a slot of that line with its first file, and gets
    it unless the line's own files came so far before; then its own first slot
    is lost.  Whether a claim holds depends on the claims of lower slots only,
    so claims are settled in rounds over all lines at once until none changes.
    A slug that half the library shares is ranked over many tasks.
    """
    # written, as the ranges are drawn from a pass of their own; captions are read once
    named = written(files.withColumn("slug", caption_slug(caption)).drop(caption), "named")
    ranked = group_rank(named, _LINE, [order], "_k")
    if taken is None:
        taken = files.sparkSession.createDataFrame([], "folder string, new_name string")
    ranked = written(ranked, "ranked")
    static = written(_taken_slots(taken), "taken")
    slots = written(static.unionByName(_settled_claims(ranked, static, order)).distinct(), "slots")
    # the k-th file takes the k-th free number: k plus the taken numbers that
    # have fewer than k free ones below them
    slots = group_rank(slots, _LINE, ["_o"], "_j")
    marks = slots.select(*_LINE, (F.col("_o") - F.col("_j")).alias("_k"), F.lit(1).alias("_mark"))
    mixed = ranked.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    mixed = block_scan(mixed, _LINE, "_k", {"_taken": ("sum", F.col("_mark"))}, order=("_mark",))
    number = F.col("_k") + F.col("_taken")
    name = F.when(number == 1, F.concat("slug", "ext")).otherwise(
        F.concat("slug", F.lit("_"), number.cast("string"), "ext")
    )
    return mixed.where(F.col("_mark") == 0).withColumn("new_name", name).drop("_k", "_mark", "_taken")


def _taken_slots(taken: DataFrame) -> DataFrame:
    """(line, _o): the slots that names in use take, each in its own line and,
    if numbered, in that of the name before the number."""
    stem, ext = (F.regexp_extract("new_name", r"^(.*)(\.[^.]*)$", i) for i in (1, 2))
    used = taken.select("folder", stem.alias("stem"), ext.alias("ext"))
    plain = used.select("folder", F.col("stem").alias("slug"), "ext", F.lit(1).cast("long").alias("_o"))
    tail = F.regexp_extract("stem", _NUMBERED, 2)
    numbered = used.where(tail != "").select(
        "folder", F.regexp_extract("stem", _NUMBERED, 1).alias("slug"), "ext", tail.try_cast("long").alias("_o")
    )
    return plain.unionByName(numbered.where("_o is not null")).distinct()


def _settled_claims(ranked: DataFrame, static: DataFrame, order: str) -> DataFrame:
    """(line, _o): the slots that first files of other slugs claim, and the
    first slots that such slugs lose."""
    lines = written(ranked.groupBy(*_LINE).agg(F.min(order).alias("_first")), "lines")
    tail = F.regexp_extract("slug", _NUMBERED, 2)
    claims = lines.where(tail != "").select(
        "folder", F.regexp_extract("slug", _NUMBERED, 1).alias("_of"), "ext", tail.try_cast("long").alias("_o"), "slug", "_first"
    )
    # a claim matters where the other line has files, and a slot that is taken anyway needs none
    claims = claims.join(lines.select("folder", F.col("slug").alias("_of"), "ext"), ["folder", "_of", "ext"], "left_semi")
    parents = static.withColumnRenamed("slug", "_of")
    claims = claims.join(parents, ["folder", "_of", "ext", "_o"], "left_anti")
    # taken slots below each claimed one
    parent = ["folder", "_of", "ext"]
    both = claims.withColumn("_mark", F.lit(0)).unionByName(parents.withColumn("_mark", F.lit(1)), allowMissingColumns=True)
    below = F.sum("_mark").over(W.partitionBy(*parent).orderBy("_o", "_mark").rowsBetween(W.unboundedPreceding, -1))
    claims = both.withColumn("_below", F.coalesce(below, F.lit(0))).where("_mark = 0").drop("_mark")
    state = written(claims.withColumn("_holds", F.lit(True)), "claims")
    while not state.isEmpty():
        lost = state.where("not _holds").select("folder", F.col("slug").alias("_of"), "ext", F.lit(1).alias("_lost"))
        before = F.sum(F.col("_holds").cast("int")).over(W.partitionBy(*parent).orderBy("_o").rowsBetween(W.unboundedPreceding, -1))
        asked = state.withColumn("_before", F.coalesce(before, F.lit(0))).join(lost, parent, "left")
        asked = asked.withColumn("_nth", F.col("_o") - F.col("_below") - F.col("_before") - F.coalesce("_lost", F.lit(0)))
        rival = ranked.select("folder", F.col("slug").alias("_of"), "ext", F.col("_k").cast("long").alias("_nth"), F.col(order).alias("_rival"))
        judged = asked.join(rival, [*parent, "_nth"], "left").withColumn("_now", F.col("_rival").isNull() | (F.col("_first") < F.col("_rival")))
        judged = written(judged.select(*parent, "_o", "slug", "_first", "_below", "_holds", "_now"), "claims")
        changed = judged.where("_holds <> _now").limit(1).count()
        state = judged.drop("_holds").withColumnRenamed("_now", "_holds")
        if not changed:
            break
    held = state.where("_holds").select("folder", F.col("_of").alias("slug"), "ext", "_o")
    return held.unionByName(state.where("not _holds").select("folder", "slug", "ext", F.lit(1).cast("long").alias("_o")))


def components(pairs: DataFrame, a: str = "id_a", b: str = "id_b", max_rounds: int = 60) -> DataFrame:
    """Connected components of a pair list: (id, cluster), the cluster named by
    its smallest id.

    Alternating large-star and small-star steps; a round only moves edges
    towards smaller ids, so a hub with very many edges costs one partial
    minimum and a salted join, and the number of rounds is logarithmic.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = written(edges, "edges")
    seen = None
    for _ in range(max_rounds):
        edges = written(_small_star(_large_star(edges)), "edges")
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.greatest("u", "v").alias("id"), F.least("u", "v").alias("cluster"))
    return leaves.unionByName(leaves.select(F.col("cluster").alias("id"), "cluster")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = salted_join(both.where(F.col("v") > F.col("u")), low, ["u"], spread=["v"])
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(down, low, ["u"], spread=["v"])
    joined = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select("u", F.col("m").alias("v"))
    )
    return joined.where(F.col("u") != F.col("v")).distinct()


def removal_plan(clusters: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file to remove: keep the largest file of a cluster (first
    name on ties), ignore files that are gone, skip clusters with one left.

    ``clusters``: name, cluster; ``files``: name, size.
    """
    present = clusters.join(files.select("name", "size"), "name")
    keeper = present.groupBy("cluster").agg(
        F.min_by(F.struct("name", "size"), F.struct(-F.col("size"), F.col("name"))).alias("_keep"),
        F.count("*").alias("_n"),
    )
    keeper = keeper.where(F.col("_n") > 1)
    rows = salted_join(present, keeper, ["cluster"], spread=["name"])
    return rows.where(F.col("name") != F.col("_keep.name")).select(
        "cluster", F.col("_keep.name").alias("keep"), F.col("_keep.size").alias("keep_size"),
        F.col("name").alias("remove"), F.col("size").alias("remove_size"),
    )


def apply_removals(index: DataFrame, files: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index without the removed entries, quarantined files)."""
    gone = plan.select(F.col("remove").alias("name")).distinct()
    present = gone.join(files.select("name"), "name", "left_semi")
    return index.join(present, "name", "left_anti"), files.join(present, "name", "left_semi")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (id_a, id_b, score) with caption_a and caption_b; pairs with an unknown id are left out.

    ``texts``: id, text, ids unique.  Pairs are dealt over a grid by their two
    ids and stream past the texts of their cell, so a text travels once for a
    cell that has a pair of it, not once for each pair, and no row with a text
    in it is shuffled again.
    """
    kind = dict(pairs.dtypes)["id_a"]
    pairs = written(pairs.select("id_a", "id_b", "score"), "pairs")
    ids = pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id"))).distinct()
    used = written(texts.select("id", "text").join(ids, "id", "left_semi"), "texts")
    side = max(LEAST_CELLS, math.ceil((used.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / CELL_BYTES))
    chunks = max(1, math.ceil(pairs.count() / (side * side * CELL_PAIRS)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    cell = (place("id_a") * side + place("id_b")) * chunks + F.pmod(F.xxhash64("id_a", "id_b"), F.lit(chunks))
    dealt = pairs.withColumn("cell", cell.cast("int"))
    needed = dealt.select("cell", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    held = needed.join(used, "id")
    # the texts of a cell come before its pairs
    both = held.unionByName(dealt, allowMissingColumns=True).repartition(4 * side * side * chunks, "cell")
    both = both.sortWithinPartitions("cell", F.col("id_a").asc_nulls_first())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, known = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            cells = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])).tolist()
            for first, last in zip(edges, [*edges[1:], len(batch)], strict=True):
                if cells[first] != here:
                    here, held, known = cells[first], [], None
                part = batch.slice(first, last - first)
                n = part.column("id_a").null_count
                if n:
                    held.append(part.slice(0, n).select(["id", "text"]))
                if n == len(part) or not held:
                    continue
                if known is None:
                    known = pa.Table.from_batches(held).combine_chunks()
                for start in range(n, len(part), TEXT_PAIRS):
                    rows = part.slice(start, min(TEXT_PAIRS, len(part) - start))
                    at = [pa.compute.index_in(rows.column(c), value_set=known.column("id").combine_chunks()) for c in ("id_a", "id_b")]
                    there = pa.compute.and_(*[pa.compute.is_valid(x) for x in at])
                    taken = [known.column("text").take(x.filter(there)).combine_chunks() for x in at]
                    columns = [rows.column(c).filter(there) for c in ("id_a", "id_b", "score")]
                    yield pa.RecordBatch.from_arrays([*columns, *taken], names=["id_a", "id_b", "score", "caption_a", "caption_b"])

    return both.mapInArrow(fill, f"id_a {kind}, id_b {kind}, score double, caption_a string, caption_b string")
