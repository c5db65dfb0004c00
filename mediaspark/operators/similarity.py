"""Exact vector joins: near-duplicate pairs and nearest neighbours.

Both rest on balls: a centre and the largest distance from it bound what any
member can reach, so whole groups of vectors are passed over unread.  Only rows
that count leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.plans.materialise import written
from mediaspark.plans.skew import top_per_group

#: Rows of a block at most; a task compares two blocks.  Blocks that smaller inputs are cut into, of so many rows at least.
BLOCK_ROWS, LEAST_BLOCKS, SMALL_BLOCK = 65_536, 8, 2048
#: Rows a leaf, the ball inside a block, is meant to hold, and leaves of a block at most.
LEAF_ROWS, MAX_LEAVES = 256, 1024
#: Pivots; they and one row for each are all that the driver sees.
MAX_PIVOTS = 1024
#: Rows of the other block that a leaf is multiplied with at once.
TILE_ROWS = 4096
#: Room for rounding in angles and scores.
SLACK = 1e-6
#: Bytes of the query vectors sent to the tasks at once.
QUERY_BYTES = 32 << 20
#: Items the first guess of every query's k-th best score is taken from.
SEED_ITEMS = 2048
#: Items of one ball inside a batch.
BALL_ROWS = 128
#: Queries multiplied with one ball at once.
QUERY_ROWS = 4096
#: Vectors of one side of a cell, the least number of cells a side, and pairs of a cell, when named pairs are multiplied.
CELL_VECTORS, LEAST_CELLS, CELL_PAIRS = 65_536, 6, 1_000_000
#: Pairs multiplied at once.
PAIR_ROWS = 65_536
#: Bytes of vectors that are sent to the tasks whole, and pairs multiplied at once there.
HELD_BYTES, HELD_ROWS = 64 << 20, 2_048


def _matrix(values: pd.Series) -> np.ndarray:
    return np.vstack(values.to_numpy()).astype(float) if len(values) else np.empty((0, 0))


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1.0, 1.0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _vectors(lists: pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks()
    size = pa.compute.min_max(lists.value_lengths()).as_py()
    if size["min"] != size["max"]:
        raise ValueError("vectors of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _cut_blocks(cells: list, size: int) -> dict[int, tuple[int, int]]:
    """cell -> (first block, blocks): neighbouring cells share a block of ``size`` rows, a cell with more has its own."""
    out, block, room = {}, -1, 0
    for cell, rows in cells:
        if rows > size:
            parts = math.ceil(rows / size)
            out[cell], block, room = (block + 1, parts), block + parts, 0
            continue
        if rows > room:
            block, room = block + 1, size
        out[cell], room = (block, 1), room - rows
    return out


class _Leaves:
    """The rows of one block, sorted by leaves: balls around some of its rows."""

    def __init__(self, rows: pa.Table, leaf_rows: int) -> None:
        x = _vectors(rows.column("vector"))
        unit = _unit(x)
        centres = unit[:: max(leaf_rows, math.ceil(len(x) / MAX_LEAVES))]
        home, off = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for first in range(0, len(x), TILE_ROWS):
            angles = _angles(unit[first:first + TILE_ROWS], centres)
            home[first:first + TILE_ROWS], off[first:first + TILE_ROWS] = angles.argmin(axis=1), angles.min(axis=1)
        order = np.argsort(home, kind="stable")
        self.ids = rows.column("id").combine_chunks().take(pa.array(order)).to_numpy(zero_copy_only=False)
        self.x = x[order]
        self.short = self.x.astype(np.float32)
        self.longest = np.linalg.norm(x, axis=1).max(initial=0.0)
        self.at = np.searchsorted(home[order], np.arange(len(centres) + 1))
        self.centres, self.radius = centres, np.zeros(len(centres))
        np.maximum.at(self.radius, home, off)


def _close(left: _Leaves, right: _Leaves, threshold: float, reach: float) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks (of one if both are the same) with a product of ``threshold``, a batch for each tile.

    Tiles of leaves that could hold a pair are multiplied in single precision; what may pass is
    summed again in double precision, in the order of the dimensions.
    """
    dims = left.x.shape[1]
    limit = threshold - 1e-9 - (dims + 4) * 1.2e-7 * left.longest * right.longest
    open_ = _angles(left.centres, right.centres) <= left.radius[:, None] + right.radius + reach
    if left is right:
        open_ = np.triu(open_)
    for leaf in range(len(left.centres)):
        mine = slice(left.at[leaf], left.at[leaf + 1])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], open_[leaf], [False]]).astype(np.int8)))
        for start, end in zip(right.at[edge[::2]], right.at[edge[1::2]], strict=True):
            for first in range(start, end, TILE_ROWS):
                last = min(first + TILE_ROWS, end)
                i, j = np.nonzero(left.short[mine] @ right.short[first:last].T >= limit)
                i, j = i + mine.start, j + first
                if left is right:
                    # a leaf meets itself once
                    once = (j >= mine.stop) | (i < j)
                    i, j = i[once], j[once]
                if not len(i):
                    continue
                total = np.zeros(len(i))
                for d in range(dims):
                    total += left.x[i, d] * right.x[j, d]
                score = np.round(total, 9)
                a, b = left.ids[i], right.ids[j]
                kept = (score >= threshold) & (a != b)
                a, b, score = a[kept], b[kept], score[kept]
                low = a < b
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(low, a, b)), pa.array(np.where(low, b, a)), pa.array(score)], names=["id_a", "id_b", "score"]
                )


def near_pairs(
    items: DataFrame,
    threshold: float = C.DUPLICATE_REPORT,
    block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """All pairs of vectors with a dot product >= ``threshold`` (cosine, for unit
    vectors): id_a < id_b, score rounded to nine places.  Rows without id or
    vector are left out.

    Exact, by one plan at every threshold and size.  A vector lives in the cell
    of its nearest pivot; neighbouring cells make blocks of a bounded number of
    rows.  Two blocks meet in one task unless their cells are too far apart for
    any pair, so a vector travels once for each block it meets, not for each
    leaf; leaves are balls inside the blocks, and those too far apart are not
    multiplied.  A task holds two blocks and hands its pairs on tile by tile.
    Where no ball can be passed over (loose thresholds on vectors without
    clusters) all pairs are multiplied.
    """
    items = items.select("id", "vector").where("id is not null and vector is not null")
    id_type = dict(items.dtypes)["id"]
    schema = f"id_a {id_type}, id_b {id_type}, score double"
    n = items.count()
    if pivots is None:
        pivots = max(1, min(MAX_PIVOTS, math.ceil(math.sqrt(n / leaf_rows))))
    # a bounded number of vectors, the same on every run
    chosen = items.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    if not chosen:
        return items.sparkSession.createDataFrame([], schema)
    centres = _unit(np.array([row["vector"] for row in chosen], dtype=float))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _vectors(pa.chunked_array([batch.column("vector")]))
                angles = _angles(_unit(x), centres)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(angles.argmin(axis=1), pa.int32()), pa.array(angles.min(axis=1)), pa.array(np.linalg.norm(x, axis=1)),
                     batch.column("id"), batch.column("vector")],
                    names=["cell", "off", "long", "id", "vector"],
                )

    kind = dict(items.dtypes)["vector"]
    placed = written(items.mapInArrow(place, f"cell int, off double, long double, id {id_type}, vector {kind}"), "cells")
    # one row per pivot
    cells = placed.groupBy("cell").agg(F.max("off").alias("radius"), F.max("long").alias("long"), F.count("*").alias("n")).collect()
    longest = max(c["long"] for c in cells)
    # a pair at this angle or less has the product; below 0 any angle may
    reach = math.acos(max(-1.0, min(1.0, (threshold - 1e-9) / max(longest**2, 1e-300)))) + SLACK if threshold > 1e-9 else math.pi
    cells.sort(key=lambda c: float(centres[c["cell"]] @ centres[0]))
    cut = _cut_blocks([(c["cell"], c["n"]) for c in cells], min(block_rows, max(SMALL_BLOCK, math.ceil(n / LEAST_BLOCKS))))
    middle, radius = centres[[c["cell"] for c in cells]], np.array([c["radius"] for c in cells])
    near = _angles(middle, middle) <= radius[:, None] + radius + reach
    np.fill_diagonal(near, True)
    met = sorted({
        (min(p, q), max(p, q))
        for i, j in zip(*np.nonzero(np.triu(near)), strict=True)
        for p in range(cut[cells[i]["cell"]][0], sum(cut[cells[i]["cell"]]))
        for q in range(cut[cells[j]["cell"]][0], sum(cut[cells[j]["cell"]]))
    })
    tasks: dict[int, list] = {}
    for number, (p, q) in enumerate(met):
        # a block that meets itself is on both sides
        tasks.setdefault(p, []).append((number, 0 if p != q else 2))
        if p != q:
            tasks.setdefault(q, []).append((number, 1))
    spark = items.sparkSession
    # one row per pivot, one per block
    homes = F.broadcast(spark.createDataFrame([(c, *b) for c, b in cut.items()], "cell int, first int, parts int"))
    meets = F.broadcast(spark.createDataFrame(list(tasks.items()), "block int, meets array<struct<task:int,side:int>>"))
    dealt = placed.join(homes, "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    dealt = dealt.join(meets, "block").select(F.explode("meets").alias("m"), "id", "vector").select("m.task", "m.side", "id", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sides(held: list) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            parts = [rows.filter(pa.compute.equal(rows.column("side"), k)) for k in range(3)]
            blocks = [_Leaves(part, leaf_rows) for part in parts if len(part)]
            if len(parts[2]):
                yield from _close(blocks[0], blocks[0], threshold, reach)
            elif len(blocks) == 2:
                yield from _close(*blocks, threshold, reach)

        here, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            task = batch.column("task").to_numpy()
            edges = np.flatnonzero(np.append(True, task[1:] != task[:-1])).tolist()
            for first, last in zip(edges, [*edges[1:], len(batch)], strict=True):
                if held and task[first] != here:
                    yield from sides(held)
                here = task[first]
                held.append(batch.slice(first, last - first))
        if held:
            yield from sides(held)

    # several parts for each task, so that few share one
    parts = max(4 * len(met), spark.sparkContext.defaultParallelism)
    return dealt.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(compare, schema)


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["place", "similarity", "item_id"], ascending=[True, False, True], kind="stable")
    return found[found.groupby("place").cumcount() < k]


def _search(
    asked: np.ndarray, floor: np.ndarray, k: int, batches: Iterator[pd.DataFrame]
) -> Iterator[pd.DataFrame]:
    """The items of one task that may be among the ``k`` best of a query (by its place in ``asked``).

    Each batch is cut into balls.  A query enters them from the one it could
    score highest in, and none whose bound is below its k-th best so far.
    """
    length = np.linalg.norm(asked, axis=1)
    best = np.full((len(asked), k), -np.inf)
    kept = pd.DataFrame({"place": pd.Series(dtype="int64"), "item_id": pd.Series(dtype=object), "similarity": pd.Series(dtype=float)})
    for batch in batches:
        if batch.empty:
            continue
        x = _matrix(batch["vector"])
        ids = batch["item_id"].to_numpy()
        centres = x[:: BALL_ROWS]
        home = (2 * (x @ centres.T) - (centres**2).sum(axis=1)).argmax(axis=1)
        balls = [np.flatnonzero(home == b) for b in range(len(centres))]
        radius = np.array([np.linalg.norm(x[m] - c, axis=1).max(initial=0.0) for m, c in zip(balls, centres)])
        found = [kept]
        for first in range(0, len(asked), QUERY_ROWS):
            rows = slice(first, first + QUERY_ROWS)
            bound = asked[rows] @ centres.T + length[rows, None] * radius + SLACK
            for b in np.argsort(-bound.max(axis=0)):
                limit = np.maximum(floor[rows], best[rows, 0])
                at = np.flatnonzero(bound[:, b] >= limit)
                if not len(at) or not len(balls[b]):
                    continue
                scores = np.round(asked[rows][at] @ x[balls[b]].T, 9)
                i, j = np.nonzero(scores >= limit[at, None])
                found.append(pd.DataFrame({"place": at[i] + first, "item_id": ids[balls[b]][j], "similarity": scores[i, j]}))
                both = np.concatenate([best[rows][at], scores], axis=1)
                # ascending: the first column is the k-th best
                best[at + first] = np.sort(np.partition(both, -k, axis=1)[:, -k:], axis=1)
        kept = _best(pd.concat([f for f in found if len(f)] or [kept]), k)
    yield kept


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int = C.PER_PAGE,
    query_bytes: int = QUERY_BYTES,
    seed_items: int = SEED_ITEMS,
) -> DataFrame:
    """Exact ``k`` most similar items of every query: query_id, rank, item_id,
    similarity (dot product, which is 1 - cosine distance of unit vectors; nine
    places), lowest item id on ties.  Rows without id or vector are left out.

    ``queries``: query_id, vector; ``items``: item_id, vector.

    Items stay in the tasks that read them.  Queries are sent in blocks of at
    most about ``query_bytes``, with the k-th best score that a few items
    already give each; a task passes over what cannot beat it.  What is
    shuffled are at most ``k`` rows of a query and task.
    """
    queries = queries.select("query_id", "vector").where("query_id is not null and vector is not null")
    items = items.select("item_id", "vector").where("item_id is not null and vector is not null")
    q_type, i_type = dict(queries.dtypes)["query_id"], dict(items.dtypes)["item_id"]
    schema = f"query_id {q_type}, item_id {i_type}, similarity double"
    size = queries.agg(F.sum(F.size("vector").cast("long") * 8)).first()[0] or 0
    blocks = max(1, math.ceil(size / query_bytes))
    seeds = items.orderBy(F.xxhash64("item_id"), "item_id").limit(seed_items).select("vector").collect()
    seed = np.array([row["vector"] for row in seeds], dtype=float)

    def answer(names: list, asked: np.ndarray) -> DataFrame:
        floor = np.full(len(names), -np.inf)
        if len(seed) >= k:
            for first in range(0, len(names), QUERY_ROWS):
                rows = slice(first, first + QUERY_ROWS)
                floor[rows] = np.partition(np.round(asked[rows] @ seed.T, 9), -k, axis=1)[:, -k]
        # a product may differ in the last place from the one taken in a task
        sent = items.sparkSession.sparkContext.broadcast((names, asked, floor - SLACK))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, asked, floor = sent.value
            for kept in _search(asked, floor, k, batches):
                ids = [names[p] for p in kept["place"]]
                yield pd.DataFrame({"query_id": ids, "item_id": kept["item_id"].to_numpy(), "similarity": kept["similarity"].to_numpy()})

        return items.mapInPandas(search, schema)

    found: DataFrame | None = None
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block
        rows = queries.where(mine).collect()
        if rows:
            part = answer([r["query_id"] for r in rows], np.array([r["vector"] for r in rows], dtype=float))
            # written block by block, so that one block's queries are in use at a time
            part = written(part, "nearest") if blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.sparkSession.createDataFrame([], schema)
    return top_per_group(found, ["query_id"], [F.desc("similarity"), F.col("item_id")], k)


def _padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, zeros behind the shorter ones, and their lengths (-1 where null or with a null)."""
    size = np.array(lists.value_lengths().fill_null(0))
    values = lists.flatten()
    gaps = values.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), size.max(initial=0)))
    inside = np.arange(out.shape[1]) < size[:, None]
    out[inside] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    broken = np.zeros(out.shape, dtype=bool)
    broken[inside] = gaps
    return out, np.where(lists.is_null().to_numpy(zero_copy_only=False) | broken.any(axis=1), -1, size)


def _lookup(column: pa.Array, ids: pa.Array) -> np.ndarray:
    """Place of every value among the ids, -1 if it is none."""
    return np.array(pa.compute.index_in(column, value_set=ids).fill_null(-1))


def _held_dots(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pair_dots`` with all vectors in every task: ``HELD_BYTES`` of them at most."""
    rows = vectors.where("id is not null").select("id", F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
    ids = rows.column("id").combine_chunks() if len(rows) else pa.array([], rows.schema.field("id").type)
    x, size = _padded(rows.column("vector").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.float64())))
    small = x.astype(np.float32)
    # half the bytes where nothing is lost
    known = pairs.sparkSession.sparkContext.broadcast((ids, small if (small == x).all() else x, size))
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, size = known.value
        for batch in batches:
            at_a, at_b = (_lookup(batch.column(c), ids) for c in ("a", "b"))
            there = np.flatnonzero((at_a >= 0) & (at_b >= 0))
            a, b = at_a[there], at_b[there]
            total = np.zeros(len(there))
            for start in range(0, len(there), HELD_ROWS):
                mine = slice(start, start + HELD_ROWS)
                products = x[a[mine]].astype(np.float64) * x[b[mine]]
                for d in range(products.shape[1]):
                    total[mine] += products[:, d]
            wrong = (size[a] != size[b]) | (size[a] < 0)
            kept = batch.take(pa.array(there))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(total, mask=wrong)], names=[*columns, "dot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{fields}, dot double")


def pair_dots(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` with their dot product as ``dot``, summed in the order of the dimensions; pairs with an
    unknown id are left out, a null or vectors of different lengths give null.

    ``pairs``: a, b and what else a pair carries; ``vectors``: id, vector, ids unique.  Pairs are dealt
    over a square grid by their two ids and stream past the vectors of their cell, so that a vector
    travels to one row and one column of cells, however many pairs it is in, and a pair travels once.
    A cell with many pairs is cut.  Vectors of ``HELD_BYTES`` at most are sent to the tasks instead, and
    pairs stay where they are.
    """
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if shape["n"] * max(1, shape["width"] or 1) * 8 <= HELD_BYTES:
        return _held_dots(pairs, vectors)
    side = max(LEAST_CELLS, math.ceil(vectors.count() / CELL_VECTORS))
    chunks = max(1, math.ceil(pairs.count() / (side * side * CELL_PAIRS)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    chunk = F.pmod(F.xxhash64("a", "b", *rest), F.lit(chunks))
    every, cuts = F.sequence(F.lit(0), F.lit(side - 1)), F.sequence(F.lit(0), F.lit(chunks - 1))
    dealt = pairs.select(((place("a") * side + place("b")) * chunks + chunk).cast("int").alias("cell"), F.lit(1).alias("turn"), *pairs.columns)
    # no null lists: Arrow's writer goes over all rows of a batch for each row of them
    dealt = dealt.withColumn("vector", F.array().cast("array<double>"))
    held = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("id is not null")
    sides = F.when(F.col("left"), place("id") * side + F.col("other")).otherwise(F.col("other") * side + place("id"))
    held = held.withColumn("other", F.explode(every)).withColumn("left", F.explode(F.array(F.lit(True), F.lit(False))))
    held = held.withColumn("chunk", F.explode(cuts))
    held = held.select((sides * chunks + F.col("chunk")).cast("int").alias("cell"), F.lit(0).alias("turn"), "left", "id", "vector")
    # the vectors of a cell come before its pairs
    both = held.unionByName(dealt, allowMissingColumns=True).repartition(2 * side * side * chunks, "cell").sortWithinPartitions("cell", "turn")

    def multiply(asked: pa.RecordBatch, known: list) -> pa.RecordBatch:
        (at_a, x, size_a), (at_b, y, size_b) = [
            (np.array(pa.compute.index_in(asked.column(name), value_set=ids).fill_null(-1)), x, size)
            for name, (ids, x, size) in zip(("a", "b"), known, strict=True)
        ]
        there = np.flatnonzero((at_a >= 0) & (at_b >= 0))
        a, b = at_a[there], at_b[there]
        total = np.zeros(len(there))
        for d in range(min(x.shape[1], y.shape[1])):
            total += x[a, d] * y[b, d]
        wrong = (size_a[a] != size_b[b]) | (size_a[a] < 0) if len(there) else np.zeros(0, dtype=bool)
        kept = asked.select(pairs_columns).take(pa.array(there))
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(total, mask=wrong)], names=[*pairs_columns, "dot"])

    pairs_columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, known = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            cell, turn = (batch.column(c).to_numpy() for c in ("cell", "turn"))
            edges = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (turn[1:] != turn[:-1]))).tolist()
            for first, last in zip(edges, [*edges[1:], len(batch)], strict=True):
                if cell[first] != here:
                    here, rows, known = cell[first], [], None
                part = batch.slice(first, last - first)
                if turn[first] == 0:
                    rows.append(part.select(["left", "id", "vector"]))
                elif rows or known:
                    if known is None:
                        table = pa.Table.from_batches(rows).combine_chunks()
                        known, rows = [], []
                        for mine in (table.column("left"), pa.compute.invert(table.column("left"))):
                            some = table.filter(mine).combine_chunks()
                            lists = some.column("vector").combine_chunks() if len(some) else pa.array([], pa.list_(pa.float64()))
                            known.append((some.column("id").combine_chunks() if len(some) else pa.array([], some.schema.field("id").type), *_padded(lists)))
                    for start in range(0, len(part), PAIR_ROWS):
                        yield multiply(part.slice(start, min(PAIR_ROWS, len(part) - start)), known)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return both.mapInArrow(run, f"{fields}, dot double")
