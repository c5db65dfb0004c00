"""Helpers that keep hot keys and long groups from landing in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16
BLOCK = 10_000
HOT_ROWS = 20_000


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join for a left side whose keys may be hot.

    Each left row gets one of ``salts`` salts; each right row is copied once
    per salt, so one hot key spreads over ``salts`` tasks.  Only joins that
    never emit unmatched right rows are allowed (the copies would be emitted
    several times otherwise).  ``spread`` names the left columns the salt is
    hashed from, so that the salt is the same when a lost task is run again.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot run a {how} join")
    spread = list(spread or [c for c, t in left.dtypes if not t.startswith("map")])
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def hot_join(left: DataFrame, right: DataFrame, on: str, counts: DataFrame, spread: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join of a skewed left side with a wide right side that has each key
    once: only rows of hot keys are copied, one copy for every ``rows`` left
    rows.

    ``counts``: the key and about how many left rows have it (``n``).
    """
    # at most one row for every ``rows`` rows of the left side
    hot = F.broadcast(counts.where(F.col("n") > rows).select(on, F.ceil(F.col("n") / rows).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    salted = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    copies = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(copies, [on, "_salt"]).drop("_salt")


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning for a costly Python group step.

    Python work is heavy for its bytes, so its partitions must not be merged
    by size the way adaptive execution does; a named count keeps them apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *[F.col(k) for k in keys])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.  The rank filter lets Spark cut every
    map task down to ``k`` rows per group before the shuffle."""
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def block_scan(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    running: Mapping[str, tuple[str, Column]] | None = None,
    previous: Mapping[str, Column] | None = None,
    order: Sequence[str] = (),
    longest: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Running aggregates over an ordered group of any length.

    A plain window would put a whole group into one task.  It is used only
    when the highest position (``longest``; counted here when not given) shows
    that every group fits into one block.  Otherwise groups are cut into
    blocks of consecutive integer positions; the window runs inside a block,
    and a second small window over one row per block carries the total of all
    earlier blocks in.  The join that brings the carry back is on
    (group, block), so a long group stays spread.

    ``running``: output -> (op, expr) with op in sum/max/min/count; the value
    covers all rows *before* the current one (null, or 0 for sum and count,
    on the first row).
    ``previous``: output -> expr of the row just before (null on the first).
    ``order`` breaks ties between rows of equal position.
    """
    running = dict(running or {})
    previous = dict(previous or {})
    ops = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    keys = [position, *order]
    if longest is None:
        longest = df.agg(F.max(position)).first()[0] or 0
    if longest < block:
        plain = W.partitionBy(*group).orderBy(*keys)
        before = plain.rowsBetween(W.unboundedPreceding, -1)
        out = df
        for name, (op, expr) in running.items():
            value = ops[op](expr).over(before)
            out = out.withColumn(name, F.coalesce(value, F.lit(0)) if op in ("sum", "count") else value)
        for name, expr in previous.items():
            out = out.withColumn(name, F.lag(expr).over(plain))
        return out

    from mediaspark.plans.materialise import written

    staged = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)).cast("long"))
    for name, (_, expr) in running.items():
        staged = staged.withColumn(f"_v_{name}", expr)
    for name, expr in previous.items():
        staged = staged.withColumn(f"_p_{name}", F.struct(expr.alias("v")))
    staged = written(staged, "scan")
    inside = W.partitionBy(*group, "_block").orderBy(*keys)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    local, totals = staged, []
    for name, (op, _) in running.items():
        local = local.withColumn(f"_l_{name}", ops[op](f"_v_{name}").over(before))
        totals.append(ops[op](f"_v_{name}").alias(f"_t_{name}"))
    for name in previous:
        local = local.withColumn(f"_l_{name}", F.lag(f"_p_{name}").over(inside))
        totals.append(F.max_by(f"_p_{name}", F.struct(*keys)).alias(f"_t_{name}"))
    carry = staged.groupBy(*group, "_block").agg(*totals)
    across = W.partitionBy(*group).orderBy("_block")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    for name, (op, _) in running.items():
        fold = F.sum if op == "count" else ops[op]
        carry = carry.withColumn(f"_c_{name}", fold(f"_t_{name}").over(earlier))
    for name in previous:
        carry = carry.withColumn(f"_c_{name}", F.lag(f"_t_{name}").over(across))
    carry = carry.select(*group, "_block", *[f"_c_{n}" for n in [*running, *previous]])
    out = local.join(carry, [*group, "_block"], "left")
    for name, (op, _) in running.items():
        inner, outer = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if op in ("sum", "count"):
            out = out.withColumn(name, F.coalesce(inner, F.lit(0)) + F.coalesce(outer, F.lit(0)))
        elif op == "max":
            out = out.withColumn(name, F.greatest(inner, outer))
        else:
            out = out.withColumn(name, F.least(inner, outer))
    for name in previous:
        out = out.withColumn(name, F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))["v"])
    return out.select(*df.columns, *running, *previous)


def group_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str = "rank") -> DataFrame:
    """1-based rank inside a group of any size.

    Rows are range-partitioned by (group, order), so a large group spans
    several sorted partitions; a row's rank is its place in its partition plus
    the group's rows in earlier partitions.  The partitioned rows are written
    once, as the partition numbers must be the same for both uses.
    """
    from mediaspark.plans.materialise import written

    parts = df.repartitionByRange(*[F.col(c) for c in [*group, *order]])
    parts = written(parts.withColumn("_part", F.spark_partition_id()), "ranges")
    inside = parts.withColumn(
        "_place", F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))
    )
    sizes = parts.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    # one row per group and range partition
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    ranked = inside.join(offsets, [*group, "_part"])
    return ranked.withColumn(rank, (F.col("_place") + F.col("_offset")).cast("long")).drop("_place", "_offset", "_part")
