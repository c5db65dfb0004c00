"""Checks and edits of resolved timelines; violations come out as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaspark.plans.materialise import written

from mediaspark import config as C
from mediaspark.functions.media import is_landscape


def orientation_violations(entries: DataFrame) -> DataFrame:
    """Rows with an asset that is not 16:9 landscape."""
    ratio = F.when(F.col("height") > 0, F.col("width").cast("double") / F.col("height")).otherwise(F.lit(0.0))
    bad = ~F.col("placeholder") & F.col("source").isNotNull() & ~is_landscape("width", "height")
    return entries.where(bad).withColumn("ratio", ratio)


def total_violations(
    entries: DataFrame, measured: DataFrame, tolerance: float = C.TOTAL_TOLERANCE,
    size: tuple[int, int] = (C.FRAME_WIDTH, C.FRAME_HEIGHT),
) -> DataFrame:
    """Projects whose measured file (project_id, measured_seconds, width,
    height) is off in length or size."""
    expected = entries.groupBy("project_id").agg(F.sum("duration").alias("expected_seconds"))
    both = measured.join(expected, "project_id", "left").withColumn(
        "expected_seconds", F.coalesce("expected_seconds", F.lit(0.0))
    )
    wrong_size = (F.col("width") != size[0]) | (F.col("height") != size[1])
    wrong_length = F.abs(F.col("measured_seconds") - F.col("expected_seconds")) > tolerance
    problem = F.when(wrong_size, F.lit("resolution")).when(wrong_length, F.lit("duration"))
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull())


def verification_passes(score: Column | str, floor: float = C.VERIFICATION_FLOOR, enabled: bool = True) -> Column:
    """A missing score passes; so does everything when the check is off."""
    if not enabled:
        return F.lit(True)
    score = F.col(score) if isinstance(score, str) else score
    return F.coalesce(score >= floor, F.lit(True))


def _in_turn(judged: DataFrame) -> DataFrame:
    """Settles the edits without a problem as if taken in turn."""
    row = ["project_id", "clip_number"]
    asset = ["project_id", "new_source", "new_source_id"]
    judged = written(judged, "edits")
    done = judged.where(F.col("problem").isNotNull())
    left = open_edits = judged.where(F.col("problem").isNull())
    won = left.limit(0)
    turn = F.struct("clip_number", "alternate_index")
    while not left.isEmpty():
        # two small sorts of edits; the first one left of a project is always accepted
        marked = left.withColumn("_row_first", F.min("alternate_index").over(W.partitionBy(*row)))
        marked = marked.withColumn("_asset_first", F.min(turn).over(W.partitionBy(*asset)))
        wins = (F.col("alternate_index") == F.col("_row_first")) & (turn == F.col("_asset_first"))
        marked = written(marked.withColumn("_wins", wins).drop("_row_first", "_asset_first"), "edits")
        new = marked.where("_wins").drop("_wins")
        rest = marked.where("not _wins").drop("_wins").join(new.select(*row), row, "left_anti")
        left = written(rest.join(new.select(*asset), asset, "left_anti"), "edits")
        won = won.unionByName(new)
    won = written(won, "edits")
    lost = open_edits.join(won.select(*row, "alternate_index"), [*row, "alternate_index"], "left_anti")
    lost = lost.join(won.select(*row, F.col("alternate_index").alias("_taken")), row, "left")
    lost = lost.join(won.select(*asset, F.col("clip_number").alias("_by")), asset, "left")
    edited = F.col("_taken") < F.col("alternate_index")
    lost = lost.withColumn("problem", F.when(edited, F.lit("row already edited")).otherwise(F.lit("already used")))
    lost = lost.withColumn("used_by", F.when(~F.coalesce(edited, F.lit(False)), F.col("_by"))).drop("_taken", "_by")
    return done.unionByName(won).unionByName(lost)


def swap_alternates(entries: DataFrame, alternates: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies editor swaps: (new timeline, rejected edits).

    ``edits``: project_id, clip_number, alternate_index (0-based);
    ``alternates``: project_id, clip_number, alternate_index, source,
    source_id, media_type, score.  An edit is rejected when its row or
    alternate does not exist, or when another row of the project shows that
    asset already.  An asset that an edit frees counts as used until the next
    batch.  The others are taken as one after the other by clip and alternate:
    a row is edited once and an asset taken once.  That order is kept by
    rounds that accept the edits which are the first for their row and for
    their asset, and reject what they block.
    """
    key = ["project_id", "clip_number"]
    edits = edits.dropDuplicates([*key, "alternate_index"])
    # the asset as a whole: every column that both tables have
    asset = [c for c in alternates.columns if c in entries.columns and c not in key]
    chosen = edits.join(entries.select(*key, F.lit(True).alias("_row")), key, "left").join(
        alternates.select(*key, "alternate_index", *[F.col(c).alias(f"new_{c}") for c in asset]), [*key, "alternate_index"], "left",
    )
    shown = entries.where(F.col("source").isNotNull()).select(
        "project_id", F.col("clip_number").alias("used_by"), F.col("source").alias("new_source"),
        F.col("source_id").alias("new_source_id"),
    )
    # per asset of a project only the two lowest clip numbers matter: one of
    # them is another row unless the asset is shown by this row alone
    firsts = shown.groupBy("project_id", "new_source", "new_source_id").agg(
        F.min("used_by").alias("_low"), F.max("used_by").alias("_high")
    )
    chosen = chosen.join(firsts, ["project_id", "new_source", "new_source_id"], "left")
    other = F.when(F.col("_low") != F.col("clip_number"), F.col("_low")).when(
        F.col("_high") != F.col("clip_number"), F.col("_high")
    )
    problem = (
        F.when(F.col("_row").isNull(), F.lit("clip not found"))
        .when(F.col("new_source").isNull(), F.lit("alternate out of range"))
        .when(other.isNotNull(), F.lit("already used"))
    )
    judged = chosen.withColumn("used_by", other).withColumn("problem", problem)
    judged = _in_turn(judged.drop("_row", "_low", "_high"))
    good = judged.where(F.col("problem").isNull()).select(
        *key, *[f"new_{c}" for c in asset],
        F.concat(F.lit("swapped to alternate "), F.col("alternate_index").cast("string"), F.lit(" ("),
                 "new_source", F.lit(":"), "new_source_id", F.lit(") via editor")).alias("new_note"),
    )
    merged = entries.join(good, key, "left")
    swapped = F.col("new_source").isNotNull()
    take = lambda new, old: F.when(swapped, F.col(new)).otherwise(F.col(old))
    columns = []
    for name in entries.columns:
        if name in (*asset, "note"):
            columns.append(take(f"new_{name}", name).alias(name))
        elif name == "placeholder":
            columns.append(F.when(swapped, F.lit(False)).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    rejected = judged.where(F.col("problem").isNotNull()).select(*key, "alternate_index", "problem", "used_by")
    return merged.select(*columns), rejected
