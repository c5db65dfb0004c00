"""Assets for the beats of a project, first come first served under a reuse cap.

What a candidate is worth by itself is a *verdict* column, found once.  What a
beat may take depends on earlier beats of its project in three ways only: an
asset is closed to it once ``cap`` earlier fetches took it, the media mix leans
its order, and the download budget may be used up.  These are a conflict table
(project, asset, beats of the first fetches) and two running sums.

All beats of all projects are decided side by side from the conflicts of the
last round.  A project whose outcomes did not change is settled and leaves the
rounds.  As the first beat has no conflicts, and a beat is right once all
before it are, every round settles at least one more beat of a project, and
the outcome at rest is that of taking the beats in turn.  The budget needs no
rounds: beats act as if there were none until it is used up, and nothing comes
after, so a running sum over the settled outcomes finds the beats it ends.  A
decision is one column expression over the beat's own list of candidates (sources x phrases x
page size at most); no project is ever gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.operators.candidates import CLIP_KEY
from mediaspark.plans.materialise import written
from mediaspark.plans.skew import block_scan, top_per_group

# Codes of an outcome.
REAL, GENERATED, EMPTY, COVERED, THIN = "real", "ai_generated", "placeholder", "covered", "thin"
# Codes of why a beat stays without a candidate, and of why a candidate is refused.
BUDGET, NOTHING, ALL_REFUSED = "budget_spent", "no_candidate", "all_refused"
ACCEPTED, NO_FILE, TOO_SMALL, NO_FIT, NO_MATCH = "accepted", "fetch_failed", "too_small", "not_16_9", "not_verified"

OUTPUT = (
    "outcome", "source", "source_id", "media_type", "score", "fill_source", "fill_source_id", "reason", "last_refusal",
    "generation_attempted", "generation_failed", "n_candidates", "tried", "downloads", "fetched", "alternates",
)


@dataclass(frozen=True)
class Rules:
    min_score: float = C.MIN_SCORE
    high_score: float = C.HIGH_QUALITY_SCORE
    generation_score: float = C.GENERATION_TRIGGER
    verify_floor: float = C.VERIFICATION_FLOOR
    cap: int = C.REUSE_CAP
    allow_duplicates: bool = False
    generation: bool = True
    semantic_tier: bool = True
    limit: int | None = None
    simulate: bool = False


def beat_rows(beats: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per beat with its candidates in order of arrival.

    ``rows`` are usable scored candidates with the outcome of fetching each:
    fetch_ok, verify_score, file_width, file_height, file_seconds, and where
    known fit_ok (whether a file of another shape could be brought to 16:9).
    A beat has at most sources x phrases x page size of them.  ``beats`` has
    target_seconds and generation_ok.
    """
    if "fit_ok" not in rows.columns:
        rows = rows.withColumn("fit_ok", F.lit(True))
    item = F.struct(
        "provider_rank", "tier", "phrase_no", "pos", "source", "source_id", "media_type", "score", "fetch_ok",
        "verify_score", "file_width", "file_height", "file_seconds", "fit_ok",
    )
    lists = rows.groupBy(*CLIP_KEY).agg(F.sort_array(F.collect_list(item)).alias("candidates"))
    return beats.select(*CLIP_KEY, "target_seconds", "generation_ok").join(lists, list(CLIP_KEY), "left")


def verdict(fetch_ok: Column, width: Column, height: Column, fit_ok: Column, verify_score: Column, floor: float) -> Column:
    """Why a candidate is refused, or ``accepted``.  A file of exactly the
    frame's shape is only scaled; any other must be large enough to be cropped
    or padded, and that must succeed."""
    known = (width > 0) & (height > 0)
    exact = known & (F.abs(width / F.when(height > 0, height) - 16 / 9) < C.EXACT_RATIO_TOLERANCE)
    return (
        F.when(~F.coalesce(fetch_ok, F.lit(False)), NO_FILE)
        .when(F.coalesce(exact, F.lit(False)) & (F.coalesce(verify_score, F.lit(floor)) >= floor), ACCEPTED)
        .when(F.coalesce(exact, F.lit(False)), NO_MATCH)
        .when(~F.coalesce(known & (F.least(width, height) >= C.MIN_DIMENSION), F.lit(False)), TOO_SMALL)
        .when(~F.coalesce(fit_ok, F.lit(True)), NO_FIT)
        .when(verify_score < floor, NO_MATCH)
        .otherwise(ACCEPTED)
    )


def _judged(beats: DataFrame, rules: Rules) -> DataFrame:
    """Candidates reduced to what the rounds read, with asset and verdict."""
    fields = beats.schema["candidates"].dataType.elementType.fieldNames()

    def slim(c: Column, i: Column) -> Column:
        fit = c["fit_ok"] if "fit_ok" in fields else F.lit(True)
        return F.struct(
            i.alias("at"), c["provider_rank"].alias("rank"), c["tier"].alias("tier"), c["phrase_no"].alias("phrase_no"),
            c["source"].alias("source"), c["source_id"].alias("source_id"),
            F.concat(c["source"], F.lit(":"), c["source_id"]).alias("asset"), c["media_type"].alias("media_type"),
            c["score"].alias("score"), c["file_seconds"].alias("seconds"),
            verdict(c["fetch_ok"], c["file_width"], c["file_height"], fit, c["verify_score"], rules.verify_floor).alias("verdict"),
        )

    return beats.select(
        *CLIP_KEY, F.coalesce("target_seconds", F.lit(0.0)).alias("need"),
        F.coalesce("generation_ok", F.lit(False)).alias("can_generate"), F.transform("candidates", slim).alias("candidates"),
    )


def _visible(free: str, rules: Rules) -> tuple[Column, Column, Column]:
    """Sources that found enough in their first two tiers, and the phrases of
    the third tier in order, as small lists."""
    def enough(tier: int) -> Column:
        hits = F.filter(free, lambda c: (c["tier"] == tier) & (c["score"] >= rules.min_score))
        return F.array_distinct(F.transform(hits, lambda c: c["rank"]))

    third = F.filter(free, lambda c: c["tier"] == 3)
    phrases = F.array_distinct(F.transform(third, lambda c: F.struct(c["rank"].alias("rank"), c["phrase_no"].alias("phrase_no"))))
    return enough(1), enough(2), phrases


def _decided(state: DataFrame, rules: Rules) -> DataFrame:
    """Outcome of every beat under its state: ``taken`` (asset -> earlier
    fetches), ``images``, ``videos`` and ``spent``."""
    taken = lambda asset: F.coalesce(F.col("taken")[asset], F.lit(0))
    none = F.lit(None)
    step = state.withColumn("images", F.coalesce("images", F.lit(0))).withColumn("videos", F.coalesce("videos", F.lit(0)))
    budget = F.lit(rules.limit).cast("long") - F.coalesce("spent", F.lit(0))
    step = step.withColumn("budget", budget)
    # candidates that a search shows: still open, of the tiers that the source had to try ...
    listed = F.coalesce("candidates", F.array().cast(step.schema["candidates"].dataType))
    open_now = listed if rules.allow_duplicates else F.filter(listed, lambda c: taken(c["asset"]) < rules.cap)
    step = step.withColumn("free", open_now)
    first, second, phrases = _visible("free", rules)
    step = step.withColumns({"found1": first, "found2": second, "phrases": phrases})

    def searched(c: Column) -> Column:
        low1, low2 = ~F.array_contains("found1", c["rank"]), ~F.array_contains("found2", c["rank"])
        earlier = F.exists("phrases", lambda p: (p["rank"] == c["rank"]) & (p["phrase_no"] < c["phrase_no"]))
        third = (c["tier"] == 3) & low1 & low2 & ~earlier if rules.semantic_tier else F.lit(False)
        return (c["tier"] == 1) | ((c["tier"] == 2) & low1) | third

    step = step.withColumn("pool", F.filter("free", searched))
    # ... and of sources up to the first that ends the search
    ends = F.filter("pool", lambda c: (c["score"] >= rules.high_score) | (
        (c["source"] == C.LIBRARY_SOURCE) & (c["score"] >= rules.generation_score)))
    step = step.withColumn("last_rank", F.array_min(F.transform(ends, lambda c: c["rank"])))
    shown = F.col("images") + F.col("videos")
    lean = (F.lit(C.TARGET_IMAGE_RATIO) - F.col("images") / F.when(shown > 0, shown)) * C.MEDIA_BIAS_SLOPE
    lean = F.when(shown > 0, F.greatest(F.lit(-C.MEDIA_BIAS_CAP), F.least(F.lit(C.MEDIA_BIAS_CAP), lean))).otherwise(0.0)
    step = step.withColumn("lean", F.lit(0.0) if rules.simulate else lean)

    def order(c: Column) -> Column:
        image = c["media_type"] == "image"
        value = c["score"] + F.when(image, F.col("lean")).otherwise(-F.col("lean"))
        return F.struct((-value).alias("value"), image.alias("image"), c["at"].alias("at"), c.alias("c"))

    good = F.filter("pool", lambda c: (c["score"] >= rules.min_score) & (
        F.col("last_rank").isNull() | (c["rank"] <= F.col("last_rank"))))
    step = step.withColumn("ordered", F.array_sort(F.transform(good, order)))
    step = step.withColumn("ranked", F.transform("ordered", lambda o, i: o["c"].withField("at", i + 1)))
    step = step.withColumn("n", F.size("ranked")).withColumn("best", F.get("ranked", F.lit(0)))
    step = step.withColumn("best_assets", F.transform(F.slice("ranked", 1, C.MAX_ALTERNATES), lambda c: c["asset"]))
    if rules.simulate:
        top = F.filter(F.array(F.col("best")["asset"]), lambda a: a.isNotNull())
        blank = {name: none.cast("string") for name in (
            "source", "source_id", "media_type", "fill_source", "fill_source_id", "reason", "last_refusal")}
        out = {**blank, "outcome": F.when(F.col("n") > 0, COVERED).otherwise(THIN), "score": F.col("best")["score"],
               "generation_attempted": F.lit(False), "generation_failed": F.lit(False), "n_candidates": F.col("n"),
               "tried": F.lit(0), "downloads": F.lit(0), "fetched": top, "alternates": F.col("best_assets")}
        return step.select(*CLIP_KEY, *[out[name].alias(name) for name in OUTPUT])

    # how far down the list the beat gets
    step = step.withColumn("files", F.filter("ranked", lambda c: c["verdict"] != NO_FILE))
    step = step.withColumn("pick", F.get(F.filter("ranked", lambda c: c["verdict"] == ACCEPTED), F.lit(0)))
    step = step.withColumn("shut", F.coalesce(F.col("budget") <= 0, F.lit(False)))
    last_paid = F.get("files", (F.greatest("budget", F.lit(1)) - 1).cast("int"))["at"]
    step = step.withColumn("reach", F.when(F.col("budget").isNotNull(), last_paid))
    cut = ~F.col("shut") & F.coalesce(F.col("reach") < F.coalesce(F.col("pick")["at"], F.col("n")), F.lit(False))
    weak = lambda c: c.isNull() | (c["score"] < rules.generation_score)
    step = step.withColumn("cut", cut).withColumn("early", ~F.col("shut") & weak(F.col("best")) & F.lit(rules.generation))
    step = step.withColumn("ahead", F.col("early") & F.col("can_generate"))
    step = step.withColumn("cut", F.col("cut") & ~F.col("ahead"))
    walked = ~F.col("shut") & ~F.col("ahead")
    step = step.withColumn(
        "late", walked & ~F.col("early") & ~F.col("cut") & weak(F.col("pick")) & F.lit(rules.generation))
    step = step.withColumn("made", F.col("ahead") | (F.col("late") & F.col("can_generate")))
    step = step.withColumn("real", walked & ~F.col("cut") & ~F.col("made") & F.col("pick").isNotNull())
    step = step.withColumn(
        "tried", F.when(~walked, 0).when(F.col("cut"), F.col("reach")).otherwise(F.coalesce(F.col("pick")["at"], F.col("n"))))
    step = step.withColumn(
        "own", F.transform(F.filter("files", lambda c: c["at"] <= F.col("tried")), lambda c: c["asset"]))

    # a second asset for a video too short to be stretched over its slot
    pick, eps = F.col("pick"), C.DURATION_EPSILON
    speed = pick["seconds"] / F.when(F.col("need") > eps, F.col("need"))
    short = (
        F.col("real") & (pick["media_type"] == "video") & (pick["seconds"] > eps) & (F.col("need") > eps)
        & (pick["seconds"] < F.col("need") - eps) & ~speed.between(C.SPEED_MIN, C.SPEED_MAX)
    )
    rest = F.filter("files", lambda c: (c["at"] > pick["at"]) & (c["asset"] != pick["asset"]) & (
        taken(c["asset"]) + F.size(F.filter("own", lambda a: a == c["asset"])) < rules.cap))
    step = step.withColumn("rest", F.when(F.coalesce(short, F.lit(False)), rest))
    suits = F.transform("rest", lambda c: c["verdict"].isin(ACCEPTED, NO_MATCH))
    step = step.withColumn("fill_at", F.array_position(suits, True))
    asked = F.when(F.col("rest").isNull(), 0).when(F.col("fill_at") > 0, F.col("fill_at")).otherwise(F.size("rest"))
    step = step.withColumn("asked", asked.cast("int"))
    step = step.withColumn("paid", F.greatest(F.least("asked", F.col("budget") - F.size("own")), F.lit(0)).cast("int"))
    filled = (F.col("fill_at") > 0) & (F.col("paid") == F.col("asked"))
    step = step.withColumn("fill", F.when(filled, F.get("rest", (F.col("fill_at") - 1).cast("int"))))

    broke = F.col("shut") | F.col("cut")
    tried_making = (F.col("early") | F.col("late")) & ~broke
    refused = walked & ~F.col("cut") & (F.col("n") > 0) & pick.isNull()
    drawn = F.format_string("clip%03d_generated.jpg", F.col("clip_number"))
    chosen = lambda name: F.when(F.col("real"), pick[name])
    fill_asset = F.filter(F.array(F.col("fill")["asset"]), lambda a: a.isNotNull())
    out = {
        "outcome": F.when(F.col("made"), GENERATED).when(F.col("real"), REAL).otherwise(EMPTY),
        "source": F.when(F.col("made"), GENERATED).otherwise(chosen("source")),
        "source_id": F.when(F.col("made"), drawn).otherwise(chosen("source_id")),
        "media_type": F.when(F.col("made"), "image").otherwise(chosen("media_type")),
        "score": chosen("score"),
        "fill_source": F.col("fill")["source"],
        "fill_source_id": F.col("fill")["source_id"],
        "reason": F.when(broke, BUDGET).when(refused, ALL_REFUSED).when(walked & (F.col("n") == 0), NOTHING),
        "last_refusal": F.when(refused, F.get("ranked", F.col("n") - 1)["verdict"]),
        "generation_attempted": tried_making,
        "generation_failed": tried_making & ~F.col("can_generate"),
        "n_candidates": F.when(F.col("shut"), 0).otherwise(F.col("n")),
        "tried": F.col("tried"),
        "downloads": F.size("own") + F.col("paid"),
        "fetched": F.concat("own", fill_asset),
        "alternates": F.when(F.col("shut"), F.array().cast("array<string>")).otherwise(F.col("best_assets")),
    }
    return step.select(*CLIP_KEY, *[out[name].alias(name) for name in OUTPUT])


def _states(beats: DataFrame, keys: DataFrame, outcomes: DataFrame, rules: Rules, longest: int) -> DataFrame:
    """What the outcomes of a round leave for every later beat."""
    fetches = outcomes.select(*CLIP_KEY, F.posexplode("fetched").alias("place", "asset"))
    # only the first ``cap`` fetches of an asset matter to anyone
    first = top_per_group(fetches, ["project_id", "asset"], [F.col("clip_number"), F.col("place")], rules.cap)
    conflicts = first.groupBy("project_id", "asset").agg(F.collect_list("clip_number").alias("by"))
    earlier = F.size(F.filter("by", lambda clip: clip < F.col("clip_number")))
    taken = keys.join(conflicts, ["project_id", "asset"]).select(*CLIP_KEY, "asset", earlier.alias("uses"))
    taken = taken.where(F.col("uses") > 0).groupBy(*CLIP_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("asset", "uses"))).alias("taken"))
    shown = lambda kind: ((F.col("outcome") == REAL) & (F.col("media_type") == kind)).cast("int")
    sums = block_scan(
        outcomes.select(*CLIP_KEY, "outcome", "media_type", "downloads"), ["project_id"], "clip_number",
        {"images": ("sum", F.coalesce(shown("image"), F.lit(0))), "videos": ("sum", F.coalesce(shown("video"), F.lit(0))),
         "spent": ("sum", F.col("downloads"))},
        longest=longest,
    ).select(*CLIP_KEY, "images", "videos", "spent")
    return beats.join(sums, list(CLIP_KEY)).join(taken, list(CLIP_KEY), "left")


def assign(beats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Outcome of every beat; ``beats`` comes from ``beat_rows`` and holds a
    beat once."""
    beats = written(_judged(beats, rules), "beats")
    longest = beats.agg(F.max("clip_number")).first()[0] or 0
    keys = beats.select(*CLIP_KEY, F.explode("candidates").alias("c")).select(*CLIP_KEY, F.col("c.asset").alias("asset"))
    keys = written(keys.where(F.col("asset").isNotNull()).distinct(), "keys")
    nothing = F.lit(0).cast("long")
    state = beats.select("*", nothing.alias("images"), nothing.alias("videos"), nothing.alias("spent"),
                         F.lit(None).cast("map<string,int>").alias("taken"))
    told = F.xxhash64(*CLIP_KEY, "outcome", "source", "source_id", "media_type", F.array_join("fetched", "\n"), "downloads")
    mark = F.sum(told.cast("decimal(38,0)")).alias("mark")
    free = replace(rules, limit=None)
    settled, last = [], None
    while True:
        outcomes = written(_decided(state, free), "outcomes")
        marks = outcomes.groupBy("project_id").agg(mark)
        if last is not None:
            before = last.select("project_id", F.col("mark").alias("before"))
            marks = marks.join(before, "project_id").withColumn("same", F.col("mark") == F.col("before")).drop("before")
        else:
            marks = marks.withColumn("same", F.lit(False))
        last = written(marks, "marks")
        going = last.where(~F.col("same")).select("project_id")
        settled.append(outcomes.join(last.where("same").select("project_id"), "project_id", "left_semi"))
        if going.isEmpty():
            break
        live = outcomes.join(going, "project_id", "left_semi")
        state = _states(beats, keys, live, rules, longest)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    if rules.limit is None:
        return out
    return _decided(_states(beats, keys, written(out, "settled"), rules, longest), rules)


def availability(beats: DataFrame) -> DataFrame:
    """Dry run before any download: only the top pick of a beat counts as used."""
    out = assign(beats, Rules(simulate=True, semantic_tier=False, generation=False))
    return out.select(
        *CLIP_KEY, F.col("n_candidates").alias("candidate_count"), F.col("score").alias("top_score"),
        (F.col("n_candidates") < C.THIN_CANDIDATES).alias("thin"),
    )
