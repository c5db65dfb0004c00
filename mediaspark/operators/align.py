"""Script against transcript: audit, and spans of beats in the spoken words."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.functions.text import PUNCTUATION_AND_DASHES, normal_tokens, word_count
from mediaspark.plans.materialise import written
from mediaspark.plans.skew import BLOCK, block_scan, by_key

# Projects up to this many beats (and this many words for each) are matched in
# one group; longer ones by rounds, with the same spans.
GROUP_BEATS = 2000
WORDS_PER_BEAT = 50
SPAN = "project_id string, clip_number int, first_word int, end_word int, matched boolean"
AUDIT = (
    "ratio double, script_words int, transcript_words int, "
    "mismatches array<struct<tag:string,i1:int,i2:int,j1:int,j2:int,script:string,transcript:string>>"
)


def _audit(scripts: pd.Series, transcripts: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(scripts, transcripts):
        a, b = list(a), list(b)
        matcher = difflib.SequenceMatcher(a=a, b=b, autojunk=False)
        ratio = matcher.ratio()
        spans = []
        if ratio < C.AUDIT_WARN:
            unequal = (op for op in matcher.get_opcodes() if op[0] != "equal")
            spans = [
                {"tag": tag, "i1": i1, "i2": i2, "j1": j1, "j2": j2, "script": " ".join(a[i1:i2]),
                 "transcript": " ".join(b[j1:j2])}
                for tag, i1, i2, j1, j2 in islice(unequal, C.AUDIT_MAX_SPANS)
            ]
        rows.append((ratio, len(a), len(b), spans))
    return pd.DataFrame(rows, columns=["ratio", "script_words", "transcript_words", "mismatches"])


def script_audit(pairs: DataFrame, key: str = "project_id") -> DataFrame:
    """Similarity of script and transcript, a warning flag, and the first
    differing spans.  ``pairs``: key, script, transcript (texts)."""
    audit = F.pandas_udf(_audit, AUDIT)
    judged = pairs.select(
        key, audit(normal_tokens("script", dashes=False), normal_tokens("transcript", dashes=False)).alias("_a")
    )
    return judged.select(
        key, "_a.ratio", (F.col("_a.ratio") < C.AUDIT_WARN).alias("warn"), "_a.script_words", "_a.transcript_words",
        "_a.mismatches",
    )


def _places(wanted: Sequence[str], heard: Sequence[str]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {token: [] for token in wanted}
    for at, token in enumerate(heard):
        if token in places:
            places[token].append(at)
    return places


def _in_order(wanted: Sequence[str], places: dict[str, list[int]], n: int) -> float:
    past = met = 0
    for token in wanted:
        mine = places[token]
        nth = bisect_left(mine, past)
        if nth < len(mine) and mine[nth] < n:
            past, met = mine[nth] + 1, met + 1
    return met / len(wanted) if len(wanted) else 0.0


def in_order_shares(wanted: Sequence[str], heard: Sequence[str], lengths: Sequence[int]) -> list[float]:
    """For each length, the share of the wanted tokens that its window holds
    one after the other, each as early as it can be."""
    places = _places(wanted, heard)
    return [_in_order(wanted, places, n) for n in lengths]


def _equal_tokens(matcher: difflib.SequenceMatcher, n_a: int, n_b: int, known: dict) -> int:
    """Tokens in the matching blocks of the first side and the first ``n_b``
    tokens of the second: those that a matcher of that window would find.
    ``known`` keeps longest matches, as windows share most of them."""
    equal, queue = 0, [(0, n_a, 0, n_b)]
    while queue:
        part = queue.pop()
        found = known.get(part)
        if found is None:
            found = known[part] = matcher.find_longest_match(*part)
        i, j, k = found
        if k:
            a, a_end, b, b_end = part
            equal += k
            if a < i and b < j:
                queue.append((a, i, b, j))
            if i + k < a_end and j + k < b_end:
                queue.append((i + k, a_end, j + k, b_end))
    return equal


def _best_end(wanted: list[str], words: list[str], shortest: int, longest: int) -> int:
    """Length of the best window, 0 if none is good enough.

    What windows could reach at most comes from running counts of equal tokens
    in any order; windows are compared in that order, so most are never
    aligned.  All windows start at one place, so one matcher serves them.  Of
    equal ones the shortest wins.
    """
    if longest < shortest:
        return 0
    size, left, heard, common, bounds = len(wanted), {}, 0, 0, []
    for token in wanted:
        left[token] = left.get(token, 0) + 1
    for n in range(longest + 1):
        if n and (word := words[n - 1]):
            heard += 1
            if left.get(word, 0) > 0:
                left[word] -= 1
                common += 1
        if n >= shortest:
            likeness = 2.0 * common / (size + heard) if size + heard else 1.0
            # tokens in order are among the common ones
            bounds.append((-(0.7 * likeness + 0.3 * (common / size if size else 0.0)), n, likeness, heard))
    best, matcher = (-C.ALIGN_ACCEPT, 0), None
    for bound, n, likeness, heard in sorted(bounds):
        if bound > best[0]:
            break
        if matcher is None:
            matcher = difflib.SequenceMatcher(a=wanted, b=[w for w in words if w], autojunk=False)
            places, known = _places(wanted, words), {}
        part = _in_order(wanted, places, n)
        if -(0.7 * likeness + 0.3 * part) > best[0]:
            continue
        both = size + heard
        ratio = 2.0 * _equal_tokens(matcher, size, heard, known) / both if both else 1.0
        value = (-(0.7 * ratio + 0.3 * part), n)
        if value[0] < best[0] or (value[0] == best[0] and (best[1] == 0 or n < best[1])):
            best = value
    return best[1]


def _best_ends(wanted: pd.Series, ahead: pd.Series, shortest: pd.Series, longest: pd.Series) -> pd.Series:
    """Length of the best window of each row, 0 where none is good enough."""
    found = [_best_end(list(w), list(a), int(low), int(high)) for w, a, low, high in zip(wanted, ahead, shortest, longest)]
    return pd.Series(found, dtype="int32")


def _with_best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        found = _best_ends(rows["wanted"], rows["ahead"], rows["shortest"], rows["longest"])
        out = rows[["project_id", "clip_number", "cursor", "naive"]]
        yield out.assign(n_ahead=rows["ahead"].map(len), best=found.to_numpy())


def _anchored(beats: DataFrame, words: DataFrame, longest: int, block: int) -> DataFrame:
    """First guess of where every beat starts among the spoken words.

    A token that a project's script and transcript both have exactly once is
    an anchor of its beat; beats without one follow the last anchor by their
    number of words.
    """
    script = beats.select("project_id", "clip_number", F.posexplode("tokens").alias("pos", "token"))
    once = script.groupBy("project_id", "token").agg(
        F.count("*").alias("n"), F.min("clip_number").alias("clip_number"), F.min("pos").alias("pos"))
    heard = words.groupBy("project_id", "token").agg(F.count("*").alias("m"), F.min("word_idx").alias("word_idx"))
    anchors = once.where("n = 1").join(heard.where("m = 1 and token <> ''"), ["project_id", "token"])
    anchors = anchors.groupBy("project_id", "clip_number").agg(F.min(F.col("word_idx") - F.col("pos")).alias("anchor"))
    laid = block_scan(beats.select("project_id", "clip_number", "naive"), ["project_id"], "clip_number",
                      {"laid": ("sum", F.col("naive"))}, longest=longest, block=block)
    laid = laid.join(anchors, ["project_id", "clip_number"], "left")
    shift = F.when(F.col("anchor").isNotNull(), F.struct("clip_number", (F.col("anchor") - F.col("laid")).alias("by")))
    laid = block_scan(laid.withColumn("shift", shift), ["project_id"], "clip_number", {"earlier": ("max", F.col("shift"))},
                      longest=longest, block=block)
    by = F.coalesce(F.col("shift")["by"], F.col("earlier")["by"], F.lit(0))
    return laid.select("project_id", "clip_number", F.greatest(F.lit(0), F.col("laid") + by).cast("int").alias("cursor"))


def _matched(asked: DataFrame, words: DataFrame) -> DataFrame:
    """Spans of beats from their ``cursor``."""
    reach = F.col("naive") + (C.ALIGN_SLACK + C.ALIGN_EXTRA)
    places = asked.select(
        "project_id", "clip_number", F.explode(F.sequence(F.col("cursor"), F.col("cursor") + reach - 1)).alias("word_idx"))
    ahead = places.join(words.select("project_id", "word_idx", "token"), ["project_id", "word_idx"])
    # a group here is the reach of one beat
    ahead = ahead.groupBy("project_id", "clip_number").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "token"))), lambda w: w["token"]).alias("ahead"))
    rows = asked.join(ahead, ["project_id", "clip_number"], "left").withColumns({
        "ahead": F.coalesce("ahead", F.array().cast("array<string>")),
        "wanted": F.filter("tokens", lambda t: ~t.isin(*C.FILLER_WORDS)),
        "shortest": F.greatest(F.lit(1), F.col("naive") - C.ALIGN_SLACK),
    })
    rows = rows.withColumn("longest", F.when(F.size("tokens") > 0, F.least(F.size("ahead"), reach)).otherwise(0))
    rows = rows.select("project_id", "clip_number", "cursor", "naive", "wanted", "ahead", "shortest", "longest")
    rows = rows.mapInPandas(_with_best, "project_id string, clip_number int, cursor int, naive int, n_ahead int, best int")
    taken = F.when(F.col("best") > 0, F.col("best")).otherwise(F.least("n_ahead", "naive"))
    return rows.select(
        "project_id", "clip_number", F.col("cursor").alias("first_word"), (F.col("cursor") + taken).cast("int").alias("end_word"),
        (F.col("best") > 0).alias("matched"))


def _in_turn(beats: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """All beats of a project of bounded size, each from the end of the last."""
    heard, at, ends = words.sort_values("word_idx")["token"].tolist(), 0, []
    beats = beats.sort_values("clip_number")
    for tokens, naive in zip(beats["tokens"], beats["naive"]):
        ahead = heard[at:at + naive + C.ALIGN_SLACK + C.ALIGN_EXTRA]
        wanted = [t for t in tokens if t not in C.FILLER_WORDS]
        best = _best_end(wanted, ahead, max(1, naive - C.ALIGN_SLACK), len(ahead) if len(tokens) else 0)
        ends.append((at, at + (best or min(len(ahead), naive)), best > 0))
        at = ends[-1][1]
    spans = pd.DataFrame(ends, columns=["first_word", "end_word", "matched"], index=beats.index)
    return beats[["project_id", "clip_number"]].join(spans)


def _settled(beats: DataFrame, words: DataFrame, block: int) -> DataFrame:
    """Spans of the beats of long projects, by rounds.

    All beats are matched side by side from a guess of where they start.  Then
    a beat starts where the beat before it ends; only beats whose start moved
    are matched again, until none moves.  The first beat starts right, and
    each round settles at least the next one, so the spans at rest are those
    of taking the beats in turn.
    """
    longest = beats.agg(F.max("clip_number")).first()[0] or 0
    total = words.groupBy("project_id").agg((F.max("word_idx") + 1).alias("total"))
    key = ["project_id", "clip_number"]

    def inside(starts: DataFrame) -> DataFrame:
        ends = F.coalesce("total", F.lit(0))
        return starts.join(total, "project_id", "left").withColumn("cursor", F.least("cursor", ends).cast("int")).drop("total")

    guess = inside(_anchored(beats, words, longest, block))
    spans = written(_matched(beats.join(guess, key), words), "spans")
    while True:
        starts = block_scan(spans, ["project_id"], "clip_number", previous={"cursor": F.col("end_word")}, longest=longest, block=block)
        starts = inside(starts.withColumn("cursor", F.coalesce("cursor", F.lit(0))))
        moved = written(starts.where(F.col("cursor") != F.col("first_word")).select(*key, "cursor"), "moved")
        if moved.isEmpty():
            return spans
        again = _matched(beats.join(moved, key), words)
        spans = written(spans.join(moved, key, "left_anti").unionByName(again), "spans")


def transcript_spans(
    beats: DataFrame, words: DataFrame, text: str = "script_beat", group_beats: int = GROUP_BEATS, block: int = BLOCK
) -> DataFrame:
    """Words of the transcript that each beat covers, and its raw times.

    ``beats``: project_id, clip_number, text, word_count; ``words``:
    project_id, word_idx (0, 1, ...), text, start, end.  Result: first_word,
    end_word (exclusive), matched, span_start, span_end, exhausted -- ready for
    ``timeline.floor_cascade``.
    """
    own = word_count(text)
    naive = F.when(own > 0, own).when(F.coalesce("word_count", F.lit(0)) > 0, F.col("word_count")).otherwise(F.lit(1))
    asked = beats.select(
        "project_id", "clip_number", F.coalesce(normal_tokens(text), F.array().cast("array<string>")).alias("tokens"),
        naive.cast("int").alias("naive"))
    asked = written(asked, "beats")
    spoken = words.select(
        "project_id", F.col("word_idx").cast("int").alias("word_idx"), "start", "end",
        F.lower(F.translate("text", PUNCTUATION_AND_DASHES, "")).alias("token"),
    )
    spoken = written(spoken, "words")
    sizes = asked.groupBy("project_id").agg(F.count("*").alias("beats")).join(
        spoken.groupBy("project_id").agg(F.count("*").alias("words")), "project_id", "left")
    large = (F.col("beats") > group_beats) | (F.coalesce("words", F.lit(0)) > group_beats * WORDS_PER_BEAT)
    sizes = written(sizes.select("project_id", large.alias("large")), "sizes")
    small, long = sizes.where("not large"), sizes.where("large")
    of = lambda rows, which: rows.join(which.select("project_id"), "project_id", "left_semi")
    heard = of(spoken, small).select("project_id", "word_idx", "token")
    spans = by_key(of(asked, small), "project_id").groupBy("project_id").cogroup(
        by_key(heard, "project_id").groupBy("project_id")).applyInPandas(_in_turn, SPAN)
    if not long.isEmpty():
        spans = spans.unionByName(_settled(of(asked, long), of(spoken, long), block))
    times = spoken.select("project_id", "word_idx", "start", "end")
    first = times.select("project_id", F.col("word_idx").alias("first_word"), F.col("start").alias("span_start"))
    last = times.select("project_id", (F.col("word_idx") + 1).alias("end_word"), F.col("end").alias("span_end"))
    out = spans.join(first, ["project_id", "first_word"], "left").join(last, ["project_id", "end_word"], "left")
    exhausted = F.col("span_start").isNull()
    return out.select(
        "project_id", "clip_number", "first_word", "end_word", "matched", "span_start",
        F.when(~exhausted, F.col("span_end")).alias("span_end"), exhausted.alias("exhausted"),
    )

