"""Removal of long repeated byte strings through run-length indexes.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere
else.  One index over a whole corpus doesn't distribute, so the corpus is dealt
into small indexes such that equal strings always meet:

* Every window of ``length`` bytes has an anchor, the smallest (rightmost of
  equal) hash of the ``gram`` bytes runs in it.  Equal windows have equal anchors
  at equal places.  Neighbouring windows mostly share one, and a stretch of
  windows with the same anchor, with the bytes they cover, is a piece; each
  window lies in exactly one piece.
* Pieces meet by their anchor's hash.  Equal pieces are one piece with a count,
  and all windows of a piece that occurs twice are repeated.
* Anchors with several distinct pieces are indexed, many at a time with symbols
  of their own: the Burrows-Wheeler transform of the pieces, its runs, and the
  text places at the ends of runs.  The match with the neighbour in suffix
  order shrinks by one from each place to the next except at ends of runs, so
  the samples there give the matching statistics of every place, streamed in
  text order.  Windows whose statistics reach ``length`` are repeated.
* An anchor with more than ``CROWD`` distinct pieces would not fit one index
  (a passage in a large share of all documents).  Its windows are counted by
  hash instead, summed before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import stored
from mediaspark.llm.words import chunks, mix, prefix_sums, window

#: Distinct pieces of one anchor up to which they share an index.
CROWD = 2048
#: Bytes of pieces in one index, if their anchors' groups allow.
INDEX_BYTES = 1 << 19
#: Rows of keys up to which they are broadcast (some 40 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of kept texts in one batch that a task gives back.
BATCH_BYTES = 1 << 24


def _few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if its rows are counted as few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, piece hash, first window, last window) of all pieces
    of the texts; places count from the text's start."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = prefix_sums(data)
    at = np.arange(n - gram + 1)
    hashes = window(sums, at, at + gram)
    low = np.uint64(0xFFFFFFFF)
    least = _sliding_min((hashes & ~low) | (low - at.astype(np.uint64)), length - gram + 1)
    anchor = (low - (least & low)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
    inside = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[text + 1])
    if not len(inside):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (anchor[inside[1:]] != anchor[inside[:-1]]) | (text[inside[1:]] != text[inside[:-1]])
    heads = np.flatnonzero(new)
    first, last = inside[heads], inside[np.append(heads[1:], len(inside)) - 1]
    where = anchor[first]
    whole = mix(window(sums, first, last + length) + (where - first).astype(np.uint64))
    owner = text[first]
    return owner, hashes[where], whole, first - offsets[owner], last - offsets[owner]


def repeated_starts(texts: list[bytes], groups: np.ndarray, length: int) -> np.ndarray:
    """For all places of the texts, laid out one after the other, whether the
    ``length`` bytes from there also start elsewhere in a text of the same
    group.  Texts are distinct and shorter than 1,024 bytes."""
    sizes = np.array([len(t) + 1 for t in texts])
    n = int(sizes.sum())
    stops = np.cumsum(sizes) - 1
    code = np.zeros(n, dtype=np.int64)
    ink = np.ones(n, dtype=bool)
    ink[stops] = False
    code[ink] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    code[ink] += np.repeat(groups, sizes - 1) * 256 + len(texts)
    code[stops] = np.arange(len(texts))  # each end differs from all else
    # ranks by the first 1, 2, 4, ... symbols
    levels = [np.unique(code, return_inverse=True)[1].astype(np.int64)]
    order, span = None, 1
    while span < 1024:
        rank = levels[-1]
        second = np.zeros(n, dtype=np.int64)
        second[: n - span] = rank[span:] + 1
        both = rank * (n + 2) + second
        order = np.argsort(both)
        new = np.ones(n, dtype=np.int64)
        new[1:] = both[order[1:]] != both[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        levels.append(rank)
        span *= 2
        if rank.max() == n - 1:
            break
    # the transform and its runs
    bwt = code[order - 1]
    cut = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
    heads, tails = np.append(0, cut), np.append(cut, n) - 1
    best = np.zeros(n, dtype=np.int64)
    for ends, step in ((heads, -1), (tails, 1)):
        other = ends + step
        fine = (other >= 0) & (other < n)
        here, there = order[ends], np.where(fine, order[np.clip(other, 0, n - 1)], -1)
        # sampled matches at the ends of runs
        match = np.zeros(len(ends), dtype=np.int64)
        a, b = here.copy(), there.copy()
        for level in range(len(levels) - 1, -1, -1):
            size = 1 << level
            ok = fine & (a + size <= n) & (b + size <= n)
            ok[ok] = levels[level][a[ok]] == levels[level][b[ok]]
            match[ok] += size
            a[ok] += size
            b[ok] += size
        # streamed: one less per place, anew at every sample
        streamed = np.full(n, -1, dtype=np.int64)
        streamed[here] = match + here
        streamed = np.where(streamed >= 0, np.arange(n), -1), streamed
        source = np.maximum.accumulate(streamed[0])
        value = np.where(source >= 0, streamed[1][np.maximum(source, 0)] - np.arange(n), 0)
        best = np.maximum(best, value)
    return best >= length


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


_MARKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_MARKS_SQL = "array<struct<a:int,b:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPANS_SQL = "array<struct<start:int,end:int>>"


def _indexed(found: DataFrame, length: int) -> DataFrame:
    """(anchor, piece, marks) of pieces in groups of moderate size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            texts = [t for _, _, t in rows]
            anchors = np.array([a for a, _, _ in rows])
            flags = repeated_starts(texts, np.unique(anchors, return_inverse=True)[1], length) if texts else np.zeros(0, bool)
            marks, at = [], 0
            for t in texts:
                marks.append([{"a": a, "b": b} for a, b in _runs(flags[at : at + len(t)])])
                at += len(t) + 1
            return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array([p for _, p, _ in rows], pa.int64()), pa.array(marks, _MARKS)], names=["anchor", "piece", "marks"])

        for batch in batches:
            for anchor, piece, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if size >= INDEX_BYTES and held[-1][0] != anchor:
                    yield flush(held)
                    held, size = [], 0
                held.append((anchor, piece, body))
                size += len(body)
        if held:
            yield flush(held)

    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "piece")
    return dealt.mapInArrow(run, f"anchor bigint, piece bigint, marks {_MARKS_SQL}")


def _counted(found: DataFrame, length: int) -> DataFrame:
    """(anchor, piece, marks) of pieces in crowded groups: windows by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, data, offsets = [], [], [0]
            for a, _, part, bounds in chunks(batch.column(2)):
                sums = prefix_sums(part)
                for i in range(len(bounds) - 1):
                    s = np.arange(bounds[i], bounds[i + 1] - length + 1)
                    data.append(window(sums, s, s + length).view(np.int64))
                    rows.append(np.full(len(s), a + i))
            del offsets
            owner = pa.array(np.concatenate(rows))
            start = np.concatenate([np.arange(len(d), dtype=np.int32) for d in data])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(start), pa.array(np.concatenate(data))], names=["anchor", "piece", "start", "hash"])

    windows = found.mapInArrow(run, "anchor bigint, piece bigint, start int, hash bigint")
    twice = windows.groupBy("anchor", "hash").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "hash")
    marked = windows.join(stored(twice, "windows").hint("merge"), ["anchor", "hash"], "left_semi")
    one = F.struct(F.col("start").alias("a"), F.col("start").alias("b"))
    return marked.groupBy("anchor", "piece").agg(F.collect_list(one).alias("marks"))


def _rows(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumn("_text", F.xxhash64(body, F.octet_length(body))).withColumn("_body", body)


def repeated_windows(docs: DataFrame, text: str = "text", length: int = 400, gram: int = 100) -> DataFrame:
    """(text, marks): for each text that has any, by its hash, the first and
    last starts of stretches of repeated windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                owner, anchor, piece, first, last = pieces(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(owner)), pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    names=["text", "anchor", "piece", "first", "last"],
                )

    rows = _rows(docs, text).select(F.col("_text").alias("text"), F.col("_body").alias("body"))
    all_pieces = stored(rows.where(F.octet_length("body") >= length).mapInArrow(cut, "text bigint, anchor bigint, piece bigint, first int, last int"), "pieces")
    met = all_pieces.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("piece") != F.max("piece")).alias("mixed")).where("n > 1").select("anchor", "mixed")
    met = stored(met, "anchors")
    some = stored(all_pieces.join(_few(met), "anchor"), "candidates")
    distinct = some.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(F.struct("text", "first", "last")).alias("at"), F.max("mixed").alias("mixed"))
    distinct = stored(distinct, "distinct-pieces")
    whole = distinct.where("n > 1").select("anchor", "piece")
    # the bytes of one occurrence of each piece of a mixed anchor
    wanted = distinct.where("mixed").select("anchor", "piece", "at.*")
    crowds = distinct.where("mixed").groupBy("anchor").agg(F.count("*").alias("d")).where(F.col("d") > CROWD).select("anchor")
    crowds = stored(crowds, "crowds")
    lists = stored(wanted.groupBy("text").agg(F.collect_list(F.struct("anchor", "piece", "first", "last")).alias("cuts")), "cuts")
    sources = rows.join(_few(lists.select("text")), "text", "left_semi") if lists.count() <= BROADCAST_ROWS else rows
    # copies of a text give the same bytes: they are one before the pieces travel
    taken = sources.join(lists.hint("merge"), "text").select("body", F.explode("cuts").alias("c"))
    taken = taken.select("c.anchor", "c.piece", F.expr(f"substring(body, c.first + 1, c.last - c.first + {length})").alias("body"))
    taken = stored(taken.groupBy("anchor", "piece").agg(F.min("body").alias("body")), "bodies")
    crowd = _few(crowds)
    found = _indexed(taken.join(crowd, "anchor", "left_anti"), length).where(F.size("marks") > 0)
    found = found.unionByName(_counted(taken.join(crowd, "anchor", "left_semi"), length))
    # pieces that occur twice are marked as a whole, the others where windows repeat
    found = found.join(whole, ["anchor", "piece"], "left_anti")
    marks = stored(found.unionByName(whole.withColumn("marks", F.lit(None).cast(_MARKS_SQL))), "marks")
    placed = some.join(marks.hint("merge"), ["anchor", "piece"]).select("text", "first", "last", "marks")
    full = F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))
    moved = F.transform("marks", lambda m: F.struct((m["a"] + F.col("first")).alias("a"), (m["b"] + F.col("first")).alias("b")))
    placed = placed.select("text", F.explode(F.when(F.col("marks").isNull(), full).otherwise(moved)).alias("m"))
    # a text's own marks: as many as it has pieces and windows, whatever its number of copies
    return placed.groupBy("text").agg(F.sort_array(F.collect_set("m")).alias("marks"))


def kept_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 400, gram: int = 100) -> DataFrame:
    """One row per input row: key, n_bytes, spans, kept.

    ``spans`` are the maximal removed runs as byte places of the whole text,
    the end exclusive; ``kept`` are the remaining bytes (a run may begin or end
    inside a code point).  A null text counts as empty; texts shorter than
    ``length`` bytes lose nothing; repeated rows are texts of their own, so that
    a text of at least ``length`` bytes that occurs in two rows goes as a whole;
    an empty table gives no rows; other columns are not read.
    """
    marks = stored(repeated_windows(docs, text, length, gram), "text-marks")
    kind = docs.schema[key].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cuts, kept, at_row, held = [], [], [], 0, 0

            def flush(first: int, sizes: list, cuts: list, kept: list, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(cuts, _SPANS), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

            for body, starts in zip(batch.column(1), batch.column(2), strict=True):
                raw = body.as_py()
                out, end = [], 0  # merged spans
                for m in starts.as_py() or ():
                    a, b = m["a"], m["b"] + length
                    if out and a <= end:
                        end = out[-1]["end"] = max(end, b)
                    else:
                        out.append({"start": a, "end": b})
                        end = b
                at, parts = 0, []
                for m in out:
                    parts.append(raw[at : m["start"]])
                    at = m["end"]
                parts.append(raw[at:])
                sizes.append(len(raw))
                cuts.append(out)
                kept.append(b"".join(parts))
                held += len(kept[-1])
                if held >= BATCH_BYTES:
                    yield flush(at_row, sizes, cuts, kept)
                    at_row, held = at_row + len(sizes), 0
                    sizes, cuts, kept = [], [], []
            if sizes:
                yield flush(at_row, sizes, cuts, kept)

    rows = _rows(docs, text).select(F.col(key).alias("id"), F.col("_body").alias("body"), F.col("_text").alias("text"))
    rows = rows.join(marks.hint("merge"), "text", "left").select("id", "body", "marks")
    return rows.mapInArrow(remove, f"id {kind}, n_bytes bigint, spans {_SPANS_SQL}, kept binary").withColumnRenamed("id", key)


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 400, gram: int = 100) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256 of
    its row of ``kept_texts``."""
    cut = kept_texts(docs, text, key, length, gram)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
