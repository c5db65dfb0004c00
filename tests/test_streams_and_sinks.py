"""Streams run to their end, and writers."""

import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from mediaspark import sinks
from mediaspark.operators import captions
from mediaspark.sources import library
from mediaspark.streaming import ingest, progress


def folder():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def test_index_grows_with_arrivals(spark):
    root = folder()
    media, index, mark = root / "media", str(root / "index"), str(root / "mark")
    (media / "sub").mkdir(parents=True)
    (media / "_duplicates_removed").mkdir()
    (media / "a.mp4").write_bytes(b"one")
    (media / "sub" / "b.MOV").write_bytes(b"two")
    (media / "_duplicates_removed" / "c.mp4").write_bytes(b"three")
    (media / "notes.txt").write_text("no")
    files = ingest.arriving_files(spark, str(media))
    ingest.index_arrivals(files, index, mark).awaitTermination()
    first = {r["name"]: r["status"] for r in ingest.read_index(spark, index).collect()}
    assert first == {"a.mp4": "indexed", "sub/b.MOV": "indexed"}
    (media / "copy.mp4").write_bytes(b"one")
    (media / "d.webm").write_bytes(b"four")
    ingest.index_arrivals(ingest.arriving_files(spark, str(media)), index, mark).awaitTermination()
    second = {r["name"]: (r["status"], r["duplicate_of"]) for r in ingest.read_index(spark, index).collect()}
    assert second["copy.mp4"] == ("duplicate", "a.mp4") and second["d.webm"] == ("indexed", None) and len(second) == 4
    ingest.index_arrivals(ingest.arriving_files(spark, str(media)), index, mark).awaitTermination()
    assert ingest.read_index(spark, index).count() == 4


def test_media_files_skip_quarantine(spark):
    root = folder()
    (root / "x").mkdir()
    (root / "_duplicates_removed").mkdir()
    (root / "x" / "a.MP4").write_bytes(b"1")
    (root / "_duplicates_removed" / "b.mp4").write_bytes(b"1")
    rows = library.media_files(spark, str(root)).select(library.relative_name("path", str(root)).alias("n")).collect()
    assert [r["n"] for r in rows] == ["x/a.MP4"]


def events(spark, path, rows):
    frame = spark.createDataFrame(rows, "project string, stage string, at string, event_id bigint")
    frame.withColumn("updated_at", F.to_timestamp("at")).drop("at").write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def test_progress_stream_and_windows(spark):
    path = str(folder() / "events")
    rows = [("p", "search", "2024-01-01 00:00:01", 1), ("p", "error", "2024-01-01 00:00:05", 2), ("q", "purchase", "2024-01-01 00:00:03", 3)]
    schema = events(spark, path, rows)
    stream = spark.readStream.schema(schema).parquet(path)
    query = progress.latest_state(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["project"]: (r["stage"], r["done"], r["last_error"]) for r in spark.table("latest").collect()}
    assert got == {"p": ("error", False, 2), "q": ("purchase", True, None)}
    assert {r["project"]: r["stage"] for r in progress.latest_state(spark.read.parquet(path)).collect()} == {"p": "error", "q": "purchase"}

    many = [("p", "call", f"2024-01-01 00:01:{i:02d}", 10 + i) for i in range(35)] + [("p", "call", "2024-01-01 02:00:00", 99)]
    calls = str(folder() / "calls")
    schema = events(spark, calls, many)
    stream = spark.readStream.schema(schema).parquet(calls)
    query = progress.windowed_calls(stream).writeStream.outputMode("append").format("memory").queryName("calls").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("calls").collect()
    assert max(r["calls"] for r in rows) == 35 and any(r["over_limit"] for r in rows)
    batch = progress.trailing_calls(spark.read.parquet(calls)).collect()
    assert sum(r["over_limit"] for r in batch) == 5 and max(r["calls"] for r in batch) == 35


def test_timeline_round_trip_and_text_sinks(spark):
    root = folder()
    rows = spark.createDataFrame(
        [("p", 2, "00:00:05", "00:00:08", "two"), ("p", 1, "00:00:00", "00:00:05", "one | more"), ("q", 1, "00:00:00", "00:00:03", "solo")],
        "project_id string, clip_number int, start string, end string, script_beat string",
    )
    sinks.write_timeline(rows, str(root / "timeline"))
    assert spark.read.parquet(str(root / "timeline")).count() == 3
    assert sorted(p.name for p in (root / "timeline").glob("project_id=*")) == ["project_id=p", "project_id=q"]
    sinks.write_srt(captions.cues(rows), str(root / "srt"))
    text = "".join(p.read_text() for p in sorted((root / "srt" / "project_id=p").glob("part-*")))
    assert text == "1\n00:00:00,000 --> 00:00:05,000\none | more\n\n2\n00:00:05,000 --> 00:00:08,000\ntwo\n\n"
    wide = rows.select("*", *[F.lit(c).alias(c) for c in ("section", "canva_keyword", "fallback_keyword", "visual_type", "edit_note")])
    sinks.write_timeline_table(wide, str(root / "table"))
    lines = "".join(p.read_text() for p in sorted((root / "table" / "project_id=p").glob("part-*"))).splitlines()
    assert lines[0].startswith("|1|00:00:00|00:00:05|section|one | more|") and len(lines) == 2
    sinks.write_report(rows, str(root / "report"))
    assert spark.read.json(str(root / "report")).count() == 3
    framed = rows.select("project_id", "clip_number", F.lit("x.mp4").alias("path"), F.lit(0).alias("start_frame"),
                         F.lit(90).alias("duration_frames"), F.lit("zoom").alias("effect"), F.lit(None).cast("string").alias("media_type"),
                         F.lit("Hard Cut ").alias("transition"))
    segment = json.loads(sinks.render_segments_json(framed).first()["segment"])
    assert segment["mediaType"] == "image" and segment["transition"] == "hard_cut" and segment["durationInFrames"] == 90


def test_scripts_transcripts_and_saved_timelines(spark):
    root = folder()
    (root / "s").mkdir()
    (root / "s" / "a.txt").write_text("One.\nTwo.")
    (root / "s" / "b.txt").write_text(" \n\t")
    good, bad = library.scripts(spark, str(root / "s"))
    assert [r["script"] for r in good.collect()] == ["One.\nTwo."] and bad.count() == 1
    body = json.dumps({"segments": [{"words": [{"word": " hello", "start": 0.0, "end": 0.4}]}, {}, {"words": [{"word": " world", "start": 0.4, "end": 0.9}]}]})
    landed = spark.createDataFrame([("p", body), ("q", '{"segments": []}')], "project_id string, body string")
    words = library.transcript_words(landed).orderBy("word_idx").collect()
    assert [(r["word_idx"], r["text"], r["end"]) for r in words] == [(0, "hello", 0.4), (1, "world", 0.9)]
    assert [r["project_id"] for r in library.empty_transcripts(landed).collect()] == ["q"]
    (root / "t.json").write_text(json.dumps({"project_id": "p", "clip_number": 1, "start": "00:00:01", "end": "00:01:00", "asset": {"score": None}}))
    row = library.timelines(spark, str(root / "t.json")).first()
    assert (row["start_s"], row["end_s"], row["asset"]["score"]) == (1, 60, None)
