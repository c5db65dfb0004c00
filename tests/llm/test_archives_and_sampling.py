"""Archives, importance resampling and fill-in-middle against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaspark.llm import middle, queries, resample, warc
from mediaspark.llm.common import shared_path
from tests.llm.helpers import ODD, docs

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["the", "Apple", "größe", "日本", "x" * 90, "a1b2", "İstanbul", "𝄞", "of", "zq"] + ["w%d" % i for i in range(60)]
    joins = [" ", " ", ", ", "-", "\n", "  ", "\t"]
    return ["".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.choice([0, 1, 2, 5, 30, 80]))) for _ in range(n)]


# archives


PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("type", T.LongType())])


def pages(spark, rows, parts=3):
    full = [(k, u, h, "x", 1) for k, u, h in rows]
    return spark.createDataFrame(full, PAGES).repartition(parts) if full else spark.createDataFrame([], PAGES)


def expected_pages(rows):
    first = {}
    for k, _, h in rows:
        body = h or ""
        if k is not None:
            first[body] = min(first.get(body, k), k)
    out = []
    for k, _, h in rows:
        body, raw = h or "", (h or "").encode()
        top = first.get(body)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((k, len(raw), digest, "response" if k == top else "revisit", None if k == top else top))
    return sorted(out, key=repr)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\nxx"


@pytest.mark.parametrize("block", [64, 1000, 1 << 22])
def test_archives_hold_what_was_written(spark, block):
    rng = random.Random(3)
    bodies = [None, "", "a", "WARC/1.1\r\n", "WARC/1.1", FAKE.format(0), FAKE.format(10), FAKE.format(300) * 3, "é\r\n\r\n" + FAKE.format(1), FAKE.format("9" * 30), "b" * 9000, "\r\n\r\n"]
    rows = [(i, rng.choice([None, "http://a.example/x", "http://b.example/\r\nContent-Length: 3"]), rng.choice(bodies)) for i in range(80)]
    rows += [(None, None, "only here"), (None, "u", "a"), (3, rows[3][1], rows[3][2])]
    got = [tuple(r) for r in warc.archived(pages(spark, rows), block=block).collect()]
    assert sorted(got, key=repr) == expected_pages(rows)


def test_archive_of_no_rows(spark):
    assert warc.archived(pages(spark, [])).collect() == []


def test_places_within_payloads_are_rejected(spark):
    # every payload holds a whole archive record, whose successor is the true end of its own record or lies in another payload
    rows = [(i, None, "p" * i + FAKE.format(40 + i) + "q" * 30 + FAKE.format(i)) for i in range(50)]
    folder = shared_path(spark, "archives")
    warc.write_archives(pages(spark, rows, 2), folder, "html", "page_id")
    places = warc.record_places(spark, folder, 256)
    found = places.agg(F.sum(F.size("at")).alias("n"), F.sum("rejected").alias("rejected")).first()
    assert found["n"] == 50 and found["rejected"] > 20
    read = {int(r["key"]): bytes(r["payload"]).decode() for r in warc.read_archives(spark, folder, 256).collect()}
    assert read == {k: h for k, _, h in rows}


def test_a_broken_archive_is_an_error(spark):
    folder = shared_path(spark, "archives")
    warc.write_archives(pages(spark, [(i, None, "x" * 100) for i in range(9)], 1), folder, "html", "page_id")
    path = next(p for (p,) in spark.read.format("binaryFile").load(folder).where("length > 0").select("path").collect())
    system, name = warc.file_system(path)
    with system.open_input_file(name) as source:
        whole = source.read()
    with system.open_output_stream(name) as sink:
        sink.write(whole[:-50])
    with pytest.raises(ValueError, match="not whole"):
        warc.record_places(spark, folder, 64).collect()


def test_small_payloads_stay_responses_below_the_minimum(spark):
    rows = [(1, None, "aa"), (2, None, "aa"), (3, None, "a" * 20), (4, None, "a" * 20)]
    got = {r["page_id"]: r["record_type"] for r in warc.archived(pages(spark, rows), minimum=10).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_binary_payloads(spark):
    rows = [(1, bytes(range(256))), (2, b"\r\n\r\nWARC/1.1\r\n\x00\xff"), (3, None)]
    frame = spark.createDataFrame(rows, "id bigint, body binary")
    folder = shared_path(spark, "archives")
    warc.write_archives(frame, folder, "body", "id")
    assert {int(r["key"]): bytes(r["payload"]) for r in warc.read_archives(spark, folder).collect()} == {1: rows[0][1], 2: rows[1][1], 3: b""}


# importance resampling


def features(text, buckets=10_000):
    w = WORDS.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def ranked(rows, target, percent=5, least=20, seed=42, buckets=10_000):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text, buckets)[1])
    for text in target:
        t.update(features(text, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for k, text in rows:
        n, found = features(text, buckets)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("states", [8, 300, 1 << 17])
def test_ranks_are_those_of_plain_counting(spark, states, monkeypatch):
    monkeypatch.setattr(resample.Runs.__init__, "__defaults__", (3, states))
    rows = list(enumerate(some_texts(150))) + [(k, t) for k, t in ODD if k is None or k > 3] + [(900, "word " * 20_000), (901, "y" * 30_000)]
    target = some_texts(12, seed=8) + [None, ""]
    asked = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id bigint, text string, bucket string")
    got = resample.importance_ranks(docs(spark, rows), asked, percent=30, least_words=4)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, target, 30, 4)


def test_ranks_without_rows_or_target(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.importance_ranks(docs(spark, []), none).collect() == []
    rows = list(enumerate(some_texts(20)))
    assert sorted(map(tuple, resample.importance_ranks(docs(spark, rows), none, percent=50).collect()), key=repr) == ranked(rows, [], 50)


def test_drawn_rows_keep_their_columns(spark):
    rows = list(enumerate(some_texts(60)))
    drawn = resample.resampled(docs(spark, rows), docs(spark, rows[:5]), percent=20)
    want = {k for k, *_, rank in ranked(rows, [t for _, t in rows[:5]], 20) if rank}
    assert {r["doc_id"] for r in drawn.collect()} == want and drawn.columns == docs(spark, rows).columns


def test_crcs_compose():
    rng = np.random.default_rng(1)
    shifts = resample.Shifts()
    for size in (0, 1, 7, 63, 64, 65, 200, 70_000):
        a, b = rng.bytes(int(rng.integers(0, 50))), rng.bytes(size)
        moved = shifts(np.array([zlib.crc32(a)], np.uint32), np.array([size]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_automaton_finds_whole_words_only():
    data = np.frombuffer(b" the then he  the hen the ", dtype=np.uint8)
    ink = np.concatenate([[False], data != 32])
    starts, ends = np.flatnonzero(ink[1:] & ~ink[:-1]), np.flatnonzero(~ink[1:] & ink[:-1])
    found = resample.WordAutomaton([b"the", b"hen", b"t"]).scan(data, starts, ends)
    assert found.tolist() == [0, -1, -1, 0, 1, 0]


# fill in the middle


def reordered(k, text, seed=1, rate=90, suffix_first=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (k, n, "plain", None, None, text)
    if h4 % 100 < suffix_first:
        return (k, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (k, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def test_middles_are_those_of_plain_slicing(spark):
    rows = list(enumerate(some_texts(120))) + ODD
    rows += [(500, "a <P> b"), (501, "<"), (502, "P> x <"), (503, "S>"), (504, "<<S<P<M" * 9), (505, "日" * 40_000 + "a" * 40_000), (506, "𝄞é" * 20_000)]
    out = middle.fill_in_middle(docs(spark, rows, 1))
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted((reordered(*r) for r in rows), key=repr)
    back = out.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((k, t or "") for k, t in rows), key=repr)


def test_middles_of_no_rows(spark):
    assert middle.fill_in_middle(docs(spark, [])).collect() == []


@pytest.mark.parametrize("error", [0, 1, 127])
def test_rank_index_is_exact(error):
    rng = np.random.default_rng(error)
    for steps in (rng.integers(1, 5, 30_000), np.ones(5000, int), np.repeat([1, 3, 4, 1], 9000), np.array([], int)):
        offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
        index = middle.RankIndex(offsets, error)
        assert (index(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.rests.astype(int)).max() <= error
    assert len(middle.RankIndex(np.arange(100_000), 0).starts) < 9


@pytest.mark.parametrize("name", ["op11_boundary_chains", "op12_word_automaton", "op13_learned_rank"])
def test_queries_agree_with_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = queries.queries()[name](spark, folder)
    want = con.execute(queries.oracle_sql()[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
