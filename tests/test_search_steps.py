"""Steps of the search and of the scoring: what leaves a task, and what is shuffled."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mediaspark.functions import text, tokens
from mediaspark.operators import retrieval, similarity

ODD = [
    "The Road, the ROAD; road's \"end\" — a–b (x) [y]!", "  ", "", "ΑΣ. ΑΣΑ ΟΔΟΣ, ΟΔΟΣ(Β ΣΣ", "İstanbul STRASSE Straße ǅ",
    "a\x1cb\x85c d e　f​g", "...", "x\ny\tz\x0bw", "naïve Ünï-code 漢字, 漢字 😀!😀", "or Or OR and",
]


def test_tokens_of_a_batch_equal_the_column_expression(spark):
    row, number, names = tokens.pieces(pa.array([*ODD, None]))
    got = [[] for _ in range(len(ODD) + 1)]
    for r, n in zip(row.tolist(), number.tolist(), strict=True):
        got[r].append(names[n].as_py())
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "i int, t string")
    want = [r[0] or [] for r in frame.orderBy("i").select(text.normal_tokens("t")).collect()]
    assert got == want
    counted = {n for n, c in zip(names.to_pylist(), tokens.count_in_match(names), strict=True) if c}
    assert counted == {t for r in frame.select(text.overlap_tokens("t")).collect() for t in r[0] or []} - {""}


def test_word_ids_do_not_depend_on_the_batch():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcé漢", k=rng.randrange(0, 9))) for _ in range(3000)]
    ids = tokens.word_ids(pa.array(words))
    other = tokens.word_ids(pa.array(["x", *reversed(words)]).slice(1))[::-1]
    assert (ids == other).all() and len(set(ids.tolist())) == len(set(words))


def test_word_frequencies_of_odd_texts(spark):
    texts = spark.createDataFrame([(t,) for t in [*ODD, None]], "text string")
    found = texts.select(F.explode(text.normal_tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    got = retrieval.word_frequencies(texts)
    assert sorted((r["token"], r["n"]) for r in got.collect()) == sorted((r["token"], r["n"]) for r in found.collect())


def test_later_blocks_name_no_entry_that_only_ties(spark, monkeypatch):
    """Entries are put into order, so what comes later has to beat a full page, whatever order the rows had."""
    monkeypatch.setattr(retrieval, "BLOCK_ENTRIES", 20)
    monkeypatch.setattr(retrieval, "FIRST_BLOCKS", 1)
    read, scored = [], retrieval._scored
    monkeypatch.setattr(retrieval, "_scored", lambda work, *rest: read.append(work.count()) or scored(work, *rest))
    rows = [(i, "a", ["w0", "w1"]) for i in range(400)]
    random.Random(1).shuffle(rows)
    entries = spark.createDataFrame(rows, "entry bigint, source string, tokens array<string>").repartition(4)
    sets = spark.createDataFrame([("w0 w1", [("w0", 5), ("w1", 9)])], "set_key string, weighted array<struct<token:string,w:bigint>>")
    pages = retrieval.set_pages(sets, entries, 3).collect()
    assert sorted((r["entry"], r["matched"]) for r in pages) == [(0, 14), (1, 14), (2, 14)]
    assert sum(read) == 1


def test_entries_carry_only_words_that_a_phrase_has(spark):
    sets = spark.createDataFrame([(0, [("road", 5)])], "set_id bigint, weighted array<struct<token:string,w:bigint>>")
    coded = retrieval.coded_sets(sets)
    catalogue = spark.createDataFrame([(1, "a", "The road, the ROAD of a truck"), (2, "b", "truck"), (3, "b", None)], "entry int, source string, text string")
    got = {r["entry"]: r["words"] for r in retrieval.coded_entries(catalogue, retrieval.known_words(coded)).collect()}
    assert got == {1: [coded.first()["words"][0]], 2: [], 3: []}


def test_pairs_are_not_shuffled_for_few_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=7).tolist()) for i in range(30)]
    vectors = spark.createDataFrame(rows, "id bigint, vector array<double>")
    pairs = spark.createDataFrame([(int(a), int(b), str(a)) for a, b in rng.integers(0, 33, (200, 2))], "a bigint, b bigint, name string")
    held = similarity.pair_dots(pairs, vectors)
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(similarity, "HELD_BYTES", 0)
    assert sorted(held.collect()) == sorted(similarity.pair_dots(pairs, vectors).collect())


def test_batches_of_texts_are_bounded_in_bytes(spark):
    """A Python task holds a few MB of texts, however long they are."""
    texts = spark.range(0, 300, 1, 1).select(F.expr("repeat('x', 100000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    got = [r["n"] for r in texts.mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) >= 30_000_000 and max(got) < 10_000_000
