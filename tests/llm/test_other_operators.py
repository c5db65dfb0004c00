"""The joins, language model, repeats, token files, classifier, mixing and pipeline."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, docs  # noqa: E402

from mediaspark.llm import parity_join, repeats  # noqa: E402
from mediaspark.llm.common import shared_path  # noqa: E402
from mediaspark.llm.ctw import Model, fit, runs, scores  # noqa: E402
from mediaspark.llm.mixing import fit_rates, memberships, mixed, mixture  # noqa: E402
from mediaspark.llm.parity_join import one_of_each, similarity_components  # noqa: E402
from mediaspark.llm.repeats import kept_texts, repeated_starts, without_repeats  # noqa: E402
from mediaspark.llm.tokens import token_files, write_sequences  # noqa: E402
from mediaspark.llm.weak_quality import classify, posteriors  # noqa: E402
from mediaspark.llm.words import chunks, shingle_sets, word_hashes  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def _lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def _split(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", _lower(text)) if w]


def _set(text, n):
    w = _split(text)
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({" ".join(w)} if w else set())


def _components(rows, n, percent):
    sets = [_set(t, n) for _, t in rows]
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                home[root(i)] = root(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        name[root(i)] = min(name.get(root(i), d), d)
    return sorted((d, len(sets[i]), name[root(i)]) for i, (d, _) in enumerate(rows))


def _family(rng, count, words, edits, start):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for i in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append((start + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_similarity_components(spark, n, percent):
    rng = random.Random(5)
    rows = _family(rng, 60, 150, 5, 0) + _family(rng, 30, 40, 2, 200) + _family(rng, 20, 12, 1, 300) + [(400 + i, "Same  Text\there of a few words") for i in range(9)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "two words"), (506, " one")]
    got = similarity_components(docs(spark, rows), words=n, percent=percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _components(rows, n, percent)


def test_similarity_in_small_sub_groups(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "SUBGROUP", 4)
    monkeypatch.setattr(parity_join, "NEIGHBOURS", 1)
    rows = _family(random.Random(6), 40, 100, 6, 0)
    got = similarity_components(docs(spark, rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _components(rows, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_a_large_group_of_copies_near_the_threshold(spark, monkeypatch, percent):
    monkeypatch.setattr(parity_join, "SUBGROUP", 8)
    rng = random.Random(percent)
    base = [f"b{i}" for i in range(90)]
    shared = " ".join(f"s{i}" for i in range(40))
    rows = []
    for i in range(120):  # each differs from the base in some places, from most others in more than the threshold allows
        w = list(base)
        for at in rng.sample(range(90), rng.choice([1, 2, 3, 4])):
            w[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, f"{shared} " + " ".join(f"p{i}q{j}" for j in range(rng.choice([4, 20, 200])))) for i in range(60)]
    rows += [(300 + i, rows[i % 7][1]) for i in range(50)]
    got = similarity_components(docs(spark, rows), words=3, percent=percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _components(rows, 3, percent)


def test_one_of_each_tells_texts_of_one_key_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    frame = docs(spark, [(1, a), (1, b), (2, a + " end"), (3, b), (None, a), (4, ""), (4, a + " more"), (5, "  ")])
    frame = frame.selectExpr("doc_id", "text", "lang as row_mark", "size as c0", "id as mark", "sig as first")
    left = one_of_each(frame)
    assert left.columns == frame.columns
    assert sorted(map(tuple, left.select("doc_id", "text", "row_mark", "c0").collect())) == [(1, a, "en", "x"), (1, b, "en", "x"), (4, "", "en", "x"), (5, "  ", "en", "x")]


def test_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(60))
    frame = docs(spark, [(5, long), (3, long + " end"), (9, "other words in here all the time"), (9, "other words in here all the time"), (1, None), (2, "")])
    left = one_of_each(frame)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 9]
    assert one_of_each(docs(spark, [])).count() == 0 and similarity_components(docs(spark, ODD)).count() == len(ODD)


def test_word_hashes_follow_bytes():
    texts = pa.array(["The cat\x0bTHE x", None, "", "cat  ", "a" * 3000])
    for size in (1, 1 << 20):
        words = []
        for _, _, data, offsets in chunks(texts, size):
            h, firsts = word_hashes(data, offsets)
            words += [list(h[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        assert [len(w) for w in words] == [3, 0, 0, 1, 1] and words[0][1] == words[3][0] and len({*words[0], *words[4]}) == 4
        assert all(len(s) <= 1 for _, _, d, o in chunks(texts, size) for s in shingle_sets(d, o, 3))


def _gone(rows, length):
    seen = Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        spans = []
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        kept += b[at:]
        out.append((d, len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _passages(rng):
    parts = ["".join(rng.choices("abcdé ", k=rng.randint(5, 60))) for _ in range(12)] + ["ab" * 40, "x" * 90, "abc" * 30]
    return [(i, "".join(rng.choices(parts, k=rng.randint(0, 6))) + "".join(rng.choices("abcd", k=rng.randint(0, 30)))) for i in range(80)]


@pytest.mark.parametrize("crowd", [2048, 1])
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "INDEX_BYTES", 2000)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 1_000_000 if crowd > 1 else -1)
    rows = _passages(random.Random(7)) + [(200, None), (201, ""), (202, "same text that is long enough to go"), (203, "same text that is long enough to go"), (204, "short"), (204, "short")]
    got = without_repeats(docs(spark, rows), length=30, gram=8)
    assert sorted(map(tuple, got.collect()), key=repr) == _gone(rows, 30)


def test_repeats_of_odd_rows(spark):
    got = without_repeats(docs(spark, ODD)).collect()
    assert sorted(map(tuple, got), key=repr) == _gone(ODD, 400)
    assert without_repeats(docs(spark, [])).count() == 0


def test_planted_passages_are_gone_from_the_kept_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 3000)
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(n))
    long, short = words(90), words(51)
    assert len(long.encode()) >= 400 > len(short.encode())
    # beginnings and ends around a passage differ, so that exactly the passage is covered
    rows = [(i, f"{words(40)} {i}<{p}>{i} {words(rng.randint(0, 60))}") for i, p in enumerate([long, long, short, short, "", words(80), long])]
    got = {r.doc_id: r for r in kept_texts(docs(spark, rows)).collect()}
    for i, t in rows:
        at = t.encode().find(f"<{long}>".encode())
        spans = [(at, at + len(long.encode()) + 2)] if at >= 0 else []
        assert [tuple(s) for s in got[i].spans] == spans and got[i].n_bytes == len(t.encode())
        assert bytes(got[i].kept).decode() == t.replace(f"<{long}>", "")
    # only passages below 400 bytes stay, whatever their number of words
    assert sorted(i for i in got if short.encode() in bytes(got[i].kept)) == [2, 3]


def test_index_finds_repeats_within_groups():
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(1, 60))) for _ in range(60)]
    texts = list(dict.fromkeys(texts))
    groups = np.array([rng.randint(0, 5) for _ in texts])
    flags = repeated_starts(texts, groups, 9)
    seen = Counter((g, t[i : i + 9]) for g, t in zip(groups, texts, strict=True) for i in range(len(t) - 8))
    at = 0
    for g, t in zip(groups, texts, strict=True):
        assert [bool(f) for f in flags[at : at + len(t)]] == [len(t) - i >= 9 and seen[g, t[i : i + 9]] > 1 for i in range(len(t))]
        at += len(t) + 1


def _kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def _tree_probability(data, context, last, depth):
    """P(last | context) of the mixture, straight from its definition."""
    padded = []
    for t in data:
        b = b"\0" * depth + t + b"\0"
        padded += [(b[i - depth : i], b[i]) for i in range(depth, len(b))]
    p = 1.0
    for bit in range(8):
        prefix, one = (256 + last) >> (8 - bit), (last >> (7 - bit)) & 1
        found = [(c, (y >> (7 - bit)) & 1) for c, y in padded if (256 + y) >> (8 - bit) == prefix]

        def weighted(suffix, found=found):
            own = [y for c, y in found if c.endswith(suffix)]
            e = _kt(own.count(0), own.count(1))
            if len(suffix) == depth:
                return e, e, own
            below = sum(weighted(c)[1] for c in {c[-len(suffix) - 1 :] for c, _ in found if c.endswith(suffix)})
            return e, math.log(0.5) + max(e, below) + math.log(math.exp(e - max(e, below)) + math.exp(below - max(e, below))), own

        q = None
        for d in range(depth, -1, -1):
            e, w, own = weighted(context[depth - d :])
            if own:
                est = (own.count(1) + 0.5) / (len(own) + 1)
                share = 0.5 * math.exp(e - w) if d < depth else 1.0
                q = est if q is None else share * est + (1 - share) * q
        q = 0.5 if q is None else q
        p *= q if one else 1 - q
    return p


def test_context_tree(spark):
    texts = ["abracadabra", "abra cadabra", "banana bandana", "", None]
    model = fit(docs(spark, list(enumerate(texts))).select("text"), 2)
    raw = [(t or "").encode() for t in texts]
    for context in (b"ab", b"an", b"zz", b"\0\0", b"za"):
        grams = np.array([(context[0] << 16) + (context[1] << 8) + y for y in range(256)], dtype=np.uint64)
        p = 10 ** model.log10(grams)
        assert p.sum() == pytest.approx(1, abs=1e-4)
        for y in (0, 97, 98, 110, 200):
            assert p[y] == pytest.approx(_tree_probability(raw, context, y, 2), rel=1e-4)


def test_model_finds_what_it_remembers():
    model = Model(1, np.array([1 << 56], dtype=np.uint64), np.ones(1), np.full(1, 0.5))
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 5000).astype(np.uint64))
    model.remember(keys, np.arange(len(keys)) / 7)
    assert np.allclose(model.log10(keys), np.arange(len(keys)) / 7, rtol=1e-6)
    grams, bounds = runs(np.frombuffer(b"abc", dtype=np.uint8), np.array([0, 2, 2, 3]), 1)
    assert [hex(int(g)) for g in grams] == ["0x61", "0x6162", "0x6200", "0x0", "0x63", "0x6300"] and list(bounds) == [0, 3, 4, 6]


def test_base_scores(spark, monkeypatch):
    from mediaspark.llm import ctw

    monkeypatch.setattr(ctw, "FREQUENT", 4)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["The", "the", "cat", "Dog", "é", "rare" + str(i)], k=rng.randint(0, 12)))) for i in range(60)] + [(None, "the end"), (61, None), (7, "the cat")]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not held(d) for w in [*_split(t), None])
    n, v = sum(c.values()), len(c)
    expected = sorted(
        ((d, held(d), len(_split(t)) + 1, sum(c[w] > 0 for w in [*_split(t), None]), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*_split(t), None]), 6)) for d, t in rows), key=repr
    )
    got = scores(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == expected
    assert all(r.score < 0 for r in got)
    assert scores(docs(spark, [])).count() == 0 and scores(docs(spark, ODD)).count() == len(ODD)


def test_scores_rest_on_the_whole_tree(spark, monkeypatch):
    from mediaspark.llm import ctw

    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcd é", k=rng.randint(0, 40)))) for i in range(60)] + [(None, "abc"), (7, "dcba"), (61, None)]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    assert any(held(d) for d, _ in rows)
    model = fit(docs(spark, [r for r in rows if not held(r[0])]).select("text"), 4)

    def score(t):
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        return float(model.log10(runs(data, np.array([0, len(data)]), 4)[0]).sum())

    expected = sorted((str(d), round(score(t), 3)) for d, t in rows)
    # neither the contexts held in memory nor the runs that are sent bound the result
    for contexts, sent in ((64, 1 << 20), (64, 16), (64, 0)):
        monkeypatch.setattr(ctw, "CONTEXTS", contexts)
        monkeypatch.setattr(ctw, "RUNS", sent, raising=False)
        got = sorted((str(r.doc_id), round(r.score, 3)) for r in scores(docs(spark, rows), depth=4).collect())
        assert [g[0] for g in got] == [e[0] for e in expected]
        assert [g[1] for g in got] == pytest.approx([e[1] for e in expected], abs=2e-3)


def test_token_files(spark):
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary)
    rows = [(i, t) for i, t in enumerate(["Hello, World!  it's", None, "", "ΣΑΣ Σ İx ẞ", "á e f\x1cg", "<|endoftext|> x<|endoftext|>y", "12 345 ...!? don't", "日本語 𝄞", "word " * 3000])]
    got = {r.doc_id: r for r in token_files(docs(spark, rows), vocabulary, length=64).collect()}
    start = 0
    for d, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    assert token_files(docs(spark, []), vocabulary).count() == 0 and token_files(docs(spark, ODD), vocabulary).count() == len(ODD)


def test_sequences_are_read_in_place(spark):
    folder = shared_path(spark, "test-tokens")
    rows = [(i, "ab" * i) for i in range(50)]
    index = write_sequences(docs(spark, rows), "", folder, length=16, end=7, encode=lambda t: [ord(c) for c in t]).collect()
    base = folder.removeprefix("file:").replace("///", "/")
    for file in {r.file for r in index}:
        before = pa.total_allocated_bytes()
        reader = pa.ipc.open_file(pa.memory_map(os.path.join(base, file)))
        ids = reader.get_batch(0).column(0).flatten()
        assert reader.schema.field("ids").type == pa.list_(pa.uint16(), 16) and reader.num_record_batches == 1
        assert pa.total_allocated_bytes() - before < 8192
        mask = reader.get_batch(0).column(1).flatten()
        own = sorted((r.at, r.id, r.n_tokens) for r in index if r.file == file)
        assert mask.true_count == sum(n for _, _, n in own)
        for at, d, n in own:
            assert ids.slice(at, n).to_pylist() == [ord(c) for c in "ab" * d] + [7]


def test_label_model():
    counts = {(1, 1, 1): 900, (-1, 1, 1): 40, (1, -1, 1): 30, (1, -1, -1): 5, (0, 0, 0): 10}
    fine = posteriors(counts)
    assert fine[1, 1, 1] > 0.95 and fine[0, 0, 0] > 0.5 and max(fine[-1, 1, 1], fine[1, -1, 1], fine[1, -1, -1]) < 0.5
    assert posteriors({}) == {}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_classifier_accuracy(spark):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in classify(frame, labels.where("doc_id % 2 = 0")).collect()}
    rest = [r for r in labels.where("doc_id % 2 = 1").collect()]  # not used to learn the word list
    clean, bad = [r for r in rest if r.quality == 1 and r.toxic == 0], [r for r in rest if r.quality == 0]
    assert sum(got[r.doc_id].accepted for r in clean) >= 0.9 * len(clean)
    assert sum(not got[r.doc_id].accepted for r in bad) >= 0.9 * len(bad)


def test_classifier_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert classify(docs(spark, ODD), labels).count() == len(ODD) and classify(docs(spark, ODD), labels.limit(0)).count() == len(ODD)
    assert classify(docs(spark, []), labels).count() == 0


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(1, 200, 400)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, p array<double>")
    now = (t[:, None] * p).sum(axis=0)
    for targets in (now * [1.5, 1.0, 2.0], now * [0.6, 1.2, 1.0]):
        wanted, reached, rate = fit_rates(members, 3, targets)
        assert np.allclose(reached, wanted, rtol=1e-3)
        assert members.select(rate.alias("r")).where("r < 0").count() == 0


def test_mixture(spark):
    rng = random.Random(11)
    words = {"en": ["the", "of", "and", "cat"], "de": ["der", "und", "von", "katze"], "fr": ["le", "et", "de", "chat"]}
    rows = [(i, " ".join(rng.choices(words[l], k=30)), l) for i, l in enumerate(rng.choices(["en", "de", "fr"], [8, 2, 1], k=300))]
    frame = docs(spark, rows)
    labelled = frame.select("doc_id", __import__("pyspark.sql.functions", fromlist=["col"]).col("lang").alias("domain")).where("doc_id % 3 = 0")
    domains, table = memberships(frame, labelled)
    assert domains == ["de", "en", "fr"] and table.count() == 300
    got = {r.doc_id: r for r in mixture(frame, labelled).collect()}
    assert all(got[d].domain == l and got[d].tokens == 30 and got[d].rate >= 0.99 for d, _, l in rows)
    mass = Counter()
    for r in got.values():
        mass[r.domain] += r.rate * r.tokens
    share = Counter(l for _, _, l in rows)
    ideal = {l: n**0.7 for l, n in share.items()}
    for l in ideal:
        assert mass[l] / sum(mass.values()) == pytest.approx(ideal[l] / sum(ideal.values()), rel=0.02)
    out = mixed(frame, labelled)
    assert out.columns == frame.columns and Counter(r.doc_id for r in out.collect()) == {d: r.copies for d, r in got.items()}
    assert mixture(docs(spark, ODD), labelled).count() == len(ODD) and mixture(docs(spark, []), labelled).count() == 0
    assert mixture(docs(spark, ODD), labelled.limit(0)).count() == len(ODD)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = [raw]
    for i, (_, stage) in enumerate(P.STAGES):
        path = shared_path(spark, f"test-stage-{i}")
        stage(spark, frames[-1], FOLDER).write.parquet(path)
        frames.append(spark.read.parquet(path))
    good, one, clean, mix, last = ([r.doc_id for r in f.collect()] for f in frames[1:])
    assert all(f.columns == raw.columns for f in frames[1:5])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    bad = [d for d in good if d in labels and labels[d].quality == 0]
    assert len(bad) <= 0.2 * sum(r.quality == 0 for r in labels.values())
    texts = {r.doc_id: r.text for r in raw.collect()}
    expected = _components([(d, texts[d]) for d in good], 5, 80)
    assert sorted(one) == sorted({c for _, _, c in expected})
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {d for d in one if any(t in texts[d] for t in items)} == set(one) - set(clean)
    assert set(mix) == set(clean) and sorted(last) == sorted(mix)
    sizes = Counter()
    for r in frames[-1].collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= max(Counter({t: (len(t.encode()) + 16) * mix.count(d) for d, t in texts.items()}).values()) + sum(sizes.values()) / 40 + 1


def test_encoder_agrees_with_the_tokenizer_on_odd_letters():
    """Letters whose lower case is longer, final sigmas, combining marks, wide
    and joined letters, behind and before stops."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from mediaspark.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    model, encode = Tokenizer.from_file(path), tokens.Encoder(path, "uint16")
    rng = random.Random(12)
    signs = ["İ", "I", "ı", "Σ", "ς", "ß", "ẞ", "\u0307", "\u0301", "é", "Ａ", "ｂ", "ﬁ", "ǅ", "Ω", "日", "ا", "1", "-", "'", "’", "𝔄", "a", "b", "C", "th", "er"]
    word = lambda: "".join(rng.choice(signs) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", ".", ",", ".,", "!"])
    texts = ["cİ,", "DENİZLİ,", "cİ.", "İ", "x\u0307,"]
    texts += [rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randint(1, 8))) for _ in range(10_000)]
    want = model.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want, strict=True) if encode(t).tolist() != w.ids]
    assert wrong == []
