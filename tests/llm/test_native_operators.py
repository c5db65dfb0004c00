"""Sharding, fingerprints, personal data and templates next to brute force."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, docs  # noqa: E402

from mediaspark.llm import fingerprints  # noqa: E402
from mediaspark.llm.fingerprints import edited_likeness  # noqa: E402
from mediaspark.llm.minimax import minimax_shards  # noqa: E402
from mediaspark.llm.pii import BASE, KINDS, personal_data  # noqa: E402
from mediaspark.llm.templates import contaminated, decontaminate  # noqa: E402


def _capacity(sizes, shards):
    """The smallest capacity of a contiguous partition, by trying all."""
    low = max(sizes)
    while True:
        n, room = 1, low
        for s in sizes:
            if s > room:
                n, room = n + 1, low
            room -= s
        if n <= shards:
            return low
        low += 1


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_are_minimax(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.randint(0, 60) + str(rng.randint(0, 40) if rng.random() < 0.5 else i)) for i in range(300)]
    got = minimax_shards(docs(spark, rows), 7).collect()
    texts = dict(rows)
    first, size = {}, {}
    for i, t in rows:
        first.setdefault(t, i)
        size[t] = size.get(t, 0) + len(t.encode()) + 16
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    home = {}
    for r in got:
        assert home.setdefault(texts[r.doc_id], r.shard) == r.shard
    total = {}
    for r in got:
        total[r.shard] = total.get(r.shard, 0) + r.size
    for s in total:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    order = [size[t] for t in sorted(first, key=first.get)]
    assert max(total.values()) == _capacity(order, 7)
    by_first = sorted((first[t], home[t]) for t in first)
    assert [s for _, s in by_first] == sorted(s for _, s in by_first)


def test_a_huge_group_has_a_shard_of_its_own(spark):
    rows = [(i, "same text " * 20) for i in range(60)] + [(100 + i, f"text {i}") for i in range(60)]
    got = minimax_shards(docs(spark, rows), 4).collect()
    assert {r.shard for r in got if r.doc_id < 100} == {0}
    assert {r.shard for r in got if r.doc_id >= 100} == {1, 2, 3}
    counts = [sum(r.shard == s for r in got) for s in (1, 2, 3)]
    assert max(counts) - min(counts) <= 2


def test_shards_of_odd_rows(spark):
    got = minimax_shards(docs(spark, ODD), 3).collect()
    assert len(got) == len(ODD)
    assert sorted(r.size for r in got if r.doc_id in (1, 2)) == [16, 16]
    assert len({r.shard for r in got if r.doc_id in (4, 5)}) == 1
    assert minimax_shards(docs(spark, []), 3).count() == 0


def _tokens(text):
    """A plain walk: letters of scripts without spaces alone, words of up to 16
    signs whole, longer runs cut behind signs of a set or after 16."""
    import regex

    alone = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
    out = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", text):
        at = 0
        while at < len(run):
            if alone.match(run[at]):
                size = 1
            elif at == 0 and len(run) <= 16:
                size = len(run)
            else:
                size = next((i + 1 for i, c in enumerate(run[at : at + 16]) if c in "aeiou02468.,;:/_=-"), len(run[at : at + 16]))
            out.append(run[at : at + size])
            at += size
    return out


def _winnow(text, k=3, w=4):
    import xxhash

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    tokens = _tokens(text)
    if len(tokens) >= k:
        hashes = []
        for i in range(len(tokens) - k + 1):
            h = 42
            for t in tokens[i : i + k]:
                h = xxhash.xxh64(t.encode(), seed=h).intdigest()
            hashes.append(h)
    else:
        hashes = [xxhash.xxh64(" ".join(tokens).encode(), seed=42).intdigest()] if tokens else []
    chosen = set()
    for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
        part = range(i, min(i + w, len(hashes)))
        chosen.add(min(part, key=lambda p: (hashes[p] >> 33, -p)))
    return ",".join(f"{hashes[p]:x}@{p}" for p in sorted(chosen)), {signed(hashes[p]) >> 33 for p in chosen}


def _check_edited(spark, rows):
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in edited_likeness(docs(spark, rows)).collect()}
    plain = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(10**9)))
    for i, (d, t) in enumerate(plain):
        text, after = t or "", plain[(i + 1) % len(plain)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        (a, sa), (b, sb), (_, sn) = _winnow(text), _winnow(edited), _winnow(after)
        assert (r.fingerprint, r.edited_fingerprint) == (a, b)
        like = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        assert r.near_edited == pytest.approx(like(sa, sb)) and r.near_next == pytest.approx(like(sa, sn))


def test_fingerprints(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "γάμμα", "日本", "𝄞𝄞", "delta", "x" * 40]
    _check_edited(spark, [(i * 3, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)])


def test_fingerprints_of_odd_rows(spark):
    _check_edited(spark, [r for r in ODD if r[0] != 4] + [(4, "one")])
    assert edited_likeness(docs(spark, [])).count() == 0
    assert edited_likeness(docs(spark, ODD)).count() == len(ODD)
    one = edited_likeness(docs(spark, [(1, "just one text")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            s += x - 9 if x > 9 else x
        return s % 10 == 0

    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@b.c_d@e.f.g", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.02.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111",
            "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 (", "𝄞é ", " ", "\n", "555.123.4567", "q@w", "..@a.b", "12 34", "-"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 14)))) for i in range(300)]
    rows += [(1000, "9" * 20000), (1001, "a.b" * 8000 + "@x.y"), (1002, "1." * 9000), (1003, None)]
    got = {r.doc_id: r for r in personal_data(docs(spark, rows)).collect()}
    for d, t in rows:
        base = _base(t or "")
        assert got[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (d, t)
        assert [getattr(got[d], f"n_{k}") for k in KINDS] == [sum(x.startswith(k) for x in base) for k in KINDS]
        assert set(base) <= set(got[d].spans.split(",")) | {""}
    assert set(BASE) == set(PATTERNS)


def test_added_spans(spark):
    rows = [(i, f"Please write a mail to jane{i}@example.com or call +1 (212) 555-01{i:02d} today.") for i in range(60)]
    rows += [(100 + i, f"Contact by mail: jo{i} at example dot com, phone (212) 555-01{i:02d}.") for i in range(5)]
    rows += [(200 + i, f"Plain words about nothing {i}, section 12 and 13.") for i in range(40)]
    got = {r.doc_id: r for r in personal_data(docs(spark, rows)).collect()}
    assert all("phone:" in got[100 + i].spans and got[100 + i].n_added >= 1 for i in range(5))
    assert all(got[200 + i].spans == "" for i in range(40))


def test_personal_data_of_odd_rows(spark):
    got = personal_data(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.spans == "" for r in got)
    assert personal_data(docs(spark, [])).count() == 0


ITEM = "A train from Paris covers 120 km in 2 hours, then another 60 km in half that time. What was its mean speed over all?"
MOVED = "A train from Lyon covers 300 km in 5 hours, then another 90 km in half that time. What was its mean speed over all?"


def test_templates(spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, "Short one here.", "y"), (3, None, "z"), (None, ITEM + " no key", "z")], "item_id long, text string, doc_id string")
    rows = [
        (1, "Intro words. " + ITEM + " More."), (2, "Intro words. " + MOVED + " More."), (3, "Nothing of it in these clean words that run on for a while longer."),
        (4, ITEM.upper().replace("PARIS", "paris")), (5, "A train from Paris covers 120 km"), (6, None), (7, ""), (8, MOVED.replace("another 90 km", "another 90 km") * 2), (None, ITEM), (1, "Intro words. " + ITEM + " More."),
    ]
    got = {r.doc_id: r for r in contaminated(docs(spark, rows), items).collect()}
    assert set(got) >= {1, 2, 8} and not set(got) & {3, 5, 6, 7, None}
    assert not got[1].reparameterised and got[2].reparameterised and got[1]["items"] == [1]
    left = decontaminate(docs(spark, rows), items)
    assert left.columns == docs(spark, []).columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - set(got)
    assert contaminated(docs(spark, []), items).count() == 0 and contaminated(docs(spark, rows), items.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    item = "If Anna has 7 red apples and gives 7 green pears to Anna then how many of the 7 fruits stay there in the end"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    same = item.replace("7", "9")
    mixed = item.replace("has 7", "has 3").replace("gives 7", "gives 4").replace("the 7", "the 5")
    got = {r.doc_id: r for r in contaminated(docs(spark, [(1, same), (2, mixed)]), items).collect()}
    assert set(got) == {1} and got[1].reparameterised


def test_alignments_are_judged_apart(spark):
    twice = "the small garden holds 4 old wooden benches and then 4 tall green trees stand behind the white house there in the warm light of summer"
    other = twice.replace("holds 4", "holds 6")
    items = spark.createDataFrame([(1, twice), (2, other)], "item_id long, text string")
    filler = " clean words that have no part in anything at all" * 8
    words = twice.split(" ")
    rows = [
        (1, twice + filler + " " + twice.replace("holds 4", "holds 5")),  # a copy and elsewhere one whose slots are inconsistent
        (2, other),  # a copy of the second item of a template
        (3, filler.join(" " + " ".join(words[i : i + 8]) for i in range(len(words) - 7))),  # windows far apart
        (4, " ".join(words[:13]) + " as all know " + " ".join(words[13:])),  # one copy with words added
    ]
    got = {r.doc_id: r for r in contaminated(docs(spark, rows), items).collect()}
    assert set(got) == {1, 2, 4}
    assert not got[1].reparameterised and not got[2].reparameterised and got[2]["items"] == [1]
    assert got[2].n_windows == 19 and got[2].coverage == 1


def test_templates_without_broadcast(spark, monkeypatch):
    from mediaspark.llm import templates

    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(1, ITEM), (2, MOVED), (3, "clean words only in this one here and there")]
    expected = sorted(contaminated(docs(spark, rows), items).collect())
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", 0)
    assert sorted(contaminated(docs(spark, rows), items).collect()) == expected


@pytest.mark.parametrize("kind", ["han", "mixed", "letters", "digits"])
def test_texts_without_spaces_keep_their_marks_when_shifted(spark, kind):
    rng = random.Random(kind)
    signs = {"han": [chr(0x4E00 + i) for i in range(900)], "mixed": [chr(0x4E00 + i) for i in range(300)] + list("abcxyz，。"), "letters": list("abcdefghijklmnopqrstuvwxyz"), "digits": list("0123456789abcdef")}[kind]
    text = "".join(rng.choice(signs) for _ in range(2000))
    rows = spark.createDataFrame([(text, rng.choice(signs) + text, text[:900] + signs[0] + text[900:])], "a string, b string, c string")
    sets = [fingerprints.hash_set(fingerprints.fingerprint(F.col(c))) for c in "abc"]
    near = rows.select(fingerprints.likeness(sets[0], sets[1]).alias("front"), fingerprints.likeness(sets[0], sets[2]).alias("inside")).first()
    assert near["front"] > 0.9 and near["inside"] > 0.9
