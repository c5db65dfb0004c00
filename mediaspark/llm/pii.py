"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay.  Looser patterns give
further candidates (written-out mail addresses, national phone numbers, long
internet addresses, short card numbers).  Three labelers vote on every span,
base or not: its form, a gazetteer (known ends of hosts, issuer digits, country
codes, address ranges) and its context (cue words nearby).  Expectation
maximisation over the counts of all vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data; these posteriors
train a logistic span classifier, whose accepted candidates join the base.

All text work is DataFrame functions.  Candidates stay in an array on their
document's row, so that no text is shuffled; what reaches the driver is the
table of counts by pattern, whose size is fixed by the features.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import let, stored

KINDS = ("email", "ip", "card", "phone")

# The base patterns of the contract, in Java's notation with
# possessive repeats; a match starts at the head of a run or where the last
# match ended, which are the only places a leftmost match can start.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which no base match exists.
MAYBE = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}

#: Candidates beyond the base.
LOOSE = {
    "email": r"(?i)\b[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,63}){1,4}\b",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9A-Za-z]|[.-][0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])",
}
LOOSE_MAYBE = {"email": r"(?i)[\[( ]dot[\]) ]", "ip": r"(?i)[0-9a-f]:[0-9a-f]{1,4}:[0-9a-f]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"[0-9]{3}[.-][0-9]{4}"}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|login|client|address|from)\b",
    "card": r"(?i)\b(?:card|visa|master ?card|amex|credit|debit|pay(?:ment)?|cvv)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|whatsapp|contact|dial)\b",
}
AGAINST = r"(?i)\b(?:isbn|version|build|serial|order|invoice|part|item|page|section|chapter|ratio)\W*$"
#: Code points of context on each side.
CONTEXT = 40

_SPAN = "struct<start:int,end:int,value:string>"


def matches(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """array<struct<start, end, value>> of those leftmost non-overlapping
    matches whose text ``keep`` accepts, in code points."""
    p = F.lit(pattern)

    def placed(parts: Column) -> Column:
        found, rest = parts["found"], parts["rest"]

        def step(acc: Column, i: Column) -> Column:
            value = F.get(found, i)
            start = acc["at"] + F.char_length(F.get(rest, i))
            end = start + F.char_length(value)
            span = F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value")))
            return F.struct(end.alias("at"), F.when(keep(value), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), none, step)["out"]

    both = let(F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("rest")), placed)
    return F.when(F.regexp_like(text, p), both).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def total(d: Column) -> Column:
        doubled = lambda i: F.substr(d, F.char_length(d) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), lambda acc, i: acc + let(doubled(i), lambda x: F.when(x > 9, x - 9).otherwise(x)))

    return let(digits, total) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # digits without leading zeros decide, so that long parts need no number
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return let(_digits(value), lambda d: F.char_length(d).between(16, 19) & F.when(F.char_length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = matches(text, BASE[kind], lambda value: _valid(kind, value))
    return F.when(F.regexp_like(text, F.lit(MAYBE[kind])), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def loose_spans(text: Column, kind: str, base: Column) -> Column:
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = F.filter(matches(text, LOOSE[kind], lambda value: F.lit(True)), apart)
    return F.when(F.regexp_like(text, F.lit(LOOSE_MAYBE[kind])), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _votes(kind: str, text: Column, span: Column, base: Column) -> Column:
    """The votes 1, 0 or -1 of the three labelers, and a length class."""
    value, digits = span["value"], _digits(span["value"])
    ends = {
        "email": F.when(F.regexp_like(value, F.lit(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co)$")), 1).otherwise(0),
        "ip": F.when(F.regexp_like(value, F.lit(r"^(?:0|127|255|2(?:2[4-9]|3[0-9]|[45][0-9]))\.")), -1).otherwise(1),
        "card": F.when(F.regexp_like(digits, F.lit(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))")), 1).otherwise(-1),
        "phone": F.when(F.regexp_like(value, F.lit(r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")), 1).otherwise(0),
    }
    known = ends[kind]
    form = F.when(base, 1).when(luhn(digits), 0).otherwise(-1) if kind == "card" else F.when(base, 1).otherwise(0)
    start = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.substr(text, start + 1, span["start"] - start)
    around = F.concat(before, F.lit(" "), F.substr(text, span["end"] + 1, F.lit(CONTEXT)))
    context = F.when(F.regexp_like(before, F.lit(AGAINST)), -1).when(F.regexp_like(around, F.lit(CUES[kind])), 1).otherwise(0)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), base.alias("base"),
        form.cast("int").alias("form"), known.cast("int").alias("known"), context.cast("int").alias("context"),
        F.least(F.floor((span["end"] - span["start"]) / 8), F.lit(4)).cast("int").alias("size"),
    )


def candidates(text: Column) -> Column:
    """All spans of a text with their votes, by kind, base first."""
    return F.concat(*[_voted(text, kind) for kind in KINDS])


def _voted(text: Column, kind: str) -> Column:
    def both(base: Column) -> Column:
        return F.concat(
            F.transform(base, lambda s: _votes(kind, text, s, F.lit(True))),
            F.transform(loose_spans(text, kind, base), lambda s: _votes(kind, text, s, F.lit(False))),
        )

    return let(base_spans(text, kind), both)


FEATURES = ("kind", "form", "known", "context", "size")


def reliabilities(counts: dict[tuple, int], rounds: int = 30) -> tuple[dict[str, tuple[float, float]], dict[tuple, float]]:
    """Expectation maximisation: per labeler the share of votes for personal
    data, among what isn't and what is, and the posterior of each pattern.

    A vote of 0 is no evidence.  First guesses (0.1 and 0.9) count as 10 votes,
    and the prior as 10 spans, half of them personal, so that the sides keep
    their meaning however few candidates there are.
    """
    labelers = FEATURES[1:4]
    shares = {name: (0.1, 0.9) for name in labelers}
    prior, belief = 0.5, dict.fromkeys(counts, 0.5)
    for _ in range(rounds):
        for p in counts:
            odds = math.log(prior) - math.log(1 - prior)
            for i, name in enumerate(labelers):
                rest, own = shares[name]
                odds += {1: math.log(own / rest), -1: math.log((1 - own) / (1 - rest)), 0: 0.0}[p[1 + i]]
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        prior = (sum(n * belief[p] for p, n in counts.items()) + 5) / (sum(counts.values()) + 10)
        for i, name in enumerate(labelers):
            found = [10 * 0.1, 10 * 0.9]
            cast = [10.0, 10.0]
            for p, n in counts.items():
                for side, share in enumerate((1 - belief[p], belief[p])):
                    found[side] += n * share * (p[1 + i] > 0)
                    cast[side] += n * share * (p[1 + i] != 0)
            shares[name] = (found[0] / cast[0], found[1] / cast[1])
    return shares, belief


def train(counts: dict[tuple, int], belief: dict[tuple, float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple[str, int], float]:
    """Logistic weights of one-hot features on the posteriors, by gradient
    steps over the pattern counts."""
    weights: dict[tuple[str, int], float] = defaultdict(float)
    whole = max(1, sum(counts.values()))
    for _ in range(rounds):
        step: dict[tuple[str, int], float] = defaultdict(float)
        for p, n in counts.items():
            keys = [("", 0), *zip(FEATURES, p, strict=True)]
            z = sum(weights[k] for k in keys)
            miss = n * (belief[p] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for k in keys:
                step[k] += miss
        for k, g in step.items():
            weights[k] += rate * (g / whole - decay * weights[k])
    return dict(weights)


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per input row: key, counts and digest of the base spans, all
    spans, and how many were added.

    A null or empty text has no spans; repeated rows are rows of their own; an
    empty table gives no rows; other columns are not read.  A candidate of a
    feature value that no row has counts with weight 0.  The added spans are
    those whose classifier probability is above ``threshold``.
    """
    found = stored(docs.select(F.col(key).alias("_id"), candidates(F.coalesce(F.col(text), F.lit(""))).alias("spans")), "spans")
    patterns = found.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{f}").alias(f) for f in FEATURES]).count()
    counts = {tuple(r[f] for f in FEATURES): r["count"] for r in patterns.collect()}
    _, belief = reliabilities(counts)
    weights = train(counts, belief)

    def score(s: Column) -> Column:
        z = F.lit(float(weights.get(("", 0), 0.0)))
        for f in FEATURES:
            values = {v: w for (n, v), w in weights.items() if n == f}
            part = F.lit(0.0)
            for v, w in sorted(values.items()):
                part = F.when(s[f] == v, F.lit(float(w))).otherwise(part)
            z = z + part
        return z

    bar = math.log(threshold / (1 - threshold))
    kept = F.filter("spans", lambda s: s["base"] | (score(s) > bar))
    named = lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    listed = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))), named), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda i: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == i))).cast("long")
    out = found.select("_id", kept.alias("kept"), base.alias("base"), *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)])
    return out.select(
        F.col("_id").alias(key), *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("kept")).alias("spans"), (F.size("kept") - F.size("base")).cast("long").alias("n_added"),
    )
