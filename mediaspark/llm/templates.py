"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (title-case words inside a sentence) and
units (after a number) give way to typed placeholders, other words to lower
case.  Windows of neighbouring template tokens are hashed and joined; a
document window that meets a benchmark window also shows which value stands in
each slot.  A question whose numbers or names were changed matches in the same
windows, with slots that change consistently: within one alignment every value
of the item is replaced by one and the same value.  An alignment is a shift
between places of the item and of the document; those with inconsistent slots
don't count, and shifts add up only where each lies within an item's length of
the next.

A benchmark window counts if it has at least ``constants`` ordinary words.
Items shorter than a window are one window of their own length; items with
fewer ordinary words than ``constants`` cannot be told from chance and match
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaspark.llm.common import let, stored

#: A number or a word, with the end of a sentence before it where there is one.
_TOKEN = r"(?:(?:^|[.!?:\n]|[-*|>]\s)[\s\"'(\[]*)?(?:\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+)"
_HEAD = r"^[^\p{L}\p{M}\p{N}]+"
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
UNITS = (
    "mm", "cm", "dm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "t", "ton", "tons", "oz", "lb", "lbs", "pound", "pounds", "ml", "cl", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "hz", "khz", "mhz", "ghz", "v", "w", "kw", "mw", "j", "kj", "cal", "kcal", "pa", "kpa", "bar", "k", "c", "f", "mph", "kmh",
    "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
)
#: Rows of benchmark windows up to which they are broadcast (about 60 bytes of key and place each); beyond it both
#: sides are shuffled.
BROADCAST_WINDOWS = 500_000


def _typed(token: Column, before: Column) -> Column:
    """The template token of a raw token; ``before`` is the raw token ahead.
    Most tokens start with a-z and need no pattern."""
    small = F.ascii(token).between(97, 122)
    after_number = F.right(before, F.lit(1)).between("0", "9")
    unit = F.when(after_number, F.lower(token).isin(*UNITS)).otherwise(F.lit(False))
    other = (
        F.when(F.regexp_like(token, F.lit(r"\p{N}$")), F.lit(NUMBER))
        .when(unit, F.lit(UNIT))
        .when(F.regexp_like(token, F.lit(r"^\p{Lu}\p{Ll}")), F.lit(NAME))
        .otherwise(F.lower(F.regexp_replace(token, _HEAD, "")))
    )
    return F.when(small, F.when(unit, F.lit(UNIT)).otherwise(F.lower(token))).otherwise(other)


def canonical(text: Column) -> Column:
    """struct<raw, template>: two arrays of tokens of equal length."""

    def both(raw: Column) -> Column:
        template = F.transform(raw, lambda t, i: _typed(t, F.coalesce(F.get(raw, i - 1), F.lit(""))))
        return F.struct(raw.alias("raw"), template.alias("template"))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0)), both)


def _window_hashes(template: Column, sizes: list[int]) -> Column:
    """array<struct<size, hashes>>: the hashes of all windows of each size, in
    order."""

    def of(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(template) - (n - 1)), lambda i: F.xxhash64(F.slice(template, i, n)))
        return F.struct(F.lit(n).alias("size"), F.when(F.size(template) >= n, some).otherwise(F.array().cast("array<bigint>")).alias("hashes"))

    return F.array(*[of(n) for n in sizes])


def _clean(token: Column) -> Column:
    """A raw token without the sentence's end before it, in lower case."""
    return F.lower(F.regexp_replace(token, _HEAD, ""))


def _plain(tokens: Column) -> Column:
    """How many tokens are no placeholders."""
    return F.size(F.filter(tokens, lambda t: ~t.isin(NUMBER, NAME, UNIT)))


def benchmark_windows(items: DataFrame, window: int, constants: int, text: str, key: str) -> DataFrame:
    """One row per window of a distinct item: hash, size, tpl (the smallest item
    of the template), variant (the smallest item with the same values in the
    slots, too), pos, n_windows, raw, mask (which tokens are slots)."""
    shaped = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), canonical(F.col(text)).alias("c")).select("item", "c.*")
    shaped = shaped.groupBy("template", F.transform("raw", _clean).alias("raw")).agg(F.min("item").alias("variant"))
    smallest = shaped.groupBy("template").agg(F.min("variant").alias("tpl"))
    shaped = shaped.join(smallest, "template")
    size = F.least(F.size("template"), F.lit(window))
    places = F.transform(F.sequence(F.lit(1), F.size("template") - size + 1), lambda i: F.struct((i - 1).alias("pos"), F.slice("template", i, size).alias("part"), F.slice("raw", i, size).alias("raw")))
    rows = shaped.where(F.size("template") > 0).select("tpl", "variant", size.alias("size"), F.filter(places, lambda p: _plain(p["part"]) >= constants).alias("places"))
    rows = rows.select("tpl", "variant", "size", F.size("places").alias("n_windows"), F.explode("places").alias("p"))
    return rows.select(F.xxhash64("p.part").alias("hash"), "size", "tpl", "variant", "p.pos", "n_windows", F.col("p.raw").alias("raw"), F.transform("p.part", lambda t: t.isin(NUMBER, NAME, UNIT)).alias("mask"))


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
    window: int = 8, constants: int = 4, coverage: float = 0.5,
) -> DataFrame:
    """One row per contaminated document: key, items, n_windows, coverage,
    reparameterised.

    A document is contaminated by an item if at least ``coverage`` of the
    item's windows occur in it, in consistent alignments that neighbour each
    other.  ``items`` lists
    the smallest item of each template, ``coverage`` is the largest share,
    ``reparameterised`` says that every match has changed slots.  Null and empty
    texts match nothing; rows without a key are left out on both sides; rows
    that repeat a key are one document; empty tables give no rows; other
    columns are not read.
    """
    known = stored(benchmark_windows(items, window, constants, item_text, item_key), "templates")
    shape = known.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    sizes = list(shape["sizes"]) or [window]
    cut = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), canonical(F.col(text)).alias("c"))
    cut = cut.select("_id", F.col("c.raw").alias("_raw"), F.explode(_window_hashes(F.col("c.template"), sizes)).alias("w"))
    cut = cut.select("_id", "_raw", F.col("w.size").alias("size"), F.posexplode("w.hashes").alias("_at", "hash"))
    # documents carry their tokens only up to the join inside the scan; without a broadcast the windows' own tokens travel
    if shape["n"] <= BROADCAST_WINDOWS:
        met = cut.join(F.broadcast(known), ["hash", "size"])
        values = F.slice("_raw", F.col("_at") + 1, F.col("size"))
    else:
        cut = cut.withColumn("_raw", F.slice("_raw", F.col("_at") + 1, F.col("size")))
        met = cut.join(known.hint("merge"), ["hash", "size"])
        values = F.col("_raw")
    shift = (F.col("_at") - F.col("pos")).alias("shift")
    # ``raw`` of the benchmark is clean already
    pairs = F.transform(F.arrays_zip(F.col("raw").alias("i"), values.alias("d"), F.col("mask").alias("m")), lambda z: F.struct(z["i"].alias("was"), _clean(z["d"]).alias("now"), z["m"].alias("m")))
    slots = F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: F.struct(p["was"].alias("was"), p["now"].alias("now")))
    met = met.select("_id", "tpl", "variant", "n_windows", "size", "pos", shift, slots.alias("slots"))
    # per document, item and alignment: the windows and their slots
    item = ["_id", "tpl", "variant", "n_windows", "size"]
    per = met.groupBy(*item, "shift").agg(F.collect_set("pos").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    steady = F.size(F.array_distinct(F.transform("slots", lambda s: s["was"]))) == F.size("slots")
    per = per.where(steady)
    # neighbouring shifts hold one copy with words added or left out
    reach = F.col("n_windows") + F.col("size")
    near = W.partitionBy("_id", "variant").orderBy("shift")
    per = per.withColumn("last", F.lag("shift").over(near))
    per = per.withColumn("copy", F.sum(F.when(F.col("shift") - F.col("last") <= reach, 0).otherwise(1)).over(near))
    per = per.groupBy(*item, "copy").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    per = per.where(F.col("hits") >= F.lit(coverage) * F.col("n_windows"))
    changed = F.exists("slots", lambda s: s["was"] != s["now"])
    per = per.groupBy("_id", "tpl", "n_windows").agg(F.max("hits").alias("hits"), F.min(changed).alias("changed"))
    out = per.groupBy("_id").agg(
        F.sort_array(F.collect_set("tpl")).alias("items"), F.sum("hits").alias("n_windows"),
        F.max(F.col("hits") / F.col("n_windows")).alias("coverage"), F.min("changed").alias("reparameterised"),
    )
    return out.withColumnRenamed("_id", key)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates; rows without a
    key stay."""
    found = stored(contaminated(docs, items, key=key, **options).select(F.col(key).alias("_leak")), "leaks")
    return docs.join(found, F.col(key) == F.col("_leak"), "left_anti")
