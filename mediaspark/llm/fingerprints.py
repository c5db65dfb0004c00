"""Document fingerprints by winnowing.

A token is a word of at most 16 code points.  A longer run of non-space signs is
cut behind signs of a fixed set (after 16 without one), and a letter of a script
that doesn't set spaces is a token by itself; so tokens depend on what is near
them, not on where a run began, in texts without spaces, too.  Every ``k`` neighbouring tokens have a hash; of every
``w`` neighbouring hashes the smallest is chosen, the rightmost of equal ones,
and its hash and position are kept.  Any ``w + k - 1`` tokens that two texts
have in common hold a common chosen hash.

A text of fewer than ``k`` tokens has the hash of all it has; a text of fewer
than ``w`` hashes has the smallest of them; an empty or null text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import let, stored

_INK = r"[^\x20\x09-\x0D]"
_LETTER = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
TOKEN = rf"{_LETTER}|(?<!{_INK}){_INK}{{1,16}}(?!{_INK})|{_INK}{{0,15}}?[aeiou02468.,;:/_=-]|{_INK}{{1,16}}"
#: Positions are kept in the low 31 bits of a sort key.
_POSITIONS = 2**31


def gram_hashes(text: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` tokens, in order."""

    def hashes(tokens: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(tokens) - k),
            lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]),
        )
        short = F.when(F.size(tokens) > 0, F.array(F.xxhash64(F.array_join(tokens, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(tokens) >= k, grams).otherwise(short)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), hashes)


def winnow(hashes: Column, w: int) -> Column:
    """array<struct<hash, pos>>: the chosen hashes, by position."""

    def chosen(h: Column) -> Column:
        # smaller hash first, then the position further right
        keys = F.transform(h, lambda x, i: F.shiftrightunsigned(x, 33) * F.lit(_POSITIONS) + (F.lit(_POSITIONS - 1) - i))

        def minima(v: Column) -> Column:
            windows = F.transform(F.sequence(F.lit(1), F.size(v) - (w - 1)), lambda i: F.array_min(F.slice(v, i, w)))
            whole = F.when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(F.array().cast("array<bigint>"))
            return F.array_distinct(F.when(F.size(v) >= w, windows).otherwise(whole))

        def kept(m: Column) -> Column:
            pos = (F.lit(_POSITIONS - 1) - F.pmod(m, F.lit(_POSITIONS))).cast("int")
            return F.struct(F.get(h, pos).alias("hash"), pos.alias("pos"))

        return F.transform(let(keys, minima), kept)

    return let(hashes, chosen)


def fingerprint(text: Column, k: int = 3, w: int = 4) -> Column:
    return winnow(gram_hashes(text, k), w)


def hash_set(marks: Column) -> Column:
    """The distinct hashes of a fingerprint, cut to their top 31 bits."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m["hash"], 33).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common hashes by all hashes of two sets; of two empty sets 1."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * both / total)


def as_text(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda m: F.concat(F.lower(F.hex(m["hash"])), F.lit("@"), m["pos"].cast("string"))), ",")


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, half, owner, owner_half) for distinct ids in descending order:
    ``owner`` is the id before (of the first: the last), whose next this one is.

    ``ids``: id, half.  Null counts as the smallest id.
    """
    from pyspark.sql import Window as W

    order = F.col("id").desc_nulls_last()
    parted = stored(ids.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ids")
    # one row per part: the last id of the part before
    low = F.struct(F.col("id").isNotNull(), "id")
    edges = parted.groupBy("part").agg(F.min_by(F.struct("id", "half"), low).alias("tail"))
    by_part = W.orderBy("part")
    edges = edges.withColumn("before", F.lag("tail").over(by_part)).withColumn("end", F.last("tail").over(by_part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    edges = edges.select("part", F.coalesce("before", "end").alias("before"))
    within = W.partitionBy("part").orderBy(order)
    linked = parted.withColumn("prev", F.lag(F.struct("id", "half")).over(within)).join(F.broadcast(edges), "part")
    owner = F.coalesce("prev", "before")
    return linked.select("id", "half", owner["id"].alias("owner"), owner["half"].alias("owner_half"))


def edited_likeness(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 3, w: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last half of the code points (rounded down)
    replaced by the first as many of the next document in descending ``key``
    order, or by all it has; after the last document comes the first, so that
    a single document is its own next one.  Null texts are empty; a null key
    counts as the smallest.  Rows that repeat a key are rows of their own; as a
    neighbour such a key stands for its smallest text.  An empty table gives no
    rows.  Other columns are not read.

    The order is found on keys alone.  Texts are dealt by key once; a document
    then sends its owner only the piece of text that the owner takes and the
    distinct hashes of its fingerprint.
    """
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    halves = own.groupBy("id").agg(F.max(F.floor(F.char_length("body") / 2)).cast("int").alias("half"))
    owners = stored(next_ids(halves), "owners")
    # null as a key that joins; both joins read the same two columns and so share one exchange of the texts
    name = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit(""))
    own = own.select(name("id").alias("_k"), "body")
    links = owners.select(name("id").alias("_k"), name("owner").alias("_owner"), "owner_half")
    sent = own.hint("merge").join(links, "_k").select(
        F.col("_owner").alias("_k"),
        F.expr("left(body, owner_half)").alias("lead"),
        hash_set(fingerprint(F.col("body"), k, w)).alias("lead_set"),
    )
    sent = sent.groupBy("_k").agg(F.min(F.struct("lead", "lead_set")).alias("next"))
    n = F.char_length("body")
    whole = own.hint("merge").join(sent, "_k").select(
        F.when(F.col("_k") != "", F.expr("substr(_k, 2)").cast(docs.schema[key].dataType)).alias(key), n.cast("long").alias("n_chars"),
        F.concat(F.expr("left(body, char_length(body) - cast(floor(char_length(body) / 2) as int))"),
                 F.expr("left(next.lead, cast(floor(char_length(body) / 2) as int))")).alias("edited"),
        fingerprint(F.col("body"), k, w).alias("marks"), F.col("next.lead_set").alias("lead_set"),
    )
    scored = whole.select(key, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "marks", fingerprint(F.col("edited"), k, w).alias("edited_marks"), "lead_set")
    out = let(F.struct("marks", "edited_marks", hash_set(F.col("marks")).alias("own")), lambda s: F.struct(
        as_text(s["marks"]).alias("fingerprint"), as_text(s["edited_marks"]).alias("edited_fingerprint"),
        likeness(s["own"], hash_set(s["edited_marks"])).alias("near_edited"), likeness(s["own"], F.col("lead_set")).alias("near_next"),
    ))
    return scored.select(key, "n_chars", "edited_sha256", out.alias("o")).select(key, "n_chars", "edited_sha256", "o.*")
