"""Text expressions: tokens, slugs, names, keyword lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspark.config import LOW_SIGNAL_WORDS

# What counts as white space between words, and the
# punctuation removed from a word (with and without the two dashes).
SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PUNCTUATION = ".,!?;:\"'()[]"
PUNCTUATION_AND_DASHES = PUNCTUATION + "—–"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# The white space that a plain \\s does not cover: mapped to a blank first, as
# one translate and a plain split are several times faster than a split on the
# whole class.
_WIDE_SPACE = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column | str) -> Column:
    """Without white space at both ends.  A pattern that looks for the end
    would start at every blank of a run inside the text."""
    return F.btrim(col(text), F.lit(" \t\n\x0b\x0c\r" + _WIDE_SPACE))


def is_blank(text: Column | str) -> Column:
    text = col(text)
    return text.isNull() | (strip(text) == "")


def _split_words(text: Column, drop: str = "") -> Column:
    """Pieces between white space (empty pieces kept), ``drop`` characters removed."""
    return F.split(F.translate(text, _WIDE_SPACE + drop, " " * len(_WIDE_SPACE)), r"\s+")


def words(text: Column | str) -> Column:
    """Words between white space; blank text gives an empty array."""
    return F.filter(_split_words(col(text)), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def normal_tokens(text: Column | str, dashes: bool = True) -> Column:
    """Lower-case words without punctuation, in order, repeats kept."""
    chars = PUNCTUATION_AND_DASHES if dashes else PUNCTUATION
    return F.filter(_split_words(F.lower(col(text)), chars), lambda w: w != "")


def overlap_tokens(text: Column | str) -> Column:
    """Distinct tokens that count in a keyword match: low-signal words and
    one-letter tokens dropped."""
    tokens = _split_words(F.lower(col(text)), PUNCTUATION_AND_DASHES)
    return F.array_distinct(
        F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*LOW_SIGNAL_WORDS))
    )


def longest_first(tokens: Column) -> Column:
    """Tokens by falling length, then alphabetically."""
    keyed = F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    return F.transform(F.sort_array(keyed), lambda s: s["t"])


def url_slug(url: Column | str) -> Column:
    """Last path part without its numeric suffix, dashes as spaces."""
    trimmed = F.rtrim(col(url), F.lit("/"))
    last = F.element_at(F.split(trimmed, "/"), -1)
    return F.translate(F.regexp_replace(last, r"-\d+$", ""), "-", " ")


def caption_slug(text: Column | str, max_words: int = 6) -> Column:
    """File-name stem of a caption: letters, digits and the first words."""
    # a word is a run without white space and _ that has a letter or digit; what follows the last one wanted is not read
    first = F.regexp_extract(col(text), rf"^(?:[^a-zA-Z0-9]*+[a-zA-Z0-9][^\s_]*+){{0,{max_words}}}", 0)
    cleaned = F.lower(F.regexp_replace(first, r"[^a-zA-Z0-9\s_]", ""))
    parts = F.filter(F.split(cleaned, r"[\s_]+"), lambda w: w != "")
    stem = F.array_join(F.slice(parts, 1, max_words), "_")
    return F.when(stem == "", F.lit("clip")).otherwise(stem)


def key_slug(name: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def safe_file_name(name: Column | str) -> Column:
    cleaned = F.regexp_replace(col(name), r'[<>:"/\\|?*\x00-\x1f]', "")
    return F.btrim(F.regexp_replace(strip(cleaned), f"{SPACE}+", "_"), F.lit("_"))


def final_video_name(project: Column | str) -> Column:
    """Output file name of a project; generated project names get the default."""
    default = F.lit("final_video_with_narration.mp4")
    # bound to a name, as two uses would be worked out twice
    named = F.transform(F.array(safe_file_name(project)), lambda s: F.when(s == "", default).otherwise(F.concat(s, F.lit(".mp4"))))
    return F.when(col(project).rlike(r"^project_\d+$"), default).otherwise(F.element_at(named, 1))


def url_extension(url: Column | str, media_type: Column | str) -> Column:
    """Extension of the file behind a URL, query part ignored."""
    path = F.element_at(F.split(col(url), r"\?"), 1)
    name = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    fallback = F.when(col(media_type) == "video", F.lit(".mp4")).otherwise(F.lit(".jpg"))
    return F.when(found != "", found).otherwise(fallback)


def keywords_to_csv(keywords: Column | str) -> Column:
    return F.array_join(col(keywords), ",")


def keywords_from_csv(text: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), ","), lambda k: k != "")


def query_text(description: Column | str, keywords: Column | str) -> Column:
    return F.concat(col(description), F.lit(" "), F.array_join(col(keywords), " "))


def generation_prompt(keyword: Column | str, note: Column | str, category_name: Column | str) -> Column:
    note = col(note)
    head = F.when(F.coalesce(note, F.lit("")) == "", col(keyword)).otherwise(
        F.concat(col(keyword), F.lit(". "), note)
    )
    return F.concat(head, F.lit(". "), col(category_name), F.lit(" context, photorealistic, natural lighting."))


def sentences(text: Column | str) -> Column:
    """Sentences of a text: cut at white space that follows . ! or ?"""
    marked = F.regexp_replace(strip(text), f"([.!?]){SPACE}+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def pack_sentences(sentence_array: Column, max_words: int) -> Column:
    """Greedy packing of sentences into chunks of at most ``max_words`` words;
    a longer sentence stands alone."""
    counted = F.transform(
        sentence_array, lambda s: F.struct(s.alias("s"), word_count(s).alias("n"))
    )
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("cur"),
        F.lit(0).alias("n"),
    )

    def step(state: Column, item: Column) -> Column:
        full = (state["cur"] != "") & (state["n"] + item["n"] > max_words)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["cur"]))).otherwise(state["done"]).alias("done"),
            F.when(full | (state["cur"] == ""), item["s"])
            .otherwise(F.concat(state["cur"], F.lit(" "), item["s"]))
            .alias("cur"),
            F.when(full, item["n"]).otherwise(state["n"] + item["n"]).alias("n"),
        )

    return F.aggregate(
        counted,
        start,
        step,
        lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))),
    )


def caption_word(word: Column | str) -> Column:
    """Word as compared with the emphasis list."""
    return F.lower(F.regexp_replace(col(word), r"[^A-Za-z0-9_']", ""))
