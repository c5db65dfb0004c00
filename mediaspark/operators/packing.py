"""Greedy packing of sentences into chunks, of rows or of whole texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.functions.text import sentences as split_sentences
from mediaspark.functions.text import word_count
from mediaspark.plans.materialise import written
from mediaspark.plans.skew import block_scan


def chunk_numbers(rows: DataFrame, max_words: int) -> DataFrame:
    """``rows`` (doc_id, sentence_no from 1 without gaps, n_words) with chunk_no from 0.

    A chunk takes sentences while they have at most ``max_words`` words together;
    a longer sentence stands alone.  Every sentence points to the one that would
    start the next chunk if it started one: the last sentence that ends within
    its reach is a running maximum over starts and ends along the words.  From a
    document's first sentence the pointers are followed by doubling, so a
    document of c chunks takes log2(c) rounds, all documents at once.
    """
    rows = rows.select("doc_id", "sentence_no", F.col("n_words").cast("long").alias("n_words"))
    ended = block_scan(rows, ["doc_id"], "sentence_no", running={"before": ("sum", F.col("n_words"))})
    ended = written(ended.withColumn("words_end", F.col("before") + F.col("n_words")), "sentences")
    ends = ended.select("doc_id", F.col("words_end").alias("at"), F.lit(0).alias("asks"), "sentence_no")
    reach = ended.select("doc_id", (F.col("before") + max_words).alias("at"), F.lit(1).alias("asks"), "sentence_no")
    last = block_scan(
        ends.unionByName(reach), ["doc_id"], "at", order=["asks", "sentence_no"],
        running={"last": ("max", F.when(F.col("asks") == 0, F.col("sentence_no")))},
    ).where("asks = 1")
    # "last" covers the rows before: ends at the same place come before the questions
    jumps = written(last.select("doc_id", "sentence_no", (F.greatest("last", "sentence_no") + 1).alias("to")), "jumps")
    # two neighbouring chunks hold more than max_words words
    total = ended.agg(F.max("words_end")).first()[0] or 0
    starts = ended.where("sentence_no = 1").select("doc_id", "sentence_no")
    for _ in range(math.ceil(math.log2(2 * total / max_words + 2))):
        more = starts.join(jumps, ["doc_id", "sentence_no"]).select("doc_id", F.col("to").alias("sentence_no"))
        starts = written(starts.unionByName(more).distinct(), "starts")
        further = jumps.select("doc_id", F.col("sentence_no").alias("to"), F.col("to").alias("then"))
        jumps = written(jumps.join(further, ["doc_id", "to"]).select("doc_id", "sentence_no", F.col("then").alias("to")), "jumps")
    marked = ended.join(starts.withColumn("starts", F.lit(1)), ["doc_id", "sentence_no"], "left")
    counted = block_scan(marked, ["doc_id"], "sentence_no", running={"earlier": ("sum", F.coalesce("starts", F.lit(0)))})
    number = F.col("earlier") + F.coalesce("starts", F.lit(0)) - 1
    return counted.select("doc_id", "sentence_no", "n_words", number.cast("int").alias("chunk_no"))


def pack(sentences: DataFrame, max_words: int) -> DataFrame:
    """doc_id, chunk_no, n_words, chunk.  ``sentences``: doc_id, sentence_no, sentence, n_words."""
    numbered = chunk_numbers(sentences, max_words).drop("n_words").join(sentences, ["doc_id", "sentence_no"])
    # a group is one chunk: max_words words or a single sentence
    part = F.sort_array(F.collect_list(F.struct("sentence_no", "sentence")))
    return numbered.groupBy("doc_id", "chunk_no").agg(
        F.sum("n_words").cast("int").alias("n_words"), F.array_join(F.transform(part, lambda s: s["sentence"]), " ").alias("chunk")
    )


def pack_texts(texts: DataFrame, max_words: int, text: str = "text") -> DataFrame:
    """doc_id, chunk_no, n_words, chunk of texts that lie whole in their rows.

    The same chunks as those of ``pack`` over the sentences.  As a text and all
    its sentences are in one row, nothing is shuffled or written in between:
    sentences are counted in their row, one pass over the counts names the
    first sentence of every chunk, and chunks are cut out of the row.
    """
    rows = texts.select("doc_id", split_sentences(text).alias("parts"))
    rows = rows.withColumn("counts", F.transform("parts", word_count))
    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("held"), F.lit(0).alias("at"))

    def step(state: Column, n: Column) -> Column:
        new = (state["at"] == 0) | (state["held"] + n > max_words)
        return F.struct(
            F.when(new, F.concat(state["starts"], F.array(state["at"] + 1))).otherwise(state["starts"]).alias("starts"),
            F.when(new, n).otherwise(state["held"] + n).alias("held"), (state["at"] + 1).alias("at"),
        )

    rows = rows.withColumn("starts", F.aggregate("counts", none, step, lambda s: s["starts"]))

    def chunk(start: Column, i: Column) -> Column:
        after = F.coalesce(F.get("starts", i + 1), F.size("parts") + 1)
        own = lambda c: F.slice(c, start, after - start)
        words = F.aggregate(own("counts"), F.lit(0), lambda total, n: total + n)
        return F.struct(i.cast("int").alias("chunk_no"), words.alias("n_words"), F.array_join(own("parts"), " ").alias("chunk"))

    return rows.select("doc_id", F.inline(F.transform("starts", chunk)))
