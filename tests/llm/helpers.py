"""Small tables for the operators' tests."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("id", T.LongType()), T.StructField("sig", T.LongType()),
])


def docs(spark, rows, parts=3):
    """``rows``: (doc_id, text) or (doc_id, text, lang); further columns clash with the operators' own names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "x", 7, None) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


#: Nulls, empty and repeated rows, ties.
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (4, "one"), (None, "null key text"), (5, "one"), (6, "ümlaut 日本語 𝄞 text"), (7, "a" * 5000)]
