"""Small documents, and what a query must give whatever they hold."""

from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("id", T.StringType()),
])
LABEL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def docs(spark, texts, sources=None, langs=None, ids=None):
    """Documents, with further columns whose names clash with those of results."""
    n = len(texts)
    rows = [
        (ids[i] if ids else i, t, (langs or ["en"] * n)[i], (sources or ["a"] * n)[i], len(t) if t is not None else None, "x", "y", "z")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " \n\t ", "word", "word", "word", "déjà vu 中文", "a " * 60_000, "x" * 200_000, "one two three four five six seven"]


def odd(spark):
    """Null, empty, blank, equal, foreign and very long texts, null sources, languages and a null id, a repeated row."""
    n = len(ODD)
    return docs(spark, ODD + ["word"], [None, "a", "b"] * 3 + ["a", "a"], ["en", None, "de"] * 3 + ["en", "en"], [*range(n - 1), None, 3])
