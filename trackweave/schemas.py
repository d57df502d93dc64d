"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SONG = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("bpm", T.DoubleType()),
    T.StructField("key", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("content_hash", T.StringType()),
    T.StructField("fingerprint", T.ArrayType(T.IntegerType())),
    T.StructField("duration_sec", T.DoubleType()),
])
EDGE = T.StructType([
    T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("weight", T.DoubleType()),
    T.StructField("edge_type", T.StringType()), T.StructField("harmonic", T.DoubleType()),
    T.StructField("tempo", T.DoubleType()), T.StructField("semantic", T.DoubleType()),
])
LAYOUT = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

_DEFAULTS = {"bpm": 0.0, "key": "", "content_hash": "", "duration_sec": 0.0}


def songs(df: DataFrame) -> DataFrame:
    """``df`` in the ``SONG`` schema: absent columns and nulls become their sentinels.

    A missing ``filename`` is the last part of the path; a missing ``ord`` can't be
    made up without a sort and stays null.
    """
    has = set(df.columns)
    out = []
    for f in SONG.fields:
        if f.name == "filename":
            base = F.element_at(F.split("file_path", "[/\\\\]"), -1)
            c = F.coalesce(F.col("filename"), base) if "filename" in has else base
        else:
            c = F.col(f.name).cast(f.dataType) if f.name in has else F.lit(None).cast(f.dataType)
            if f.name in _DEFAULTS:
                c = F.coalesce(c, F.lit(_DEFAULTS[f.name]))
            elif isinstance(f.dataType, T.ArrayType):
                c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)
