"""Tracks derived from the test tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
_PITCH = "case cast((vec_id * 5) % 12 as int) " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(PITCHES)) + " end"

#: One track per vector; ``ord`` orients pairs.
TRACKS_SQL = f"""
select cast(vec_id as bigint) as ord,
 concat('/music/', case when vec_id % 7 = 0 then '' else concat('genre', cast(label as string), '/', case when vec_id % 3 = 0 then 'deep/' else '' end) end, 'track_', lpad(cast(vec_id as string), 6, '0'), '.mp3') as file_path,
 concat('track_', lpad(cast(vec_id as string), 6, '0'), '.mp3') as filename,
 cast(60 as double) + cast((vec_id * 7919) % 12000 as double) / cast(100 as double) as bpm,
 concat({_PITCH}, case when cast(floor(vec_id / 12.0) as bigint) % 2 = 1 then ' minor' else ' major' end) as key,
 case when vec_id % 11 = 0 then cast(0 as double) else cast(120 + (vec_id * 31) % 240 as double) end as duration_sec
from embeddings"""

#: Two fingerprint words per track; some are near copies of the track before.
WORDS_SQL = """
select ord, {xor1} as w1, {xor2} as w2
from (select ord, (((base * 1103515245 + 12345) % 2147483648) * 69069 + 1) % 4294967296 as w1, (((base * 22695477 + 1) % 2147483648) * 1664525 + 1013904223) % 4294967296 as w2
from (select cast(vec_id as bigint) as ord, cast(vec_id as bigint) - case vec_id % 10 when 8 then 1 when 9 then 2 else 0 end as base from embeddings) b0) b1"""
_MASKS = ("cast(case when ord % 10 in (8, 9) then 1023 else 0 end as bigint)", "cast(case when ord % 10 = 9 then 1023 else 0 end as bigint)")
WORDS_SPARK = WORDS_SQL.format(xor1=f"w1 ^ {_MASKS[0]}", xor2=f"w2 ^ {_MASKS[1]}")
WORDS_DUCKDB = WORDS_SQL.format(xor1=f"xor(w1, {_MASKS[0]})", xor2=f"xor(w2, {_MASKS[1]})")


def _over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("from embeddings", "from {embeddings}"), embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def tracks(spark: SparkSession, sf_dir: str, embedding: bool = True) -> DataFrame:
    """The track table of a test directory, with the vectors unless told otherwise."""
    sql = TRACKS_SQL if not embedding else TRACKS_SQL.replace("\nfrom embeddings", ",\n embedding\nfrom embeddings")
    return _over(spark, sf_dir, sql)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord, fingerprint)`` with two words, as signed 32-bit integers."""
    words = _over(spark, sf_dir, WORDS_SPARK)
    signed = [F.when(F.col(w) >= 1 << 31, F.col(w) - (1 << 32)).otherwise(F.col(w)).cast("int") for w in ("w1", "w2")]
    return words.select("ord", F.array(*signed).alias("fingerprint"))
