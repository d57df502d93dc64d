"""Scanning folders of audio through Spark's binary file reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave import constants as C
from trackweave import scratch
from trackweave.operators import dedup


def _folder(spark: SparkSession, directory: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(directory)


def listing(spark: SparkSession, directory: str, excluded: list[str] | None = None, content: bool = False) -> DataFrame:
    """Audio files below a folder: (file_path, size, modified, and content if asked for).

    Endings count in any case.  Files in an excluded folder are left out.  Contents are
    only read where they are asked for.
    """
    _folder(spark, directory)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    path = F.regexp_replace("path", "^file:/+", "/")
    ending = F.lower(F.regexp_extract(F.col("path"), r"(\.[^./]+)$", 1))
    rows = files.where(ending.isin(C.AUDIO_EXTENSIONS)).withColumn("file_path", path)
    for e in excluded or []:
        rows = rows.where(~F.col("file_path").startswith(e.rstrip("/") + "/"))
    return rows.select("file_path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def hashed(spark: SparkSession, directory: str, excluded: list[str] | None = None) -> DataFrame:
    """``(file_path, content_hash)`` of every audio file; contents stay in their tasks."""
    return listing(spark, directory, excluded, content=True).select("file_path", F.sha2("content", 256).alias("content_hash"))


def unique(spark: SparkSession, directory: str, excluded: list[str] | None = None) -> DataFrame:
    """The first file by path of each content."""
    return dedup.first_per_hash(hashed(spark, directory, excluded))


def changes(spark: SparkSession, directory: str, known: DataFrame, excluded: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files whose content is not known, and known hashes no longer on disk."""
    disk = hashed(spark, directory, excluded)
    return dedup.new_files(disk, known), dedup.removed_hashes(known, disk)


def numbered(files: DataFrame, after: int = -1) -> DataFrame:
    """``ord`` in the order of paths, from ``after`` + 1 on.

    Ranges of paths are numbered apart; contents are not part of it.
    """
    return scratch.numbered(files, ["file_path"], "ord", after)
