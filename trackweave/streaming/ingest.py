"""Structured Streaming over a folder of audio, beyond the batch synchronisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackweave import constants as C
from trackweave.sources import audio

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, directory: str, files_per_batch: int = 100) -> DataFrame:
    """Audio files as they appear below a folder."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(directory)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return stream.where(ending.isin(C.AUDIO_EXTENSIONS)).select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), "content")


def follow(spark: SparkSession, directory: str, add: Callable[[DataFrame], None], checkpoint: str, how: audio.Analysis | None = None, once: bool = False) -> StreamingQuery:
    """Analyse files as they arrive and hand usable tracks to ``add``, batch by batch.

    ``add`` must take a batch twice without harm, as a restart may repeat the last one;
    adding by content hash does.
    """

    def batch(frame: DataFrame, number: int) -> None:
        rows = audio.extract(frame, how).where("status = 'ok'")
        add(rows)

    writer = arrivals(spark, directory).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()
