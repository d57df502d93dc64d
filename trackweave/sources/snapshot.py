"""Library snapshots: one folder a version, with a Parquet table for each part."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave import schemas
from trackweave.operators import edges

ORIGINAL = "original"

#: The JSON form of a library, as other tools write it.
JSON_SCHEMA = T.StructType([
    T.StructField("songs", T.ArrayType(T.StructType([
        T.StructField("file_path", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("bpm", T.DoubleType()),
        T.StructField("key", T.StringType()), T.StructField("embedding", T.StringType()), T.StructField("content_hash", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("duration_sec", T.DoubleType()),
    ]))),
    T.StructField("edges", T.ArrayType(T.StructType([
        T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("edge_type", T.StringType()),
    ]))),
    T.StructField("layout", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
])


def version_key(n_neighbors: int, min_dist: float, n_components: int) -> str:
    return f"UMAP_{n_neighbors}_{min_dist}_{n_components}"


def save(root: str, version: str, settings: dict | None = None, **parts: DataFrame) -> None:
    """Write each table to a folder of its own below ``root/version``, then name it in the mark
    that makes the version whole.

    What a version held before stays on disk until it is saved the next time but one, so a
    library read from there can be saved there; readers see the old tables or the new ones.
    """
    spark = next(iter(parts.values())).sparkSession
    before = _mark(spark, root, version) if version in versions(spark, root) else None
    folder = uuid.uuid4().hex
    for name, df in parts.items():
        df.write.parquet(f"{root}/{version}/{folder}/{name}")
    mark = (version, folder, ",".join(sorted(parts)), json.dumps(settings or {}), before["folder"] if before else None)
    spark.createDataFrame([mark], "version string, folder string, parts string, settings string, before string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{version}/whole")
    if before and before["before"]:
        _path(spark, f"{root}/{version}/{before['before']}", lambda fs, path: fs.delete(path, True))


def _path(spark: SparkSession, name: str, do):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return do(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)


def _mark(spark: SparkSession, root: str, version: str):
    return spark.read.parquet(f"{root}/{version}/whole").first()


def versions(spark: SparkSession, root: str) -> list[str]:
    """Versions that are whole, sorted; unfinished ones are skipped."""
    names = _path(spark, root, lambda fs, path: [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else [])
    return sorted(n for n in names if _path(spark, f"{root}/{n}/whole/_SUCCESS", lambda fs, path: fs.exists(path)))


def load(spark: SparkSession, root: str, version: str = ORIGINAL) -> dict[str, DataFrame]:
    mark = _mark(spark, root, version)
    return {name: spark.read.parquet(f"{root}/{version}/{mark['folder']}/{name}") for name in mark["parts"].split(",")}


def settings(spark: SparkSession, root: str, version: str = ORIGINAL) -> dict:
    """What was saved with a version besides its tables."""
    return json.loads(_mark(spark, root, version)["settings"])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats(blob: pd.Series) -> pd.Series:
    """Vectors from bytes of 32-bit floats."""
    import numpy as np

    return pd.Series([None if b is None else np.frombuffer(b, "<f4") for b in blob])


@F.pandas_udf(T.BinaryType())
def blob(vector: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series([None if v is None else np.asarray(v, "<f4").tobytes() for v in vector])


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Songs, edges and layout of a JSON library; absent fields get their sentinels.

    ``path`` is one file, or a folder that ``write_json`` made.

    Vectors are base64 of 32-bit floats, or number arrays in older files.  ``ord`` is
    the place in the list.
    """
    if _path(spark, f"{path}/songs", lambda fs, p: fs.exists(p)):
        return _read_lines(spark, path)
    doc = spark.read.schema(JSON_SCHEMA).option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("songs").alias("ord", "s")).select(F.col("ord").cast("long"), "s.*")
    numbers, listed = F.from_json("embedding", "array<float>"), F.col("embedding").startswith("[")
    rows = rows.withColumn("embedding", F.coalesce(F.when(listed, numbers), floats(F.when(~listed, F.unbase64("embedding")))))
    songs = schemas.songs(rows.withColumn("fingerprint", F.from_json("fingerprint", "array<int>")))
    ids = songs.select("file_path", "ord")
    raw = doc.select(F.explode("edges").alias("e")).select("e.*")
    a, b = (ids.select(F.col("file_path").alias(p), F.col("ord").alias(o)) for p, o in (("source", "src"), ("target", "dst")))
    found = raw.join(a, "source").join(b, "target").select("src", "dst", "weight", F.coalesce("edge_type", F.lit("direct")).alias("edge_type"))
    layout = doc.select(F.explode("layout").alias("file_path", "at")).select("file_path", F.get("at", F.lit(0)).alias("x"), F.get("at", F.lit(1)).alias("y"))
    return {"songs": songs, "edges": found, "layout": layout}


def _read_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What ``write_json`` wrote, one row a line."""
    song, edge = (JSON_SCHEMA[n].dataType.elementType for n in ("songs", "edges"))
    listed = T.StructType([T.StructField("ord", T.LongType()), *[f if f.name != "fingerprint" else T.StructField("fingerprint", T.ArrayType(T.IntegerType())) for f in song.fields]])
    rows = spark.read.schema(listed).json(f"{path}/songs")
    songs = schemas.songs(rows.withColumn("embedding", floats(F.unbase64("embedding"))))
    ids = songs.select("file_path", "ord")
    a, b = (ids.select(F.col("file_path").alias(p), F.col("ord").alias(o)) for p, o in (("source", "src"), ("target", "dst")))
    found = spark.read.schema(edge).json(f"{path}/edges").join(a, "source").join(b, "target").select("src", "dst", "weight", "edge_type")
    places = schemas.LAYOUT
    there = _path(spark, f"{path}/layout", lambda fs, p: fs.exists(p))
    layout = spark.read.schema(places).json(f"{path}/layout") if there else spark.createDataFrame([], places)
    return {"songs": songs, "edges": found, "layout": layout}


def write_json(path: str, songs: DataFrame, links: DataFrame, layout: DataFrame | None = None) -> None:
    """JSON lines below ``path``: one folder for each of songs, edges and layout."""
    songs.withColumn("embedding", F.base64(blob("embedding"))).write.mode("overwrite").json(f"{path}/songs")
    ids = songs.select("ord", "file_path")
    named = (
        links.join(ids.select(F.col("ord").alias("src"), F.col("file_path").alias("source")), "src")
        .join(ids.select(F.col("ord").alias("dst"), F.col("file_path").alias("target")), "dst")
    )
    named.select("source", "target", "weight", "edge_type").write.mode("overwrite").json(f"{path}/edges")
    if layout is not None:
        layout.write.mode("overwrite").json(f"{path}/layout")


def migrate(spark: SparkSession, json_path: str, root: str, version: str = ORIGINAL) -> bool:
    """Turn a JSON library into a snapshot, unless one is there already.

    Edges keep the weights that the file states until they are recalculated; ``parts`` are
    their components.
    """
    if version in versions(spark, root):
        return False
    tables = read_json(spark, json_path)
    parts = edges.components_of(tables["edges"], tables["songs"])
    save(root, version, {"weights": None}, parts=parts, **tables)
    return True
