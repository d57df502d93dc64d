"""Writing setlists out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_manifest(manifest: DataFrame, path: str) -> str:
    """The manifest as CSV in the setlist's folder below ``path``; returns that folder."""
    first = manifest.select("folder").first()
    if first is None:
        raise ValueError("the setlist is empty")
    target = f"{path}/{first['folder']}"
    manifest.drop("folder").coalesce(1).sortWithinPartitions("pos").write.mode("overwrite").option("header", True).csv(f"{target}/manifest")
    return target


def save(manifest: DataFrame, path: str) -> str:
    """Copy the tracks that are there into the setlist's folder and write the manifest of all;
    returns the folder.  Where ``path`` is no plain folder only the manifest is written."""
    target = write_manifest(manifest, path)
    if "://" not in path:
        copy_tracks(manifest, path).agg(F.count("*")).collect()
    return target


def copy_tracks(manifest: DataFrame, path: str) -> DataFrame:
    """Copy each track into the setlist's folder, skipping missing ones: (pos, target, copied).

    For paths that the executors can open, one task for each share of the tracks.
    """
    import os
    import shutil

    import pandas as pd

    def copy(frames):
        for frame in frames:
            done = []
            for source, folder, target in zip(frame["file_path"], frame["folder"], frame["target"]):
                there = os.path.isfile(source)
                if there:
                    os.makedirs(os.path.join(path, folder), exist_ok=True)
                    shutil.copy2(source, os.path.join(path, folder, target))
                done.append(there)
            yield pd.DataFrame({"pos": frame["pos"], "target": frame["target"], "copied": done})

    return manifest.withColumn("pos", F.col("pos").cast("long")).mapInPandas(copy, "pos long, target string, copied boolean")
