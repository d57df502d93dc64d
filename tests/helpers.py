"""Small libraries of tracks."""

import numpy as np

from trackweave import schemas

SHARED = np.random.default_rng(42).normal(size=16).astype(float).tolist()


def library(spark, *rows):
    """Tracks from (name, bpm, key) or (name, bpm, key, vector), numbered in order."""
    out = []
    for i, (name, bpm, key, *more) in enumerate(rows):
        vector = more[0] if more else SHARED
        out.append((i, f"/music/{name}", name, float(bpm), key, [float(x) for x in vector], f"h{i}", [], 0.0))
    return spark.createDataFrame(out, schemas.SONG)
