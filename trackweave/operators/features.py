"""Feature extraction: chunks, intros, length buckets and weighted mean vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave import constants as C

CHUNKS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("len", T.IntegerType())]))


def fixed_stride(start: int, n: int, rate: int) -> list[tuple[int, int]]:
    """Pieces of 30 seconds; a last one under a second goes, unless nothing else is left."""
    step, least = int(C.CHUNK_MAX * rate), int(C.CHUNK_VALID * rate)
    pieces = [(start + at, min(step, n - at)) for at in range(0, n, step)]
    return [p for p in pieces if p[1] >= least] or [(start, n)]


def merge_undersized(segments: list[tuple[int, int]], rate: int) -> list[tuple[int, int]]:
    """Neighbours joined until each has 12 seconds; a short tail joins the one before."""
    least = int(C.CHUNK_MIN * rate)
    out: list[list[int]] = []
    held: list[int] | None = None
    for start, n in segments:
        held = [held[0], held[1] + n] if held else [start, n]
        if held[1] >= least:
            out.append(held)
            held = None
    if held and out:
        out[-1][1] += held[1]
    return [tuple(p) for p in out]


def split_oversized(segments: list[tuple[int, int]], rate: int) -> list[tuple[int, int]]:
    longest, least = int(C.CHUNK_MAX * rate), int(C.CHUNK_VALID * rate)
    out = []
    for start, n in segments:
        out += [(start, n)] if n <= longest else [p for p in fixed_stride(start, n, rate) if p[1] >= least]
    return out


def phrase_chunks(n: int, rate: int, beats: list[float], rhythmic_intro: bool) -> list[tuple[int, int]]:
    """Chunks ``(start, length)`` of ``n`` samples, along phrases of 32 beats.

    Fewer beats give fixed strides.  What comes before the first beat is a chunk of its
    own if rhythmic and 12 seconds long, part of the first phrase if rhythmic and
    shorter, and dropped if not rhythmic.
    """
    if len(beats) < C.PHRASE_BEATS:
        return fixed_stride(0, n, rate)
    bounds = [min(n, int(b * rate)) for b in beats[:: C.PHRASE_BEATS]] + [n]
    segments = [(a, b - a) for a, b in zip(bounds, bounds[1:])]
    if rhythmic_intro and bounds[0] > 0:
        if bounds[0] >= int(C.CHUNK_MIN * rate):
            segments = [(0, bounds[0]), *segments]
        else:
            segments = [(0, segments[0][0] + segments[0][1]), *segments[1:]]
    segments = [s for s in segments if s[1] > 0]
    merged = merge_undersized(segments, rate)
    if not merged:
        # under 12 seconds in all: one chunk, or the whole track where that has not a second
        held = sum(k for _, k in segments)
        merged = [(segments[0][0], held)] if held >= int(C.CHUNK_VALID * rate) else [(0, n)]
    return split_oversized(merged, rate)


@F.pandas_udf(CHUNKS)
def chunk_plan(n: pd.Series, rate: pd.Series, beats: pd.Series, rhythmic: pd.Series) -> pd.Series:
    return pd.Series([[{"start": s, "len": k} for s, k in phrase_chunks(int(a), int(r), list(b), bool(i))] for a, r, b, i in zip(n, rate, beats, rhythmic)])


def stride_plan(n: Column, rate: int = C.EMBED_RATE) -> Column:
    """``fixed_stride`` of a whole track as a native expression."""
    step, least = int(C.CHUNK_MAX * rate), int(C.CHUNK_VALID * rate)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: F.struct(s.cast("int").alias("start"), F.least(F.lit(step), n - s).cast("int").alias("len")))
    kept = F.filter(pieces, lambda p: p["len"] >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("len"))))


def length_bucket(seconds: Column) -> Column:
    return F.when(seconds <= C.BUCKET_SHORT, "short").when(seconds <= C.BUCKET_MEDIUM, "medium").otherwise("long")


def rhythmic_intro(y: np.ndarray, rate: int, beats: list[float], bpm: float) -> bool:
    """Whether what precedes the first beat keeps its pulse.

    A first beat within five seconds, or no tempo, counts as rhythmic.  Otherwise beats
    are continued backwards for half a minute, and loudness on them is held against
    loudness half way between: more than twice as loud is rhythmic.
    """
    if not len(beats) or beats[0] <= C.INTRO_FROM or bpm <= 0:
        return True
    period = 60.0 / bpm
    from_ = max(0.0, beats[0] - C.INTRO_BACK)
    count = int((beats[0] - from_) / period)
    on = [beats[0] - k * period for k in range(1, count + 1) if beats[0] - k * period >= from_]

    def loud(at: float) -> float | None:
        a, b = max(0, int((at - C.INTRO_WINDOW) * rate)), min(len(y), int((at + C.INTRO_WINDOW) * rate))
        return float(np.sqrt(np.mean(np.square(y[a:b], dtype=np.float64)))) if b > a else None

    on_beat = [v for v in map(loud, on) if v is not None]
    off_beat = [v for v in (loud(t + period / 2) for t in on) if v is not None]
    if not on_beat or not off_beat:
        return True
    off = float(np.mean(off_beat))
    ratio = float(np.mean(on_beat)) / off if off > 1e-9 else C.INTRO_RATIO
    return ratio > C.INTRO_RATIO


def weighted_mean(chunks: DataFrame, size: int = C.EMBEDDING_SIZE) -> DataFrame:
    """Mean vector of each track, its chunks' vectors weighted by length.

    ``chunks(ord, len, vector)``; a track whose vectors are all null gets zeros.
    Sums are partial before the shuffle, one row a track and dimension.
    """
    flat = chunks.select("ord", "len", F.posexplode_outer("vector").alias("i", "x"))
    means = flat.groupBy("ord", "i").agg((F.sum(F.col("len") * F.col("x").cast("double")) / F.sum("len")).alias("x"))
    packed = means.groupBy("ord").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "x")))).alias("v"))
    return packed.select("ord", F.when(F.size("v") > 0, F.transform("v", lambda p: p["x"])).otherwise(F.array_repeat(F.lit(0.0), size)).alias("embedding"))


def fingerprint_words(y: np.ndarray) -> np.ndarray:
    """Peak-normalised 16-bit samples, what a fingerprinter is given; empty if silent."""
    peak = float(np.abs(y).max()) if len(y) else 0.0
    return (y / peak * 32767).astype(np.int16) if peak > 0 else np.empty(0, np.int16)
