"""Chunks, intros, weighted means and reductions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import library
from trackweave.operators import dedup, edges, features, reduction
from trackweave.sources import fixtures

RATE = 24_000


def seconds(chunks):
    return [(s / RATE, n / RATE) for s, n in chunks]


def test_few_beats_give_strides():
    assert seconds(features.phrase_chunks(60 * RATE, RATE, [0.5 * i for i in range(10)], True)) == [(0, 30), (30, 30)]
    assert seconds(features.phrase_chunks(int(60.5 * RATE), RATE, [], True)) == [(0, 30), (30, 30)]
    assert seconds(features.phrase_chunks(RATE // 2, RATE, [], True)) == [(0, 0.5)]


def test_phrases():
    beats = [0.5 * i for i in range(200)]
    chunks = features.phrase_chunks(100 * RATE, RATE, beats, True)
    assert len(chunks) > 1 and all(n <= 30 * RATE for _, n in chunks) and sum(n for _, n in chunks) == 100 * RATE
    late = [15 + 0.5 * i for i in range(100)]
    assert features.phrase_chunks(100 * RATE, RATE, late, False)[0][0] == 15 * RATE
    assert features.phrase_chunks(100 * RATE, RATE, late, True)[0] == (0, 15 * RATE)
    soon = [5 + 0.5 * i for i in range(100)]
    assert features.phrase_chunks(100 * RATE, RATE, soon, True)[0] == (0, 21 * RATE)


def test_merge_and_split():
    assert features.merge_undersized([(0, 5 * RATE), (5 * RATE, 8 * RATE), (13 * RATE, 2 * RATE)], RATE) == [(0, 15 * RATE)]
    assert features.merge_undersized([(0, 5 * RATE)], RATE) == []
    assert seconds(features.split_oversized([(0, int(60.5 * RATE))], RATE)) == [(0, 30), (30, 30)]


def test_native_strides_and_udf(spark):
    df = spark.createDataFrame([(int(s * RATE), RATE, [0.5 * i for i in range(10)], True) for s in (0.5, 29.0, 60.0, 60.5, 75.0)], "n int, rate int, beats array<double>, rhythmic boolean")
    got = df.select(features.stride_plan(F.col("n")).alias("a"), features.chunk_plan("n", "rate", "beats", "rhythmic").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_intro():
    rate, bpm, first = 44_100, 120.0, 10.0
    beats = [first + 0.5 * i for i in range(20)]
    y = np.zeros(20 * rate)
    assert features.rhythmic_intro(y, rate, [1.0, 1.5], bpm) is True
    assert features.rhythmic_intro(y, rate, beats, 0.0) is True
    assert features.rhythmic_intro(y, rate, beats, bpm) is False
    quiet = np.full(20 * rate, 0.01)
    for k in range(20):
        at = int(0.5 * k * rate)
        quiet[at : at + 2000] = 0.8
    assert features.rhythmic_intro(quiet, rate, beats, bpm) is True


def test_weighted_mean(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 3, [0.0, 4.0]), (2, 1, None)], "ord long, len int, vector array<float>")
    got = {r["ord"]: r["embedding"] for r in features.weighted_mean(df, size=2).collect()}
    assert got == {1: [0.25, 3.0], 2: [0.0, 0.0]}


def test_greedy_fingerprints(spark, sf_dir):
    songs = fixtures.fingerprints(spark, sf_dir)
    prints = {r["ord"]: [x & 0xFFFFFFFF for x in r["fingerprint"]] for r in songs.collect()}
    like = lambda a, b: sum(32 - (x ^ y).bit_count() for x, y in zip(a, b)) / 64 >= 0.8
    kept = []
    for o in sorted(prints):
        if not any(like(prints[o], prints[k]) for k in kept):
            kept.append(o)
    assert sorted(r["ord"] for r in dedup.greedy_fingerprints(songs).collect()) == kept
    blank = spark.createDataFrame([(0, []), (1, []), (2, [5]), (3, [5, 9])], "ord long, fingerprint array<int>")
    assert sorted(r["ord"] for r in dedup.greedy_fingerprints(blank).collect()) == [0, 1, 2]


def test_reductions(spark, sf_dir):
    songs = fixtures.tracks(spark, sf_dir)
    small = reduction.pca(songs, 4).collect()
    assert all(len(r["embedding"]) == 4 and np.linalg.norm(r["embedding"]) == pytest.approx(1, abs=1e-5) for r in small)
    assert [r["ord"] for r in sorted(small, key=lambda r: r["filename"])] == list(range(len(small)))
    with pytest.raises(ValueError, match="no tracks"):
        reduction.pca(library(spark), 4)
    few = songs.where("ord < 60")
    weights = [r["weight"] for r in reduction.fuzzy_neighbours(few, edges.components(few), k=5).collect()]
    assert weights and all(0 < w <= 1 + 1e-9 for w in weights)
    assert reduction.layout(few, edges.build(few), rounds=2).count() == 60


def test_nearest_over_all_vectors(spark, sf_dir):
    few = fixtures.tracks(spark, sf_dir).where("ord < 70").withColumn("bpm", F.when(F.col("ord") == 3, 0.0).otherwise(F.col("bpm")))
    rows = few.select("ord", "embedding").orderBy("ord").collect()
    u = np.array([r["embedding"] for r in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    d = np.round((1 - u @ u.T) / 2, 12)
    np.fill_diagonal(d, np.inf)
    want = {(min(i, j), max(i, j)) for i in range(70) for j in np.lexsort((np.arange(70), d[i]))[:5]}
    found = reduction.nearest(few, k=5, tile=16)
    assert {(r["src"], r["dst"]) for r in found.collect()} == want
    weights = reduction.fuzzy_neighbours(few, found, k=5).collect()
    assert {(r["src"], r["dst"]) for r in weights} == want


def test_one_short_segment_is_kept():
    beats = [20 + 0.125 * i for i in range(64)]
    assert seconds(features.phrase_chunks(28 * RATE, RATE, beats, False)) == [(20, 8)]
    assert seconds(features.phrase_chunks(int(20.5 * RATE), RATE, beats, False)) == [(0, 20.5)]


def test_manifold_reduction_keeps_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 16)) * 4
    rows = [(f"t{i:02d}", 120, "C major", centres[i % 3] + rng.normal(size=16) * 0.2) for i in range(45)]
    songs = library(spark, *rows)
    got = reduction.umap(songs, components=4, neighbours=5, rounds=12).orderBy("ord").collect()
    x = np.array([r["embedding"] for r in got])
    assert [r["filename"] for r in got] == sorted(r[0] for r in rows) and np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)
    cosine = x @ x.T
    same = np.arange(45)[:, None] % 3 == np.arange(45)[None, :] % 3
    assert cosine[same].mean() > cosine[~same].mean() + 0.5
    a, b = reduction.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.01))
    with pytest.raises(ValueError, match="no tracks"):
        reduction.umap(songs.limit(0))
