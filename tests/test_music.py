"""Scalar functions against known values."""

import math

import pytest
from pyspark.sql import functions as F

from trackweave.functions import music, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def pos(spark, key, strict=True):
    return one(spark, music.key_position(F.lit(key), strict))


def test_circle_of_fifths(spark):
    assert [pos(spark, k) for k in ("C major", "G major", "F# major")] == [0, 1, 6]
    for minor, major in (("A minor", "C major"), ("E minor", "G major"), ("D minor", "F major"), ("  A   MINOR ", "C major")):
        assert pos(spark, minor) == pos(spark, major)
    assert pos(spark, "C dorian") == 0


@pytest.mark.parametrize("key", ["Cmajor", "X major", "c major", "Db major", "", None])
def test_invalid_keys(spark, key):
    assert pos(spark, key, strict=False) is None
    with pytest.raises(Exception, match="invalid key"):
        pos(spark, key)


def test_flats_become_sharps(spark):
    assert one(spark, music.sharp(F.lit("Bb minor"))) == "A# minor"
    assert one(spark, music.sharp(F.lit("B minor"))) == "B minor"


def test_harmonic_distance(spark):
    for a, b, want in (("C major", "G major", 1 / 6), ("C major", "D major", 2 / 6), ("C major", "F# major", 1.0), ("F major", "G major", 2 / 6), ("C major", "A minor", 0.0)):
        got = one(spark, music.harmonic_distance(music.key_position(F.lit(a)), music.key_position(F.lit(b))))
        assert got == pytest.approx(want)


def test_tempo_penalty(spark):
    for a, b, want in ((120.0, 126.0, 0.625), (100.0, 108.0, 1.0), (100.0, 110.0, math.inf), (128.0, 129.0, 1 / 128 * 100 / 8)):
        assert one(spark, music.tempo_penalty(F.lit(a), F.lit(b))) == pytest.approx(want)
    for a, b in ((0.0, 120.0), (120.0, -5.0)):
        assert one(spark, music.tempo_penalty(F.lit(a), F.lit(b))) is None
        with pytest.raises(Exception, match="positive"):
            one(spark, music.tempo_penalty(F.lit(a), F.lit(b), strict=True))


def test_compatible(spark):
    for a, b, want in ((100.0, 108.0, True), (100.0, 110.0, False), (80.0, 160.0, False), (0.0, 100.0, False), (-10.0, 100.0, False)):
        assert one(spark, music.is_compatible(F.lit(a), F.lit(b))) is want


def vector(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_semantic_distance(spark):
    for u, v, want in (((1, 0), (1, 0), 0.0), ((1, 0), (-1, 0), 1.0), ((1, 0), (0, 1), 0.5), ((0, 0), (0, 1), 0.5)):
        assert one(spark, music.semantic_distance(vector(*u), vector(*v))) == pytest.approx(want)
    with pytest.raises(Exception, match="empty or zero"):
        one(spark, music.semantic_distance(vector(0, 0), vector(0, 1), strict=True))


def test_direct_weight(spark):
    args = lambda b, k: (F.lit(120.0), F.lit(b), F.lit("C major"), F.lit(k), vector(1, 0), vector(0, 1))
    assert one(spark, music.direct_weight(*args(126.0, "G major"))) == pytest.approx(0.35 / 6 + 0.25 * 0.625 + 0.4 * 0.5)
    assert one(spark, music.direct_weight(*args(200.0, "G major"))) == math.inf


def test_fingerprint_similarity(spark):
    ints = lambda *xs: F.array(*[F.lit(x).cast("int") for x in xs]) if xs else F.array().cast("array<int>")
    for a, b, want in (((0, -1), (0, -1), 1.0), ((0,), (-1,), 0.0), ((0, 0), (0b1111,), 28 / 32), ((), (1,), 0.0)):
        assert one(spark, music.fingerprint_similarity(ints(*a), ints(*b))) == pytest.approx(want)


def test_paths_and_labels(spark):
    for path, want in (("/mnt/c/Music\\x/", "C:/Music/x"), ("/home/u//", "/home/u"), ("/mnt/c", "/mnt/c")):
        assert one(spark, text.canonical_path(F.lit(path))) == want
    for path, want in (("/music/a/b/x.mp3", "a/b"), ("/music/x.mp3", "."), ("/musical/a/x.mp3", "."), ("/other/x.mp3", ".")):
        assert one(spark, text.relative_dir(F.lit(path), "/music")) == want
    for rel, want in (("a", True), ("a/b", True), ("ab", False), (".", False)):
        assert one(spark, text.dir_excluded(F.lit(rel), ["a"])) is want
    assert one(spark, text.dir_excluded(F.lit("a"), [])) is False
    assert one(spark, text.ancestors(F.lit("a/b/c"))) == ["a", "a/b", "a/b/c"]
    assert one(spark, text.label(F.lit("x.mp3"), F.lit(120.0), F.lit("C major"))) == "x.mp3  (120.0 BPM, C major)"
    assert one(spark, text.path_summary(F.lit(1), F.lit(0))) == "1 track · 0 hops"
    assert one(spark, text.setlist_summary(F.lit(2), F.lit(150.0))) == "2 tracks · ~2 min"
    assert one(spark, text.safe_name(F.lit("a/b: c_d-é"))) == "a_b_ c_d-é"
    assert one(spark, text.safe_name(F.lit("  "))) == "Setlist"
    assert one(spark, text.version_label(F.lit("UMAP_15_0.1_32"))) == "UMAP (15, 0.1, 32)"
    assert one(spark, text.version_label(F.lit("original"))) == "original"
    assert one(spark, text.clamp(F.lit(9.0), 0, 5, 1, F.lit(2.0))) == 5.0
    assert one(spark, text.clamp(F.lit(float("nan")), 0, 5, 1, F.lit(2.0))) == 2.0
    assert one(spark, music.duration(F.lit(0.0))) == 210.0
