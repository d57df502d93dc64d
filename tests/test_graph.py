"""Edges, queries over them and their maintenance."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import library
from trackweave.engine import Library, Settings, Versions
from trackweave.functions import music
from trackweave.operators import edges, filters, library as lib, neighbours, paths
from trackweave.operators.filters import NoPath, NotFound
from trackweave.plans.catalogue import QUERIES
from trackweave.sources import fixtures


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("method", ["native", "blocked"])
@pytest.mark.parametrize(
    ("a", "b", "kind"),
    [(120, 122, "direct"), (100, 115, None), (80, 190, None), (140, 70, "double"), (70, 140, "double"), (150, 100, "triplet"), (100, 150, None), (100, 130, "triplet"), (130, 100, None), (75, 100, "triplet"), (100, 75, None), (0, 120, None), (100, 108, "direct")],
)
def test_oriented_pairs(spark, method, a, b, kind):
    e = edges.build(library(spark, ("a", a, "C major"), ("b", b, "G major")), method=method)
    assert [r["edge_type"] for r in e.collect()] == ([kind] if kind else [])


def test_zero_vectors_and_invalid_keys(spark):
    e = edges.build(library(spark, ("a", 120, "C major", [0.0] * 4), ("b", 120, "C major", [1.0] * 4)))
    assert e.first()["semantic"] == pytest.approx(0.5)
    with pytest.raises(Exception, match="invalid key"):
        edges.build(library(spark, ("a", 120, "H major"), ("b", 120, "C major"))).collect()


def test_tiles_take_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 2.0], None, [1.0, None], [nan, 1.0], [], [inf, 1.0], [0.0, 0.0], [3.0, 0.0], [0.0, 1.0, 0.0, 5.0]]
    schema = "ord long, bpm double, key string, embedding array<float>"
    songs = spark.createDataFrame([(i, 120.0, "C major", v) for i, v in enumerate(vectors)], schema)
    got = {(r["src"], r["dst"]): r["semantic"] for r in edges.build(songs).collect()}
    want = {(i, j): 1.0 if {i, j} & {5, 7} else 0.5 for i, j in itertools.combinations(range(11), 2)}
    for i, j in itertools.combinations(range(11), 2):
        if vectors[i] is None or vectors[j] is None or None in vectors[i] + vectors[j] or len(vectors[i]) != len(vectors[j]):
            want[i, j] = 0.5
    assert got == pytest.approx(want | {(0, 9): 0.0})


def test_direct_weights_equal_those_of_single_pairs(spark):
    schema = "ord long, bpm double, key string, embedding array<float>"
    vectors = [[1.0, 0.0], [0.0, 2.0], None, [1.0, None], [float("nan"), 1.0], [0.0, 0.0], [1.0, 2.0, 3.0], [3.0, 1.0]]
    rows = [(i, 100.0 + 3 * i, ["C major", "H major", None, "F# minor"][i % 4], v) for i, v in enumerate(vectors)] + [(8, 0.0, "C major", [1.0, 0.0]), (9, None, "C major", [1.0, 0.0])]
    songs = spark.createDataFrame(rows, schema)
    near = edges.components(songs, direct_only=True, strict=False)
    got = near.select("src", "dst", F.round(music.composite(F.col("harmonic"), F.col("tempo"), F.col("semantic")), 6))
    met = edges.tempo_matches(songs, songs, direct_only=True)
    want = met.select("a_ord", "b_ord", F.round(music.direct_weight(*[F.col(f"{s}_{c}") for c in ("bpm", "key", "embedding") for s in ("a", "b")]), 6))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 10


@pytest.mark.parametrize(("name", "n"), [("edges_native", 54348), ("weight_direct", 18059)])  # FIXTURES.md
def test_edge_queries_take_no_pairs_one_by_one(spark, sf_dir, monkeypatch, name, n):
    def pairs(*_):
        raise AssertionError("a row for each candidate pair, with both vectors")

    monkeypatch.setattr(edges, "tempo_matches", pairs)
    assert QUERIES[name](spark, sf_dir).count() == n


def test_empty_and_single(spark):
    assert edges.build(library(spark)).count() == 0
    assert edges.build(library(spark, ("a", 120, "C major"))).count() == 0


def test_tiled_equals_native_equals_nested_loop(spark, sf_dir):
    songs = fixtures.tracks(spark, sf_dir)
    both = [edges.build(songs, method=m).select("src", "dst", "edge_type", F.round("weight", 9).alias("w")) for m in ("native", "blocked")]
    assert both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()
    tempo = {r["ord"]: r["bpm"] for r in songs.select("ord", "bpm").collect()}
    want = {(i, j) for i, j in itertools.combinations(sorted(tempo), 2) for f in (1.0, 2.0, 0.5, 1.5, 0.75) if abs(tempo[i] - tempo[j] * f) / min(tempo[i], tempo[j] * f) * 100.0 <= 8.0}
    assert {tuple(r) for r in both[1].select("src", "dst").collect()} == want


def test_incremental_equals_rebuild_but_for_triplets(spark):
    songs = library(spark, *[(f"t{i}", 60 + 3 * i, "C major") for i in range(30)])
    new, old = songs.where("ord >= 20"), songs.where("ord < 20")
    cross, inner = edges.build_incremental(new, old)
    plain = F.col("edge_type") != "triplet"
    pair = (F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.round("weight", 9).alias("w"))
    parts = edges.build(old).unionByName(cross).unionByName(inner).where(plain)
    assert rows(parts, *pair) == rows(edges.build(songs).where(plain), *pair)
    three = library(spark, ("a", 120, "C major"), ("b", 121, "C major"), ("c", 122, "C major"))
    cross, inner = edges.build_incremental(three.where("ord = 2"), three.where("ord < 2"))
    assert edges.build(three.where("ord < 2")).unionByName(cross).unionByName(inner).count() == 3


def test_weights_and_penalties(spark):
    songs = library(spark, ("a", 120, "C major"), ("b", 60, "G major"))
    parts = edges.components(songs)
    r = edges.weigh(parts, {"harmonic": 0.5, "tempo": 0.2, "semantic": 0.3}, {"double": 0.7}).first()
    assert r["weight"] == pytest.approx(0.5 / 6 + 0.7)


@pytest.fixture(scope="module")
def chain(spark):
    songs = library(spark, ("a", 100, "C major"), ("b", 105, "C major"), ("c", 112, "C major"), ("far", 165, "C major"))
    return songs, edges.build(songs)


def test_shortest_path(spark, chain):
    songs, e = chain
    path = paths.path(songs, e, [0, 2]).orderBy("pos").collect()
    assert [r["ord"] for r in path] == [0, 1, 2]
    assert path[-1]["cum_cost"] == pytest.approx(sum(r["hop_cost"] for r in path))
    assert [tuple(r) for r in paths.path(songs, e, [3, 3], excluded_dirs=["."]).collect()] == [(0, 3, 0.0, 0.0)]
    with pytest.raises(NoPath, match="0 -> 2"):
        paths.path(songs, e, [0, 2], allowed_types=["double"])
    stops = paths.path(songs, e, [0, 1, 1, 2, 0]).orderBy("pos").collect()
    assert [r["ord"] for r in stops] == [0, 1, 2, 1, 0]


def test_distances_are_a_fixpoint(spark, sf_dir):
    songs = fixtures.tracks(spark, sf_dir)
    e = edges.build(songs)
    d = paths.distances(e, spark.createDataFrame([(0, 0)], "leg int, node long"))
    found = {r["node"]: r["dist"] for r in d.collect()}
    for r in edges.adjacency(e).collect():
        assert found[r["other"]] <= found[r["node"]] + r["weight"] + 1e-12


def test_neighbours(spark):
    songs = library(spark, ("hub", 120, "C major"), ("x/f", 120, "F# major"), ("g", 120, "G major"), ("far", 200.5, "C major"))
    e = edges.build(songs)
    assert [r["filename"] for r in neighbours.neighbours(songs, e, 0).collect()] == ["g", "x/f"]
    assert neighbours.neighbours(songs, e, 3).count() == 0
    assert neighbours.neighbours(songs, e, 0, excluded_dirs=["x"]).count() == 1
    assert neighbours.neighbours(songs, e, 0, allowed_types=["double"]).count() == 0
    assert neighbours.neighbours(songs, e, 0, allowed_types=[]).count() == 2
    assert neighbours.top_k(songs, e, 0, 0).count() == 1
    info = neighbours.edge_info(e, spark.createDataFrame([(2, 0), (0, 3)], "a long, b long")).orderBy("a").collect()
    assert info[0]["weight"] == float("inf") and info[0]["edge_type"] == "" and info[1]["edge_type"] == "direct"


def test_lookup(spark):
    songs = library(spark, ("a.mp3", 120, "C major"), ("b.mp3", 121, "C major"))
    assert filters.find(songs, "/music/a.mp3") == 0
    assert filters.find(songs, "b.mp3") == 1
    assert filters.find(songs, "/music/b.mp3/") == 1
    with pytest.raises(NotFound):
        filters.find(songs, "c.mp3")


def test_engine_lifecycle(spark, tmp_path):
    songs = library(spark, ("a.mp3", 120, "C major"), ("g/b.mp3", 122, "G major"), ("g/h/c.mp3", 124, "D major"))
    first = Library.build(songs)
    assert first.describe()["num_edges"] == 3
    again = first.recalculate(harmonic=1.0, tempo=0.0, semantic=0.0, double_penalty=0.5)
    assert {round(r["weight"], 6) for r in again.edges.collect()} == {round(1 / 6, 6), round(2 / 6, 6)}
    added = first.add(library(spark, ("d.mp3", 126, "C major")).withColumn("content_hash", F.lit("h9")))
    assert added.describe()["num_nodes"] == 4 and added.songs.agg(F.max("ord")).first()[0] == 3
    assert first.add(library(spark)) is first
    gone = added.remove(spark.createDataFrame([("h1",), ("unknown",)], "content_hash string"))
    assert gone.describe()["num_nodes"] == 3 and gone.edges.where("src = 1 or dst = 1").isEmpty()
    everything = spark.createDataFrame([(f"h{i}",) for i in (0, 1, 2, 9)], "content_hash string")
    assert added.remove(everything) is added
    disk = spark.createDataFrame([("/music/a.mp3", "h0"), ("/music/new.mp3", "h7")], "file_path string, content_hash string")
    synced = first.sync(disk, lambda new: new.select(F.lit(0).alias("ord"), "file_path", F.lit(121.0).alias("bpm"), F.lit("C major").alias("key"), F.array(*[F.lit(1.0)] * 16).alias("embedding"), "content_hash"))
    assert rows(synced.songs, "filename") == [("a.mp3",), ("new.mp3",)]
    first.save(str(tmp_path / "lib"))
    back = Library.load(spark, str(tmp_path / "lib"))
    assert rows(back.edges, "src", "dst") == rows(first.edges, "src", "dst")
    versions = Versions(spark, str(tmp_path / "lib"))
    key = versions.fit(first, n_components=2)
    assert versions.available() == sorted(["original", key]) and versions.use(key).songs.first()["embedding"].__len__() == 2
    with pytest.raises(ValueError, match="no such version"):
        versions.use("nothing")
    placed = first.with_layout(rounds=2).export_graph()
    assert placed["nodes"].where("x is null").isEmpty() and placed["directories"].count() == 3
    assert first.path(["a.mp3", "/music/g/h/c.mp3"]).count() >= 2
    assert [r["label"] for r in first.song_labels().limit(1).collect()] == ["a.mp3  (120.0 BPM, C major)"]
    assert first.search("B.MP3").count() == 1
    target = first.save_setlist(["/music/a.mp3", "/music/g/b.mp3"], "My/set", str(tmp_path))
    assert target.endswith("My_set") and spark.read.option("header", True).csv(f"{target}/manifest").count() == 2
    with pytest.raises(ValueError, match="unique"):
        Library.build(library(spark, ("a", 120, "C major"), ("a", 120, "C major")))
    with pytest.raises(ValueError, match="least tempo"):
        first.setlist(min_bpm=200.0, max_bpm=100.0)
    assert Settings().weights["semantic"] == 0.4


def test_directories(spark):
    songs = library(spark, ("a/b/x", 1, "C major"), ("a/b/y", 1, "C major"), ("z", 1, "C major"))
    got = {r["path"]: (r["depth"], r["parent"], r["direct_count"], r["total_count"]) for r in lib.dir_rollup(songs).collect()}
    assert got == {".": (0, "", 1, 1), "a": (1, ".", 0, 2), "a/b": (2, "a", 2, 2)}
    nested = lib.tree(lib.dir_rollup(songs), "music")
    assert nested["count"] == 3 and nested["children"][0]["children"][0]["count"] == 2
    assert filters.active(songs, ["a"], "/music").count() == 3
    assert filters.active(songs, ["b"], "/music").count() == 1


@pytest.fixture(scope="module")
def crowd(spark):
    """2,100 tracks of one tempo: 2,203,950 edges in one tile."""
    rng = np.random.default_rng(3)
    return library(spark, *[(f"{i}.mp3", 120, f"{p} major", v) for i, (p, v) in enumerate(zip(rng.choice(["C", "D", "E", "F", "G", "A", "B"], 2100), rng.normal(size=(2100, 8))))])


def test_edges_take_little_room(crowd, tmp_path):
    rows = edges.build(crowd).select("src", "dst", "edge_type", F.round("weight", 6).alias("weight"))
    rows.write.parquet(f"{tmp_path}/edges")
    size = sum(p.stat().st_size for p in (tmp_path / "edges").glob("*.parquet"))
    assert rows.sparkSession.read.parquet(f"{tmp_path}/edges").count() == 2100 * 2099 // 2
    assert size < 7 * 2100 * 2099 // 2


def test_edges_in_order_of_weight_are_the_same(crowd, monkeypatch):
    few = crowd.where("ord < 150")
    want = {tuple(r) for r in edges.build(few, method="native").select("src", "dst", "edge_type", F.round("weight", 9)).collect()}
    assert len(want) == 150 * 149 // 2
    for least, most in ((1, 1 << 20), (1, 3000), (1 << 20, 2000)):
        monkeypatch.setattr(edges, "LEAST_SORTED", least)
        monkeypatch.setattr(edges, "MOST_SORTED", most)
        monkeypatch.setattr(edges, "BATCH", 1000)
        got = edges.build(few).select("src", "dst", "edge_type", F.round("weight", 9).alias("weight")).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        if most > 4000:
            costs = [r["weight"] for r in got]
            assert all(a <= b + 2e-6 for a, b in zip(costs, costs[1:])) == (least == 1)
