"""Setlists by what must hold of each."""

import pytest
from pyspark.sql import functions as F

from trackweave import constants as C
from trackweave.operators import edges, filters, setlist
from trackweave.scratch import scratch
from trackweave.sources import fixtures


@pytest.fixture(scope="module")
def graph(spark, sf_dir):
    songs = fixtures.tracks(spark, sf_dir)
    return songs, scratch(spark).write(edges.build(songs), "edges")


def tracks(df):
    return [r["ord"] for r in df.orderBy("pos").collect()]


def test_free_walk(spark, graph):
    songs, e = graph
    target = 900.0
    found = tracks(setlist.generate(songs, e, target, min_bpm=90.0, max_bpm=140.0, attempts=4, seed=7))
    assert found == tracks(setlist.generate(songs, e, target, min_bpm=90.0, max_bpm=140.0, attempts=4, seed=7))
    pool = {r["ord"] for r in filters.pool(songs, 90.0, 140.0).collect()}
    assert len(set(found)) == len(found) and set(found) <= pool
    cost = {}
    for r in edges.adjacency(e).collect():
        cost.setdefault(r["node"], {})[r["other"]] = r["weight"]
    seconds = {r["ord"]: r["d"] for r in songs.select("ord", F.when(F.col("duration_sec") > 0, F.col("duration_sec")).otherwise(C.DEFAULT_DURATION).alias("d")).collect()}
    for i, (a, b) in enumerate(zip(found, found[1:])):
        eligible = sorted((w, v) for v, w in cost[a].items() if v in pool and v not in found[: i + 1])
        assert b in [v for _, v in eligible[: C.SHORTLIST]]
    assert sum(seconds[t] for t in found) >= target > sum(seconds[t] for t in found[:-1])


def test_endings(spark, graph):
    songs, e = graph
    found = tracks(setlist.generate(songs, e, 500.0, starting_song=3, ending_song=200, seed=1))
    assert found[0] == 3 and found[-1] == 200
    keyed = tracks(setlist.generate(songs, e, 700.0, starting_song=3, ending_key="C major", seed=1))
    key = {r["ord"]: r["key"] for r in songs.select("ord", "key").collect()}
    near = {r["other"] for r in edges.adjacency(e).where(F.col("node") == keyed[-2]).collect()}
    assert key[keyed[-1]] == "C major" or not any(key[v] == "C major" and v not in keyed for v in near)


def test_waypoints(spark, graph):
    songs, e = graph
    stops = [setlist.Waypoint(50), setlist.Waypoint(120, minute=15.0)]
    found = tracks(setlist.generate(songs, e, 1200.0, starting_song=3, waypoints=stops, ending_song=9, seed=2))
    assert found[0] == 3 and found[-1] == 9 and found.index(50) < found.index(120)


def test_errors(spark, graph):
    songs, e = graph
    with pytest.raises(setlist.NoSetlist):
        setlist.generate(songs, e, 600.0, min_bpm=500.0)
    with pytest.raises(setlist.NoSetlist):
        setlist.generate(songs, e, 600.0, set_key="C major", starting_key="D major")
    with pytest.raises(filters.NotFound):
        setlist.generate(songs, e, 600.0, starting_song=99_999)


def test_segments_keep_both_keys_and_reach_their_minute(spark, graph):
    songs, e = graph
    walks = setlist.Walks(songs, e, set_key="C major", seed=3, attempts=6)
    assert walks.pool("C major").count() == songs.where("key = 'C major'").count() and walks.pool("G major").count() == 0
    free = setlist.Walks(songs, e, seed=3, attempts=6)
    found = free.segment(3, None, 900.0)
    assert free.seconds([3, *found]) >= 900.0


def test_waypoints_as_asked_for():
    assert setlist.waypoint(4, {"minute": 0, "segment_key": ""}) == setlist.Waypoint(4)
    assert setlist.waypoint(4, {"minute": 12, "position_mode": "next"}) == setlist.Waypoint(4)
    assert setlist.waypoint(4, {"minute": 12, "position_mode": "timed", "segment_key": "A minor"}) == setlist.Waypoint(4, 12, "A minor")
