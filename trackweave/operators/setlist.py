"""Setlists: constrained random walks, all attempts at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave import constants as C
from trackweave.functions import music
from trackweave.operators import edges as E
from trackweave.operators import filters, paths
from trackweave.operators.filters import NoPath, NotFound
from trackweave.operators.graph import Graph
from trackweave.scratch import scratch


@dataclass
class Waypoint:
    """A track to pass, at a minute or, without one, next in line."""

    song: int
    minute: float | None = None
    segment_key: str | None = None


def waypoint(song: int, asked: dict) -> Waypoint:
    """A waypoint as it is asked for; a minute counts only where the place is timed and the
    minute not 0, and an empty key is none."""
    timed = asked.get("position_mode", "timed") == "timed"
    return Waypoint(song, (asked.get("minute") or None) if timed else None, asked.get("segment_key") or None)


class NoSetlist(ValueError):
    """No track meets the constraints."""


class Walks:
    """Walks over the graph under one set of constraints.

    Choices are drawn by a hash of seed, attempt and step, so a seed fixes the result.
    """

    def __init__(self, songs: DataFrame, edges: DataFrame | Graph, *, min_bpm: float = 0.0, max_bpm: float = 999.0, set_key: str | None = None, allowed_types: list[str] | None = None, excluded_dirs: list[str] | None = None, base: str = "/music", seed: int = 42, attempts: int = C.ATTEMPTS):
        self.songs, self.edges, self.seed, self.attempts = songs, edges, seed, attempts
        self.spark, self.store = songs.sparkSession, scratch(songs.sparkSession)
        self.min_bpm, self.max_bpm, self.set_key = min_bpm, max_bpm, set_key
        self.filters = {"allowed_types": allowed_types, "excluded_dirs": excluded_dirs, "base": base}
        self.facts = self.store.write(songs.select("ord", "key", music.duration(F.col("duration_sec")).alias("seconds")), "facts")
        if isinstance(edges, Graph):  # edges of the walks' tracks are computed at each step; the pool leaves excluded folders out
            self.near = None
            self.typed = edges.limited(allowed_types)
            self.out = filters.excluded_songs(songs, excluded_dirs, base)
            return
        near = E.adjacency(filters.by_type(edges, allowed_types)).where(F.col("weight") < float("inf"))
        out = filters.excluded_songs(songs, excluded_dirs, base)
        if out is not None:
            near = near.join(out, near["other"] == out["ord"], "left_anti")
        self.near = self.store.write(near.select("node", "other", "weight"), "near")

    def pool(self, key: str | None = None) -> DataFrame:
        """Tracks that may be drawn; a segment's key counts besides the set's."""
        rows = filters.pool(self.songs, self.min_bpm, self.max_bpm, self.set_key, self.filters["excluded_dirs"], self.filters["base"])
        return (rows.where(F.col("key") == key) if key else rows).select("ord")

    def has(self, node: int) -> bool:
        return not self.facts.where(F.col("ord") == node).isEmpty()

    def seconds(self, nodes: list[int]) -> float:
        known = {r["ord"]: r["seconds"] for r in self.facts.where(F.col("ord").isin(list(set(nodes)))).collect()}
        return sum(known[n] for n in nodes)

    def starts(self, pool: DataFrame, attempts: int, key: str | None = None) -> DataFrame:
        """A start for each attempt, drawn from the pool: ``(attempt, cur)``."""
        if key:
            pool = pool.join(self.facts.where(F.col("key") == key), "ord", "left_semi")
        n = pool.count()
        if not n:
            raise NoSetlist("no track to start with meets the constraints")
        tries = self.spark.range(attempts).select(F.col("id").cast("int").alias("attempt"))
        # the least hash over the pool is a fair draw, one for each attempt
        drawn = pool.join(F.broadcast(tries), F.lit(True)).groupBy("attempt").agg(F.min_by("ord", F.struct(F.xxhash64(F.lit(self.seed), "attempt", "ord"), "ord")).alias("cur"))
        return drawn

    def walk(self, starts: DataFrame, pool: DataFrame, target: float, ending_key: str | None = None) -> DataFrame:
        """Walks from ``starts(attempt, cur)`` until each reaches ``target`` seconds or is stuck:
        (attempt, cur, visited, total).  A walk draws from the ten cheapest tracks of the pool
        it hasn't visited; past three quarters of the target, those in the ending key if any."""
        pool = self.store.write(pool.distinct(), "pool")
        pool_facts = self.facts.join(pool, "ord", "left_semi").select(F.col("ord").alias("other"), "key", "seconds")
        if self.near is None:
            if self.out is not None:
                pool_facts = pool_facts.join(self.out, F.col("other") == F.col("ord"), "left_anti")
            pool_facts = self.store.write(pool_facts, "walkable")
        else:
            near = self.store.write(self.near.join(pool_facts, "other"), "walkable")
        state = starts.join(self.facts, F.col("cur") == F.col("ord")).select("attempt", "cur", F.array("cur").alias("visited"), F.col("seconds").alias("total"), F.lit(False).alias("stuck"))
        state = self.store.write(state, "walk")
        step = 0
        going = (F.col("total") < target) & ~F.col("stuck")
        while not state.where(going).isEmpty():
            if self.near is None:
                ends = state.where(going).select(F.col("cur").alias("ord"))
                reached = self.typed.around(ends, pool_facts.select(F.col("other").alias("ord"))).where(F.col("weight") < float("inf"))
                near = self.store.write(reached.join(pool_facts, "other"), "step")
            options = state.where(going).join(near, F.col("cur") == F.col("node")).where(~F.array_contains("visited", F.col("other")))
            if ending_key:
                hit = (F.col("key") == ending_key) & (F.col("total") > C.ENDING_FROM * target)
                some = F.max(hit.cast("int")).over(Window.partitionBy("attempt"))
                options = options.withColumn("hit", hit).withColumn("some", some).where("some = 0 or hit")
            cheap = Window.partitionBy("attempt").orderBy("weight", "other")
            short = options.withColumn("n", F.row_number().over(cheap)).where(F.col("n") <= C.SHORTLIST)
            draw = F.min_by(F.struct("other", "seconds"), F.struct(F.xxhash64(F.lit(self.seed), F.lit(step), "attempt", "n"), "n")).alias("next")
            chosen = short.groupBy("attempt").agg(draw)
            moved = state.join(chosen, "attempt", "left").select(
                "attempt", F.coalesce("next.other", "cur").alias("cur"),
                F.when(F.col("next").isNotNull(), F.array_append("visited", F.col("next.other"))).otherwise(F.col("visited")).alias("visited"),
                (F.col("total") + F.coalesce("next.seconds", F.lit(0.0))).alias("total"),
                (F.col("stuck") | (going & F.col("next").isNull())).alias("stuck"),
            )
            following = self.store.write(moved, "walk")
            self.store.drop(state, near if self.near is None else None)
            state, step = following, step + 1
        return state

    def best(self, walks: DataFrame, target: float) -> list[int]:
        """The first attempt that reaches the target, else the longest, the earlier of equals."""
        reached = F.col("total") >= target
        short = F.when(~reached, F.col("total")).otherwise(0.0)
        return walks.orderBy(reached.desc(), short.desc(), "attempt").first()["visited"]

    def bridge(self, a: int, b: int) -> list[int]:
        """Tracks after ``a`` on the cheapest path to ``b``; ``b`` alone where there is none."""
        try:
            found = paths.path(self.songs, self.edges, [a, b], **self.filters)
        except NoPath:
            return [b]
        return [r["ord"] for r in found.orderBy("pos").collect()][1:]

    def segment(self, cur: int, key: str | None, target: float, ending_key: str | None = None) -> list[int]:
        """Tracks after ``cur`` on the first of several walks whose total, that of ``cur``
        included, reaches the target, else on the longest."""
        tries = self.spark.range(self.attempts).select(F.col("id").cast("int").alias("attempt"), F.lit(cur).cast("long").alias("cur"))
        return self.best(self.walk(tries, self.pool(key), target, ending_key), target)[1:]


def generate(songs: DataFrame, edges: DataFrame | Graph, target_seconds: float, *, starting_song: int | None = None, starting_key: str | None = None, ending_song: int | None = None, ending_key: str | None = None, waypoints: list[Waypoint] | None = None, attempts: int = C.ATTEMPTS, seed: int = 42, **constraints: object) -> DataFrame:
    """A setlist ``(pos, ord)`` of about ``target_seconds``.

    Without waypoints every attempt walks at once and the first to reach the target is
    taken; with an ending song the first attempt is, followed by the cheapest path to
    that song.  With waypoints, walks fill the time before each timed one, paths lead to
    the others, and a last walk fills what remains.  Tracks may recur across segments.
    """
    walks = Walks(songs, edges, seed=seed, attempts=attempts, **constraints)
    if ending_song is not None:
        ending_key = None
    for node in [starting_song, ending_song, *[w.song for w in waypoints or []]]:
        if node is not None and not walks.has(node):
            raise NotFound(f"no such track: {node}")
    pool = walks.pool()
    if pool.isEmpty():
        raise NoSetlist("no track meets the constraints")
    spark = songs.sparkSession
    if starting_song is not None:
        pool = pool.unionByName(spark.createDataFrame([(starting_song,)], "ord long"))
        tries = spark.range(attempts if not waypoints and ending_song is None else 1)
        starts = tries.select(F.col("id").cast("int").alias("attempt"), F.lit(starting_song).cast("long").alias("cur"))
    else:
        starts = walks.starts(pool, 1 if waypoints or ending_song is not None else attempts, starting_key)
    if waypoints:
        tracks = _through(walks, starts.first()["cur"], waypoints, target_seconds, ending_song, ending_key)
    else:
        tracks = walks.best(walks.walk(starts, pool, target_seconds, ending_key), target_seconds)
        if ending_song is not None and tracks[-1] != ending_song:
            tracks = tracks + walks.bridge(tracks[-1], ending_song)
    return spark.createDataFrame(list(enumerate(tracks)), "pos long, ord long")


def _through(walks: Walks, start: int, waypoints: list[Waypoint], target: float, ending_song: int | None, ending_key: str | None) -> list[int]:
    tracks, clock = [start], walks.seconds([start])
    for w in waypoints:
        if w.minute is None:
            if tracks[-1] != w.song:
                more = walks.bridge(tracks[-1], w.song)
                tracks += more
                clock += walks.seconds(more)
            continue
        fill = max(0.0, w.minute * 60 - clock - walks.seconds([w.song]))
        if fill > 0:
            tracks += walks.segment(tracks[-1], w.segment_key, fill)
        if tracks[-1] != w.song:
            tracks.append(w.song)
        clock = w.minute * 60
    if target - clock > 0:
        tracks += walks.segment(tracks[-1], None, target - clock, ending_key)
    if ending_song is not None and tracks[-1] != ending_song:
        tracks.append(ending_song)
    return tracks
