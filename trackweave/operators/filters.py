"""Predicates on tracks and edges that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions import music, text
from trackweave.operators.graph import Graph


class NotFound(LookupError):
    """A track that the library doesn't hold."""


class NoPath(LookupError):
    """Two tracks that no usable edges connect."""


def excluded_songs(songs: DataFrame, excluded_dirs: list[str] | None, base: str) -> DataFrame | None:
    """``(ord)`` of tracks in an excluded folder; None where nothing is excluded."""
    if not excluded_dirs:
        return None
    return songs.where(text.dir_excluded(text.relative_dir(F.col("file_path"), base), excluded_dirs)).select("ord")


def by_type(edges: DataFrame, allowed_types: list[str] | None) -> DataFrame:
    """Edges of allowed types; a missing type is direct, an empty list allows all."""
    return edges.where(F.coalesce("edge_type", F.lit("direct")).isin(list(allowed_types))) if allowed_types else edges


def usable_edges(songs: DataFrame, edges: DataFrame | Graph, allowed_types: list[str] | None = None, excluded_dirs: list[str] | None = None, base: str = "/music") -> DataFrame | Graph:
    """Edges of allowed types that touch no excluded folder."""
    if isinstance(edges, Graph):
        return edges.limited(allowed_types, excluded_songs(songs, excluded_dirs, base))
    edges = by_type(edges, allowed_types)
    out = excluded_songs(songs, excluded_dirs, base)
    if out is None:
        return edges
    return edges.join(out, edges["src"] == out["ord"], "left_anti").join(out, edges["dst"] == out["ord"], "left_anti")


def pool(songs: DataFrame, min_bpm: float = 0.0, max_bpm: float = 999.0, set_key: str | None = None, excluded_dirs: list[str] | None = None, base: str = "/music") -> DataFrame:
    """Tracks a setlist may hold: tempo range and key, outside excluded folders."""
    rows = songs.where(F.col("bpm").between(min_bpm, max_bpm))
    if set_key:
        rows = rows.where(F.col("key") == set_key)
    if excluded_dirs:
        rows = rows.where(~text.dir_excluded(text.relative_dir(F.col("file_path"), base), excluded_dirs))
    return rows


def find(songs: DataFrame, identifier: str) -> int:
    """``ord`` of a track by path, else by file name (the last one of that name), else by
    the path in canonical form; raises ``NotFound``."""
    rank = (
        F.when(F.col("file_path") == identifier, 1).when(F.col("filename") == identifier, 2)
        .when(text.canonical_path(F.col("file_path")) == text.canonical_path(F.lit(identifier)), 3)
    )
    hit = songs.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.desc("ord")).select("ord").first()
    if hit is None:
        raise NotFound(f"no such track: {identifier}")
    return hit["ord"]


def active(songs: DataFrame, active_dirs: list[str], base: str) -> DataFrame:
    """Tracks whose folder or one above it is active; those at the top always are."""
    rel = text.relative_dir(F.col("file_path"), base)
    return songs.where((rel == ".") | F.exists(text.ancestors(rel), lambda d: d.isin(list(active_dirs))))


def inactive_dirs(all_dirs: DataFrame, active_dirs: DataFrame) -> DataFrame:
    """Folders that are not active, as the excluded ones."""
    return all_dirs.select("path").exceptAll(active_dirs.select("path"))


def key_conflicts(songs: DataFrame, set_key: str | None) -> DataFrame:
    """Tracks of another key than the set's; none without a set key."""
    return songs.where(F.col("key") != set_key) if set_key else songs.where(F.lit(False))


def with_duration(songs: DataFrame) -> DataFrame:
    return songs.withColumn("seconds", music.duration(F.col("duration_sec")))
