"""The edge table: a band self-join on tempo ratio with a composite cost.

A pair (a, b) with ``a.ord < b.ord`` has an edge if a's tempo is within 8 percent of
one of five factors of b's.  The factors' windows are disjoint, so a pair matches one
at most.  The bands are turned into equi-joins on logarithmic tempo buckets, and two
physical forms compute the same rows:

* ``native``: one row per candidate pair, everything in column expressions;
* ``blocked``: buckets are packed into tiles and each pair of tiles is one row, whose
  cosines are one matrix product over Arrow.  It never has more than one tile pair in
  memory and shuffles each vector a bounded number of times, however many edges it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave import constants as C
from trackweave.functions import music
from trackweave.scratch import scratch

#: Width of a tempo bucket: a ratio within 8 percent moves the logarithm by less.
WIDTH = math.log(1 + C.MAX_TEMPO_PCT / 100 + 1e-4)
#: Tracks in one tile, about, and those of them that are compared with another tile at a time:
#: larger tiles are sent less often.
TILE, STRIP = 4096, 128
#: Edges of two tiles from which they are put in the order of their weights, and so many at most at
#: a time: weights have six places, so there are several of each, which files hold once.
LEAST_SORTED, MOST_SORTED = 2 << 20, 8 << 20
#: Edges in a batch of those.
BATCH = 1 << 18
#: Largest ratio of two tempi that match, and slack against rounding.
RATIO = 1 + C.MAX_TEMPO_PCT / 100 + 1e-6


def _bucket(bpm: Column, factor: float = 1.0) -> Column:
    return F.floor(F.log(bpm * factor) / F.lit(WIDTH)).cast("long")


def prepare(songs: DataFrame, strict: bool = True) -> DataFrame:
    """What pairs are made of: order, tempo, place on the circle of fifths, unit vector."""
    return songs.select("ord", "bpm", music.key_position(F.col("key"), strict).cast("double").alias("pos"), music.unit(F.col("embedding")).alias("unit")).where("bpm > 0")


def _factors(direct_only: bool) -> list[tuple[float, str]]:
    return [f for f in C.TEMPO_FACTORS if not direct_only or f[1] == "direct"]


def tempo_matches(left: DataFrame, right: DataFrame, direct_only: bool = False, oriented: bool = True) -> DataFrame:
    """Pairs ``(a.*, b.*, edge_type, tempo)`` in the band of some factor.

    Columns of ``left`` and ``right`` are prefixed ``a_`` and ``b_``.  ``oriented``
    keeps a.ord < b.ord.
    """
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns]).withColumn("k", _bucket(F.col("a_bpm")))
    factors = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(t).alias("edge_type")) for f, t in _factors(direct_only)])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns]).withColumn("f", F.explode(factors))
    b = b.withColumn("scaled", F.col("b_bpm") * F.col("f.factor")).withColumn("k", F.explode(F.array(*[_bucket(F.col("scaled")) + d for d in (-1, 0, 1)])))
    within = music.tempo_pct(F.col("a_bpm"), F.col("scaled")) <= C.MAX_TEMPO_PCT
    pairs = a.join(b, "k").where(within & (F.col("a_ord") < F.col("b_ord")) if oriented else within)
    return pairs.withColumn("tempo", music.tempo_pct(F.col("a_bpm"), F.col("scaled")) / C.MAX_TEMPO_PCT).withColumn("edge_type", F.col("f.edge_type")).drop("k", "f", "scaled")


def _native(left: DataFrame, right: DataFrame, direct_only: bool, oriented: bool) -> DataFrame:
    pairs = tempo_matches(left, right, direct_only, oriented)
    cosine = F.aggregate(F.zip_with("a_unit", "b_unit", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.select(
        F.col("a_ord").alias("src"), F.col("b_ord").alias("dst"), "edge_type",
        music.harmonic_distance(F.col("a_pos"), F.col("b_pos")).alias("harmonic"), "tempo",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - cosine) / 2)).alias("semantic"),
    )


def plain(songs: DataFrame, strict: bool = True) -> DataFrame:
    """What ``prepare`` gives, with vectors as they are: half as large as doubles."""
    return songs.select("ord", "bpm", music.key_position(F.col("key"), strict).cast("double").alias("pos"), F.col("embedding").alias("vector")).where("bpm > 0")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``k`` and ``s``, the tempo bucket and the part of it that name their tile."""
    keyed = rows.withColumn("k", _bucket(F.col("bpm")))
    crowds = keyed.groupBy("k").agg(F.ceil(F.count("*") / TILE).alias("n"))
    # a bucket is 8 percent wide: a few hundred cover any tempo
    return keyed.join(F.broadcast(crowds), "k").withColumn("s", F.pmod(F.xxhash64("ord"), F.col("n"))).drop("n")


def units(vectors: pa.ListArray, n: int) -> np.ndarray:
    """Vectors as doubles at length one; zero vectors stay zero."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(length > 0, length, 1.0)[:, None]


def sized_units(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """``units`` of vectors that may differ in size, filled up with zeros, and their sizes; -1 and
    zeros where a vector or a component is null."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, count = vectors.flatten(), np.maximum(sizes, 0)
    x = np.zeros((len(sizes), int(count.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), count)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = flat.to_numpy(zero_copy_only=False)
    sizes[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    x[sizes < 0] = 0.0
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    with np.errstate(invalid="ignore"):
        return x / np.where(length > 0, length, 1.0)[:, None], sizes


def _order(keys: np.ndarray) -> np.ndarray:
    """Places of ``keys``, 32 bits each, in their order."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    return order[np.argsort((keys >> 16).astype(np.uint16)[order], kind="stable")]


def _blocked(left: DataFrame, right: DataFrame, direct_only: bool, oriented: bool, by: dict | None = None) -> DataFrame:
    def tiles(rows: DataFrame) -> DataFrame:
        return placed(rows).groupBy("k", "s").agg(F.collect_list(F.struct("ord", "bpm", "pos", "vector")).alias("tile"), F.min("bpm").alias("lo"), F.max("bpm").alias("hi"))

    one, other = tiles(left), tiles(right)
    factors = _factors(direct_only)
    # the second track's tempo times a factor lies in one of two buckets shifted by the factor's own
    shifts = [[d + e for d in (-1, 0, 1) for e in (math.floor(math.log(f) / WIDTH), math.floor(math.log(f) / WIDTH) + 1)] for f, _ in factors]
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.lit(f).alias("factor"), F.lit(s).cast("long").alias("shift")) for i, ((f, _), near) in enumerate(zip(factors, shifts)) for s in sorted(set(near))]))
    # names meet first, and tiles follow by their whole names: a bucket that many tracks share
    # does not have all its pairs in one task, and no tile is copied for partners it lacks
    store = scratch(left.sparkSession)
    one = store.write(one, "tiles")
    other = one if right is left else store.write(other, "tiles")
    b = other.select(F.col("k").alias("kb"), F.col("s").alias("sb"), "lo", "hi", moves.alias("m"))
    b = b.select("kb", "sb", "m.f", (F.col("lo") * F.col("m.factor")).alias("lo_b"), (F.col("hi") * F.col("m.factor")).alias("hi_b"), (F.col("kb") + F.col("m.shift")).alias("ka"))
    touch = (F.col("lo") <= F.col("hi_b") * RATIO) & (F.col("lo_b") <= F.col("hi") * RATIO)
    met = one.select(F.col("k").alias("ka"), F.col("s").alias("sa"), "lo", "hi").join(b, "ka").where(touch).select("ka", "sa", "kb", "sb", "f")
    met = met.join(one.select(F.col("k").alias("ka"), F.col("s").alias("sa"), F.col("tile").alias("a")), ["ka", "sa"])
    pairs = met.join(other.select(F.col("k").alias("kb"), F.col("s").alias("sb"), F.col("tile").alias("b")), ["kb", "sb"]).select("f", "a", "b")
    types = [t for _, t in factors]

    def columns(tile: pa.StructArray) -> tuple[np.ndarray, ...]:
        ord_, bpm, pos, vector = tile.flatten()
        return ord_.to_numpy(zero_copy_only=False), bpm.to_numpy(zero_copy_only=False), pos.to_numpy(zero_copy_only=False), *sized_units(vector)

    def apart(f: int, one: tuple, other: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Harmonic and tempo distance."""
        arc = np.abs(one[2][i] - other[2][j])
        x, y = one[1][i], other[1][j] * factors[f][0]
        return np.minimum(arc, 12 - arc) / 6.0, np.abs(x - y) / np.minimum(x, y) * 100.0 / C.MAX_TEMPO_PCT

    def found(f: int, one: tuple, other: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in the two tiles and semantic distance of their edges, strip by strip."""
        bpm_b = (other[1] * factors[f][0])[None, :]
        dims = min(one[3].shape[1], other[3].shape[1])
        for top in range(0, len(one[0]), STRIP):
            ord_a, bpm_a, _, unit_a, size_a = (c[top : top + STRIP] for c in one)
            x = bpm_a[:, None]
            hit = np.abs(x - bpm_b) / np.minimum(x, bpm_b) * 100.0 <= C.MAX_TEMPO_PCT
            if oriented:
                hit &= ord_a[:, None] < other[0][None, :]
            i, j = np.nonzero(hit)
            if len(i):
                cosine = np.where(size_a[i] == other[4][j], (unit_a[:, :dims] @ other[3][:, :dims].T)[i, j], 0.0)
                yield i + top, j, np.fmax(0.0, np.fmin(1.0, (1 - cosine) / 2))  # 1 where it is no number, as in SQL

    def edges(f: int, one: tuple, other: tuple, i: np.ndarray, j: np.ndarray, semantic: np.ndarray) -> pa.RecordBatch:
        harmonic, tempo = apart(f, one, other, i, j)
        kind = pa.DictionaryArray.from_arrays(np.zeros(len(i), np.int32), [types[f]]).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(one[0][i]), pa.array(other[0][j]), kind, pa.array(harmonic, from_pandas=True), pa.array(tempo), pa.array(semantic)], ["src", "dst", "edge_type", "harmonic", "tempo", "semantic"])

    def ordered(f: int, one: tuple, other: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        i, j, semantic, keys = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = _order(keys) if len(i) >= LEAST_SORTED else np.arange(len(i))
        for top in range(0, len(order), BATCH):
            at = order[top : top + BATCH]
            yield edges(f, one, other, i[at], j[at], semantic[at])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                one, other = columns(a.values), columns(b.values)
                held, n = [], 0
                for i, j, semantic in found(f, one, other):
                    if by is None:
                        yield edges(f, one, other, i, j, semantic)
                        continue
                    harmonic, tempo = apart(f, one, other, i, j)
                    cost = harmonic * by["harmonic"] + tempo * by["tempo"] + semantic * by["semantic"]
                    held.append((i.astype(np.int32), j.astype(np.int32), semantic, np.clip(np.nan_to_num(cost) * 1e6 + 0.5, 0, 2**32 - 1).astype(np.uint32)))
                    n += len(i)
                    if n >= MOST_SORTED:
                        yield from ordered(f, one, other, held)
                        n = 0
                if held:
                    yield from ordered(f, one, other, held)

    return pairs.mapInArrow(cross, "src long, dst long, edge_type string, harmonic double, tempo double, semantic double")


def components(songs: DataFrame, other: DataFrame | None = None, direct_only: bool = False, method: str = "blocked", strict: bool = True, by: dict | None = None) -> DataFrame:
    """``(src, dst, edge_type, harmonic, tempo, semantic)`` of all pairs with an edge.

    With ``other`` the pairs are (song of ``songs``, song of ``other``), unordered by ord.
    An invalid key is an error, or a null ``harmonic`` if not ``strict``.  The blocked form gives
    many edges of two tiles in the order of their cost under weights ``by``, if any, and so rounded
    costs take less room where they are written.
    """
    form = {"native": prepare, "blocked": plain}[method]
    left = form(songs, strict)
    right = left if other is None else form(other, strict)
    if method == "native":
        return _native(left, right, direct_only, other is None)
    return _blocked(left, right, direct_only, other is None, by)


def components_of(pairs: DataFrame, songs: DataFrame) -> DataFrame:
    """``pairs(src, dst, edge_type, ...)`` with the components of their edges, whichever of
    the two tracks is faster by a factor of the type."""
    rows = prepare(songs)
    a, b = (rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns]) for s in ("a", "b"))
    met = pairs.join(a, F.col("src") == F.col("a_ord")).join(b, F.col("dst") == F.col("b_ord"))
    pct = None
    for factor, name in C.TEMPO_FACTORS:
        for x, y in (("a_bpm", "b_bpm"), ("b_bpm", "a_bpm")):
            here = F.when(F.col("edge_type") == name, music.tempo_pct(F.col(x), F.col(y) * factor))
            pct = here if pct is None else F.least(pct, here)
    cosine = F.aggregate(F.zip_with("a_unit", "b_unit", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return met.select(
        *pairs.columns, music.harmonic_distance(F.col("a_pos"), F.col("b_pos")).alias("harmonic"), (pct / C.MAX_TEMPO_PCT).alias("tempo"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.coalesce(cosine, F.lit(0.0))) / 2)).alias("semantic"),
    )


def weigh(parts: DataFrame, weights: dict | None = None, penalties: dict | None = None) -> DataFrame:
    """Edges from their components; new weights need no new join."""
    cost = music.composite(F.col("harmonic"), F.col("tempo"), F.col("semantic"), F.col("edge_type"), weights, penalties)
    return parts.select("src", "dst", cost.alias("weight"), "edge_type", "harmonic", "tempo", "semantic")


def build(songs: DataFrame, weights: dict | None = None, penalties: dict | None = None, direct_only: bool = False, method: str = "blocked") -> DataFrame:
    return weigh(components(songs, direct_only=direct_only, method=method, by=C.WEIGHTS | (weights or {})), weights, penalties)


def build_incremental(new: DataFrame, old: DataFrame, weights: dict | None = None, penalties: dict | None = None, direct_only: bool = False, method: str = "blocked") -> tuple[DataFrame, DataFrame]:
    """Edges of new with old tracks, the new one first, and of new tracks among themselves."""
    by = C.WEIGHTS | (weights or {})
    cross = components(new, old, direct_only, method, by=by)
    inner = components(new, direct_only=direct_only, method=method, by=by)
    return weigh(cross, weights, penalties), weigh(inner, weights, penalties)


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, as ``(node, other, weight, edge_type)``."""
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight", "edge_type")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight", "edge_type")
    return there.unionByName(back)
