"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import connected_components, scratch, spread, tile_pairs
from trackweave.llm.vectors import children, comparable, lengths, matrix, sizes, small_batches, usable

#: Blocks of dimensions, leading dimensions of each that name a cell, vectors in a tile.
#: Every block sends each vector to all that its cell touches, so few blocks and large tiles
#: keep copies few.
BLOCKS, GRID, TILE = 2, 2, 4096
#: Rows of a tile that are compared with the other tile at a time.
STRIP = 256
#: Slack against rounding, far above what double precision needs.
EPSILON = 1e-6


class Subspaces:
    """A rotation, its blocks of dimensions, and each block's share of the budget.

    The rotation is to principal axes, dealt to the blocks in turn, so every block
    leads with a wide axis.  Unit vectors of cosine c are 2 - 2c apart in square; if
    they are within the whole budget, then in some block they are within its share,
    whatever the shares.  Shares go by the blocks' variance.
    """

    def __init__(self, second: np.ndarray, cosine: float, blocks: int = BLOCKS, grid: int = GRID):
        values, axes = np.linalg.eigh(second)
        order = np.argsort(-values, kind="stable")
        self.axes = [axes[:, order[b::blocks]] for b in range(min(blocks, len(values)))]
        weight = np.array([max(values[order[b::blocks]].sum(), 1e-9) for b in range(len(self.axes))])
        self.budget = (2 - 2 * cosine) * (1 + EPSILON) * weight / weight.sum() + 1e-12
        self.grid = grid

    def coordinates(self, unit: np.ndarray, block: int) -> np.ndarray:
        return unit @ self.axes[block]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Each row's cell in each block, as one number: its place on the block's leading
        axes in steps of the block's radius, so partners lie in cells that touch."""
        out = np.zeros((len(unit), len(self.axes)), np.int64)
        for b, axes in enumerate(self.axes):
            width = np.sqrt(self.budget[b]) * (1 + EPSILON)
            for g in range(min(self.grid, axes.shape[1])):
                out[:, b] = out[:, b] * CELL + np.floor(unit @ axes[:, g] / width).astype(np.int64) + CELL // 2
        return out


#: What a squared distance of unit vectors in single precision may be off by, and more.
SINGLE = 1e-5
#: Steps on one axis of the grid, more than any unit vector can need.
CELL = 1 << 20


def _second_moment(rows: DataFrame, dims: int) -> np.ndarray:
    """Mean outer product of the unit vectors, summed over partitions first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0), dims)
            unit = x / lengths(x)[:, None]
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

    sums = rows.select("vector").mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(dims * dims)
    for r in sums:
        out[r["i"]] = r["v"]
    return out.reshape(dims, dims) / max(1.0, np.trace(out.reshape(dims, dims)))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links of every vector with others of cosine ``cosine`` or more, and its group.

    Exact copies are one class; classes are joined and every member gets its class's
    links.  In each block of the rotated dimensions, tiles of vectors whose cells
    touch are joined.  Pairs within the block's budget are verified by exact cosine in
    double precision on the original vectors, and a pair that an earlier block finds
    too is left to that one, so each link is counted once and pairs are never written:
    a tile pair yields sums of links and as many edges as connect the same vectors.

    Vectors of each number of dimensions are joined among themselves.  Vectors that are
    null, zero, or hold null or non-finite components link with nothing and are groups of
    their own; components are scaled by powers of two, so tiny and huge ones count like any
    others.  Rows of one id are compared like any others.  Ids are whole numbers.  An empty
    table gives an empty result; other columns are ignored.
    Returns id, n_links, component_id (smallest id reachable), kept.
    """
    store = scratch(vectors.sparkSession)
    rows = store.write(usable(vectors, id_col, vector_col).select(F.col("id").cast("long").alias("id"), "vector"), "usable")
    classes = store.write(rows.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    fits = comparable(F.col(vector_col)) & F.col(id_col).isNotNull()
    out = vectors.where(~F.coalesce(fits, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    for dims in sizes(classes):
        named = _classes(classes.where(F.size("vector") == dims), dims, cosine).withColumnRenamed("vector", "of")
        out = out.unionByName(rows.where(F.size("vector") == dims).join(named, F.col("vector") == F.col("of")).select("id", "n_links", "component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def _classes(classes: DataFrame, dims: int, cosine: float) -> DataFrame:
    """``(vector, n_links, component_id)`` of distinct vectors of ``dims`` dimensions."""
    spark = classes.sparkSession
    store = scratch(spark)
    shared = spark.sparkContext.broadcast(Subspaces(_second_moment(classes, dims), cosine))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), dims)
            cells = shared.value.cells(x / lengths(x)[:, None])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

    located = classes.mapInArrow(locate, T.StructType([*classes.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))]))
    located = located.select("rep", "copies", "vector", F.posexplode("cells").alias("block", "cell"))
    dealt = spread(located, ["block", "cell"], F.col("rep"), TILE)
    tiles = store.write(dealt.groupBy("block", "cell", "sub").agg(F.collect_list(F.struct("rep", "copies", "vector")).alias("tile")), "tiles")
    steps = [sum(d * CELL**g for g, d in enumerate(delta)) for delta in product((-1, 0, 1), repeat=GRID)]
    pairs = tile_pairs(tiles, ["block"], "cell", [s for s in steps if s >= 0], "tile")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_link_tiles(batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].values, batch.column(3)[i].as_py(), shared.value, cosine, dims) for i in range(batch.num_rows)]
            a, b, n = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    with small_batches(spark, 4):
        found = store.write(pairs.select("block", "one", "other", "same").mapInArrow(link, "a long, b long, n long"), "links")
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("n = 0").select("a", "b"))
    return (
        classes.join(links, F.col("rep") == links["a"], "left").join(groups, F.col("rep") == groups["id"], "left")
        .select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )


def _link_tiles(block: int, one: pa.StructArray, other: pa.StructArray, same: bool, spaces: Subspaces, cosine: float, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, null, links of a) and (a, b, 0) for edges, of the links this block owns."""
    sides = []
    for tile in (one, other):
        part = children(tile)
        x = matrix(part["vector"], dims)
        sides.append((part["rep"].to_numpy(zero_copy_only=False), part["copies"].to_numpy(zero_copy_only=False), x, lengths(x)))
    (ra, wa, xa, la), (rb, wb, xb, lb) = sides
    ua, ub = xa / la[:, None], xb / lb[:, None]
    va, vb = spaces.coordinates(ua, block), spaces.coordinates(ub, block)
    # one product of single precision gives all squared distances; those near the budget are judged again in double
    left = np.concatenate([va, (va**2).sum(axis=1, keepdims=True), np.ones((len(va), 1))], axis=1).astype(np.float32)
    right = np.concatenate([-2 * vb, np.ones((len(vb), 1)), (vb**2).sum(axis=1, keepdims=True)], axis=1).astype(np.float32)
    na, nb = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
    shift, n = (0, len(ra)) if same else (len(ra), len(ra) + len(rb))
    edges = np.empty((0, 2), np.int64)
    for top in range(0, len(ra), STRIP):
        first = top if same else 0
        near = left[top : top + STRIP] @ right[first:].T <= np.float32(spaces.budget[block] + SINGLE)
        if not near.any():
            continue
        i, j = np.nonzero(near)
        i, j = i + top, j + first
        if same:
            i, j = i[i < j], j[i < j]
        keep = np.empty(len(i), bool)
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            ok = np.einsum("ij,ij->i", xa[a], xb[b]) / (la[a] * lb[b]) >= cosine
            ok &= _within(spaces, ua[a], ub[b], block)
            for earlier in range(block):
                some = np.flatnonzero(ok)
                ok[some] &= ~_within(spaces, ua[a[some]], ub[b[some]], earlier)
            keep[at : at + (1 << 14)] = ok
        i, j = i[keep], j[keep]
        na += np.bincount(i, wb[j], len(ra)).astype(np.int64)
        nb += np.bincount(j, wa[i], len(rb)).astype(np.int64)
        edges = np.concatenate([edges, np.stack([i, j + shift], 1)])
        edges = _forest(edges[:, 0], edges[:, 1], n)
    names = ra if same else np.concatenate([ra, rb])
    a = np.concatenate([ra[na > 0], rb[nb > 0], names[edges[:, 0]]])
    b = np.concatenate([ra[na > 0], rb[nb > 0], names[edges[:, 1]]])
    return a, b, np.concatenate([na[na > 0], nb[nb > 0], np.zeros(len(edges), np.int64)])


def _within(spaces: Subspaces, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
    """Whether pairs of rows are within a block's budget, the same whichever tile asks."""
    p = np.einsum("ij,jk->ik", a - b, spaces.axes[block])
    return np.einsum("ij,ij->i", p, p) <= spaces.budget[block]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """At most one edge for each node that connect what the edges (i, j) connect."""
    if len(i) <= n:
        return np.stack([i, j], 1)
    label = np.arange(n)
    while True:
        after = label.copy()
        np.minimum.at(after, i, label[j])
        np.minimum.at(after, j, label[i])
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([moved, label[moved]], 1)
