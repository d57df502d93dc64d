"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import scratch
from trackweave.llm.vectors import children, distinct, lengths, matrix, scaled, sizes, small_batches, usable

#: Codebooks, entries of each, paths the encoder keeps, vectors they are trained on.
BOOKS, ENTRIES, BEAM, TRAIN = 8, 256, 4, 8192
#: Vectors in a block of the index, queries in a block, candidates ranked exactly for a first bound.
BLOCK, QUERIES, RERANK = 4096, 1024, 32
#: Queries whose estimates are made at a time.
STRIP = 256
#: Standard deviations that an estimate may be below what is expected.
DEVIATIONS = 3.0
ROUNDS = 8


def train(sample: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, seed: int = 7) -> np.ndarray:
    """Codebooks ``(books, entries, dims)`` of full dimension.

    Each book is fitted by k-means to what the books before leave of the unit
    vectors in the sample, encoded by the beam so far.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    out = np.zeros((books, entries, dims))
    residual = sample.copy()
    for m in range(books):
        picks = rng.choice(len(sample), entries, replace=len(sample) < entries) if len(sample) else []
        centres = residual[picks].copy() if len(sample) else np.zeros((entries, dims))
        for _ in range(ROUNDS if len(sample) else 0):
            nearest = (residual @ centres.T - 0.5 * np.einsum("ij,ij->i", centres, centres)).argmax(axis=1)
            n = np.bincount(nearest, minlength=entries)
            sums = np.zeros((entries, dims))
            np.add.at(sums, nearest, residual)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
            lost = np.flatnonzero(n == 0)
            centres[lost] = residual[rng.choice(len(residual), len(lost))]
        out[m] = centres
        codes = encode(sample, out[: m + 1])
        residual = sample - decode(codes, out[: m + 1])
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(books.shape[0]))


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes of each row: the best sum of one entry per book that a beam finds."""
    codes = np.zeros((len(x), 1, 0), np.uint8)
    residual = x[:, None, :].astype(np.float32)
    for book in books.astype(np.float32):
        squares = np.einsum("ij,ij->i", book, book)
        left = np.einsum("nbd,nbd->nb", residual, residual)
        cost = left[:, :, None] - 2 * (residual @ book.T) + squares
        flat = cost.reshape(len(x), cost.shape[1] * cost.shape[2])
        width = min(beam, flat.shape[1])
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        best = np.take_along_axis(best, np.take_along_axis(flat, best, 1).argsort(axis=1, kind="stable"), 1)
        path, entry = best // len(book), best % len(book)
        codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), entry[:, :, None].astype(np.uint8)], axis=2)
        residual = np.take_along_axis(residual, path[:, :, None], 1) - book[entry]
    return codes[:, 0, :]


def build(vectors: DataFrame, dims: int, k: int = 5) -> tuple[DataFrame, np.ndarray]:
    """The written index of all ``vectors(id, vector)`` of ``dims`` dimensions, and its codebooks.

    Codebooks are trained on at most about ``TRAIN`` vectors of least hash; every
    vector is encoded.  Exact copies share one entry that names their ``k + 1``
    smallest ids: no other copy can be among the ``k`` nearest of any query.  One
    row of the index is a block of entries: ids, vectors, codes, the norms of what the codes
    stand for, and its cosine with the vector.
    """
    spark = vectors.sparkSession
    store = scratch(spark)
    rows = store.write(distinct(vectors, k + 1).withColumn("order", F.xxhash64("vector")), "distinct")
    n = rows.count()
    share = F.col("order") / F.lit(2.0**64) + 0.5
    sample = scaled(np.array([r["vector"] for r in rows.where(share < min(1.0, TRAIN / max(1, n))).orderBy("order").limit(2 * TRAIN).select("vector").toLocalIterator()], np.float64).reshape(-1, dims))
    books = train(sample / lengths(sample)[:, None])
    shared = spark.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), dims)
            unit = x / lengths(x)[:, None]
            code = np.concatenate([encode(unit[i : i + 512], shared.value) for i in range(0, len(unit), 512)]) if len(unit) else np.empty((0, BOOKS), np.uint8)
            coded = decode(code, shared.value) if len(unit) else np.empty((0, dims))
            norm = lengths(coded)
            close = np.clip(np.einsum("ij,ij->i", unit, coded) / np.maximum(norm, 1e-12), -1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(close)], [*batch.schema.names, "code", "norm", "close"])

    blocks = max(1, -(-n // BLOCK))
    dealt = rows.select("ids", "vector", F.pmod("order", F.lit(blocks)).cast("int").alias("block"))
    encoded = dealt.mapInArrow(codes, T.StructType([*dealt.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("norm", T.DoubleType()), T.StructField("close", T.DoubleType())]))
    index = encoded.groupBy("block").agg(F.collect_list(F.struct("ids", "vector", "code", "norm", "close")).alias("entries"))
    return store.write(index, "index"), books


def search(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """The ``k`` of ``vectors`` nearest to each of ``queries`` by cosine.

    Each block of queries meets each block of the index once.  One matrix product of the
    queries with what the codes stand for scores every code; over the stored norm that
    estimates the cosine.  Where a query has no k-th yet, the best ``RERANK`` are ranked by
    exact cosine in double precision on the original vectors, which gives one; each block
    that a task looks at raises it for the next.  A code whose cosine with
    its vector is c, and the vector's with the query t, is estimated at about c t, give or
    take the part of the code that lies across; every code is ranked exactly whose
    estimate is no more than ``DEVIATIONS`` standard deviations below what a vector as near
    as the k-th would get.  Ties go to the smaller id; a query's own id is no candidate of it.

    Queries meet vectors of their own number of dimensions alone.  Vectors that are null,
    zero, or hold null or non-finite components are neither queries nor candidates; tiny and
    huge components count like any others.  A repeated query id counts once, with its least vector.  Ids are whole
    numbers.  Empty tables give an empty result; other columns are ignored.
    Returns query_id, rank (from 1), vec_id, score.
    """
    store = scratch(vectors.sparkSession)
    whole = lambda rows: usable(rows, id_col, vector_col).select(F.col("id").cast("long").alias("id"), "vector")
    asked = store.write(whole(queries).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    known = store.write(whole(vectors), "usable")
    found = None
    for dims in sizes(asked):
        part = _search(asked.where(F.size("vector") == dims), known.where(F.size("vector") == dims), dims, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(asked: DataFrame, vectors: DataFrame, dims: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each block of the index the ``k`` nearest."""
    spark = vectors.sparkSession
    store = scratch(spark)
    index, books = build(vectors, dims, k)
    parts = max(1, -(-asked.count() // QUERIES))
    packed = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("part").agg(F.collect_list(F.struct("id", "vector")).alias("asked"))
    blocks = index.select(F.max("block")).first()[0]
    everywhere = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks if blocks is not None else 0))))
    # a plan reckons with one copy of the queries, not one a block, so it would broadcast them all
    pairs = everywhere.hint("merge").join(index, "block").select("asked", "entries")
    shared = spark.sparkContext.broadcast(books.astype(np.float32))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[int, float] = {}  # the k-th cosine so far of each query, k + 1 candidates counted
        for batch in batches:
            parts = [_search_block(batch.column(0)[i].values, batch.column(1)[i].values, shared.value, dims, k, bounds) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[j] for p in parts]) if parts else [], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    with small_batches(spark, 4):
        return store.write(pairs.mapInArrow(look, "query_id long, vec_id long, score double"), "found")


def _search_block(asked: pa.StructArray, entries: pa.StructArray, books: np.ndarray, dims: int, k: int, bounds: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest ``k`` in one block of the index, for each query of one block, but for those
    that ``bounds`` has shown to be none of the nearest; raises the bounds."""
    asked_by, entry = children(asked), children(entries)
    ids = asked_by["id"].to_numpy(zero_copy_only=False)
    q = matrix(asked_by["vector"], dims)
    q_size = lengths(q)
    unit = (q / q_size[:, None]).astype(np.float32)
    x = matrix(entry["vector"], dims)
    size = lengths(x)
    codes = np.frombuffer(b"".join(entry["code"].to_pylist()), np.uint8).reshape(len(x), -1)
    coded = (decode(codes, books) / np.maximum(entry["norm"].to_numpy(zero_copy_only=False), 1e-12)[:, None]).astype(np.float32)
    close = entry["close"].to_numpy(zero_copy_only=False).astype(np.float32)
    across = (DEVIATIONS * np.sqrt(np.maximum(1 - close**2, 0) / max(1, dims - 1))).astype(np.float32)
    starts = entry["ids"].offsets.to_numpy()
    members = entry["ids"].values.to_numpy(zero_copy_only=False)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for top in range(0, len(q), STRIP):
        own = ids[top : top + STRIP].tolist()
        guess = unit[top : top + STRIP] @ coded.T
        for at, name in enumerate(own):
            row = top + at
            cosines = lambda some: (x[some] @ q[row]) / (size[some] * q_size[row])  # noqa: B023, E731
            least = bounds.get(name)
            if least is None and len(x) > RERANK:
                first = np.argpartition(-guess[at], RERANK - 1)[:RERANK]
                least = float(np.sort(cosines(first))[-min(RERANK, k + 1)])
            if least is None:
                near = np.arange(len(x))
            else:
                near = np.flatnonzero(guess[at] >= close * np.float32(least) - across * np.float32(np.sqrt(max(0.0, 1 - least**2))) - np.float32(1e-5))
            exact = cosines(near)
            if len(near) > k + 1:
                keep = exact >= max(np.partition(exact, -(k + 1))[-(k + 1)], -2.0 if least is None else least - 1e-9)
                near, exact = near[keep], exact[keep]
                if len(near) > k:  # k others at least are as near, the query itself left out
                    bounds[name] = max(bounds.get(name, -1.0), float(exact.min()))
            found, scores = _spread(near, exact, starts, members)
            other = found != name
            found, scores = found[other], scores[other]
            best = np.lexsort((found, -scores))[:k]
            out.append((np.full(len(best), name), found[best], scores[best]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def _spread(near: np.ndarray, exact: np.ndarray, starts: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the entries ``near``, each with its entry's cosine."""
    n = starts[near + 1] - starts[near]
    at = np.repeat(starts[near] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return members[at], np.repeat(exact, n)
