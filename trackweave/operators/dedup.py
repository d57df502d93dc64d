"""Duplicates by content hash and by audio fingerprint, and changes on disk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave import constants as C
from trackweave.functions import music
from trackweave.scratch import scratch

#: Fingerprints in one tile of the pair join, about.
TILE = 1024


def first_per_hash(files: DataFrame, hash_col: str = "content_hash", order_col: str = "file_path") -> DataFrame:
    """The first file by path of each content hash."""
    first = Window.partitionBy(hash_col).orderBy(order_col)
    return files.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def known_hashes(songs: DataFrame) -> DataFrame:
    return songs.where("content_hash <> ''").select("content_hash").distinct()


def known_fingerprints(songs: DataFrame) -> DataFrame:
    """The last track of each fingerprint that is not empty."""
    return songs.where(F.size("fingerprint") > 0).groupBy("fingerprint").agg(F.max_by("file_path", "ord").alias("file_path"))


def new_files(disk: DataFrame, known: DataFrame) -> DataFrame:
    """First file of each hash on disk that is not known."""
    return first_per_hash(disk).join(known, "content_hash", "left_anti")


def removed_hashes(known: DataFrame, disk: DataFrame) -> DataFrame:
    return known.join(disk.select("content_hash").distinct(), "content_hash", "left_anti")


def removal_is_safe(known: DataFrame, removed: DataFrame) -> bool:
    """Whether something known would remain; an unreadable disk must not empty a library."""
    return not known.join(removed, "content_hash", "left_anti").isEmpty() or known.isEmpty()


def fingerprint_pairs(left: DataFrame, right: DataFrame | None = None, alike: float = C.FINGERPRINT_ALIKE) -> DataFrame:
    """Pairs ``(a, b, similarity)`` of ``(ord, fingerprint)`` rows, a < b within one table.

    Tiles of fingerprints are compared by exclusive-or and bit counts; one row is one
    pair of tiles, so no comparison needs more than two tiles in memory.
    """
    spark = left.sparkSession
    oriented = right is None

    def tiles(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.size("fingerprint") > 0)
        n = max(1, -(-rows.count() // TILE))
        return rows.groupBy(F.pmod(F.xxhash64("ord"), F.lit(n)).alias("t")).agg(F.collect_list(F.struct("ord", "fingerprint")).alias("rows")), n

    one, n_one = tiles(left)
    other, n_other = (one, n_one) if oriented else tiles(right)
    meet = F.explode(F.sequence(F.col("t") if oriented else F.lit(0).cast("long"), F.lit(n_other - 1).cast("long")))
    pairs = one.select(F.col("t").alias("ta"), F.col("rows").alias("a"), meet.alias("t")).join(other.select("t", F.col("rows").alias("b")), "t").select("a", "b", F.expr("ta = t").alias("same"))

    def padded(tile: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, prints = tile.flatten()
        lists = [np.asarray(p.values.to_numpy(zero_copy_only=False), np.int32).view(np.uint32) for p in prints]
        size = np.array([len(x) for x in lists])
        words = np.zeros((len(lists), size.max()), np.uint32)
        for row, x in zip(words, lists):
            row[: len(x)] = x
        return ids.to_numpy(zero_copy_only=False), words, size

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                ids_a, wa, na = padded(a.values)
                ids_b, wb, nb = padded(b.values)
                n = np.minimum(na[:, None], nb[None, :])
                equal = np.zeros(n.shape, np.int64)
                for w in range(min(wa.shape[1], wb.shape[1])):
                    equal += np.where(w < n, 32 - np.bitwise_count(wa[:, None, w] ^ wb[None, :, w]).astype(np.int64), 0)
                share = equal / (32.0 * n)
                hit = share >= alike
                if oriented and same:
                    hit &= ids_a[:, None] < ids_b[None, :]
                i, j = np.nonzero(hit)
                first, second = (np.minimum(ids_a[i], ids_b[j]), np.maximum(ids_a[i], ids_b[j])) if oriented else (ids_a[i], ids_b[j])
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(share[i, j])], ["a", "b", "similarity"])

    return pairs.mapInArrow(compare, "a long, b long, similarity double")


def greedy_fingerprints(songs: DataFrame, alike: float = C.FINGERPRINT_ALIKE) -> DataFrame:
    """Tracks kept when each, in order, is dropped if it is like one already kept.

    Tracks without a fingerprint are kept.  The kept ones are the lexicographically
    first independent set of the pairs: each round keeps tracks without an undecided
    earlier partner and drops the partners of those, until all are decided.
    """
    store = scratch(songs.sparkSession)
    pairs = store.write(fingerprint_pairs(songs.select("ord", "fingerprint"), alike=alike).select("a", "b"), "pairs")
    dropped = store.write(pairs.select(F.col("b").alias("ord")).where(F.lit(False)), "dropped")
    while not pairs.isEmpty():
        waiting = pairs.select(F.col("b").alias("x")).distinct()
        kept = pairs.select("a").distinct().join(waiting, F.col("a") == F.col("x"), "left_anti").select(F.col("a").alias("k"))
        out = store.write(pairs.join(kept, F.col("a") == F.col("k"), "left_semi").select(F.col("b").alias("ord")).distinct(), "out")
        left = pairs.join(out, pairs["a"] == out["ord"], "left_anti").join(out, F.col("b") == out["ord"], "left_anti")
        following, gone = store.write(left, "pairs"), store.write(dropped.unionByName(out), "dropped")
        store.drop(pairs, dropped)
        pairs, dropped = following, gone
    return songs.join(dropped, "ord", "left_anti")


def unlike_known(new: DataFrame, known: DataFrame, alike: float = C.FINGERPRINT_ALIKE) -> DataFrame:
    """New tracks that are like no known one; new ones are not held against each other."""
    like = fingerprint_pairs(new.select("ord", "fingerprint"), known.select("ord", "fingerprint"), alike).select(F.col("a").alias("ord")).distinct()
    return new.join(like, "ord", "left_anti")


def fingerprint_similarity_native(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("similarity", music.fingerprint_similarity(F.col(a), F.col(b)))
