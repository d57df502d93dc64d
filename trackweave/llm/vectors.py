"""What the operators on vectors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def comparable(v: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component,
    some component not zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, vector)`` of comparable rows with an id."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return rows.where(F.col("id").isNotNull() & comparable(F.col("vector")))


def sizes(rows: DataFrame) -> list[int]:
    """The numbers of dimensions that the vectors have; only vectors of one size have a cosine."""
    return sorted(r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().collect())


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors, each with its ``keep`` smallest ids.

    All but the smallest ids are left out before any shuffle, so a vector that a
    third of all rows hold is no burden.
    """
    first = Window.partitionBy("vector").orderBy("id")
    small = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    return small.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def children(rows: pa.StructArray) -> dict[str, pa.Array]:
    """Fields of a struct array by name, of the slice alone."""
    return dict(zip([f.name for f in rows.type], rows.flatten()))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as ``scaled`` doubles."""
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component between a half and
    one: no cosine changes by it, and no square is lost to underflow or overflow."""
    largest = np.abs(x).max(axis=1, initial=0.0)
    return np.ldexp(x, -np.frexp(largest)[1][:, None])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows while rows hold whole tiles."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
