"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import held_out


#: Rows of all classes together, and bytes of their texts, that reach the driver at most.
MOST_ROWS, MOST_BYTES = 1 << 16, 48 << 20


def sample_per_class(docs: DataFrame, labels: DataFrame, per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text", salt: str = "fit", class_bytes: int = 24 << 20) -> tuple[list, dict]:
    """About ``per_class`` rows (id, text in bytes, label) of each class of ``labels(id, label)``.

    Ids whose crc32 leaves 2 modulo 4 are never taken, nor are texts over ``max_bytes``.
    A class gives no more than ``class_bytes``, and all classes together no more than
    ``MOST_ROWS`` rows and ``MOST_BYTES`` bytes, in equal shares: with more classes each
    is learnt from fewer texts, none is left out.  The sample is the rows of least hash, so
    reruns agree.  Null ids and labels are left out; a repeated id counts once, with its
    least label and text, before anything is collected.  Also returns the number of rows
    of each class.
    """
    share = F.xxhash64(F.lit(salt), F.col("id")) / F.lit(2.0**64) + 0.5
    known = labels.select(F.col(id_col).alias("id"), "label").where(F.col("label").isNotNull() & ~held_out(F.col("id")) & F.col("id").isNotNull())
    counts = known.groupBy("label").count()
    sizes = {r["label"]: r["count"] for r in counts.collect()}
    if not sizes:
        return [], {}
    each = max(1, min(per_class, MOST_ROWS // len(sizes)))
    least = F.broadcast(counts.select(F.col("label").alias("class"), (F.lit(float(each)) / F.col("count")).alias("least")))
    picked = known.join(least, F.col("label") == F.col("class")).where(share < F.col("least")).groupBy("id").agg(F.min("label").alias("label")).select(F.col("id").alias("of"), "label")
    texts = docs.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= max_bytes)).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(picked), F.col("id") == F.col("of")).groupBy("id", "label").agg(F.min("text").alias("text"))
    upto = Window.partitionBy("label").orderBy(share, "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = min(class_bytes, MOST_BYTES // len(sizes))
    fits = rows.withColumn("upto", F.sum(F.octet_length("text")).over(upto)).where(F.col("upto") <= F.greatest(F.lit(room), F.octet_length("text")))
    return sorted(fits.select("id", "text", "label").collect(), key=lambda r: str(r["id"])), sizes


class Logistic:
    """Weighted logistic regression with a small ridge, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z, w = self._standard(x), weight / weight.sum()
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        self.beta = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = self._sigmoid(z @ self.beta)
            slope = z.T @ (w * (p - y)) + penalty * self.beta
            curve = (z * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty)
            move = np.linalg.solve(curve, slope)
            self.beta -= move / max(1.0, float(np.abs(move).max()) / 4)
            if np.abs(move).max() < 1e-9:
                break

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], axis=1)

    @staticmethod
    def _sigmoid(t: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(t, -35, 35)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._standard(x) @ self.beta)
