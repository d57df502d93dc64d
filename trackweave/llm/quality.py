"""Quality by compression: dictionaries of good and bad texts compete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import held_out, id_field
from trackweave.llm.fitting import Logistic, sample_per_class

#: Labelled texts of a class that are learnt from, and the longest of them in bytes.
PER_CLASS, TRAIN_BYTES = 1600, 65_536
#: Bytes of a dictionary, of a block that is compressed alone, and the level.
DICTIONARY, BLOCK, LEVEL = 262_144, 1024, 3
#: Points between which the calibration is straight.
KNOTS = 12
#: A text is predicted good from this score on.
GOOD_FROM = 0.7


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary trained on the blocks of the texts.

    Too few blocks for training give their plain content instead.
    """
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, blocks)) // 4)), blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-size:]


class Compressors:
    """Sizes of a text under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for content in (good, bad):
            known = {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **known))

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        """Bytes after compression, good and bad, and before.

        Blocks are compressed one by one, so that the dictionaries matter as much at
        the end of a long text as at its start.
        """
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.pair)
        return good, bad, len(text)


def difference(sizes: np.ndarray) -> np.ndarray:
    """How much smaller a text is under the good dictionary than under the bad one, as a
    share of its length."""
    good, bad, n = sizes.T
    return (bad - good) / (n + 1.0)


class Calibration:
    """The probability of label 1 as a function of the difference alone: a logistic
    regression on straight pieces between quantiles of the differences learnt from."""

    def __init__(self, apart: np.ndarray, label: np.ndarray, weight: np.ndarray):
        self.knots = np.unique(np.quantile(apart, np.linspace(0, 1, KNOTS + 2)[1:-1]))
        self.model = Logistic(self._pieces(apart), label, weight)

    def _pieces(self, apart: np.ndarray) -> np.ndarray:
        return np.concatenate([apart[:, None], np.maximum(0, apart[:, None] - self.knots)], axis=1)

    def __call__(self, apart: np.ndarray) -> np.ndarray:
        return self.model(self._pieces(apart))


def fit(rows: list, weights: dict) -> tuple[bytes, bytes, Calibration | None]:
    """Dictionaries of all rows (text, label), and the calibration of their sizes.

    Each half of the rows is measured with dictionaries of the other half, so the
    calibration sees texts that its dictionaries have not.
    """
    texts = [bytes(r["text"]) for r in rows]
    label = np.array([r["label"] for r in rows], float)
    fold = np.arange(len(rows)) % 2
    of = lambda keep: [dictionary([t for t, k in zip(texts, keep & (label == want)) if k]) for want in (1, 0)]
    sizes = np.zeros((len(rows), 3))
    for side in (0, 1):
        pair = Compressors(*of(fold != side))
        for i in np.flatnonzero(fold == side):
            sizes[i] = pair.sizes(texts[i])
    good, bad = of(np.ones(len(rows), bool))
    if len(set(label)) < 2:
        return good, bad, None
    return good, bad, Calibration(difference(sizes), label, np.array([weights[int(x)] for x in label]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Score of every whole text, 0 to 1, higher where label 1 is likelier.

    Each text is compressed with a dictionary of good and one of bad labelled texts;
    the difference of the sizes, as a share of the text's length, is all that the score
    depends on, calibrated on labelled rows.  Null and empty texts are scored as texts of
    no bytes; with fewer than two classes to learn from, every score is the share of
    label 1 (0.5 without labels).  Repeated rows are each returned; ids keep their type;
    bytes that are no UTF-8 are compressed as they are; an empty table gives an empty
    result; other columns are ignored.

    At most about ``per_class`` labelled texts of a class are learnt from, none over
    ``train_bytes`` and within the bytes of ``sample_per_class``; dictionaries have at most
    ``DICTIONARY`` bytes.
    Returns id, held_out, score, predicted (1 from ``GOOD_FROM`` on), size_good,
    size_bad.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    rows, counts = sample_per_class(docs, known, per_class, train_bytes, id_col, text_col, "quality")
    drawn = {c: sum(r["label"] == c for r in rows) for c in counts}
    good, bad, model = fit(rows, {c: counts[c] / max(1, drawn[c]) for c in counts})
    base = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    shared = spark.sparkContext.broadcast((good, bad, model))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = shared.value
        pair, model = Compressors(*content[:2]), content[2]
        for batch in batches:
            ids, out, text = batch.columns
            sizes = np.array([pair.sizes(t.as_py() or b"") for t in text], float).reshape(-1, 3)
            score = model(difference(sizes)) if model else np.full(len(sizes), base)
            predicted = (score >= GOOD_FROM).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, out, pa.array(score), pa.array(predicted), pa.array(sizes[:, 0].astype(np.int64)), pa.array(sizes[:, 1].astype(np.int64))],
                ["id", "held_out", "score", "predicted", "size_good", "size_bad"],
            )

    texts = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    fields = T.StructType([id_field(docs, id_col)]).add("held_out", "boolean").add("score", "double").add("predicted", "integer").add("size_good", "long").add("size_bad", "long")
    return texts.mapInArrow(each, fields).withColumnRenamed("id", id_col)
