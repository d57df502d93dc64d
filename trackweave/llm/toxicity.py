"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import decoded, held_out, id_field
from trackweave.llm.fitting import Logistic, sample_per_class

#: Labelled texts of a class that are learnt from, and the longest of them in bytes.
PER_CLASS, TRAIN_BYTES = 4000, 65_536
#: Terms of the vectors: those that tell of toxic texts, seen in so many of them, and so
#: many times as often as in other texts.
LEAST_TEXTS, LEAST_LIFT = 3, 4.0
#: Searches that a worker remembers; texts with one or two terms are often alike.
REMEMBERED = 5_000
#: Beginnings of words that are terms besides whole words, by their letters.
STEMS = range(4, 9)
#: Neighbours that vote, and examples in one block of the index.
NEIGHBOURS, BLOCK = 10, 64
#: A text is predicted toxic from this score on.
TOXIC_FROM = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[str]:
    """Whole words, and beginnings of words marked by a trailing ``-``."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "-" for w in words for k in STEMS if k < len(w)}


class Vocabulary:
    """The chosen terms; reads a text's terms without listing all of its stems."""

    def __init__(self, terms: list[str], idf: np.ndarray):
        self.idf = idf
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith("-")}
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("-")}
        self.starts = {s[: STEMS[0]] for s in self.stems}

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray, float, int]:
        """Terms, unit weights, their length before scaling, and the number of words."""
        tokens = _WORD.findall(text.lower())
        first, starts, words = STEMS[0], self.starts, self.words
        hits = [w for w in tokens if w in words or w[:first] in starts]
        counts: Counter = Counter()
        for w in hits:
            if (i := words.get(w)) is not None:
                counts[i] += 1
            for k in STEMS:
                if k >= len(w):
                    break
                if (i := self.stems.get(w[:k])) is not None:
                    counts[i] += 1
        terms = np.array(sorted(counts), np.int64)
        weights = np.array([(1 + math.log(counts[i])) * self.idf[i] for i in terms.tolist()])
        norm = float(np.sqrt(weights @ weights)) if len(terms) else 0.0
        return terms, weights / norm if norm else weights, norm, len(tokens)


def choose_terms(texts: list[str], label: np.ndarray) -> Vocabulary:
    """Terms over-represented in toxic texts, by the likelihood ratio of their
    document frequencies.  The ratio must exceed twice the logarithm of the number of
    terms tried, so that few pass by chance.  Inverse document frequency is that of
    all the texts."""
    total = [int((label == c).sum()) for c in (0, 1)]
    toxic_in: Counter = Counter()
    for text, y in zip(texts, label):
        if y:
            toxic_in.update(terms_of(text))
    toxic_in = Counter({t: n for t, n in toxic_in.items() if n >= LEAST_TEXTS})
    clean_in: Counter = Counter()
    for text, y in zip(texts, label):
        if not y:
            clean_in.update(terms_of(text) & toxic_in.keys())
    base = total[1] / max(1, sum(total))
    least = 2 * math.log(max(2, len(toxic_in)))
    ranked = []
    for term, toxic in toxic_in.items():
        n = toxic + clean_in[term]
        if base == 1 or toxic / total[1] < LEAST_LIFT * (n - toxic) / total[0]:
            continue
        ratio = 2 * toxic * math.log(toxic / n / base)
        if n > toxic:
            ratio += 2 * (n - toxic) * math.log((1 - toxic / n) / (1 - base))
        if ratio >= least:
            ranked.append((-ratio, term, n))
    ranked.sort()
    idf = np.array([math.log((1 + sum(total)) / (1 + n)) + 1 for _, _, n in ranked])
    return Vocabulary([t for _, t, _ in ranked], idf)


class BlockMaxIndex:
    """Postings of unit vectors, with each term's largest weight in each block.

    Examples with like terms stand near each other, so blocks differ in their bounds.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.order = sorted(range(len(vectors)), key=lambda i: tuple(vectors[i][0][np.argsort(-vectors[i][1], kind="stable")][:3].tolist()))
        self.n_blocks = -(-len(vectors) // BLOCK)
        self.largest = np.zeros((n_terms, self.n_blocks))
        #: row of a term in the postings of a block, -1 where no example there has it
        self.row = np.full((n_terms, self.n_blocks), -1, np.int32)
        self.postings: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        for block in range(self.n_blocks):
            here = self.order[block * BLOCK : (block + 1) * BLOCK]
            terms = np.unique(np.concatenate([vectors[i][0] for i in here]))
            self.row[terms, block] = np.arange(len(terms))
            weights = np.zeros((len(terms), len(here)))
            for at, i in enumerate(here):
                weights[self.row[vectors[i][0], block], at] = vectors[i][1]
            self.largest[terms, block] = weights.max(axis=1)
            self.postings.append(weights)
            self.members.append(np.array(here, np.int64))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave_out: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of largest cosine above zero, ties to the smaller number.

        Blocks are opened in the order of their bounds; once the bound of the next
        is below the k-th cosine found, no block left can hold a nearer example.
        """
        bound = weights @ self.largest[terms]
        scores, which, least = np.empty(0), np.empty(0, np.int64), 0.0
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or bound[block] * (1 + 1e-9) < least:
                break
            rows = self.row[terms, block]
            some = rows >= 0
            found = weights[some] @ self.postings[block][rows[some]]
            good = (found > 0) & (found >= least)
            good &= self.members[block] != leave_out
            if not good.any():
                continue
            scores, which = np.concatenate([scores, found[good]]), np.concatenate([which, self.members[block][good]])
            if len(scores) > k:
                best = np.lexsort((which, -scores))[:k]
                scores, which = scores[best], which[best]
            if len(scores) == k:
                least = float(scores.min())
        best = np.lexsort((which, -scores))
        return list(zip(scores[best].tolist(), which[best].tolist()))


class Model:
    def __init__(self, vocabulary: Vocabulary, index: BlockMaxIndex, ids: list[int], toxic: np.ndarray, calibrated: Logistic | None, without: float):
        self.vocabulary, self.index, self.ids, self.toxic, self.calibrated, self.without = vocabulary, index, ids, toxic, calibrated, without
        self.searched: dict = {}

    def evidence(self, vector: tuple, leave_out: int = -1) -> tuple[np.ndarray | None, list[tuple[float, int]]]:
        """What the score is calibrated on, and the neighbours found.

        Votes count by squared cosine, one clean vote of 0.1 among them; the cosine of the
        nearest, how much of the vocabulary the text holds, and its number of words, complete
        the picture: a toxic word tells less in a long text.
        """
        terms, weights, norm, words = vector
        near = self._search(terms, weights, leave_out) if len(terms) else []
        if not near:
            return None, []
        cosines, votes = np.array([s for s, _ in near]), self.toxic[[i for _, i in near]]
        share = float(cosines**2 @ votes) / (float((cosines**2).sum()) + 0.1)
        return np.array([share, share**2, cosines[0], math.log1p(norm), math.log1p(words), len(terms) ** 0.5]), near

    def _search(self, terms: np.ndarray, weights: np.ndarray, leave_out: int) -> list[tuple[float, int]]:
        if leave_out >= 0:
            return self.index.nearest(terms, weights, NEIGHBOURS, leave_out)
        key = (terms.tobytes(), weights.tobytes())
        if (near := self.searched.get(key)) is None:
            if len(self.searched) >= REMEMBERED:
                self.searched.clear()
            near = self.searched[key] = self.index.nearest(terms, weights, NEIGHBOURS)
        return near

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        seen, near = self.evidence(self.vocabulary.vector(text))
        if seen is None or self.calibrated is None:
            return self.without, near
        return float(self.calibrated(seen[None, :])[0]), near


def fit(rows: list, counts: dict) -> Model:
    """Choose terms, index the labelled texts that hold any, calibrate on each text
    searched without itself.  Texts without any term get the share of toxic ones
    among the labelled texts without any."""
    label = np.array([r["label"] for r in rows], float)
    texts = [bytes(r["text"]).decode("utf-8", "replace") for r in rows]
    vocabulary = choose_terms(texts, label)
    vectors = [vocabulary.vector(t) for t in texts]
    held = [i for i, v in enumerate(vectors) if len(v[0])]
    index = BlockMaxIndex([vectors[i][:2] for i in held], len(vocabulary.idf))
    drawn = {c: max(1, int((label == c).sum())) for c in counts}
    weight = np.array([counts[int(y)] / drawn[int(y)] for y in label])
    model = Model(vocabulary, index, [rows[i]["id"] for i in held], label[held], None, 0.0)
    seen = {i: model.evidence(vectors[i], at)[0] for at, i in enumerate(held)}
    some = [i for i in held if seen[i] is not None]
    none = np.ones(len(rows), bool)
    none[some] = False
    model.without = float(weight[none] @ label[none] + 0.01) / float(weight[none].sum() + 1) if len(rows) else 0.0
    if some and len(set(label[some])) == 2:
        model.calibrated = Logistic(np.stack([seen[i] for i in some]), label[some], weight[some])
    return model


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, train_bytes: int) -> Broadcast:
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    rows, counts = sample_per_class(docs, known, per_class, train_bytes, id_col, text_col, "toxicity")
    return docs.sparkSession.sparkContext.broadcast(fit(rows, counts))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Score of every whole text, 0 to 1, higher where label 1 is likelier.

    The ``NEIGHBOURS`` labelled texts of largest TF-IDF cosine over the selected terms,
    those over-represented in toxic texts, are found exactly with a block-max inverted
    index; other terms count for nothing, so the nearest over all terms may be others and
    a text without a selected term has no evidence; their votes, weighted by nearness, give a calibrated
    score, and they are returned as evidence.  Null and empty texts hold no term and
    score as any text without terms.  Without labels every score is 0.  Repeated rows
    are each returned; ids keep their type; bytes that are no UTF-8 count as the replacement
    character; an empty table gives an empty result; other columns are ignored.

    At most about ``per_class`` labelled texts of a class are learnt from, none over
    ``train_bytes``, which bounds the index every executor receives.
    Returns id, held_out, score, predicted (1 from ``TOXIC_FROM`` on), evidence (ids of
    the neighbours, nearest first) and cosines.
    """
    shared = _fitted(docs, labels, id_col, text_col, label_col, per_class, train_bytes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, out, text = batch.columns
            found = [model.score(t) for t in decoded(text)]
            score = np.array([s for s, _ in found])
            yield pa.RecordBatch.from_arrays(
                [
                    ids, out, pa.array(score, pa.float64()), pa.array((score >= TOXIC_FROM).astype(np.int32)),
                    pa.array([[model.ids[i] for _, i in near] for _, near in found], pa.list_(ids.type)),
                    pa.array([[s for s, _ in near] for _, near in found], pa.list_(pa.float64())),
                ],
                ["id", "held_out", "score", "predicted", "evidence", "cosines"],
            )

    texts = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    id_ = id_field(docs, id_col)
    fields = T.StructType([id_]).add("held_out", "boolean").add("score", "double").add("predicted", "integer").add("evidence", T.ArrayType(id_.dataType)).add("cosines", T.ArrayType(T.DoubleType()))
    return texts.mapInArrow(each, fields).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``docs`` without the rows that ``score_toxicity`` predicts toxic, in one pass.

    Null and empty texts hold no term and stay unless texts without terms are toxic.
    Repeated rows are judged one by one, bytes that are no UTF-8 count as the replacement
    character, an empty table stays empty, and all columns are kept as they are.
    """
    at = docs.columns.index(text_col)
    shared = _fitted(docs, labels, id_col, text_col, label_col, per_class, train_bytes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            clean = [model.score(t)[0] < TOXIC_FROM for t in decoded(batch.column(at))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
