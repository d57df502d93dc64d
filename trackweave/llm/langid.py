"""Language identification by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import held_out, id_field
from trackweave.llm.fitting import sample_per_class

#: Longest context, in bytes.
ORDER = 3
#: Training texts of a language, the longest of them and all of them together in bytes.
PER_LANGUAGE, TRAIN_BYTES, LANGUAGE_BYTES = 400, 65_536, 2 << 20
#: Bytes that are scored at a time.
BLOCK = 1 << 20
#: Bits that count as one in the posterior, since neighbouring bytes are no independent evidence.
TEMPERATURE = 8.0
PAD = b"\n" * ORDER
UNKNOWN = "und"


class Tree:
    """The context tree of one language, as code lengths in bits.

    ``one[context, symbol]`` holds all of order one, escapes included.  For longer
    contexts ``known`` has the (context, symbol) codes that were seen, sorted, with their
    ``bits``, and ``contexts`` those that were seen with the cost of leaving them, so a
    symbol not seen there costs that and what the next shorter context says.
    """

    def __init__(self, stream: np.ndarray, width: int):
        self.width = width
        counts = [_counts(stream, width, k) for k in range(ORDER + 1)]
        p = self._refine(np.full((1, width), 1.0 / width), np.zeros(1, np.int64), counts[0])
        self.one = self._refine(np.repeat(p, width, 0), np.arange(width), counts[1])
        with np.errstate(divide="ignore"):
            self.one = -np.log2(self.one)
        self.longer = []
        for code, n in counts[2:]:
            contexts, at = np.unique(code // width, return_inverse=True)
            total, kinds = np.bincount(at, n), np.bincount(at)
            left = 1.0 - np.bincount(at, np.exp2(-self.bits(code)))
            leave = -np.log2(kinds / (total + kinds) / np.maximum(left, 1e-12))
            self.longer.append((code, -np.log2(n / (total[at] + kinds[at])), contexts, leave))

    def _refine(self, shorter: np.ndarray, contexts: np.ndarray, seen: tuple) -> np.ndarray:
        """Probabilities in all ``contexts`` from those one symbol shorter."""
        code, n = seen
        at, symbol = code // self.width, code % self.width
        total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
        left = 1.0 - np.bincount(at, shorter[at, symbol], len(contexts))
        out = shorter.copy()
        known = kinds > 0
        out[known] *= (kinds[known] / (total[known] + kinds[known]) / np.maximum(left[known], 1e-12))[:, None]
        out[at, symbol] = n / (total[at] + kinds[at])
        return out

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Exact code lengths of (context, symbol) codes, under the orders built so far."""
        cost = self.one[code // self.width % self.width, code % self.width]
        for order, (known, bits, contexts, leave) in enumerate(self.longer, 2):
            pair = code % self.width ** (order + 1)
            at, there = _find(known, pair)
            up, met = _find(contexts, pair // self.width)
            cost = np.where(there, bits[at], cost + np.where(met, leave[up], 0.0))
        return cost


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _counts(symbols: np.ndarray, width: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, symbol) codes of a stream and their counts."""
    code = np.zeros(len(symbols) - ORDER, np.int64)
    for k in range(order, -1, -1):
        code = code * width + symbols[ORDER - k : len(symbols) - k]
    return np.unique(code, return_counts=True)


class Model:
    """A context tree for each language, over symbols that are bytes seen in any."""

    def __init__(self, languages: list[str], symbols: np.ndarray, width: int, trees: list[Tree]):
        self.languages, self.symbols, self.width, self.trees = languages, symbols, width, trees

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language.

        Every context with its symbol is looked up once in a block of texts, however
        often it stands there.
        """
        total = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (not size or size + len(texts[upto]) <= BLOCK):
                size += len(texts[upto]) + ORDER
                upto += 1
            joined = np.frombuffer(PAD + PAD.join(texts[at:upto]), np.uint8)
            lengths = np.fromiter(map(len, texts[at:upto]), np.int64, upto - at)
            owner = np.repeat(np.arange(upto - at), lengths + ORDER)[: len(joined) - ORDER]
            own = np.ones(len(owner), bool)
            gaps = np.cumsum(lengths + ORDER)[:-1]
            for k in range(ORDER):
                own[gaps - 1 - k] = False
            for lo in range(0, len(owner), BLOCK):
                hi = min(lo + BLOCK, len(owner))
                s = self.symbols[joined[lo : hi + ORDER]].astype(np.int64)
                code = ((s[:-3] * self.width + s[1:-2]) * self.width + s[2:-1]) * self.width + s[3:]
                keep = own[lo:hi]
                met = pa.array(code[keep]).dictionary_encode()
                which, distinct, of = met.indices.to_numpy(), met.dictionary.to_numpy(), owner[lo:hi][keep]
                for language, tree in enumerate(self.trees):
                    total[at:upto, language] += np.bincount(of, tree.bits(distinct)[which], upto - at)
            at = upto
        return total


def fit(texts: dict[str, list[bytes]]) -> Model:
    """Count contexts up to three bytes in each language and freeze their code lengths.

    Escapes follow method C: a context seen n times with q different symbols keeps
    q / (n + q) for the symbols it has not seen, shared as the next shorter context
    shares them among those alone; a context never seen passes on at no cost.  Below
    the empty context all symbols are alike.  Every context of the texts is kept.
    """
    languages = sorted(texts)
    streams = {name: PAD + PAD.join(texts[name]) for name in languages}
    seen = sorted(set(b"".join(streams.values())))
    width = len(seen) + 1  # the last symbol stands for all bytes never seen
    table = np.full(256, len(seen), np.uint16)
    table[seen] = np.arange(len(seen))
    return Model(languages, table, width, [Tree(table[np.frombuffer(streams[name], np.uint8)].astype(np.int64), width) for name in languages])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Language of every whole text, learnt from the documents that are not held out.

    The text's code length in bits under each language's frozen trees decides; ties
    go to the first name.  ``und`` with score 0 where the text is null or has no
    letter, or nothing could be learnt.  Repeated rows are each returned; ids keep their
    type; bytes that are no UTF-8 are coded as they are; an empty table gives an empty
    result; columns beyond the three named are ignored.

    Every language is learnt, from at most about ``per_language`` texts, none over
    ``train_bytes``, within ``LANGUAGE_BYTES`` and the bounds of ``sample_per_class`` on all
    together, so the trees can be sent to every executor.
    Returns id, held_out, lang_pred, score (posterior of that language), bits.
    """
    spark = docs.sparkSession
    learnt, _ = sample_per_class(docs, docs.select(F.col(id_col), F.col(lang_col).alias("label")), per_language, train_bytes, id_col, text_col, "language", LANGUAGE_BYTES)
    texts: dict[str, list[bytes]] = {}
    for r in learnt:
        texts.setdefault(r["label"], []).append(bytes(r["text"]))
    shared = spark.sparkContext.broadcast(fit(texts)) if texts else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, letters, raw = batch.columns
            names, scores, least = [UNKNOWN] * len(ids), np.zeros(len(ids)), np.zeros(len(ids))
            use = np.flatnonzero(letters.to_numpy(zero_copy_only=False)) if shared else []
            if len(use):
                model = shared.value
                bits = model.code_lengths([raw[int(i)].as_py() for i in use])
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(use)), best]
                scores[use] = 1 / np.exp2(-(bits - low[:, None]) / TEMPERATURE).sum(axis=1)
                least[use] = low
                for i, b in zip(use.tolist(), best.tolist()):
                    names[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([ids, out, pa.array(names, pa.string()), pa.array(scores), pa.array(least)], ["id", "held_out", "lang_pred", "score", "bits"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.cast("binary").alias("text"))
    fields = T.StructType([id_field(docs, id_col)]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double").add("bits", "double")
    return rows.mapInArrow(each, fields).withColumnRenamed("id", id_col)
