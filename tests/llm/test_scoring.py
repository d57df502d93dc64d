"""Quality, language and toxicity on held-out rows and odd ones."""

import math
import zlib

import numpy as np
import pytest

from tests.llm.helpers import LABEL, odd
from trackweave.llm import fitting, langid, quality, queries, toxicity


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.9), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, read, name, label, least):
    truth = {i: y for i, y in read(f"select doc_id, {label} from {{labels}}", "sf0.01")}
    got = queries.queries()[name](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == held_out(r["doc_id"]) for r in got)
    limit = 0.7 if label == "quality" else 0.3
    assert all(r["predicted"] == int(r["score"] >= limit) for r in got)
    known = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == y for p, y in known]) >= least


def test_language_accuracy(spark, read):
    truth = dict(read("select doc_id, lang from {documents}", "sf0.01"))
    got = queries.op3_language(spark, "/root/testdata/sf0.01").collect()
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows, counts = fitting.sample_per_class(docs, labels.selectExpr("doc_id", "toxic as label"), 1000, 65_536)
    assert rows and not any(held_out(r["id"]) for r in rows)
    assert sum(counts.values()) == len(rows) or sum(counts.values()) > len(rows)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_odd_rows(spark, score):
    docs = odd(spark)
    for labels in (spark.createDataFrame([], LABEL), spark.createDataFrame([(3, 1, 1), (4, 0, 0), (5, None, None), (None, 1, 0)], LABEL)):
        got = score(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
        assert score(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_odd_languages(spark):
    got = langid.identify(odd(spark)).collect()
    blank = [r for r in got if r["lang_pred"] == "und"]
    assert len(got) == 11 and len(blank) == 3 and all(r["score"] == 0 for r in blank)
    assert langid.identify(odd(spark).limit(0)).count() == 0
    unlearnt = langid.identify(odd(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r["lang_pred"] for r in unlearnt} == {"und"}


def test_code_lengths_follow_the_trees():
    texts = {"a": [b"abracadabra abracadabra", b"barbara"], "b": [b"hocus pocus", b"focus"]}
    model = langid.fit(texts)

    def slow(name, text):
        stream = langid.PAD + langid.PAD.join(texts[name])
        seen = sorted(set(b"".join(langid.PAD + langid.PAD.join(t) for t in texts.values())))
        alphabet = [*seen, None]
        as_symbol = lambda c: c if c in seen else None
        whole = langid.PAD + text
        total = 0.0
        kept = {(langid.PAD + langid.PAD.join(t))[i : i + 3] for t in texts.values() for i in range(len(langid.PAD + langid.PAD.join(t)) - 3)}

        def probabilities(context):
            if context is None:
                return {s: 1 / len(alphabet) for s in alphabet}
            shorter = probabilities(context[1:] if context else None)
            if len(context) == 3 and context not in kept:
                return shorter
            k = len(context)
            following = [stream[i] for i in range(3, len(stream)) if stream[i - k : i] == context]
            if not following:
                return shorter
            n, q = len(following), len(set(following))
            left = 1 - sum(shorter[s] for s in set(following))
            out = {s: p * q / (n + q) / max(left, 1e-12) for s, p in shorter.items()}
            out.update({s: following.count(s) / (n + q) for s in set(following)})
            return out

        for i in range(3, len(whole)):
            total -= math.log2(probabilities(whole[i - 3 : i])[as_symbol(whole[i])])
        return total

    tests = [b"abra", b"pocus!", b"", b"bara hocus \xc3\xa9"]
    fast = model.code_lengths(tests)
    for i, t in enumerate(tests):
        for j, name in enumerate(model.languages):
            assert fast[i, j] == pytest.approx(slow(name, t), rel=1e-4, abs=1e-3)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        terms = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = rng.random(len(terms)) + 0.1
        vectors.append((terms, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, 60)
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(100):
        cosines = dense @ dense[i]
        cosines[i] = 0
        want = [j for j in np.lexsort((np.arange(500), -np.round(cosines, 12)))[:10] if cosines[j] > 0]
        got = index.nearest(*vectors[i], 10, leave_out=i)
        assert [j for _, j in got] == want or np.allclose([s for s, _ in got], cosines[want])


def test_evidence_is_labelled(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    known = {r["doc_id"] for r in labels.collect()}
    got = queries.op10_toxicity(spark, path).where("size(evidence) > 0").collect()
    assert got and all(set(r["evidence"]) <= known and r["cosines"] == sorted(r["cosines"], reverse=True) for r in got)
