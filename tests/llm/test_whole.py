"""Operators against brute force on whole tables, and on rows that are easily mishandled."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LABEL, docs
from tests.llm.test_dedup import components, letters
from trackweave.llm import ann, common, fitting, langid, line_dedup, mixing, packing, quality, queries, sharding, simhash, toxicity, vector_dedup
from trackweave.llm.tokens import Tokens

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


# line templates


def plain_lines(texts):
    """(document, line) that the line operator drops, one document and line after another."""
    lines, pairs = {}, {}
    for d, text in enumerate(texts):
        part = Tokens([(0, 0, text)])
        key, leaf = part.paths(line_dedup.DEPTH)
        which, hashed = part.pairs()
        for i, number in enumerate(part.line.tolist()):
            lines[d, number] = (int(key[i]), int(leaf[i]), part.row(i))
            pairs[d, number] = set(hashed[which == i].tolist())
    leaves = defaultdict(dict)
    for key, leaf, row in lines.values():
        leaves[leaf][key] = row
    template = {}
    for members in leaves.values():
        known = []
        for key in sorted(members):
            row = members[key]
            agree = [int(((k == row) & (row != 0)).sum()) for _, k in known]
            best = int(np.argmax(agree)) if agree else -1
            if agree and agree[best] >= np.ceil(line_dedup.ALIKE * len(row)):
                known[best] = (known[best][0], np.where(known[best][1] == row, row, 0))
            else:
                best = len(known)
                known.append((key, row))
            template[key] = known[best][0]
    held = defaultdict(set)
    for (d, _), (key, _, _) in lines.items():
        held[template[key]].add(d)
    count = defaultdict(int)
    for d, key in {(d, key) for (d, _), (key, _, _) in lines.items()}:
        count[template[key]] += 1
    keeper = {t: min(ds) for t, ds in held.items() if count[t] >= 2}
    size = [sum(len(r) for (x, _), (_, _, r) in lines.items() if x == d) for d in range(len(texts))]
    whole = [set().union(*(p for (x, _), p in pairs.items() if x == d)) for d in range(len(texts))]
    mine = defaultdict(dict)
    for (d, n), (key, _, _) in lines.items():
        mine[d][n] = template[key]
    sig = {}
    for d, own in mine.items():
        for k in {keeper[t] for t in own.values() if t in keeper} - {d}:
            rest = {n: count[t] if t in keeper else 1 for n, t in own.items() if keeper.get(t) != k}
            least = min(rest.values(), default=0)
            text = sorted(set().union(*(pairs[d, n] for n, c in rest.items() if c <= 2 * least)))[: line_dedup.PAIRS]
            copy = sum(p in whole[k] for p in text) >= line_dedup.COPY * len(text) and max(size[k], size[d]) <= line_dedup.LONGER * min(size[k], size[d])
            if not copy:
                sig[d, k] = text[0] if text else 0
    unlike, tokens, apart = defaultdict(set), {}, []
    for d, own in mine.items():
        for n, t in own.items():
            if (d, keeper.get(t)) in sig:
                unlike[t].add(sig[d, keeper[t]])
                tokens[t] = len(lines[d, n][2])
                apart.append((d, n, t))
    often = {t for t, s in unlike.items() if len(s) + 1 >= line_dedup.UNLIKE and (len(s) + 1) * tokens[t] >= line_dedup.TOKENS}
    return {(d, n) for d, n, t in apart if t in often}


def test_line_query_equals_brute_force(spark, read):
    rows = read("select doc_id, text from {documents} order by doc_id")
    gone = plain_lines([t or "" for _, t in rows])
    want = {i: "\n".join(line for n, line in enumerate(t.split("\n")) if (d, n) not in gone) for d, (i, t) in enumerate(rows)}
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == want and gone


@pytest.mark.parametrize("n", [4000, 4200])
def test_lines_of_one_template_go_whatever_their_number(spark, n):
    rng = np.random.default_rng(n)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (n, 41, 7))] if n < 0 else rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (n, 21, 7))
    word = lambda i, k: "".join(words[i, k])
    texts = [" ".join(word(i, k) for k in range(20)) + f"\nthis page was last edited by {word(i, 20)} who is one of the many people that keep it up and running" for i in range(n)]
    dropped = line_dedup.drop_lines(docs(spark, texts)).agg(F.sum("n_dropped")).first()[0]
    assert dropped == n - 1


# vectors


def test_vectors_of_any_scale_and_size(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    x = np.repeat(base, 2, 0) + rng.normal(size=(80, 6)) * 0.05
    scale = np.where(np.arange(80) % 4 == 1, 1e-200, np.where(np.arange(80) % 4 == 2, 1e200, 1.0))
    short = rng.normal(size=(10, 3))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, scale))] + [(100 + i, v.tolist()) for i, v in enumerate(short)] + [(110, short[0].tolist()), (200, [5e-324, 0.0])]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    like = u @ u.T >= 0.9
    np.fill_diagonal(like, False)
    group = components(80, list(zip(*np.nonzero(like))))
    s = short / np.linalg.norm(short, axis=1)[:, None]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(table).collect()}
    assert [got[i] for i in range(80)] == [(int(like[i].sum()), group[i]) for i in range(80)]
    assert got[110][0] == got[100][0] == int((s @ s[0] >= 0.9).sum()) and got[110][1] == got[100][1] == 100 and got[200] == (0, 200)
    found = ann.search(table.where("vec_id in (0, 1, 2, 100, 200)"), table).collect()
    near = {q: [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 1, 2, 100, 200)}
    for q in (0, 1, 2):
        want = [j for j in np.argsort(-(u @ u[q]), kind="stable") if j != q][:5]
        assert [v for v, _ in near[q]] == want and [c for _, c in near[q]] == pytest.approx((u @ u[q])[want], abs=1e-12)
    assert near[100][0] == (110, pytest.approx(1.0)) and len(near[100]) == 5 and near[200] == []


# near-duplicates


def test_near_duplicates_have_a_partner(spark, read):
    rows = read("select doc_id, text from {documents} order by doc_id", "sf0.01")
    sets = {i: shingles(t) for i, t in rows}
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(source).collect()}
    kept = {r["doc_id"] for r in simhash.keep_one(source).collect()}
    assert kept == {i for i, g in group.items() if i == g}
    members = defaultdict(list)
    for i, g in group.items():
        members[g].append(i)
    for g, ids in members.items():
        assert len(ids) == 1 or all(any(j != i and alike(sets[i], sets[j]) >= 0.8 for j in ids) for i in ids)
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() if len(ids) < 60 for a in ids for b in ids if a < b}
    true = [(a, b) for a, b in pairs if alike(sets[a], sets[b]) >= 0.8]
    assert true and sum(group[a] == group[b] for a, b in true) >= 0.99 * len(true)


def test_documents_that_share_a_passage_stay(spark):
    rng = np.random.default_rng(21)
    passage = letters(rng, 200)
    texts = [f"{passage} {letters(rng, 80)}" for _ in range(60)]
    assert simhash.keep_one(docs(spark, texts)).count() == 60


def test_crowded_tiles_of_sets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = np.random.default_rng(22)
    words = letters(rng, 150).split()
    texts = []
    for i in range(60):
        changed = list(words)
        changed[int(rng.integers(0, 150))] = f"other{i}x"
        texts.append(" ".join(changed))
    assert [r["doc_id"] for r in simhash.keep_one(docs(spark, [*texts, letters(rng, 150)])).orderBy("doc_id").collect()] == [0, 60]


def test_parts_of_fingerprints_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    values = sorted({int(b) for b in base} | {int(b ^ np.int64((1 << i) | (1 << (i + 9)))) for b in base for i in range(0, 50, 7)})
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    place = {v: i for i, v in enumerate(values)}
    got = []
    for parts in (4, 8):
        monkeypatch.setattr(simhash, "PARTS", ((0, parts),))
        got.append(components(len(values), [(place[r["a"]], place[r["b"]]) for r in simhash.fingerprint_links(table).collect()]))
    assert got[0] == got[1] and max(np.bincount(got[0])) > 5


# mixing


def dense_newton(x, w, goal):
    m = np.zeros(x.shape[1])
    for _ in range(200):
        r = w * np.exp(x @ m)
        slope, curve = x.T @ r - goal, (x * r[:, None]).T @ x
        move = np.linalg.lstsq(curve, slope, rcond=1e-12)[0]
        m -= move / max(1.0, np.abs(move).max() / 2)
    return np.exp(x @ m)


def test_joint_newton_equals_a_dense_one(spark):
    rng = np.random.default_rng(7)
    n = 300
    source, lang, fact, words = rng.integers(0, 3, n), rng.integers(0, 2, n), rng.random(n).round(2), rng.integers(1, 90, n).astype(float)
    x = np.concatenate([np.eye(3)[source], np.eye(2)[lang], fact[:, None]], 1)
    aim = np.exp(x @ rng.normal(size=6) * 0.5)
    goal = x.T @ (words * aim)
    rows = spark.createDataFrame([(i, f"s{s}", None if k == 0 else "b", float(f), float(w)) for i, (s, k, f, w) in enumerate(zip(source, lang, fact, words))], "i int, s string, l string, f double, tokens double")
    margins = {"s": spark.createDataFrame([(f"s{k}", float(goal[k])) for k in range(3)], "s string, target double"), "l": spark.createDataFrame([(None, float(goal[3])), ("b", float(goal[4]))], "l string, target double")}
    got = {r["i"]: r["rate"] for r in mixing.entropy_balance(rows, margins, {"f": float(goal[5])}).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(dense_newton(x, words, goal).tolist(), rel=1e-5)
    one = {r["i"]: r["rate"] for r in mixing.entropy_balance(rows, {"s": margins["s"]}).collect()}
    assert [one[i] for i in range(n)] == pytest.approx([goal[s] / words[source == s].sum() for s in source], rel=1e-9)


def test_repeat_gives_what_the_mix_says(spark):
    texts = ["w " * 5, "w " * 900, *["w " * (3 + i % 40) for i in range(200)], "a b c", "a b c"]
    ids = [1, 1, *range(2, 202), 7, 7]
    sources = ["a", "a", *["ab"[i % 2] for i in range(200)], "b", "b"]
    table = docs(spark, texts, sources, ids=ids)
    mixed, copied = defaultdict(int), defaultdict(int)
    for r in mixing.mix(table).collect():
        mixed[r["doc_id"], r["size"]] += r["copies"]
    for r in mixing.repeat(table).collect():
        copied[r["doc_id"], len((r["text"] or "").split())] += 1
    assert copied == {k: n for k, n in mixed.items() if n}


# packing


def test_every_piece_goes_to_the_tightest_compatible_bin():
    rng = np.random.default_rng(9)
    capacity, per_source = 60, 2
    for _ in range(20):
        rows = [(int(rng.integers(1, 59)), "abc"[int(rng.integers(0, 3))], int(rng.integers(0, 25))) for _ in range(80)]
        pieces = packing.pack_rows(rows, capacity, per_source)
        often = defaultdict(int)
        for _, _, c in rows:
            often[c] += 1
        bins: dict = {}
        for i in sorted(range(len(rows)), key=lambda i: (-(rows[i][0] % capacity), str(rows[i][2]), i)):
            size, source, cluster = rows[i]
            (which, offset, _, _), = pieces[i]
            fits = [b for b, held in bins.items() if sum(rows[j][0] for j in held) + size <= capacity and sum(rows[j][1] == source for j in held) < per_source and (often[cluster] == 1 or all(rows[j][2] != cluster for j in held))]
            room = lambda b: capacity - sum(rows[j][0] for j in bins[b])
            assert (which in fits and room(which) == min(map(room, fits))) if fits else which not in bins
            bins.setdefault(which, []).append(i)


def test_a_hot_row_is_packed_in_many_groups(spark):
    table = docs(spark, ["one two three"] * 300, ids=[5] * 300)
    got = packing.pack(table, group_rows=20).collect()
    assert len(got) == 300 and len({r["bin"] for r in got}) == 300 and len({r["bin"] >> 32 for r in got}) > 5


# scores


def test_nearest_labelled_texts_equal_brute_force(spark):
    path = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{path}/labels.parquet")
    texts = spark.read.parquet(f"{path}/documents.parquet")
    rows, counts = fitting.sample_per_class(texts, known.selectExpr("doc_id", "toxic as label"), toxicity.PER_CLASS, toxicity.TRAIN_BYTES, salt="toxicity")
    model = toxicity.fit(rows, counts)
    ids = [r["id"] for r in rows]
    vectors = [model.vocabulary.vector(bytes(r["text"]).decode()) for r in rows]
    dense = np.zeros((len(rows), len(model.vocabulary.idf)))
    for i, (t, w, _, _) in enumerate(vectors):
        dense[i, t] = w
    for r in queries.op10_toxicity(spark, path).join(texts, "doc_id").collect():
        t, w, _, _ = model.vocabulary.vector(r["text"] or "")
        cosines = dense[:, t] @ w if len(t) else np.zeros(len(rows))
        want = np.sort(cosines[cosines > 0])[::-1][: toxicity.NEIGHBOURS]
        assert r["cosines"] == pytest.approx(want.tolist(), abs=1e-9)
        assert [cosines[ids.index(e)] for e in r["evidence"]] == pytest.approx(want.tolist(), abs=1e-9)


def test_an_id_of_many_rows_counts_once(spark):
    texts = [f"text {i} " + "good " * 5 for i in range(3000)]
    table = docs(spark, texts + ["bad words here", "more good here"], ids=[1] * 3000 + [3, 4])
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, label int")
    rows, counts = fitting.sample_per_class(table, labels, 100, 1000)
    kept = [i for i in (1, 3, 4) if not spark.range(1).select(common.held_out(F.lit(i))).first()[0]]
    assert sorted(r["id"] for r in rows) == kept and sum(counts.values()) == len(kept)


def test_samples_stay_within_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(fitting, "MOST_BYTES", 4000)
    table = docs(spark, ["x" * 100] * 400)
    labels = spark.createDataFrame([(i, i % 4) for i in range(400)], "doc_id long, label int")
    rows, counts = fitting.sample_per_class(table, labels, 100, 1000)
    assert len(counts) == 4 and {r["label"] for r in rows} == {0, 1, 2, 3} and sum(len(r["text"]) for r in rows) <= 4000


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(17)
    alphabet = list("abcdefghijklmnopqrstuvwxyz")
    texts, langs = [], []
    for k in range(70):
        words = ["".join(rng.choice(alphabet, 4)) for _ in range(30)]
        for _ in range(8):
            texts.append(" ".join(rng.choice(words, 60)))
            langs.append(f"l{k:02d}")
    got = langid.identify(docs(spark, texts, langs=langs)).collect()
    assert len({r["lang_pred"] for r in got}) == 70
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got]) >= 0.99


# rows and columns that are easily mishandled


def clashing(spark):
    names = ["_id", "_doc", "_text", "_of", "_drop", "n_lines", "n_dropped", "_kept", "_copies", "_n", "row", "doc", "copies", "of", "size", "order", "parts", "shard", "slot"]
    rng = np.random.default_rng(2)
    passage = letters(rng, 60)
    table = docs(spark, [f"{letters(rng, 30)}\n{passage}" for _ in range(6)])
    return table.drop(*names).select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])


def test_columns_of_any_name_are_kept(spark):
    table = clashing(spark)
    extra = [c for c in table.columns if c not in ("doc_id", "text", "source")]
    for got in (line_dedup.drop_lines(table), simhash.keep_one(table), mixing.repeat(table), toxicity.drop_toxic(table, spark.createDataFrame([], LABEL))):
        rows = got.collect()
        assert rows and set(table.columns) <= set(got.columns)
        for c in extra:
            if c not in ("n_lines", "n_dropped", "n_chars", "lang", "score", "id"):
                assert {r[c] for r in rows} == {r[c] for r in table.collect()}, c
    assert [r["n_dropped"] for r in line_dedup.drop_lines(table).orderBy("doc_id").collect()] == [0, 1, 1, 1, 1, 1]
    assert packing.pack(table).count() == 6 and sharding.shard_by_bytes(table, 2).count() == 6 and mixing.mix(table).count() == 6


def test_ids_of_any_type(spark):
    rng = np.random.default_rng(3)
    passage = letters(rng, 60)
    table = docs(spark, [f"{letters(rng, 30)}\n{passage}" for _ in range(5)]).withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    names = {f"doc-{i}" for i in range(5)}
    labels = spark.createDataFrame([(f"doc-{i}", i % 2, i % 2) for i in range(5)], "doc_id string, quality int, toxic int")
    results = [line_dedup.drop_lines(table), simhash.near_duplicates(table), simhash.similar_groups(table), simhash.keep_one(table), packing.pack(table), mixing.mix(table), sharding.shard_by_bytes(table), langid.identify(table), quality.score_quality(table, labels), toxicity.score_toxicity(table, labels)]
    for got in results:
        assert {r["doc_id"] for r in got.collect()} == names


def test_bytes_that_are_no_text(spark):
    table = docs(spark, ["good text of some words", "x", "plain words that are text"]).withColumn("text", F.when(F.col("doc_id") == 1, F.expr("cast(unhex('61ff62200a63') as string)")).otherwise(F.col("text")))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 0)], LABEL)
    scored = [line_dedup.drop_lines(table), simhash.near_duplicates(table), simhash.keep_one(table), packing.pack(table), mixing.mix(table), mixing.repeat(table), sharding.shard_by_bytes(table), langid.identify(table), quality.score_quality(table, labels), toxicity.score_toxicity(table, labels), toxicity.drop_toxic(table, labels)]
    for got in scored:
        assert got.select("doc_id").distinct().count() == 3 or got.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for view in ("documents", "embeddings"):
        con.execute(f"create view {view} as select * from '/root/testdata/sf0.01/{view}.parquet'")
    got, want = queries.queries()[name](spark, "/root/testdata/sf0.01").toPandas(), con.execute(queries.oracle_sql()[name]).df()
    plain = lambda frame: sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
