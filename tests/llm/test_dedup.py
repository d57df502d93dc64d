"""SimHash, line templates and vectors against brute force."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import docs, odd
from trackweave.llm import ann, line_dedup, queries, simhash, vector_dedup
from trackweave.llm.common import connected_components


def components(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(600, pairs)
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB cÉ\n\x0b ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_query(spark, read):
    rows = read("select doc_id, text from {documents} order by doc_id")
    prints = [plain_fingerprint(t) for _, t in rows]
    n = len(rows)
    want = components(n, [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {rows[i][0]: (f"{prints[i]:016x}", rows[want[i]][0]) for i in range(n)}


def test_simhash_links_within_crowded_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 6, dtype=np.int64)
    near = {int(b) for b in base} | {int(b ^ np.int64(1 << i)) for b in base for i in range(40)} | {int(b ^ np.int64((1 << i) | (1 << (i + 9)))) for b in base for i in range(20)}
    values = sorted(near)
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"))
    place = {v: i for i, v in enumerate(values)}
    got = components(len(values), [(place[r["a"]], place[r["b"]]) for r in links.collect()])
    mask = (1 << 64) - 1
    want = components(len(values), [(i, j) for i in range(len(values)) for j in range(i) if ((values[i] ^ values[j]) & mask).bit_count() <= 2])
    assert got == want


def test_simhash_odd_rows(spark):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(odd(spark)).collect()}
    assert simhash.near_duplicates(odd(spark)).count() == 11
    assert {got[(i, "0" * 16)] for i in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0
    assert simhash.keep_one(odd(spark)).columns == odd(spark).columns


def test_similar_groups_keep_one_of_each(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts, family = [], []
    for f in range(30):
        words = list(rng.choice(vocabulary, 400))
        for copy in range(4):
            changed = list(words)
            for at in rng.choice(400, 2 * copy, replace=False):
                changed[at] = "changed"
            texts.append(" ".join(changed))
            family.append(f)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs(spark, texts)).collect())
    assert kept == [4 * f for f in range(30)]


def test_refused_candidates_hide_no_links(spark, monkeypatch):
    # every name of one tile is a candidate of every other; the closest that connect them are all
    # refused, so the groups hang on pairs that were held back
    rng = np.random.default_rng(3)
    shared = " ".join(f"w{v}" for v in rng.integers(0, 10**6, 40))
    texts = [f"{shared} t{i}" for i in range(24)]
    monkeypatch.setattr(simhash, "wide_fingerprint", lambda hashes: (np.zeros(simhash.WIDE, np.uint64), [7]))  # one tile
    spanning = simhash._spanning

    def misled(i, j, bits, n):
        wrong = np.flatnonzero(i % 2 != j % 2)
        return (i[wrong], j[wrong]) if len(i) > 4 * n else spanning(i, j, bits, n)

    def halves(links, classes, *args):  # judged alike: names of one half alone
        order = {r["name"]: k for k, r in enumerate(classes.orderBy("name").collect())}
        kept = [(r["a"], r["b"]) for r in links.collect() if order[r["a"]] % 2 == order[r["b"]] % 2]
        return spark.createDataFrame(kept, "a long, b long")

    monkeypatch.setattr(simhash, "_spanning", misled)
    monkeypatch.setattr(simhash, "verified", halves)
    got = {r["component_id"] for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert len(got) == 2


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_refused_candidates_are_not_joined_pair_by_pair(spark, monkeypatch, most):
    # one tile of 40 names, each a candidate of every other; alike are those of one of 20 families alone
    rng = np.random.default_rng(4)
    shared = " ".join(f"w{v}" for v in rng.integers(0, 10**6, 30))
    own = [" ".join(f"o{v}" for v in rng.integers(0, 10**6, 20)) for _ in range(20)]
    texts = [f"{shared} {own[i % 20]} {'first' if i < 20 else 'second'}" for i in range(40)]
    monkeypatch.setattr(simhash, "wide_fingerprint", lambda hashes: (np.zeros(simhash.WIDE, np.uint64), [7]))
    monkeypatch.setattr(simhash, "SHINGLES", most, raising=False)  # at 300 the tile is cut into parts
    joined, verified = [], simhash.verified

    def counted(links, *args):
        joined.append(links.count())
        return verified(links, *args)

    monkeypatch.setattr(simhash, "verified", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert got == {i: i % 20 for i in range(40)}
    assert sum(joined) <= 4 * 40  # of 780 pairs


def test_sets_that_join_groups():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.choice(60, 40)).astype("<u8") for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    alike = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)]) >= 0.55
    few = rng.random(len(i)) < 0.1
    for some in (np.ones(len(i), bool), few):
        links = simhash._joining(sets, i[some], j[some], np.arange(60) // 2, 0.55)
        pairs = set(zip(i[some & alike].tolist(), j[some & alike].tolist()))
        assert set(links) <= pairs
        halves = [(2 * g, 2 * g + 1) for g in range(30)]
        assert list(components(60, halves + links)) == list(components(60, halves + sorted(pairs)))


def test_line_templates(spark):
    shared = "this passage of many words stands in several documents and ought to stay in one of them alone " * 3
    own = [" ".join(f"own{c}{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(60)) for c in "xyz"]
    texts = [
        f"own first line of zero here\n{shared}\nshort", f"another line with other words\n{shared}\nshort", f"{shared}\nthird text has lines of its own",
        "Page 1 of 20 printed on 2024-01-01 by user17 at http://x.org/a",
        "something else entirely in this one\nPage 3 of 20 printed on 2024-05-01 by user99 at http://x.org/b",
        "Served by the node alpha within the usual limits of our contract\nPage 7 of 20 printed on 2023-05-01 by user3 at http://y.org/c",
        "Served by the node omega within the usual limits of our contract\nlast words",
        "Served by the node gamma within the usual limits of our contract\nfarewell then",
    ]
    texts[:3] = [f"{o}\n{t}" for o, t in zip(own, texts)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.drop_lines(docs(spark, texts)).collect()}
    assert got[0] == (texts[0], 0) and got[3] == (texts[3], 0)
    assert got[1] == (f"{own[1]}\nanother line with other words\nshort", 1) and got[2] == (f"{own[2]}\nthird text has lines of its own", 1)
    assert got[4] == ("something else entirely in this one", 1)
    assert got[5] == ("Served by the node alpha within the usual limits of our contract", 1)
    assert got[6] == ("last words", 1) and got[7] == ("farewell then", 1)


def test_copies_are_no_templates(spark):
    rng = np.random.default_rng(6)
    lines = [" ".join(rng.choice([f"w{i}" for i in range(900)], 40)).replace("w", "v") for _ in range(6)]
    letters = [" ".join("".join("abcdefghij"[int(c)] for c in t[1:]) for t in line.split()) for line in lines]
    near = [letters[:k] + [letters[k].replace(letters[k].split()[20], "changed")] + letters[k + 1 :] for k in range(6)]
    texts = ["\n".join(letters)] * 20 + ["\n".join(n) for n in near]
    assert {r["n_dropped"] for r in line_dedup.drop_lines(docs(spark, texts)).collect()} == {0}


def letters(rng, n):
    """``n`` words that no other call is likely to give."""
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n))


def test_templates_recur_whatever_the_copies_of_a_holder(spark):
    rng = np.random.default_rng(11)
    passage, pair = letters(rng, 60), letters(rng, 40)
    texts = [f"{letters(rng, 50)}\n{passage}" for _ in range(12)]
    texts += [texts[5]] * 100 + [texts[0]] * 3 + [f"{letters(rng, 50)}\n{pair}", f"{letters(rng, 50)}\n{pair}"]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(docs(spark, texts)).collect()}
    assert got[0] == 0 and all(got[i] == 1 for i in range(1, 112))
    assert all(got[i] == 0 for i in (112, 113, 114)) and (got[115], got[116]) == (0, 1)


def test_own_text_tells_copies_apart(spark):
    rng = np.random.default_rng(12)
    passage, four, five = letters(rng, 60), [letters(rng, 60) for _ in range(4)], [letters(rng, 30) for _ in range(5)]
    texts = [f"{letters(rng, 1)}\n{passage}" for _ in range(30)]
    texts += ["\n".join([letters(rng, 40), *four]) for _ in range(30)]
    texts += ["\n".join([letters(rng, 60), *five]) for _ in range(30)]
    copied = "\n".join([letters(rng, 40), *four, letters(rng, 25)])
    texts += [copied] * 4 + [copied.replace(copied.split()[20], "changed")]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(30)] == [0] + [1] * 29
    assert [got[i] for i in range(30, 60)] == [0] + [4] * 29
    assert [got[i] for i in range(60, 90)] == [0] + [5] * 29
    assert [got[i] for i in range(90, 95)] == [4] * 5


def test_parts_of_a_keeper_go(spark):
    rng = np.random.default_rng(15)
    passage = letters(rng, 40)
    texts = ["\n".join([letters(rng, 60), passage, letters(rng, 60)]), passage, passage]
    assert [r["n_dropped"] for r in line_dedup.drop_lines(docs(spark, texts)).orderBy("doc_id").collect()] == [0, 1, 1]


def test_full_leaves_still_find_equal_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAF_LINES", 2)
    lines = [f"the very same leading tokens {'abcdefgh'[i]} then {'hgfedcba'[i]} some more words that differ {'qrstuvwx'[i]} at the end" for i in range(8)]
    texts = [lines[i % 8] + "\nown " + " ".join("xyzuvw"[i // 8] * (k + 1) + "abcdefgh"[i % 8] for k in range(30)) for i in range(40)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(docs(spark, texts)).collect()}
    assert all(got[i] == 0 for i in range(8)) and all(got[i] == 1 for i in range(8, 40))


def test_crowded_leaves_generalise_like_others(spark, monkeypatch):
    rng = np.random.default_rng(13)
    texts = [f"{letters(rng, 30)}\nthis page was last edited by {letters(rng, 1)} who is one of the many people that keep it up" for _ in range(60)]
    texts += [f"{letters(rng, 30)}\nthis page was last {letters(rng, 16)}" for _ in range(20)]
    for limit in (4096, 8):
        monkeypatch.setattr(line_dedup, "LEAF_LINES", limit)
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(docs(spark, texts)).collect()}
        assert [got[i] for i in range(80)] == [0] + [1] * 59 + [0] * 20


def test_templates_equal_brute_force():
    rng = np.random.default_rng(14)
    for n in (5, 6, 9, 16, 31):
        base = rng.integers(1, 1000, (6, n))
        rows = base[rng.integers(0, 6, 300)]
        rows = np.where(rng.random(rows.shape) < rng.choice([0.02, 0.1, 0.3], (300, 1)), rng.integers(1, 1000, rows.shape), rows).astype(np.int32)
        rows[:, :4] = base[0, :4]
        found, known = line_dedup.Templates(n), []
        for i, row in enumerate(rows):
            agree = [int((k == row).sum()) for k in known]
            best = int(np.argmax(agree)) if agree else -1
            if agree and agree[best] >= 0.75 * n:
                known[best] = np.where(known[best] == row, row, 0)
            else:
                best = len(known)
                known.append(row.copy())
            assert found.add(row, i) == best
        assert (found.known[: len(known)] == np.array(known)).all()


def test_lines_odd_rows(spark):
    got = line_dedup.drop_lines(odd(spark))
    assert got.count() == 11 and set(odd(spark).columns) < set(got.columns)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[0] is None and texts[1] == "" and texts[2] == " \n\t "
    assert line_dedup.drop_lines(odd(spark).limit(0)).count() == 0


def clusters(rng, n, dims=16):
    centres = rng.normal(size=(n // 5, dims))
    x = np.repeat(centres, 5, 0) + rng.normal(size=(n // 5 * 5, dims)) * rng.choice([0.05, 0.2, 0.5], (n // 5 * 5, 1))
    return x.astype(np.float32)


VECTOR = "vec_id long, embedding array<float>, label int, id string, score string"


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist() if isinstance(v, np.ndarray) else v, 0, "a", "b") for i, v in zip(ids if ids is not None else range(len(x)), x)], VECTOR)


@pytest.mark.parametrize("cosine", [0.9, 0.6])
def test_vector_links(spark, cosine):
    x = clusters(np.random.default_rng(2), 400)
    x[7], x[9] = x[3], x[3]
    ids = np.arange(400) * 3 + 1
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    like = u @ u.T >= cosine
    np.fill_diagonal(like, False)
    group = components(400, list(zip(*np.nonzero(like))))
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(vectors(spark, x, ids), cosine).collect()}
    assert [got[int(i)]["n_links"] for i in ids] == like.sum(1).tolist()
    assert [got[int(i)]["component_id"] for i in ids] == [int(ids[g]) for g in group]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_vector_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 16)
    x = clusters(np.random.default_rng(4), 200)
    x[:60] = x[0] + np.random.default_rng(5).normal(size=(60, 16)) * 0.01
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    like = u @ u.T >= 0.9
    np.fill_diagonal(like, False)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(vectors(spark, x)).collect()}
    assert [got[i] for i in range(200)] == like.sum(1).tolist()


BAD = [None, [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], []]


def test_few_copies_of_each_vector_are_sent(spark, monkeypatch):
    sent = []
    pairs = vector_dedup.tile_pairs

    def counted(*args):
        sent.append(pairs(*args))
        return sent[-1]

    monkeypatch.setattr(vector_dedup, "tile_pairs", counted)
    x = np.random.default_rng(12).normal(size=(1500, 64))
    assert vector_dedup.near_vectors(vectors(spark, x)).where("n_links > 0").isEmpty()
    copies = sent[0].selectExpr("sum(size(one) + size(other))").first()[0]
    assert copies < 40 * len(x)


def test_strips_of_a_tile_count_every_link(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "STRIP", 7)
    x = clusters(np.random.default_rng(14), 200)
    x[:60] = x[0] + np.random.default_rng(15).normal(size=(60, 16)) * 0.01
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    like = u @ u.T >= 0.9
    np.fill_diagonal(like, False)
    group = components(200, list(zip(*np.nonzero(like))))
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(vectors(spark, x)).collect()}
    assert [got[i]["n_links"] for i in range(200)] == like.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(200)] == [int(g) for g in group]


def test_vectors_that_link_with_nothing(spark):
    rows = vectors(spark, [[1.0, 0.0], [1.0, 0.01], *BAD, [1.0, 0.0]])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(rows).collect()}
    assert got[0] == got[1] == got[9] == (2, 0) and all(got[i] == (0, i) for i in range(2, 9))
    assert vector_dedup.near_vectors(rows.limit(0)).count() == 0
    only_bad = vectors(spark, BAD)
    assert vector_dedup.near_vectors(only_bad).count() == len(BAD)
    found = ann.search(rows.where("vec_id % 2 = 0"), rows).collect()
    assert {r["query_id"] for r in found} == {0} and [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [9, 1]
    assert ann.search(only_bad, only_bad).count() == 0 and ann.search(rows.limit(0), rows.limit(0)).count() == 0


def test_search_recall_and_exact_scores(spark, read):
    rows = read("select vec_id, embedding from {embeddings} order by vec_id")
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = queries.op7_nearest(spark, "/root/testdata/sf0.001").collect()
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosines = u @ u[q]
        mine = sorted([r for r in got if r["query_id"] == ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - cosines[np.searchsorted(ids, r["vec_id"])]) < 1e-9 for r in mine)
        order = [j for j in np.lexsort((ids, -cosines)) if j != q][:5]
        hits += len({int(ids[j]) for j in order} & {r["vec_id"] for r in mine})
    assert hits / len(got) >= 0.9


def test_search_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "RERANK", 40)
    x = clusters(np.random.default_rng(8), 2000)
    x[50:70] = x[0]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    rows = vectors(spark, x)
    got = ann.search(rows.where("vec_id % 50 = 0"), rows).collect()
    hits = 0
    for q in range(0, 2000, 50):
        cosines = np.round(u @ u[q], 12)
        want = [j for j in np.lexsort((np.arange(2000), -cosines)) if j != q][:5]
        hits += len(set(want) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits / 200 >= 0.9
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])] == [50, 51, 52, 53, 54]


def test_search_carries_its_bounds_from_block_to_block():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(6000, 64)), rng.normal(size=(20, 64))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    books = ann.train(u[:2000])
    code = ann.encode(u, books)
    coded = ann.decode(code, books)
    norm = np.linalg.norm(coded, axis=1)
    close = (u * coded).sum(axis=1) / norm
    asked = pa.array([{"id": -1 - i, "vector": v.tolist()} for i, v in enumerate(q)])
    bounds, found = {}, []
    for at in range(0, 6000, 2000):
        entries = pa.array([{"ids": [i], "vector": x[i].tolist(), "code": code[i].tobytes(), "norm": norm[i], "close": close[i]} for i in range(at, at + 2000)])
        found.append(ann._search_block(asked, entries, books.astype(np.float32), 64, 5, bounds))
    assert len(found[2][0]) < len(found[0][0]) == 100  # later blocks give what may still be nearest
    ids, named, scores = (np.concatenate([f[j] for f in found]) for j in range(3))
    for i, v in enumerate(q):
        cosines = u @ (v / np.linalg.norm(v))
        mine = np.flatnonzero(ids == -1 - i)
        best = mine[np.argsort(-scores[mine])][:5]
        assert named[best].tolist() == np.argsort(-cosines)[:5].tolist() and np.allclose(scores[best], np.sort(cosines)[-5:][::-1])


def test_vector_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    want = {tuple(r) for r in con.execute(f"select vec_id, n_links, component_id, kept from ({queries.oracle_sql()['op2_embedding_dedup']})").fetchall()}
    got = queries.op2_embedding_dedup(spark, "/root/testdata/sf0.01").select("vec_id", "n_links", "component_id", "kept")
    assert {tuple(r) for r in got.collect()} == want


def test_query_blocks_are_not_broadcast_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 64)).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    bounds = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": "256k"}
    before = {k: spark.conf.get(k) for k in bounds}
    for k, v in bounds.items():
        spark.conf.set(k, v)
    try:  # 60 queries in each of 75 blocks are over 1 MB
        got = ann.search(rows.where("vec_id % 10 = 0"), rows).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 600, 10):
        want = [i for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
