"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import BROADCAST, connected_components, decoded, id_field, scratch, spread, tile_pairs
from trackweave.llm.tokens import mixed
from trackweave.llm.vectors import small_batches

#: Fingerprints in one tile, about.
TILE = 2048
#: Parts of a fingerprint whose population counts name a tile, from so many fingerprints on:
#: more parts make smaller tiles, of which more touch.
PARTS = ((0, 4), (1 << 22, 8))
#: Base of the number that population counts are written as.
BASE = 32
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 16
#: 64-bit words of the wide fingerprint; tables of its tiles, and least shingles that name one.
WIDE, TABLES, MARKS = 4, 10, 2
#: Shingles of the sets that are compared with others in one task, about.
SHINGLES = 1 << 20


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 with seed 42 of every shingle of ``width`` words, repeats included.

    A-Z are lower-cased, words split at ASCII white space and shingles joined by one
    space.  Fewer words make one shingle; no word makes none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width]))
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a text's shingles, repeats included; zero without a word."""
    return majority(shingle_hashes(text, width))


#: Steps of the hashes that wide fingerprints and tile names are made of.
_STEPS = np.arange(1, WIDE + TABLES * MARKS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)


def _remixed(hashes: np.ndarray) -> np.ndarray:
    """Further 64 bits of each hash, a row for each of the ``_STEPS``."""
    return mixed(hashes[None, :] + _STEPS)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of a text's different shingles, sorted."""
    return np.unique(shingle_hashes(text, width))


def set_name(hashes: np.ndarray) -> int:
    """The name of a set of shingles; equal sets, and they alone, share it."""
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes()) - (1 << 63)


def wide_fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """256-bit SimHash of a set of shingles, and the names of its tiles: in each table the
    ``MARKS`` shingles that come first in that table's order."""
    counts = np.zeros((WIDE, 64), np.int64)
    first = np.full(TABLES * MARKS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), BLOCK // 16):
        part = _remixed(hashes[at : at + BLOCK // 16])
        bits = np.unpackbits(part[:WIDE].astype("<u8").view(np.uint8).reshape(WIDE, -1, 8), axis=2, bitorder="little")
        counts += bits.sum(axis=1, dtype=np.int64)
        first = np.minimum(first, part[WIDE:].min(axis=1))
    words = np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]
    table = mixed(mixed(first[0::MARKS]) + sum(first[k::MARKS] * np.uint64(2 * k + 1) for k in range(1, MARKS)))
    return words, table.view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` of every document, ``fp`` as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in decoded(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(each, T.StructType([id_field(docs, id_col)]).add("fp", "long"))


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``(id, doc, name, w0, w1, w2, w3, shingles, marks)`` of every document; ``doc`` is a
    hash of id and text, ``name`` that of the set of shingles."""
    words = [f"w{k}" for k in range(WIDE)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints, marks, counts = [], [], [], []
            for text in decoded(batch.column(2)):
                hashes = shingle_set(text, width)
                bits, mark = wide_fingerprint(hashes)
                names.append(set_name(hashes))
                prints.append(bits)
                marks.append(mark)
                counts.append(len(hashes))
            bits = np.array(prints, np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.int64()), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WIDE)], pa.array(counts, pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
                ["id", "doc", "name", *words, "shingles", "marks"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    fields = T.StructType([id_field(docs, id_col)])
    for name in ("doc", "name", *words, "shingles"):
        fields = fields.add(name, "long")
    return rows.mapInArrow(each, fields.add("marks", T.ArrayType(T.LongType())))


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, bits) of rows (one column a word) within ``radius`` bits.

    Blocks of rows whose population counts differ by more than that are skipped, and so
    are pairs that differ by more in the words looked at so far.
    """
    ones_a, ones_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    order_a, order_b = np.argsort(ones_a, kind="stable"), np.argsort(ones_b, kind="stable")
    a, b, ones_a, ones_b = a[order_a], b[order_b], ones_a[order_a], ones_b[order_b]
    full = min(2, a.shape[1])
    found = []
    step = max(1, (1 << 19) // max(1, len(b)))
    for at in range(0, len(a), step):
        here = a[at : at + step]
        lo, hi = np.searchsorted(ones_b, ones_a[at] - radius), np.searchsorted(ones_b, ones_a[min(at + step, len(a)) - 1] + radius, side="right")
        if lo == hi:
            continue
        apart = np.bitwise_count(here[:, None, 0] ^ b[None, lo:hi, 0])
        for k in range(1, full):
            apart = apart + np.bitwise_count(here[:, None, k] ^ b[None, lo:hi, k])
        i, j = np.nonzero(apart <= radius)
        bits = apart[i, j].astype(np.int64)
        if a.shape[1] > full:
            bits += np.bitwise_count(here[i, full:] ^ b[lo + j, full:]).sum(axis=1, dtype=np.int64)
            near = bits <= radius
            i, j, bits = i[near], j[near], bits[near]
        found.append((order_a[at + i], order_b[lo + j], bits))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _spanning(i: np.ndarray, j: np.ndarray, bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links do, the closest ones: trees of least total distance."""
    if len(i) <= 4 * n:
        return i, j
    far = np.int64(1 << 30)
    apart = np.full((n, n), far, np.int32)
    apart[i, j] = apart[j, i] = bits
    out: list[tuple[int, int]] = []
    left = np.ones(n, bool)
    best, parent = np.full(n, far), np.zeros(n, np.int64)
    for _ in range(n):
        at = int(np.where(left, best, far + 1).argmin())
        left[at] = False
        if best[at] < far:
            out.append((parent[at], at))
        nearer = left & (apart[at] <= best) & (apart[at] < far)  # of equals the latest: chains, not stars
        best[nearer], parent[nearer] = apart[at][nearer], at
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _packed(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> bytes:
    """Pairs (i, j) of ``names`` as a compressed bit a place: their number may be the square of the names'."""
    bits = np.zeros(len(names) ** 2, bool)
    bits[i * len(names) + j] = True
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpacked(left: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(left), np.uint8), count=n * n))
    return at // n, at % n


def compare_tiles(spark, pairs: DataFrame, words: int, radius: int, alike: float = 0.0) -> DataFrame:
    """Links ``(a, b)`` of ``pairs(one, other, same)`` of tiles of (name, w0.., shingles).

    Each pair of tiles is one row, compared exactly by exclusive-or and bit counts; sets
    whose numbers of shingles are in a ratio below ``alike`` are no links.  A row yields no
    more links than connect its names.  With ``alike`` links are candidates only, so a row
    that yields fewer than it has also gives, in ``names``, ``shingles`` and ``left``, those it
    held back.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [np.empty((0, 2), np.int64)], []
            for k in range(batch.num_rows):
                sides = []
                for side in (0, 1):
                    part = [c.to_numpy(zero_copy_only=False) for c in batch.column(side)[k].values.flatten()]
                    order = np.argsort(part[0])
                    sides.append([p[order] for p in part])
                one, other = sides
                same = batch.column(2)[k].as_py()
                i, j, bits = _close(np.stack(one[1 : 1 + words], 1).view(np.uint64), np.stack(other[1 : 1 + words], 1).view(np.uint64), radius)
                keep = i < j if same else np.ones(len(i), bool)
                if alike:
                    na, nb = one[-1][i], other[-1][j]
                    keep &= np.minimum(na, nb) >= alike * np.maximum(na, nb)
                i, j, bits = i[keep], j[keep], bits[keep]
                shift = 0 if same else len(one[0])
                names = one[0] if same else np.concatenate([one[0], other[0]])
                all_i, all_j = i, j + shift
                i, j = _spanning(all_i, all_j, bits, shift + len(other[0]))
                found.append(np.stack([names[i], names[j]], 1))
                if alike and len(i) < len(all_i):
                    used = np.isin(all_i * len(names) + all_j, np.concatenate([i * len(names) + j, j * len(names) + i]))
                    shingles = one[-1] if same else np.concatenate([one[-1], other[-1]])
                    held.append((names, shingles, _packed(names, all_i[~used], all_j[~used])))
            yield _links_and_held(np.concatenate(found), held)

    with small_batches(spark, 64):
        return scratch(spark).write(pairs.select("one", "other", "same").mapInArrow(compare, HELD), "links")


#: Links, and in rows of their own what was held back.
HELD = "a long, b long, names array<long>, shingles array<long>, left binary"


def _links_and_held(links: np.ndarray, held: list[tuple[np.ndarray, np.ndarray, bytes]]) -> pa.RecordBatch:
    none, blank = [None] * len(held), [None] * len(links)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*links.min(axis=1).tolist(), *none], pa.int64()), pa.array([*links.max(axis=1).tolist(), *none], pa.int64()),
            *[pa.array(blank + [h[k].tolist() for h in held], pa.list_(pa.int64())) for k in (0, 1)], pa.array(blank + [h[2] for h in held], pa.binary()),
        ],
        ["a", "b", "names", "shingles", "left"],
    )


#: Names of a part of a tile in their places, and at -1 its pairs.
PLACES = "tile long, part long, at long, name long, group long, left binary"


def held_back(held: DataFrame, groups: DataFrame) -> DataFrame:
    """``PLACES`` of the pairs of ``held(names, shingles, left)`` that lie between different
    ``groups(id, component)``.  A part has the pairs of two blocks of names with about
    ``SHINGLES`` shingles each, so its sets fit into a task however long texts are."""
    store = scratch(held.sparkSession)
    held = store.write(held.select(F.xxhash64("names", "left").alias("tile"), "names", "shingles", "left").dropDuplicates(["tile"]), "held")  # tables may share a tile
    place = held.select("tile", F.posexplode(F.arrays_zip("names", "shingles")).alias("at", "of")).select("tile", "at", F.col("of.names").alias("name"), F.col("of.shingles").alias("shingles"))
    place = place.join(groups, F.col("name") == F.col("id"), "left").select("tile", F.col("at").cast("long").alias("at"), "name", F.coalesce("component", "name").alias("group"), "shingles")
    rows = place.unionByName(held.select("tile", F.lit(-1).cast("long").alias("at"), "left"), allowMissingColumns=True)

    def cut(table: pa.Table) -> pa.Table:
        tile, left = table.column("tile")[0].as_py(), _left(table)
        names, group, shingles = _in_place(table, "name", "group", "shingles")
        i, j = _unpacked(left, len(names))
        apart = group[i] != group[j]
        i, j = i[apart], j[apart]
        some = np.unique(np.concatenate([i, j]))
        block = np.zeros(len(names), np.int64)
        block[some] = (np.cumsum(shingles[some]) - shingles[some]) // SHINGLES
        part = block[i] * len(names) + block[j]  # i < j, so the first block is the smaller one
        out = []
        for k in np.unique(part):
            a, b = i[part == k], j[part == k]
            here = np.unique(np.concatenate([a, b]))
            n = len(here) + 1
            bits = _packed(here, np.searchsorted(here, a), np.searchsorted(here, b))
            out.append(pa.table({
                "tile": pa.array(np.full(n, tile)), "part": pa.array(np.full(n, k)), "at": pa.array(np.arange(-1, n - 1)), "name": pa.array([None, *names[here].tolist()], pa.int64()),
                "group": pa.array([None, *group[here].tolist()], pa.int64()), "left": pa.array([bits] + [None] * (n - 1), pa.binary()),
            }))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in (*[(c, pa.int64()) for c in ("tile", "part", "at", "name", "group")], ("left", pa.binary()))})

    return store.write(rows.groupBy("tile").applyInArrow(cut, PLACES), "places")


def _left(table: pa.Table) -> bytes:
    return table.column("left").drop_null()[0].as_py()


def _in_place(table: pa.Table, *columns: str) -> list[np.ndarray]:
    """Columns of a tile's names in the order of their places."""
    rows = table.filter(pc.greater_equal(table.column("at"), 0)).sort_by("at")
    return [rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in columns]


def verified_within(places: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that connect the groups of ``places`` as all pairs do whose sets, of
    ``known(name, hashes)``, have a Jaccard similarity of ``similarity`` or more, exactly.

    A part of a tile is one group of rows, which brings each of its sets once: rows grow with
    names, not with pairs."""
    rows = places.where("at >= 0").join(known, "name").select("tile", "part", "at", "name", "group", "hashes")
    rows = rows.unionByName(places.where("at < 0").select("tile", "part", "at", "left"), allowMissingColumns=True)

    def judge(table: pa.Table) -> pa.Table:
        names, group, hashes = _in_place(table, "name", "group", "hashes")
        i, j = _unpacked(_left(table), len(names))
        found = _joining([np.frombuffer(h, "<u8") for h in hashes], i, j, group, similarity)
        links = names[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(links.min(axis=1)), "b": pa.array(links.max(axis=1))})

    return rows.groupBy("tile", "part").applyInArrow(judge, "a long, b long")


def _joining(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, group: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Of the pairs (i, j) of ``sets`` those alike that join two groups.  A pair is passed over
    only where its groups are joined already."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mine = np.zeros(int(sizes.sum()), bool)
    order = np.argsort(i, kind="stable")
    j, bounds, group = j[order], np.searchsorted(i[order], np.arange(n + 1)), group.copy()
    out = []
    for k in range(n):
        to = j[bounds[k] : bounds[k + 1]]
        to = to[group[to] != group[k]]
        if not len(to):
            continue
        own = ids[starts[k] : starts[k] + sizes[k]]
        mine[own] = True
        if 8 * len(to) < n:
            both = np.array([np.count_nonzero(mine[ids[starts[x] : starts[x] + sizes[x]]]) for x in to])
        else:
            both = np.add.reduceat(mine[ids], starts, dtype=np.int64)[to]
        mine[own] = False
        for x in to[both >= similarity * (sizes[k] + sizes[to] - both)].tolist():
            if group[x] != group[k]:
                out.append((k, x))
                group[group == group[x]] = group[k]
    return out


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` that connect every two of the distinct ``fps(fp)`` within ``radius``.

    Tiles hold fingerprints whose parts have the same population counts.  Two fingerprints
    whose counts differ by more than ``radius`` in sum differ in more bits, so tiles further
    apart than that are skipped.  Crowded tiles are dealt to several by hash.  With more
    fingerprints more parts name a tile; the links are the same.
    """
    spark = fps.sparkSession
    n = fps.count()
    parts = max(p for least, p in PARTS if n >= least)
    width = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1))).cast("long") * BASE**i for i in range(parts)]
    keyed = fps.select(F.col("fp").alias("name"), F.col("fp").alias("w0"), sum(counts[1:], counts[0]).alias("tile"))
    steps = [sum(d * BASE**i for i, d in enumerate(delta)) for delta in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, delta)) <= radius]
    dealt = spread(keyed, ["tile"], F.col("name"), TILE)
    tiles = scratch(spark).write(dealt.groupBy("tile", "sub").agg(F.collect_list(F.struct("name", "w0")).alias("members")), "tiles")
    return compare_tiles(spark, tile_pairs(tiles, [], "tile", [s for s in steps if s >= 0], "members"), 1, radius).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint and group of every document.

    Documents link where fingerprints differ in at most ``radius`` bits; a group is
    what links connect, named by its smallest id.  Null and empty texts have
    fingerprint zero and link like any other.  Repeated rows are each returned; an
    empty table gives an empty result; other columns are ignored.

    Equal fingerprints are compared once, whatever their number, and each pair of
    tiles yields no more links than its fingerprints need.  Ids may be of any type that can
    be ordered; bytes that are no UTF-8 count as the replacement character.
    Returns id, fingerprint (16 hexadecimal digits), component_id.
    """
    store = scratch(docs.sparkSession)
    prints = store.write(fingerprints(docs, id_col, text_col, width), "prints")
    fps = store.write(prints.groupBy("fp").agg(F.min("id").alias("first")), "fps")
    groups = connected_components(fingerprint_links(fps.select("fp"), radius))
    member = fps.join(groups, F.col("fp") == groups["id"], "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    member = store.write(member, "groups")
    named = member.join(member.groupBy("group").agg(F.min("first").alias("component_id")), "group").select(F.col("fp").alias("of"), "component_id")
    return prints.join(named, F.col("fp") == F.col("of")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def expected_distance(similarity: float, bits: int = 64 * WIDE) -> int:
    """Bits in which fingerprints of sets of that Jaccard similarity differ, and three
    standard deviations more: the distance that all but one in 700 such pairs keep."""
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * angle + 3 * math.sqrt(bits * angle * (1 - angle)))


def candidate_links(classes: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, names, shingles, left)``: the closest of ``classes(name, w0.., shingles, marks)`` that may be
    alike, and what tiles held back.

    In each table, tiles hold classes whose ``MARKS`` first shingles are the same, as those
    of a pair as alike as ``similarity`` are in at least one of the ``TABLES`` with a
    probability of 1 - (1 - similarity ** MARKS) ** TABLES, 0.99996 at 0.8.  Crowded tiles
    are dealt to several by hash, each two of which are compared.
    """
    spark = classes.sparkSession
    words = [f"w{k}" for k in range(WIDE)]
    placed = classes.where("shingles > 0").select("name", *words, "shingles", F.posexplode("marks").alias("table", "mark"))
    member = F.struct("name", *words, "shingles")
    dealt = spread(placed, ["table", "mark"], F.col("name"), TILE).groupBy("table", "mark", "sub", "subs").agg(F.collect_list(member).alias("members"))
    tiles = scratch(spark).write(dealt.where("subs > 1 or size(members) > 1"), "tiles")
    alone = tiles.where("subs = 1").select(F.col("members").alias("one"), F.col("members").alias("other"), F.lit(True).alias("same"))
    pairs = alone.unionByName(tile_pairs(tiles.where("subs > 1"), ["table"], "mark", [0], "members").select("one", "other", "same"))
    return compare_tiles(spark, pairs, WIDE, expected_distance(similarity), similarity)


def sets_of(links: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(name, hashes)``: the sets of shingles of the classes that have ``links(a, b)``, computed
    again."""
    spark = docs.sparkSession
    store = scratch(spark)
    named = links.select(F.col("a").alias("name")).unionByName(links.select(F.col("b").alias("name"))).distinct()
    wanted = store.write(classes.join(named, "name").select(F.col("name").alias("of"), F.col("first.doc").alias("at")), "wanted")
    few = wanted.limit(BROADCAST + 1).count() <= BROADCAST

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width).astype("<u8").tobytes() for t in decoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["name", "hashes"])

    texts = docs.select(F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    of = texts.join(F.broadcast(wanted) if few else wanted, F.col("doc") == F.col("at")).select("of", "text")
    return store.write(of.mapInArrow(sets, "name long, hashes binary").dropDuplicates(["name"]), "sets")


def verified(links: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The ``links(a, b)`` whose sets of shingles, of ``known(name, hashes)``, have a Jaccard
    similarity of ``similarity`` or more, exactly."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u8") for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike[k] = both >= similarity * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(alike))

    one, other = known.select(F.col("name").alias("a"), F.col("hashes").alias("x")), known.select(F.col("name").alias("b"), F.col("hashes").alias("y"))
    return links.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(id, doc, first): every row and the (id, doc) that comes first in its group."""
    store = scratch(docs.sparkSession)
    prints = store.write(wide_fingerprints(docs, id_col, text_col, width), "prints")
    words = [f"w{k}" for k in range(WIDE)]
    classes = prints.groupBy("name", *words, "shingles", "marks").agg(F.min(F.struct("id", "doc")).alias("first"))
    classes = store.write(classes, "classes")
    found = candidate_links(classes, similarity)
    candidates = store.write(found.where("a is not null").select("a", "b").distinct(), "candidates")
    known = sets_of(candidates, classes, docs, id_col, text_col, width)
    links = store.write(verified(candidates, known, similarity), "alike")
    groups = connected_components(links)
    # a candidate that verification refuses may have stood for others: those between two groups go next, each tile's
    # in one task. A name that was held back has a candidate too, so its set is known
    held = found.where("names is not null").select("names", "shingles", "left")
    if not held.isEmpty():
        places = held_back(held, groups)
        more = store.write(verified_within(places, known, similarity), "alike")
        if not more.isEmpty():
            groups = connected_components(links.unionByName(more))
    member = classes.join(groups, F.col("name") == groups["id"], "left").select("name", "first", F.coalesce("component", "name").alias("group"))
    member = store.write(member, "groups")
    least = member.groupBy("group").agg(F.min("first").alias("least"))
    of = member.join(least, "group").select(F.col("name").alias("of"), "least")
    return prints.select("id", "doc", "name").join(of, F.col("name") == F.col("of")).select("id", "doc", F.col("least").alias("first"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups of documents whose sets of ``width``-word shingles are ``similarity`` alike.

    Equal sets are one class.  256-bit fingerprints of the sets are compared in tiles; of
    the pairs within the distance that pairs of ``similarity`` rarely exceed, the closest
    that connect a tile's classes are verified by exact Jaccard similarity, and then those
    between what this leaves apart, until none is left.  A group is what
    verified links connect, so every member has a partner of that similarity in it; a pair
    is missed where its fingerprints lie further apart or share no tile, in all about one
    in 600 of pairs at exactly ``similarity``.  Texts without words are one group.  Repeated
    rows are each returned; ids may be of any type that can be ordered; bytes that are no
    UTF-8 count as the replacement character; an empty table gives an empty result; other
    columns are ignored.
    Returns id, component_id (smallest id of the group).
    """
    return _groups(docs, id_col, text_col, width, similarity).select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document, that of smallest id, of each of its ``similar_groups``.

    Rows that share an id but not the text are told apart; of repeated rows one stays; null
    and empty texts are one group; an empty table stays empty; all columns are kept as they
    are.  Texts are not shuffled where the rows to drop are checked to be few.
    """
    store = scratch(docs.sparkSession)
    groups = store.write(_groups(docs, id_col, text_col, width, similarity), "members")
    gone = store.write(groups.where("doc <> first.doc").select(F.col("doc").alias("gone")).distinct(), "gone")
    again = store.write(groups.where("doc = first.doc").groupBy(F.col("doc").alias("again")).count().where("count > 1").select("again"), "again")
    few = gone.limit(BROADCAST + 1).count() <= BROADCAST
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(id_col, text_col).alias("doc"))
    rows = rows.join(F.broadcast(gone) if few else gone, F.col("doc") == F.col("gone"), "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    once = rows.join(again, F.col("doc") == F.col("again"), "left_semi").dropDuplicates(["doc"])
    return rows.join(again, F.col("doc") == F.col("again"), "left_anti").unionByName(once).select("row.*")
