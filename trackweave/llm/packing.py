"""Best-fit packing of documents into bins, under conflicts of source and cluster."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import WORD, id_field, scratch

#: Words a bin holds, documents of one source it may hold, and rows packed together.
CAPACITY, PER_SOURCE, GROUP_ROWS = 2048, 8, 20_000


class Bins:
    """Open bins by residual, each with bitmaps of its sources and clusters.

    ``levels`` has one bit for each residual that some open bin has, so the successor
    of a size is one shift and the lowest bit left.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.levels = 0
        self.residual: list[int] = []
        self.clusters: list[int] = []
        #: planes[k][bin]: sources of which the bin has more than k documents
        self.planes: list[list[int]] = [[] for _ in range(per_source)]

    def _put(self, which: int) -> None:
        level = self.residual[which]
        self.open[level].append(which)
        self.levels |= 1 << level

    def place(self, size: int, source: int, cluster: int, parked: list[int]) -> tuple[int, int]:
        """The bin of least residual that fits without conflict, and the offset in it.

        The successor search goes on from residual to residual until a compatible bin
        is found, else a bin is opened.  Bins that already hold the cluster are moved
        to ``parked``: the rest of the cluster's run need not look at them again.
        """
        full, held = self.planes[-1], self.clusters
        at = size
        while rest := self.levels >> at:
            at += (rest & -rest).bit_length() - 1
            bins, kept, found = self.open[at], [], -1
            for n, which in enumerate(bins):
                if cluster >= 0 and held[which] >> cluster & 1:
                    parked.append(which)
                elif full[which] >> source & 1:
                    kept.append(which)
                else:
                    found = which
                    kept += bins[n + 1 :]
                    break
            self.open[at] = kept
            if not kept:
                self.levels &= ~(1 << at)
            if found >= 0:
                return self._add(found, size, source, cluster, parked)
            at += 1
        self.residual.append(self.capacity)
        self.clusters.append(0)
        for plane in self.planes:
            plane.append(0)
        return self._add(len(self.residual) - 1, size, source, cluster, parked)

    def _add(self, which: int, size: int, source: int, cluster: int, parked: list[int]) -> tuple[int, int]:
        offset = self.capacity - self.residual[which]
        self.residual[which] -= size
        bit = 1 << source
        for plane in self.planes:
            if not plane[which] & bit:
                plane[which] |= bit
                break
        if cluster >= 0:
            self.clusters[which] |= 1 << cluster
            parked.append(which)
        else:
            self._put(which)
        return which, offset

    def release(self, parked: list[int]) -> None:
        for which in parked:
            self._put(which)
        parked.clear()


def pack_rows(rows: list[tuple[int, object, object]], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[list[tuple[int, int, int, int]]]:
    """Pieces ``(bin, offset, start, words)`` of each row ``(size, source, cluster)``.

    Largest first; a row over the capacity fills bins of its own, which nothing else
    enters, and only its remainder is packed.  A cluster met once has no conflict.
    """
    sources: dict = {}
    count: dict = {}
    for _, _, cluster in rows:
        count[cluster] = count.get(cluster, 0) + 1
    shared: dict = {}
    bins, parked, pieces = Bins(capacity, per_source), [], [[] for _ in rows]
    last = object()
    whole = 0
    for i in sorted(range(len(rows)), key=lambda i: (-(rows[i][0] % capacity), str(rows[i][2]), i)):
        size, source, cluster = rows[i]
        if cluster != last:
            bins.release(parked)
            last = cluster
        full, rest = divmod(size, capacity)
        for k in range(full):
            whole += 1
            pieces[i].append((-whole, 0, k * capacity, capacity))
        if rest:
            number = shared.setdefault(cluster, len(shared)) if count[cluster] > 1 else -1
            which, offset = bins.place(rest, sources.setdefault(source, len(sources)), number, parked)
            pieces[i].append((which, offset, full * capacity, rest))
    opened = len(bins.residual)
    return [[(b if b >= 0 else opened - 1 - b, *p) for b, *p in row] for row in pieces]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack every document's words into bins of ``capacity`` words.

    No bin holds two documents of one duplicate cluster (``cluster``; by default equal
    texts, as a mix repeats them) nor more than ``per_source`` of one source.  Documents
    are dealt by hash to groups of about ``group_rows`` that are packed apart, so copies
    and sources spread evenly and every group leaves only its last bins ill filled.  Rows
    alike in all that counts are numbered and dealt one by one, however many they are.

    Documents without words (null, empty, white space) are returned once with a null
    bin.  A null source is a source like any other; repeated rows are packed one by one and,
    as equal texts, exclude each other; ids keep their type; an empty table gives an empty
    result; other columns are ignored.
    Returns id, piece, bin, bin_offset, start (first word in the document), words.
    """
    store = scratch(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.xxhash64(text) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
    )
    rows = store.write(rows.groupBy("id", "source", "size", "cluster").agg(F.count("*").alias("times")), "sized")
    groups = max(1, -(-(rows.agg(F.sum("times")).first()[0] or 0) // group_rows))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "copy"), F.lit(groups)))

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "copy", "cluster", "size"], kind="stable", na_position="last")
        packed = pack_rows(list(zip(frame["size"].tolist(), frame["source"].tolist(), frame["cluster"].tolist())), capacity, per_source)
        base = int(frame["part"].iloc[0]) << 32
        out = [(i, k, base + b, offset, start, words) for i, row in zip(frame["id"].tolist(), packed) for k, (b, offset, start, words) in enumerate(row)]
        return pd.DataFrame(out, columns=["id", "piece", "bin", "bin_offset", "start", "words"])

    schema = T.StructType([id_field(docs, id_col)]).add("piece", "integer").add("bin", "long").add("bin_offset", "integer").add("start", "long").add("words", "integer")
    packed = dealt.where("size > 0").groupBy("part").applyInPandas(each, schema)
    none = rows.where("size = 0").select("id", F.lit(0).alias("piece"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("bin_offset"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("words"))
    return packed.unionByName(none).withColumnRenamed("id", id_col)
