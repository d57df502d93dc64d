"""Sharding by histogram sort: near-equal bytes in a fixed number of shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import scratch, spread

#: Bits of the key that one round of probes resolves, and the key's length:
#: 64 bits of the text's hash, then 64 bits of the id's.
DIGIT, HALF = 8, 64
TOP = 1 << 63
#: Rows that one slot-numbering group holds, about.
GROUP_ROWS = 50_000


def _digits(level: int) -> tuple[Column, Column]:
    """A row's key prefix above ``level`` within its half, and its digit there."""
    key, at = (F.col("k1"), level) if level < HALF // DIGIT else (F.col("k2"), level - HALF // DIGIT)
    unsigned = key.bitwiseXOR(F.lit(-TOP))
    shift = HALF - DIGIT * (at + 1)
    prefix = F.shiftrightunsigned(unsigned, shift + DIGIT) if at else F.lit(0).cast("long")
    return prefix, F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))


class _Splitter:
    """One boundary being searched: bytes known below ``prefix``, and its target."""

    def __init__(self, target: float):
        self.target, self.below, self.prefix, self.group, self.edge = target, 0, 0, None, None

    def probe(self, bins: list, level: int, slack: float, fine: float) -> None:
        """Narrow to the bin that holds the target, or settle on one of its edges."""
        second = level >= HALF // DIGIT
        for b in bins:
            if self.below + b["bytes"] < self.target:
                self.below += b["bytes"]
                continue
            under, over = self.target - self.below, self.below + b["bytes"] - self.target
            one_group = not second and b["lo"] == b["hi"]
            last = b["rows"] == 1 or level == 2 * HALF // DIGIT - 1
            if last or min(under, over) <= fine or one_group and min(under, over) <= slack:
                value = (self.prefix << DIGIT) + b["digit"] + (over < under)
                at = level % (HALF // DIGIT)
                value <<= HALF - DIGIT * (at + 1)
                self.edge = (self.group << HALF) + value if second else value << HALF
            elif one_group:
                self.group, self.prefix = b["lo"] + TOP, 0
            else:
                self.prefix = (self.prefix << DIGIT) + b["digit"]
            return
        self.edge = 1 << 2 * HALF


def splitters(keyed: DataFrame, n_shards: int, slack: float, fine: float) -> list[int]:
    """Boundaries in the 128-bit key space, by rounds of exact byte counts.

    Each round counts bytes for at most 256 probes below every open boundary, in
    one aggregation with map-side sums; the driver sees those counts alone.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    share = total / n_shards
    found = [_Splitter(share * k) for k in range(1, n_shards)]
    if not total:
        return []
    level = 0
    while open_ := [s for s in found if s.edge is None]:
        second = level >= HALF // DIGIT
        # boundaries inside one group wait for the second half of the key
        live = [s for s in open_ if second or s.group is None]
        if live:
            prefix, digit = _digits(level)
            rows = keyed.withColumns({"p": prefix, "digit": digit, "g": F.col("k1") if second else F.lit(0).cast("long")})
            wanted = sorted({((s.group - TOP) if second else 0, s.prefix) for s in live})
            if level or second:
                match = F.lit(False)
                for g, p in wanted:
                    match = match | ((F.col("g") == F.lit(g)) & (F.col("p") == F.lit(p)))
                rows = rows.where(match)
            counted = rows.groupBy("g", "p", "digit").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("k1").alias("lo"), F.max("k1").alias("hi")).collect()
            bins: dict[tuple, list] = {}
            for r in sorted(counted, key=lambda r: r["digit"]):
                bins.setdefault((r["g"], r["p"]), []).append(r)
            for s in live:
                s.probe(bins.get(((s.group - TOP) if second else 0, s.prefix), []), level, slack * share, fine * share)
        level += 1
    return [s.edge for s in found]


def _place(edges: list[int]) -> Column:
    """How many boundaries are at or below the row's key, as a balanced decision tree."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        edge = edges[mid]
        if edge >= 1 << 2 * HALF:
            return tree(lo, mid)
        first, second = (edge >> HALF) - TOP, (edge & ((1 << HALF) - 1)) - TOP
        below = (F.col("k1") < F.lit(first)) | ((F.col("k1") == F.lit(first)) & (F.col("k2") < F.lit(second)))
        return F.when(below, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges)).cast("int")


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.05, fine: float = 0.001) -> DataFrame:
    """Deal every document to one of ``n_shards`` shards of near-equal bytes.

    Keys are the text's hash, then the id's hash, so a shard is a range of keys and equal
    texts lie in one shard.  Boundaries are searched by histogram sort and fall between
    groups of equal texts wherever that costs at most ``slack`` of a shard's bytes; a larger
    group is split by id hash, exactly where the bytes balance.  Rows are then exchanged
    once, by ranges of the text's hash, to number their slots in the order of the keys; a
    range that a hot text crowds is numbered in parts by the id's hash, each in that order.

    Null texts have size 16 and crc32 0 and count as one group, as empty texts do.
    Repeated rows are placed one by one.  An empty table gives an empty result;
    other columns are ignored.

    Returns id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in
    each shard), grown_shard (null: the law does not depend on the shard count).
    """
    store = scratch(docs.sparkSession)
    text = F.col(text_col)
    keyed = store.write(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.xxhash64(text).alias("k1"),
            F.xxhash64(F.lit("id"), F.col(id_col)).alias("k2"),
        ),
        "keyed",
    )
    edges = splitters(keyed, n_shards, slack, fine)
    rows = keyed.count()
    ranges = max(8 * n_shards, -(-rows // (GROUP_ROWS // 4)))
    bits = min(48, (ranges - 1).bit_length())
    placed = keyed.withColumns({"shard": _place(edges), "part": F.shiftrightunsigned(F.col("k1").bitwiseXOR(F.lit(-TOP)), HALF - bits)})
    placed = spread(placed, ["shard", "part"], F.col("k2"), max(1024, 2 * rows // ranges)).drop("subs")
    before = Window.partitionBy("shard").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part", "sub").count().select("shard", "part", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part", "sub").orderBy("k1", "k2", "id")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(offsets, ["shard", "part", "sub"])
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard, rows sorted by slot in each file.

    ``placed`` is what ``shard_by_bytes`` gives of ``docs``.  Rows of a repeated id are written
    once for each of its places; rows with a null id are not written; an empty table writes
    an empty folder.  A column named ``shard`` or ``slot`` is replaced.
    """
    keys = placed.select(F.col(id_col), "shard", "slot")
    chunk = F.floor(F.col("slot") / GROUP_ROWS)
    (
        docs.drop("shard", "slot").join(keys, id_col).repartition("shard", chunk).sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
