"""Helpers shared by the operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.scratch import scratch

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4: rows never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def id_field(docs: DataFrame, id_col: str) -> T.StructField:
    """A result's ``id`` field: ids keep their type."""
    return T.StructField("id", docs.schema[id_col].dataType)


def decoded(column: pa.Array) -> list[str]:
    """Texts of a string or binary column; empty where null, bytes that are no UTF-8 replaced."""
    return [(t.as_py() or b"").decode("utf-8", "replace") for t in column.cast(pa.binary())]


#: Tiles of one place that are sent to others together.
PACK = 8
#: Groups that are broadcast at most, in a table of a few numbers each.
BROADCAST = 200_000


def spread(rows: DataFrame, keys: list[str], by: Column, most: int) -> DataFrame:
    """``rows`` with ``sub``, which deals the rows of a group of ``keys`` by ``by`` to as many
    parts as it has times ``most`` rows, and ``subs``, that number.

    Only groups of more rows are looked up, at most one for ``most`` rows; they are broadcast
    if their number is checked to be small and joined like any table otherwise, so a hot group
    is not read by one task before it is dealt out.
    """
    store = scratch(rows.sparkSession)
    crowds = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("subs")).where("subs > 1")
    crowds = store.write(crowds.select(*[F.col(k).alias(f"of_{k}") for k in keys], "subs"), "crowds")
    few = crowds.limit(BROADCAST + 1).count() <= BROADCAST
    same = [F.col(k) == F.col(f"of_{k}") for k in keys]
    met = rows.join(F.broadcast(crowds) if few else crowds, same, "left").drop(*[f"of_{k}" for k in keys])
    return met.withColumn("subs", F.coalesce("subs", F.lit(1))).withColumn("sub", F.when(F.col("subs") > 1, F.pmod(F.xxhash64(by), F.col("subs"))).otherwise(F.lit(0)))


def tile_pairs(tiles: DataFrame, within: list[str], place: str, steps: list[int], payload: str) -> DataFrame:
    """``(within, one, other, same)``: each pair of tiles that meet, once.

    Tiles are named by ``within``, ``place`` and ``sub``; those whose places are one of
    ``steps`` apart meet, and of one place each two ``sub`` do.  Packs of ``PACK`` tiles of a
    place meet by name first, then each tile is sent to the meetings of its pack: no place,
    however crowded, has all its pairs in one task, and a tile is copied once a pack that its
    own one meets, not once a partner.
    """
    named = tiles.withColumn("g", F.floor(F.col("sub") / PACK).cast("long"))
    names = named.select(*within, place, "g").distinct()
    one = names.select(*[F.col(w).alias(f"w_{w}") for w in within], F.col(place).alias("p"), F.col("g").alias("pg"), F.explode(F.array(*[F.lit(s).cast("long") for s in sorted(steps)])).alias("step"))
    there = [F.col(f"w_{w}") == F.col(w) for w in within]
    met = one.join(names, [*there, F.col("p") + F.col("step") == F.col(place)]).where("step > 0 or pg <= g").select(*[f"w_{w}" for w in within], "p", "pg", F.col(place).alias("q"), F.col("g").alias("qg"))
    met = scratch(tiles.sparkSession).write(met, "meetings")
    key = [*[f"w_{w}" for w in within], "p", "pg", "q", "qg"]
    left = met.join(named, [*there, F.col("p") == F.col(place), F.col("pg") == F.col("g")]).select(*key, F.col("sub").alias("s"), F.col(payload).alias("one"))
    right = met.join(named, [*there, F.col("q") == F.col(place), F.col("qg") == F.col("g")]).select(*key, F.col("sub").alias("r"), F.col(payload).alias("other"))
    pairs = left.join(right, key).where("p <> q or s <= r")
    return pairs.select(*[F.col(f"w_{w}").alias(w) for w in within], "one", "other", F.expr("p = q and s = r").alias("same"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of each vertex of ``edges(a, b)`` (longs), as ``(id, component)``.

    ``component`` is the smallest vertex reachable.  Alternating large-star and
    small-star rounds: every round points vertices at smaller ones until each
    component is a star round its smallest vertex.  Minima are aggregated before
    any shuffle and hub vertices only meet in a plain join, which adaptive
    execution splits, so a hub never has its neighbours gathered in one task.
    Vertices without edges are not returned.  Each round is written to the
    shared scratch folder, so lineage stays short.
    """
    spark = edges.sparkSession
    store = scratch(spark)

    def star(pairs: DataFrame) -> DataFrame:
        """(u, v) rows, u keeps its minimum m of neighbours and itself; v goes to m."""
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
        return pairs.join(low, F.col("u") == F.col("hub")).select("u", "v", "m")

    current = store.write(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = star(large)
        small = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = store.write(small, "edges")
        store.drop(current)
        current = following
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
