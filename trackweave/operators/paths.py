"""Cheapest paths by relaxation of many sources at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import edges as E
from trackweave.operators import filters
from trackweave.operators.filters import NoPath
from trackweave.operators.graph import Graph
from trackweave.scratch import scratch


def distances(edges: DataFrame | Graph, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Least costs from each of ``sources(leg, node)``: (leg, node, dist, hops, parent).

    Each round relaxes only nodes that the round before improved, keeps the least
    (cost, hops, parent) of a node by one aggregation, and writes the result, until
    nothing changes.  With ``targets(leg, target)`` nodes dearer than what already
    reaches the leg's target go no further.  Ties go to fewer hops, then to the
    smaller parent, so results don't depend on partitioning.  Edges of a ``Graph`` are never
    written: each round computes those of the nodes that move.
    """
    store = scratch(sources.sparkSession)
    near = None if isinstance(edges, Graph) else store.write(E.adjacency(edges).where(F.col("weight") < float("inf")).select(F.col("node").alias("from"), "other", "weight"), "adjacency")
    best = sources.select("leg", "node", F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("parent"), F.lit(1).alias("fresh"))
    while True:
        moving = best.where("fresh = 1")
        if targets is not None:
            reached = best.join(targets, (best["leg"] == targets["leg"]) & (best["node"] == targets["target"])).select(best["leg"].alias("of"), F.col("dist").alias("bound"))
            moving = moving.join(reached, F.col("leg") == F.col("of"), "left").where("bound is null or dist < bound").select("leg", "node", "dist", "hops")
        found = edges.relaxed(moving).withColumn("fresh", F.lit(1)) if near is None else moving.join(near, F.col("node") == F.col("from")).select(
            "leg", F.col("other").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("parent"), F.lit(1).alias("fresh")
        )
        known = best.withColumn("fresh", F.lit(0))
        least = F.min(F.struct("dist", "hops", "parent", "fresh")).alias("best")
        merged = known.unionByName(found).groupBy("leg", "node").agg(least).select("leg", "node", "best.*")
        seen = Observation()
        following = store.write(merged.observe(seen, F.sum("fresh").alias("fresh")), "best")
        store.drop(best)
        best = following
        if not seen.get["fresh"]:
            store.drop(near)
            return best.drop("fresh")


def trace(best: DataFrame, targets: DataFrame, chunk: int = 12) -> DataFrame:
    """Nodes of the path to each of ``targets(leg, target)``: (leg, hops, node, dist).

    Follows parents one hop a join, all legs together, for as many hops as the longest
    path has; every ``chunk`` hops the trail is written.
    """
    store = scratch(best.sparkSession)
    ends = best.join(targets, (best["leg"] == targets["leg"]) & (best["node"] == targets["target"])).select(best["leg"], "node", "dist", "hops", "parent")
    longest = ends.agg(F.max("hops")).first()[0] or 0
    rows, step = ends, ends
    for n in range(1, longest + 1):
        back = step.where("parent is not null").select(F.col("leg").alias("of"), F.col("parent").alias("at"))
        step = best.join(back, (F.col("leg") == F.col("of")) & (F.col("node") == F.col("at"))).select("leg", "node", "dist", "hops", "parent")
        if n % chunk == 0:
            step = store.write(step, "trail")
        rows = rows.unionByName(step)
    return rows.select("leg", "hops", "node", "dist")


def path(songs: DataFrame, edges: DataFrame | Graph, stops: list[int], allowed_types: list[str] | None = None, excluded_dirs: list[str] | None = None, base: str = "/music") -> DataFrame:
    """The cheapest path through ``stops`` in order: (pos, ord, hop_cost, cum_cost).

    Equal neighbouring stops are one; a single stop left is a path of one track and
    no cost, whatever the filters.  Junctions appear once.  Raises ``NoPath`` naming
    the legs that can't be joined.
    """
    spark: SparkSession = songs.sparkSession
    legs = [(a, b) for a, b in zip(stops, stops[1:]) if a != b]
    if not legs:
        return spark.createDataFrame([(0, stops[0], 0.0, 0.0)], "pos long, ord long, hop_cost double, cum_cost double")
    usable = filters.usable_edges(songs, edges, allowed_types, excluded_dirs, base)
    sources = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(legs)], "leg int, node long")
    targets = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(legs)], "leg int, target long")
    best = distances(usable, sources, targets)
    rows = sorted((r["leg"], r["hops"], r["node"], r["dist"]) for r in trace(best, targets).collect())  # the answer itself, a row a track
    reached = {leg for leg, *_ in rows}
    if missing := [f"{a} -> {b}" for i, (a, b) in enumerate(legs) if i not in reached]:
        raise NoPath("no path for " + ", ".join(missing))
    out, before, at = [], 0.0, 0.0
    for leg, hops, node, dist in rows:
        if hops == 0:
            before = at
            if leg > 0:
                continue
        out.append((len(out), node, before + dist - at, before + dist))
        at = before + dist
    return spark.createDataFrame(out, "pos long, ord long, hop_cost double, cum_cost double")
