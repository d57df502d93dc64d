"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import BROADCAST, WORD, scratch

#: No document is taken more often than this, and no source grows beyond it.
MOST = 3
#: Bits of the rounding order that name a bucket in one histogram pass.
BUCKET_BITS = 12
#: Documents behind the cut that are tried in one pass.
LATER = 128
#: Constraints of a joint dual, whose Hessian the driver solves.
MOST_CONSTRAINTS = 2048
#: What stands for a null member of a margin.
_NULL = "\x00null"


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Token targets of ``sizes(source, source_size)``, one row per source.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all
    tokens; a target stops at ``most`` times its source's size and the excess is
    reshared by weight until no target is above.  With sources sorted by
    size / weight, those capped come first, and the level of the rest follows from
    running sums.  One row per source meets in one task, documents never do.
    """
    total = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "rank")
    rows = (
        sizes.withColumn("rank", F.row_number().over(order))
        .withColumn("weight", F.pmod(F.col("rank") - 1, F.lit(3)) + 1)
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(total).cast("double"))
        .withColumn("capped_below", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("capped_below")) / F.col("weight_left"))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(total))
    )
    return rows.select(
        "source", "source_size", "weight",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"),
    )


def entropy_balance(rows: DataFrame, margins: dict[str, DataFrame], features: dict[str, float] | None = None, tokens: str = "tokens", tolerance: float = 1e-9, max_rounds: int = 100) -> DataFrame:
    """Rates of least relative entropy to the corpus that meet token targets.

    ``rows`` are documents, or cells of documents alike, with their tokens;
    ``margins[column]`` is a table (column, target) of tokens wanted of each member, and
    ``features[column]`` the total wanted of tokens * feature.  The least sum of
    tokens * (rate log rate - rate + 1) under every target has rates exp(x . multipliers),
    x a row's memberships and features.  The convex dual, sum of tokens * rate less the
    multipliers' product with the targets, is minimised by Newton's method: every round
    aggregates gradient and Hessian over all rows, map side first, and the driver solves
    for the step, which is halved until the dual falls enough.

    With one margin alone the Hessian is diagonal, so each member's Newton steps are taken
    where its sums are, whatever the number of members.  Several constraints, at most
    ``MOST_CONSTRAINTS`` (more raise an error), are solved jointly.  A target of zero gives
    rate zero; a null member of a margin is a member like any other; members without tokens
    keep rate 1 and members without a target are left out; targets that contradict each
    other raise an error.  An empty table gives an empty result.  Returns ``rows`` with ``rate``.
    """
    if len(margins) == 1 and not features:
        (column, targets), = margins.items()
        return _one_margin(rows, column, targets, tokens)
    return _joint(rows, margins, features or {}, tokens, tolerance, max_rounds)


def _one_margin(rows: DataFrame, column: str, targets: DataFrame, tokens: str) -> DataFrame:
    """``rows`` with the rate of their member, by Newton's method on its own multiplier m:
    the gradient is tokens * exp(m) - target, the Hessian tokens * exp(m)."""
    goal = targets.select(F.col(column).alias("member"), F.col("target").alias("goal"))
    sums = rows.groupBy(F.col(column).alias("of")).agg(F.sum(F.col(tokens)).cast("double").alias("held"))
    # from the right of the root every step goes left and none goes beyond it
    start = F.greatest(F.lit(0.0), F.col("goal") / F.col("held") - 1)
    step = lambda m, _: m - 1 + F.col("goal") / F.col("held") * F.exp(-m)
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step)
    rate = F.when(F.col("goal") <= 0, 0.0).when(F.col("held") <= 0, 1.0).otherwise(F.exp(solved))
    rates = sums.join(goal, F.col("of").eqNullSafe(F.col("member"))).select("of", rate.alias("rate"))
    return rows.join(rates, rows[column].eqNullSafe(rates["of"])).select(*[rows[c] for c in rows.columns], "rate")


def _joint(rows: DataFrame, margins: dict[str, DataFrame], features: dict[str, float], tokens: str, tolerance: float, max_rounds: int) -> DataFrame:
    """Newton's method on the joint dual of all margins and features."""
    store = scratch(rows.sparkSession)
    place: dict[tuple, int] = {}
    goals: list[float] = []
    dead: dict[str, list] = {}
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NULL))
    for column, table in margins.items():
        members = table.select(name(column).alias("m"), "target").limit(MOST_CONSTRAINTS + 1).collect()
        dead[column] = [r["m"] for r in members if r["target"] <= 0]
        for r in sorted(members, key=lambda r: r["m"]):
            if r["target"] > 0:
                place[column, r["m"]] = len(goals)
                goals.append(float(r["target"]))
    for column, goal in features.items():
        place[column, None] = len(goals)
        goals.append(float(goal))
    if len(goals) > MOST_CONSTRAINTS:
        raise ValueError(f"more than {MOST_CONSTRAINTS} constraints")
    known = F.lit(True)
    for column, table in margins.items():
        known = known & name(column).isin([m for c, m in place if c == column] + dead[column])
    kept = store.write(rows.where(known), "cells")
    live = kept
    for column in margins:
        if dead[column]:
            live = live.where(~name(column).isin(dead[column]))
    columns, numeric = list(margins), list(features)
    facts = [F.col(c).cast("double") for c in numeric]
    # rows alike in all that the dual sees are one
    cells = store.write(live.groupBy(*[name(c).alias(f"m{i}") for i, c in enumerate(columns)], *[f.alias(f"f{i}") for i, f in enumerate(facts)]).agg(F.sum(F.col(tokens).cast("double")).alias("w")), "cells")
    goal = np.array(goals)

    def tilt(multiplier: np.ndarray, member: Column | None, fact: Column | None, column: str) -> Column:
        if member is None:
            return fact * F.lit(float(multiplier[place[column, None]]))
        pairs = [F.lit(x) for (c, m), i in place.items() if c == column for x in (m, float(multiplier[i]))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), member), F.lit(0.0)) if pairs else F.lit(0.0)

    def exponent(multiplier: np.ndarray, members: list[Column], facts: list[Column]) -> Column:
        parts = [tilt(multiplier, m, None, c) for c, m in zip(columns, members)] + [tilt(multiplier, None, f, c) for c, f in zip(numeric, facts)]
        return F.exp(F.least(sum(parts, F.lit(0.0)), F.lit(300.0)))

    def sums(multiplier: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual, its gradient and its Hessian, from one pass over the cells."""
        w = F.col("w") * exponent(multiplier, [F.col(f"m{i}") for i in range(len(columns))], [F.col(f"f{i}") for i in range(len(numeric))])
        f = [F.col(f"f{i}") for i in range(len(numeric))]
        moments = [F.sum(w * x).alias(f"s{i}") for i, x in enumerate(f)] + [F.sum(w * f[i] * f[j]).alias(f"s{i}_{j}") for i in range(len(f)) for j in range(i, len(f))]
        found = cells.groupBy(*[f"m{i}" for i in range(len(columns))]).agg(F.sum(w).alias("s"), *moments).collect()
        value, slope, curve = -float(multiplier @ goal), -goal.copy(), np.zeros((len(goal), len(goal)))
        for r in found:
            value += r["s"]
            x = [(place[c, r[f"m{i}"]], r["s"]) for i, c in enumerate(columns)]
            at = [i for i, _ in x]
            slope[at] += r["s"]
            curve[np.ix_(at, at)] += r["s"]
            for i, c in enumerate(numeric):
                k = place[c, None]
                slope[k] += r[f"s{i}"]
                curve[at, k] += r[f"s{i}"]
                curve[k, at] += r[f"s{i}"]
                for j in range(i, len(numeric)):
                    other = place[numeric[j], None]
                    curve[k, other] += r[f"s{i}_{j}"]
                    if other != k:
                        curve[other, k] += r[f"s{i}_{j}"]
        return value, slope, curve

    multiplier = np.zeros(len(goals))
    value, slope, curve = sums(multiplier)
    scale = np.maximum(np.abs(goal), 1.0)
    for _ in range(max_rounds):
        if (np.abs(slope) <= tolerance * scale).all():
            break
        move = -np.linalg.lstsq(curve + 1e-12 * np.diag(np.diag(curve)), slope, rcond=1e-13)[0]
        size = min(1.0, 5.0 / max(1e-12, float(np.abs(move).max())))
        while size > 1e-9:
            after = sums(multiplier + size * move)
            if after[0] <= value + 1e-4 * size * float(slope @ move) + 1e-12 * abs(value):
                break
            size /= 2
        else:
            raise ValueError("the targets contradict each other")
        multiplier, (value, slope, curve) = multiplier + size * move, after
    if not (np.abs(slope) <= max(tolerance, 1e-6) * scale).all():
        raise ValueError("the targets contradict each other")
    gone = F.lit(False)
    for column in margins:
        gone = gone | (name(column).isin(dead[column]) if dead[column] else F.lit(False))
    return kept.withColumn("rate", F.when(gone, 0.0).otherwise(exponent(multiplier, [name(c) for c in columns], facts)))


def _order(id_: Column, text: Column) -> Column:
    """A document's place in the rounding order; documents alike in id and text share it."""
    return F.xxhash64(F.lit("mix"), id_, text)


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """``(source, source_size, target, rate, whole, need, cut, later)``: how each source is taken.

    A source's rate is its exponential tilt.  A document gets the rate's whole part; the
    fraction's words, ``need``, go to documents in an order given by a hash of id and text, as
    far as they fit.  A histogram of that order and a look into the bucket where it ends give
    ``cut``: documents before it of at most ``need`` words get a copy more.  What is left goes
    to the documents behind it that still fit, one after another, ``LATER`` of them at a time
    until none fits; ``later`` are their orders.  So a source falls short of its target by
    less than its smallest remaining document.

    Passes read sizes alone and move one row a source and bucket, or the first documents.
    """
    store = scratch(docs.sparkSession)
    text = F.col(text_col)
    sized = store.write(docs.select(F.col(source_col).alias("source"), _size(text).alias("size"), _order(F.col(id_col), text).alias("order")), "sized")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    targets = store.write(targets, "targets")
    rates = entropy_balance(targets.withColumnRenamed("source_size", "tokens"), {"source": targets.select("source", "target")})
    rate = F.least(F.round("rate", 12), F.lit(float(most)))
    need = F.when(F.col("rate") > F.floor("rate"), F.col("target") - F.floor("rate") * F.col("source_size")).otherwise(0.0)
    known = rates.select("source", F.col("tokens").alias("source_size"), "target", rate.alias("rate"))
    known = store.write(known.withColumns({"whole": F.floor("rate").cast("int"), "need": need}), "known")
    few = known.limit(BROADCAST + 1).count() <= BROADCAST
    near = F.broadcast if few else lambda table: table
    bucket = F.shiftright("order", 64 - BUCKET_BITS)
    rest = sized.where("size > 0")
    upto = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy("of").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needs = known.select(F.col("source").alias("of"), F.col("need").alias("left"))
    open_ = rest.join(near(needs), F.col("source").eqNullSafe(F.col("of"))).where(F.col("size") <= F.col("left"))
    counted = open_.groupBy("of", "left", bucket.alias("bucket")).agg(F.sum("size").alias("words")).withColumn("sum", F.sum("words").over(upto))
    edge = counted.groupBy(F.col("of").alias("at")).agg(
        F.min(F.when(F.col("sum") > F.col("left"), F.col("bucket"))).alias("last"), F.coalesce(F.max(F.when(F.col("sum") <= F.col("left"), F.col("sum"))), F.lit(0)).alias("below"),
    )
    edge = store.write(edge, "edge")
    within = open_.join(near(edge), F.col("of").eqNullSafe(F.col("at"))).where(bucket == F.col("last"))
    # documents of one order are taken together; the cut is the first order that does not fit
    ranked = within.groupBy("of", "order", "left", "below").agg(F.sum("size").alias("size")).withColumn("sum", F.col("below") + F.sum("size").over(inside))
    over = ranked.groupBy(F.col("of").alias("in")).agg(
        F.min(F.when(F.col("sum") > F.col("left"), F.col("order"))).alias("cut"), F.max(F.when(F.col("sum") <= F.col("left"), F.col("sum"))).alias("sum"),
    )
    state = (
        needs.join(edge, F.col("of").eqNullSafe(F.col("at")), "left").join(over, F.col("of").eqNullSafe(F.col("in")), "left")
        .select("of", "cut", (F.col("left") - F.coalesce("sum", "below", F.lit(0))).alias("left"), F.col("cut").alias("behind"), F.array().cast("array<bigint>").alias("later"))
    )
    state = store.write(state, "state")
    first = Window.partitionBy("of").orderBy("order")
    top = F.lit(float((1 << 63) - (1 << 11)))
    take = lambda s, c: F.struct(
        F.when(c["size"] <= s["left"], s["left"] - c["size"]).otherwise(s["left"]).alias("left"),
        F.when(c["size"] <= s["left"], F.array_append(s["later"], c["order"])).otherwise(s["later"]).alias("later"),
    )
    while True:
        met = rest.join(near(state), F.col("source").eqNullSafe(F.col("of"))).where((F.col("order") > F.col("behind")) & (F.col("size") <= F.col("left")))
        # orders are hashes, so this share of what follows holds about four times as many as are tried
        counted = met.groupBy(F.col("of").alias("at"), "behind").agg(F.count("*").alias("n"))
        reach = F.col("behind") + F.floor((top - F.col("behind")) * F.least(F.lit(1.0), F.lit(4.0 * LATER) / F.col("n")))
        reach = store.write(counted.select("at", F.when(F.col("n") > 4 * LATER, reach).otherwise(F.lit((1 << 63) - 1)).cast("long").alias("reach")), "reach")
        if reach.isEmpty():
            break
        met = met.join(near(reach), F.col("of").eqNullSafe(F.col("at"))).where(F.col("order") <= F.col("reach"))
        groups = met.groupBy("of", "order", "left").agg(F.sum("size").alias("size")).where("size <= left")
        some = groups.withColumn("n", F.row_number().over(first)).where(F.col("n") <= LATER).groupBy("of", "left").agg(F.array_sort(F.collect_list(F.struct("order", "size"))).alias("c"))
        folded = F.aggregate("c", F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("later")), take)
        found = store.write(some.select(F.col("of").alias("in"), folded.alias("f"), F.when(F.size("c") == LATER, F.element_at("c", -1)["order"]).alias("upto")), "later")
        state = store.write(
            state.join(found, F.col("of").eqNullSafe(F.col("in")), "left").join(reach, F.col("of").eqNullSafe(F.col("at")), "left").select(
                "of", "cut", F.coalesce("f.left", "left").alias("left"), F.coalesce("upto", "reach").alias("behind"), F.concat("later", F.coalesce("f.later", F.array().cast("array<bigint>"))).alias("later"),
            ),
            "state",
        )
    out = known.join(state.select("of", "cut", "later"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return store.write(out, "plan")


def _extra(size: Column, order: Column) -> Column:
    """Whether a document gets a copy more: before the cut if it fits the source's need at
    all, behind it if it was taken later."""
    before = (size <= F.col("need")) & (F.col("cut").isNull() | (order < F.col("cut")))
    return F.when((size > 0) & (before | F.array_contains("later", order)), 1).otherwise(0)


def _taken(docs: DataFrame, planned: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, size, copies, and the columns of ``planned``) of every document."""
    text = F.col(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("of"), F.col(id_col).alias("id"), _size(text).alias("size"), _order(F.col(id_col), text).alias("order"))
    few = planned.limit(BROADCAST + 1).count() <= BROADCAST
    met = rows.join(F.broadcast(planned) if few else planned, F.col("of").eqNullSafe(F.col("source")))
    return met.withColumn("copies", F.col("whole") + _extra(F.col("size"), F.col("order")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """How many copies of each document the mix takes, from every source near its target.

    Rates are those of ``entropy_balance``, rounded into copies as ``plan`` says; a document
    is taken by what the plan says of its source, size and order alone, so reruns agree and
    no text is shuffled.  Null texts have size 0, a null source is a source of its own, and
    rows alike in id and text are taken alike.  An empty table gives an empty result.  Other
    columns are ignored.
    Returns id, size, source_size, target, taken, copies, rate and source.
    """
    rows = _taken(docs.select(*dict.fromkeys([id_col, text_col, source_col])), plan(docs, id_col, text_col, source_col, most), id_col, text_col, source_col)
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.col("copies").cast("int").alias("copies"), "rate", F.col("of").alias(source_col),
    )


def repeat(docs: DataFrame, planned: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it.

    Rows that share an id but not the text are told apart; an empty table gives an empty
    result; all columns are kept as they are.  ``planned`` is what ``plan`` gives of ``docs``.
    """
    planned = plan(docs, id_col, text_col, source_col, most) if planned is None else planned
    rows = _taken(docs, planned, id_col, text_col, source_col).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")
