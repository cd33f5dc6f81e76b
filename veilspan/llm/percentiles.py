"""Exact percentiles from one distributed sort, and day summaries that can be put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.operators.skew import join_small
from veilspan.session import materialize

#: Intervals of equal rank in a day summary; the rank error of a combination is about 1 / KNOTS.
KNOTS = 256
#: A sorted row's place: its partition above these bits, its position below.
PART_BITS = 33


def ranked(df: DataFrame, groups: list[str], *order: str) -> tuple[DataFrame, DataFrame]:
    """The rows sorted over all partitions with their ``place``, and the offset of each group in each partition.

    The second frame has ``groups, part, first, count, before, n``: one row per partition
    and group in it, so hardly more than partitions and groups together.  A group of any
    size spreads over as many partitions as it needs, also one of equal values.
    """
    # Rows that are equal in every respect are dealt out by a number of their own.
    tied = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    rows = tied.repartitionByRange(*groups, *order, "_tie").sortWithinPartitions(*groups, *order).drop("_tie").withColumn("place", F.monotonically_increasing_id())
    rows = materialize(rows, "sorted")
    parts = rows.groupBy(*groups, F.shiftright("place", PART_BITS).alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*groups)
    before = F.sum("count").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    return rows, materialize(parts.withColumns({"before": before, "n": F.sum("count").over(w)}), "offsets")


def _picked(rows: DataFrame, offsets: DataFrame, groups: list[str], value: str, wanted: Column) -> DataFrame:
    """``groups, n, target`` (with k, the rank) and ``v``, the value at rank k, for every struct in ``wanted`` that lies in the partition."""
    here = F.filter(wanted, lambda t: (t["k"] >= F.col("before")) & (t["k"] < F.col("before") + F.col("count")))
    targets = offsets.select(*groups, "n", "first", "before", F.explode(here).alias("target"))
    targets = targets.select(*groups, "n", "target", (F.col("first") + F.col("target.k") - F.col("before")).alias("place"))
    targets = materialize(targets, "targets")
    return join_small(rows.select("place", F.col(value).alias("v")), targets, ["place"], targets.count())


def percentiles(df: DataFrame, groups: list[str], value: str, probs: list[float]) -> DataFrame:
    """``groups, p, n, value``: the exact percentile, interpolated between neighbouring order statistics; its error is 0.

    Null, NaN and infinite values are left out, as is a group that has nothing else;
    null group values are groups of their own; ties and repeated rows all count; an
    empty table gives no rows.
    """
    good = df.select(*groups, F.col(value).cast("double").alias("v")).where(F.abs("v") < F.lit(float("inf")))
    rows, offsets = ranked(good, groups, "v")

    def at(p: float) -> Column:
        h = (F.col("n") - 1) * F.lit(p)
        low = F.floor(h)
        return F.array(
            F.struct(F.lit(p).alias("p"), low.alias("k"), (1 - (h - low)).alias("w")),
            F.struct(F.lit(p).alias("p"), F.least(low + 1, F.col("n") - 1).alias("k"), (h - low).alias("w")),
        )

    wanted = F.flatten(F.array(*[at(p) for p in probs]))
    ends = _picked(rows, offsets, groups, "v", wanted).select(*groups, "n", "target.*", "v")
    # The two ends sum as v0 (1 - w) + v1 w.
    return ends.groupBy(*groups, "p").agg(F.first("n").alias("n"), F.sum(F.col("v") * F.col("w")).alias("value"))


def day_summaries(df: DataFrame, groups: list[str], day: str, value: str, knots: int = KNOTS) -> DataFrame:
    """``groups, day, n, knots``: the order statistics of a day at ``knots`` + 1 evenly spaced ranks, ends included.

    Summaries need no rows to be combined.  Days of up to ``knots`` + 1 values are
    kept in full.  Nulls and infinities as in ``percentiles``.
    """
    by = [*groups, day]
    good = df.select(*by, F.col(value).cast("double").alias("v")).where(F.abs("v") < F.lit(float("inf")))
    rows, offsets = ranked(good, by, "v")
    ranks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(knots)), lambda j: F.floor(j * (F.col("n") - 1) / knots)))
    wanted = F.transform(ranks, lambda k: F.struct(k.alias("k")))
    picked = _picked(rows, offsets, by, "v", wanted)
    return picked.groupBy(*by).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("target.k").alias("k"), "v"))).alias("knots"))


def combine_days(summaries: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """``groups, p, n, value, rank_error``: percentiles over all days of the summaries.

    ``rank_error`` is proven: the value's true rank is off by at most this share of n.
    """
    w = Window.partitionBy(*groups)
    # A knot stands for the values after the knot before it, itself included.
    steps = F.transform("knots", lambda x, i: F.struct(x["v"].alias("v"), (x["k"] - F.when(i > 0, F.get(F.col("knots"), i - 1)["k"]).otherwise(F.lit(-1))).alias("c")))
    days = summaries.withColumn("steps", steps).withColumn("slack", F.array_max(F.transform("steps", lambda s: s["c"])) - 1)
    total = days.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("slack").alias("slack"))
    weights = days.select(*groups, F.explode("steps").alias("s")).groupBy(*groups, F.col("s.v").alias("v")).agg(F.sum("s.c").alias("c"))
    weights = weights.withColumn("to", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    near = [c.eqNullSafe(d) for c, d in ((F.col(f"w.{g}"), F.col(f"t.{g}")) for g in groups)]
    on = near[0]
    for c in near[1:]:
        on &= c
    met = weights.alias("w").join(total.alias("t"), on).select(*[F.col(f"w.{g}").alias(g) for g in groups], "v", "to", "c", "n", "slack")
    at = lambda p: F.floor((F.col("n") - 1) * F.lit(p))
    hits = F.array(*[F.when((at(p) < F.col("to")) & (at(p) >= F.col("to") - F.col("c")), F.lit(p)) for p in probs])
    out = met.select(*groups, "n", "v", "slack", F.explode(F.filter(hits, lambda p: p.isNotNull())).alias("p"))
    return out.select(*groups, "p", "n", F.col("v").alias("value"), ((F.col("slack") + 1) / F.col("n")).alias("rank_error"))
