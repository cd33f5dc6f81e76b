"""Exact medians of many groups without gathering any group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.operators.skew import join_small
from veilspan.session import materialize

#: Steps to a doubling in the first tally.
STEPS = 1_024
#: Values around a median that are tallied one by one; more are divided into PARTS again.
NEAR = 100_000
PARTS = 65_536


def size_bin(v: Column, steps: int = STEPS) -> Column:
    """A bin that grows with the value, ``steps`` to each doubling of its size."""
    octave = F.log2(F.least(F.greatest(F.abs(v), F.lit(1e-300)), F.lit(1e300)))
    return (F.signum(v) * (F.floor(octave * steps) + 1_000 * steps)).cast("bigint")


def _bracket(binned: DataFrame, groups: list[str]) -> DataFrame:
    """Of ``groups, bin, v, below, n`` (null ``n``: the rows are all there are) the bins that hold the two middle ranks: ``n, below, inside, lo, hi``."""
    bins = binned.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("below").alias("below"), F.first("n").alias("n"))
    w = Window.partitionBy(*groups)
    to = F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    ranked = bins.withColumn("n", F.coalesce("n", F.sum("c").over(w))).withColumn("to", to).withColumn("from", F.col("to") - F.col("c"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    held = lambda k: (F.col("from") <= k) & (k < F.col("to"))
    return ranked.where(held(low) | held(high)).groupBy(*groups).agg(F.first("n").alias("n"), F.min("from").alias("below"), F.sum("c").alias("inside"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def exact_medians(df: DataFrame, groups: list[str], value: str) -> tuple[DataFrame, int]:
    """One row per group: ``groups``, ``n``, ``median``; also the number of rows.

    A tally by size brackets the two middle ranks; where more than NEAR values lie in the bracket, it is divided again,
    until few or only equal ones are left.  Those are tallied by value, so a group of any size never meets in one task.
    ``value`` must hold neither null nor NaN.  For an even number the two middle values are averaged.  An empty input
    gives no rows.
    """
    none = F.lit(None).cast("bigint")
    values = df.select(*groups, F.col(value).cast("double").alias("v"))
    found = materialize(_bracket(values.withColumns({"bin": size_bin(F.col("v")), "below": F.lit(0).cast("bigint"), "n": none}), groups), "bracket")
    rows = found.count()
    wide = (F.col("inside") > NEAR) & (F.col("lo") < F.col("hi")) & (F.col("hi") - F.col("lo") < F.lit(float("inf")))
    while (left := found.where(wide).count()):
        met = join_small(values, found.where(wide), groups, left).where("v between lo and hi")
        part = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS).cast("bigint")
        finer = _bracket(met.select(*groups, "v", "below", "n", part.alias("bin")), groups)
        found = materialize(found.where(~wide).unionByName(finer), "bracket")
    inside = join_small(values, found.where("lo < hi").drop("inside"), groups, rows).where("v between lo and hi")
    tally = inside.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("c"), F.first("below").alias("below"), F.first("n").alias("n"))
    to = F.sum("c").over(Window.partitionBy(*groups).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    ranked = tally.withColumn("to", to).withColumn("from", F.col("to") - F.col("c"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    held = lambda k: F.max(F.when((F.col("from") <= k) & (k < F.col("to")), F.col("v")))
    out = ranked.groupBy(*groups).agg(F.first("n").alias("n"), held(low).alias("a"), held(high).alias("b"))
    out = out.select(*groups, "n", (F.col("a") + (F.col("b") - F.col("a")) / 2).alias("median"))
    return materialize(out.unionByName(found.where("lo >= hi").select(*groups, "n", F.col("lo").alias("median"))), "medians"), rows
