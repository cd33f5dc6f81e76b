"""Implausible readings: phase-space thresholding, stuck runs and bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.operators.orderstats import exact_medians
from veilspan.operators.phase import BLOCK_ROWS, opened, ordered_pass
from veilspan.operators.skew import join_small
from veilspan.session import materialize

#: Consecutive equal readings that make a stuck run.
RUN = 10
#: Readings of a record: the ellipsoids reach as far as the largest of so many normal readings is expected to lie.
RECORD = 100_000
#: Most times that the ellipsoids are taken again without what they flagged; they stop sooner where nothing new is flagged.
ITERATIONS = 4
#: Steps to an octave in the tallies of scales; a scale is off by at most half a step, 1.1 %.
STEPS = 32
#: Normal-consistency factor of the median absolute deviation.
MAD_SIGMA = 1.4826


@dataclass(frozen=True)
class Measure:
    """Bounds and scale of one measure.

    ``ratio``: readings are compared as logarithms, and the stated tolerance is this factor of the median.
    Otherwise it is ``mads`` median absolute deviations.
    """

    name: str
    low: float
    high: float
    open_low: bool = False
    ratio: float | None = None
    mads: float = 10.0

    def possible(self, v: Column) -> Column:
        above = v > self.low if self.open_low else v >= self.low
        return ~F.isnan(v) & above & (v <= self.high) & (F.abs(v) != F.lit(float("inf")))

    def scale(self, v: Column) -> Column:
        """Where a possible reading lies on the measure's scale; null has no place."""
        return F.log(v) if self.ratio else v

    def holds(self, v: np.ndarray) -> np.ndarray:
        """Which readings are possible."""
        return np.isfinite(v) & ((v > self.low) if self.open_low else (v >= self.low)) & (v <= self.high)

    def scaled(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which readings are possible and have a place on the scale, and all places."""
        usable = self.holds(v) & (v > 0) if self.ratio else self.holds(v)
        return usable, np.log(np.where(usable, v, 1.0)) if self.ratio else v


MEASURES = (
    Measure("duration", 0.0, float("inf"), ratio=4.0),
    Measure("cpu_percent", 0.0, 100.0),
    Measure("memory_mb", 0.0, 10_000_000.0, open_low=True),
)
def _pick(measures, f) -> Column:
    """A CASE over the measure's number."""
    out = None
    for i, m in enumerate(measures):
        c = f(m)
        out = F.when(F.col("m") == i, c) if out is None else out.when(F.col("m") == i, c)
    return out


def _outside(u: np.ndarray, d1: np.ndarray, d2: np.ndarray, r) -> np.ndarray:
    """Which readings lie outside one of the three ellipses of their source; a zero axis lets nothing but zero inside."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        x, y, z = (np.where(d == 0, 0.0, np.square(d / a)) for d, a in ((u, r.a), (d1, r.b), (d2, r.c)))
        out = (x + y >= 1) | (y + z >= 1)
        if r.p > 0 and r.q > 0:  # else the third ellipse is none
            along, across = u * r.cs + d2 * r.sn, d2 * r.cs - u * r.sn
            out |= np.square(along) / r.p + np.square(across) / r.q >= 1
    return out | ~np.isfinite(u)


def _placed(r, measures):
    """(v, usable, u, d1, d2, stuck) of a row of readings with the middle of its source; what has no place on the scale is infinitely far, unless it is the median itself."""
    v, usable, x, d1, d2, stuck = opened(r, measures[r.m])
    far = np.where(v == r.median, 0.0, -np.inf)
    u = np.where(usable, x - r.middle, far) if r.middle == r.middle and r.middle is not None else far
    return v, usable, u, np.nan_to_num(d1), np.nan_to_num(d2), stuck


def _tallies(measures, later: bool):
    """By source the sizes of both differences of the readings inside the ellipses so far, and the moments of value and second difference."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                _, usable, u, d1, d2, stuck = _placed(r, measures)
                keep = usable & ~stuck & np.isfinite(u)
                if later:
                    keep &= ~_outside(u, d1, d2, r)
                u, d1, d2 = u[keep], d1[keep], d2[keep]
                if len(u):
                    ud, uu = float(u @ d2), float(u @ u)
                    for kind, d in ((1, np.abs(d1)), (2, np.abs(d2))):
                        bins, c = np.unique(np.where(d > 0, np.floor(np.log2(np.maximum(d, 1e-300)) * STEPS) + 1_000 * STEPS, 0).astype(np.int64), return_counts=True)
                        yield pd.DataFrame({"src": r.src, "m": np.int8(r.m), "kind": kind, "bin": bins, "c": c, "ud": np.where(np.arange(len(c)) == 0, ud, 0.0), "uu": np.where(np.arange(len(c)) == 0, uu, 0.0)})

    return run


def _axes(tallies: DataFrame, before: DataFrame | None, normal: DataFrame) -> DataFrame:
    """``src, m, n``, the half-axes ``a, b, c``, the turn and half-axes (squared ``p, q``) of the third ellipse.

    The scale of the value is known exactly.  Those of the differences are medians of |d1| and |d2| from tallies by
    size, so that no group is gathered.  No axis is longer than ``before``, and the turn stays: what was flagged stays flagged.
    """
    group, zero = ["src", "m"], F.lit(0.0)
    reach = MAD_SIGMA * math.sqrt(2 * math.log(RECORD))
    counts = tallies.groupBy(*group, "kind", "bin").agg(*[F.sum(x).alias(x) for x in ("c", "ud", "uu")])
    w = Window.partitionBy(*group, "kind")
    ranked = counts.withColumn("to", F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    middle = (F.col("to") * 2 >= F.col("n")) & ((F.col("to") - F.col("c")) * 2 < F.col("n"))
    size = F.when(F.col("bin") > 0, F.exp((F.col("bin") + (0.5 - 1_000 * STEPS)) * (math.log(2) / STEPS))).otherwise(0.0)
    scale = lambda k: F.coalesce(F.max(F.when(middle & (F.col("kind") == k), size)), zero) * reach
    turn = F.coalesce(F.atan(F.sum("ud") / F.nullif(F.sum("uu"), zero)), zero)
    out = ranked.groupBy(*group).agg(F.max("n").alias("n"), scale(1).alias("b"), scale(2).alias("c"), turn.alias("turn")).join(normal, group).withColumn("a", F.col("mad") * reach)
    if before is not None:
        out = out.drop("turn").join(before.select(*group, "turn", *[F.col(x).alias(f"old_{x}") for x in "abcpq"]), group).withColumns({x: F.least(x, f"old_{x}") for x in "abc"})
    out = out.withColumns({"cs": F.cos("turn"), "sn": F.sin("turn")})
    cs2, sn2, a2, c2 = (F.col(x) * F.col(x) for x in ("cs", "sn", "a", "c"))
    det = F.nullif(cs2 * cs2 - sn2 * sn2, zero)
    out = out.withColumns({"p": F.coalesce((cs2 * a2 - sn2 * c2) / det, zero), "q": F.coalesce((cs2 * c2 - sn2 * a2) / det, zero)})
    if before is not None:
        there = (F.col("old_p") > 0) & (F.col("old_q") > 0)
        new = (F.col("p") > 0) & (F.col("q") > 0)
        out = out.withColumns({x: F.when(there & new, F.least(x, f"old_{x}")).when(there, F.col(f"old_{x}")).otherwise(F.col(x)) for x in "pq"})
    return materialize(out.select(*group, "n", "a", "b", "c", "p", "q", "turn", "cs", "sn"), "axes")


def _judged(measures):
    """The faulty readings of each row: ``id, src, m, v, median, mad, fault``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                v, _, u, d1, d2, stuck = _placed(r, measures)
                impossible = ~measures[r.m].holds(v)
                spike = _outside(u, d1, d2, r) if r.a == r.a and r.a is not None else np.ones(len(v), dtype=bool)
                bad = np.flatnonzero(impossible | stuck | spike)
                fault = np.where(impossible, "impossible", np.where(stuck, "stuck", "spike"))[bad]
                if len(bad):
                    yield pd.DataFrame({"id": np.asarray(r.ids)[bad], "src": r.src, "m": np.int8(r.m), "v": v[bad], "median": r.median, "mad": r.mad, "fault": fault})

    return run


def flag_faults(df: DataFrame, source: str, ts: str, key: str, measures: tuple[Measure, ...] = MEASURES, iterations: int = ITERATIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per implausible reading: ``id, src, measure_name, v, median, mad, fault``.

    Every source (null is a source of its own) is judged against its own normal behaviour.
    ``fault`` is ``impossible`` (NaN, infinite or out of bounds), ``stuck`` (one of
    RUN or more equal readings in the order of (ts, id)) or ``spike``: outside one of
    three robust ellipses over value, first and second difference.  Their half-axes
    are sqrt(2 ln RECORD) times the robust scale.  What is flagged stays flagged, and the scales
    are taken again without it until nothing new is flagged, ``iterations`` times at most.
    Differences are between possible readings of the whole source, however it is cut.  Null readings are left out;
    repeated rows count as rows; an empty table gives no rows.
    """
    rows, group = ordered_pass(df, source, ts, key, measures, RUN, block_rows), ["src", "m"]
    good = rows.select(*group, F.explode("v").alias("v")).where(_pick(measures, lambda m: m.possible(F.col("v"))))
    medians, n_groups = exact_medians(good, group, "v")
    medians = medians.withColumn("middle", _pick(measures, lambda m: m.scale(F.col("median"))))
    u = _pick(measures, lambda m: m.scale(F.col("v"))) - F.col("middle")
    # What has no place on the scale is infinitely far, unless it is the median itself.
    u = F.coalesce(u, F.when(F.col("v") == F.col("median"), 0.0).otherwise(F.lit(float("-inf"))))
    mads, _ = exact_medians(join_small(good, medians, group, n_groups).select(*group, F.abs(u).alias("u")), group, "u")
    normal = materialize(medians.join(mads.select(*group, F.col("median").alias("mad")), group).select(*group, "median", "middle", "mad"), "normal")
    placed = join_small(rows, normal, group, n_groups, "left")
    tally = "src string, m tinyint, kind int, bin bigint, c bigint, ud double, uu double"
    axes = _axes(placed.drop("ids").mapInPandas(_tallies(measures, False), tally), None, normal)
    left = axes.agg(F.sum("n")).first()[0]
    for _ in range(iterations - 1):
        inside = join_small(placed.drop("ids"), axes.drop("n", "turn"), group, n_groups).mapInPandas(_tallies(measures, True), tally)
        axes = _axes(inside, axes, normal)
        now = axes.agg(F.sum("n")).first()[0]
        if now == left:
            break
        left = now
    # Without a usable reading a source has no ellipses, and what is left of it lies infinitely far.
    judged = join_small(placed, axes.drop("n", "turn"), group, n_groups, "left")
    tagged = judged.mapInPandas(_judged(measures), "id bigint, src string, m tinyint, v double, median double, mad double, fault string")
    name = _pick(measures, lambda m: F.lit(m.name))
    return tagged.select("id", F.nullif("src", F.lit("\0")).alias("src"), name.alias("measure_name"), "v", "median", "mad", "fault")


def confirmed(faults: DataFrame, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """The exact check after the ellipsoids: of the spikes, only those beyond the measure's stated tolerance."""
    far = None
    for m in measures:
        v, med = F.col("v"), F.col("median")
        c = (v > m.ratio * med) | (v < med / m.ratio) if m.ratio else F.abs(v - med) > m.mads * F.col("mad")
        mine = F.col("measure_name") == m.name
        far = F.when(mine, c) if far is None else far.when(mine, c)
    return faults.where((F.col("fault") != "spike") | far)
