"""Rolling statistics and anomalies of metric series, also where one metric holds most points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.operators.skew import join_small
from veilspan.session import materialize

#: Points of one metric in a chunk; a larger metric is cut by time into as many as it takes.
CHUNK_ROWS = 200_000
#: Cuts that are looked through one by one.
STRIDE = 64

# Standard deviations of each sensitivity, and the severity ladder.
SENSITIVITY = {"low": 3.0, "medium": 2.5, "high": 2.0, "very_high": 1.5}
SEVERITY = ((4.0, "critical"), (3.0, "high"), (2.5, "medium"))
HISTORY, LEAST = 100, 10


def _cuts(series: DataFrame, chunk_rows: int) -> tuple[DataFrame, int]:
    """(metric, cuts) of the metrics with more than ``chunk_rows`` points, and how many those are."""
    most = series.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows)
    sizes = materialize(most, "large")
    large = sizes.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).first()
    if not large.k:
        return sizes, 0
    parts = -(-large.n // chunk_rows)
    probs = [i / parts for i in range(1, parts)]
    points = join_small(series.select("metric", F.col("ts").cast("double").alias("ts")), sizes, ["metric"], large.k)
    found = points.groupBy("metric").agg(F.first("n").alias("n"), F.percentile_approx("ts", probs, 10 * parts).alias("p"))
    step = F.greatest(F.lit(1), F.floor(F.lit(parts) * chunk_rows / F.col("n"))).cast("int")
    return materialize(found.select("metric", F.array_distinct(F.filter("p", lambda x, i: (i + 1) % step == 0)).alias("cuts")), "cuts"), large.k


def _at(t: Column) -> Column:
    """The number of cuts up to a time: first among every STRIDE-th, then between two of those."""
    coarse = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("cuts")), F.lit(STRIDE)), lambda i: F.get(F.col("cuts"), i - 1))
    skip = F.greatest(F.lit(0), F.size(F.filter(coarse, lambda c: c <= t)) - 1) * STRIDE
    return F.coalesce(skip + F.size(F.filter(F.slice("cuts", skip + 1, F.lit(STRIDE)), lambda c: c <= t)), F.lit(0))


def chunked(series: DataFrame, rows: int = 0, seconds: float = 0.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A series (metric, ts, id, value) with ``chunk`` and ``halo``.

    Metrics of more than ``chunk_rows`` points are cut by time; each chunk gets, as halo,
    what a frame of so many preceding rows or seconds can reach before it.  Windows
    are taken by (metric, chunk) and halo rows dropped after; no metric has to fit one task.
    """
    cuts, n = _cuts(series, chunk_rows)
    if not n:
        return series.withColumns({"chunk": F.lit(0), "halo": F.lit(False)})
    placed = join_small(series, cuts, ["metric"], n, "left").withColumn("chunk", _at(F.col("ts")))
    own = placed.withColumn("halo", F.lit(False))
    more = []
    if seconds:
        reach = _at(F.col("ts") + seconds)
        more.append(placed.where(reach > F.col("chunk")).withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, reach))).withColumn("halo", F.lit(True)))
    if rows:
        last = F.row_number().over(Window.partitionBy("metric", "chunk").orderBy(F.desc("ts"), F.desc("id")))
        more.append(placed.where(F.col("chunk") < F.size("cuts")).withColumn("r", last).where(F.col("r") <= rows).drop("r").withColumns({"chunk": F.col("chunk") + 1, "halo": F.lit(True)}))
    for m in more:
        own = own.unionByName(m)
    return own.drop("cuts")


def _window():
    return Window.partitionBy("metric", "chunk").orderBy("ts", "id")


def zscores(series: DataFrame, sensitivity: str = "medium", *keep: str) -> DataFrame:
    """Points far from the HISTORY points before them: ``metric, id, value, z, kind, severity``."""
    w = _window().rowsBetween(-HISTORY, -1)
    scored = chunked(series, rows=HISTORY).withColumns({"n": F.count("value").over(w), "mean": F.avg("value").over(w), "std": F.stddev_samp("value").over(w)})
    scored = scored.where((F.col("n") >= LEAST) & (F.col("std") > 0) & ~F.col("halo")).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))
    severity = F.lit("low")
    for bound, name in reversed(SEVERITY):
        severity = F.when(F.abs("z") > bound, name).otherwise(severity)
    return scored.where(F.abs("z") > SENSITIVITY[sensitivity]).select("metric", *keep, "id", "value", "z", F.when(F.col("z") > 0, "SPIKE").otherwise("DROP").alias("kind"), severity.alias("severity"))


def range_outliers(series: DataFrame) -> DataFrame:
    """Points below half the least or above one and a half times the greatest of the HISTORY points before them."""
    w = _window().rowsBetween(-HISTORY, -1)
    seen = chunked(series, rows=HISTORY).withColumns({"n": F.count("value").over(w), "low": F.min("value").over(w), "high": F.max("value").over(w)})
    return seen.where((F.col("n") >= LEAST) & ~F.col("halo") & ((F.col("value") < 0.5 * F.col("low")) | (F.col("value") > 1.5 * F.col("high")))).select("metric", "id", "value", "low", "high")


def trends(series: DataFrame) -> DataFrame:
    """The direction of each metric's last HISTORY points: later half against earlier half, within half a standard deviation."""
    newest = _newest(series, HISTORY)
    n = F.count(F.lit(1)).over(Window.partitionBy("metric"))
    halves = newest.withColumn("n", n).withColumn("late", F.col("r") <= F.ceil(F.col("n") / 2))
    out = halves.groupBy("metric").agg(
        F.first("n").alias("points"), F.avg(F.when(F.col("late"), F.col("value"))).alias("late_mean"), F.avg(F.when(~F.col("late"), F.col("value"))).alias("early_mean"), F.stddev_samp("value").alias("std")
    )
    diff = F.col("late_mean") - F.col("early_mean")
    direction = F.when(F.col("points") < LEAST, "insufficient").when(diff > 0.5 * F.col("std"), "increasing").when(diff < -0.5 * F.col("std"), "decreasing").otherwise("stable")
    return out.select("metric", "points", direction.alias("direction"))


def _newest(series: DataFrame, n: int) -> DataFrame:
    """The n newest points of each metric with their rank ``r``; a first cut by hash parts keeps large metrics apart."""
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id")))
    few = series.withColumn("part", part).withColumn("r", rank("metric", "part")).where(F.col("r") <= n)
    return few.withColumn("r", rank("metric")).where(F.col("r") <= n).drop("part")


def _extremes(v: np.ndarray, first: np.ndarray, pick) -> np.ndarray:
    """The least or greatest of v[first[i] .. i] for every i, from tables of doubling width."""
    at = np.arange(len(v))
    level = np.floor(np.log2(at - first + 1)).astype(int)
    out, wide = np.empty_like(v), v
    for k in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = pick(wide[first[own]], wide[at[own] - (1 << k) + 1])
        longer = wide.copy()
        if 1 << k < len(v):
            longer[: -(1 << k)] = pick(wide[: -(1 << k)], wide[1 << k :])
        wide = longer
    return out


def _sums(x: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """The sum of x[first[i] .. i]; prefix sums start anew every ``most`` places, so that they stay small, and a frame meets two of them at most."""
    at, blocks = np.arange(len(x)), -(-len(x) // most)
    padded = np.zeros(blocks * most, dtype=np.longdouble)
    padded[: len(x)] = x
    upto = np.cumsum(padded.reshape(blocks, most), axis=1).ravel()
    before = np.where(first % most > 0, upto[np.maximum(first - 1, 0)], 0)
    whole = upto[np.minimum(first // most * most + most - 1, len(upto) - 1)]
    return np.where(first // most == at // most, upto[at] - before, whole - before + upto[at])


def rolling(series: DataFrame, seconds: int, most: int) -> DataFrame:
    """For each point the statistics of the points of the last ``seconds``, at most the last ``most`` of them.

    Each chunk is one vectorized pass: frames only move on, so sums come from prefix sums and extremes from tables of
    doubling width, whatever the size of a frame.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ts", "id"], kind="stable")
        t, v = f["ts"].to_numpy(np.float64), f["value"].to_numpy(np.float64)
        first = np.maximum(np.searchsorted(t, t - seconds), np.arange(len(t)) - most + 1)
        n = np.arange(len(t)) - first + 1
        center = np.median(v)
        x = v.astype(np.longdouble) - center
        one, two = _sums(x, first, most), _sums(x * x, first, most)
        low, high = _extremes(v, first, np.minimum), _extremes(v, first, np.maximum)
        var = np.where((n > 1) & (low < high), np.maximum(two - one * one / n, 0) / np.maximum(n - 1, 1), 0)
        out = {"metric": f["metric"], "id": f["id"], "n": n, "mean": (center + one / n).astype(np.float64), "low": low, "high": high, "std": np.sqrt(var).astype(np.float64), "last": v}
        return pd.DataFrame(out)[~f["halo"].to_numpy()]

    kinds = {x.name: x.dataType.simpleString() for x in series.schema.fields}
    placed = chunked(series, rows=most).select("metric", "chunk", "ts", "id", F.col("value").cast("double").alias("value"), "halo")
    return placed.groupBy("metric", "chunk").applyInPandas(run, f"metric string, id {kinds['id']}, n bigint, mean double, low double, high double, std double, last double")


def threshold_alerts(series: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Alerts of points against every threshold of their metric: too few samples first, then minimum, maximum, relative change to the point before."""
    w = _window()
    placed = chunked(series, rows=1)
    own = (~F.col("halo")).cast("bigint")
    # Points of the chunks before count too.
    sizes = placed.groupBy("metric", "chunk").agg(F.sum(own).alias("size"))
    before = F.sum("size").over(Window.partitionBy("metric").orderBy("chunk")) - F.col("size")
    sizes = materialize(sizes.withColumn("before", before).drop("size"), "sizes")
    samples = F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = placed.withColumns({"previous": F.lag("value").over(w), "samples": samples}).where(~F.col("halo"))
    seen = join_small(seen, sizes, ["metric", "chunk"], sizes.count()).withColumn("samples", F.col("samples") + F.col("before"))
    met = join_small(seen, thresholds, ["metric"], thresholds.count())
    change = F.abs(F.col("value") - F.col("previous")) / F.abs("previous")
    kind = (
        F.when(F.col("samples") < F.col("sample_size"), None)
        .when(F.col("value") < F.col("min_value"), "min")
        .when(F.col("value") > F.col("max_value"), "max")
        .when((F.col("previous") != 0) & (change > F.col("change_threshold")), "change")
    )
    over = F.when(kind == "min", (F.col("min_value") - F.col("value")) / F.col("min_value")).when(kind == "max", (F.col("value") - F.col("max_value")) / F.col("max_value")).otherwise(change - F.col("change_threshold"))
    ladder = F.when(over > 0.5, "critical").when(over > 0.3, "high").when(over > 0.1, "medium").otherwise("low")
    return met.withColumns({"kind": kind, "severity": ladder}).where("kind is not null").select("metric", "id", "value", "kind", "severity")


def finite(c: Column) -> Column:
    return F.abs(c) < F.lit(float("inf"))
