"""Aggregates on detections, snapshots, feedback and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.operators.orderstats import exact_medians

#: A confidence above this counts as positive.
POSITIVE = 0.5


def quality_by(df: DataFrame, *by: str) -> DataFrame:
    """Count, mean and population deviation of confidence, which stands for precision and recall too, its complement as false positive rate, and mean time; each pattern of a category is as diverse as any, so that share is 1."""
    conf = F.col("ml_confidence")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(conf), 9).alias("avg_confidence"), F.round(F.stddev_pop(conf), 9).alias("std_confidence"),
        F.round(F.avg(conf), 9).alias("precision"), F.round(F.avg(conf), 9).alias("recall"), F.round(1 - F.avg(conf), 9).alias("false_positive_rate"), F.lit(1.0).alias("pattern_diversity"), F.round(F.avg("processing_time_ms"), 6).alias("avg_ms"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, confidence: str, truth: str, *by: str) -> DataFrame:
    """Confusion counts and accuracy, precision, recall and F1, 0 where undefined; rows without truth or confidence are left out."""
    said, is_ = F.col(confidence) > POSITIVE, F.col(truth)
    known = df.where(F.col(confidence).isNotNull() & F.col(truth).isNotNull())
    counts = known.groupBy(*by).agg(F.count_if(said & is_).alias("tp"), F.count_if(said & ~is_).alias("fp"), F.count_if(~said & ~is_).alias("tn"), F.count_if(~said & is_).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", F.round(f1, 9)).withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall")})


def variant_summary(df: DataFrame) -> DataFrame:
    """Per test, group and metric: count, mean, exact median, deviation, least and greatest.

    The medians come from bracketed tallies, so that a test with most of the rows needs no task of its own.
    """
    v, by = F.col("metric_value"), ["test_id", "group_name", "metric_name"]
    rows = df.where(v.isNotNull()).withColumns({c: F.coalesce(c, F.lit("\0")) for c in by})
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 9).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 9).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"),
    )
    medians, _ = exact_medians(rows, by, "metric_value")
    out = out.join(medians.select(*by, F.round("median", 9).alias("median")), by)
    return out.withColumns({c: F.nullif(F.col(c), F.lit("\0")) for c in by})


def t_tests(df: DataFrame, control: str = "control", variant: str = "variant") -> DataFrame:
    """Student's two-sample t with pooled variance per test and metric; null where it is undefined."""
    g, v = F.col("group_name"), F.col("metric_value")
    side = lambda s: (F.count_if(g == s).alias(f"n_{s[0]}"), F.avg(F.when(g == s, v)).alias(f"mean_{s[0]}"), F.coalesce(F.var_samp(F.when(g == s, v)), F.lit(0.0)).alias(f"var_{s[0]}"))
    both = df.where(v.isNotNull() & g.isin(control, variant)).groupBy("test_id", "metric_name").agg(*side(control), *side(variant)).where("n_c > 0 and n_v > 0")
    free = F.col("n_c") + F.col("n_v") - 2
    pooled = F.try_divide((F.col("n_c") - 1) * F.col("var_c") + (F.col("n_v") - 1) * F.col("var_v"), free)
    t = F.try_divide(F.col("mean_v") - F.col("mean_c"), F.sqrt(pooled * (1 / F.col("n_c") + 1 / F.col("n_v"))))
    winner = F.when(F.col("mean_v") > F.col("mean_c"), variant).when(F.col("mean_v") < F.col("mean_c"), control)
    return both.select("test_id", "metric_name", "n_c", "n_v", F.round("mean_c", 9).alias("mean_c"), F.round("mean_v", 9).alias("mean_v"), free.alias("df"), F.round(t, 6).alias("t"), winner.alias("leader"))


def bucket(key: Column, size: int = 1_000_000) -> Column:
    """md5 of a key modulo ``size``, by Horner's rule on four pieces of 32 bits."""
    digest = F.md5(key)
    step = (1 << 32) % size
    out = F.lit(0).cast("bigint")
    for k in range(4):
        piece = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
        out = F.pmod(out * step + piece, F.lit(size))
    return out


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Last write wins: the row of each key with the greatest order; the aggregate combines before it shuffles."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_b")).select("_b.*")


def keep_best(old: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """Upsert that replaces only by a strictly higher score; replaced rows keep their id and go up a version."""
    o, n = old.alias("o"), new.alias("n")
    met = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    better = F.col(f"o.{key}").isNull() | (F.col(f"n.{score}") > F.col(f"o.{score}"))
    pick = lambda c: F.when(F.coalesce(better & F.col(f"n.{key}").isNotNull(), F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    same = {"pattern_id": F.coalesce("o.pattern_id", "n.pattern_id"), "version_no": F.coalesce(F.col("o.version_no") + F.coalesce(better & F.col(f"n.{key}").isNotNull(), F.lit(False)).cast("int"), F.lit(1))}
    return met.select(*[same.get(c, pick(c)).alias(c) for c in old.columns])
