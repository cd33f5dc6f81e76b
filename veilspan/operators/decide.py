"""Decisions on experiments, scores in service, and triggers of training."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.operators.quality import bucket

#: A difference is significant below this.
ALPHA = 0.05
#: Intervals of the integral under Student's density; beyond FAR nothing is left.
INTERVALS = 256
FAR = 38.0
#: The metric that decides a test.
DECISIVE = "accuracy"
# What the document type does to a confidence.
TYPE_FACTOR = {"insurance": 1.05, "legal": 0.95, "financial": 1.02, "medical": 1.03, "personal": 0.98}
#: Shifts of the argument of a gamma function before its series is good to ten digits.
SHIFTS = 8


def gamma_ratio(x: Column) -> Column:
    """gamma(x + 1/2) / gamma(x), from its series at a larger argument."""
    z = x + SHIFTS
    series = F.sqrt(z) * (1 - 1 / (8 * z) + 1 / (128 * z * z) + 5 / (1024 * z * z * z) - 21 / (32768 * z * z * z * z))
    for k in range(SHIFTS):
        series = series * (x + k) / (x + k + 0.5)
    return series


def p_value(t: Column, free: Column) -> Column:
    """Two-sided p of Student's t: Simpson's rule on the density over the angle, all in one expression; null without freedom."""
    size = F.least(F.abs(t), F.lit(FAR))
    angle = F.atan(size / F.sqrt(free))
    height = lambda i: F.pow(F.cos(angle * i / INTERVALS), free - 1) * F.when((i == 0) | (i == INTERVALS), 1).when(i % 2 == 1, 4).otherwise(2)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(INTERVALS)), F.lit(0.0), lambda a, i: a + height(i)) * angle / (3 * INTERVALS)
    p = 1 - 2 * area * gamma_ratio(free / 2) / math.sqrt(math.pi)
    return F.when((free > 0) & t.isNotNull(), F.when(F.abs(t) >= FAR, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))


def decided(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``t_tests`` with ``p``, ``significant`` and the winner of each metric; ``test_winner`` is that of the decisive metric."""
    p = F.round(p_value(F.col("t"), F.col("df").cast("double")), 6)
    rows = tests.withColumn("p", p).withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))
    rows = rows.withColumn("winner", F.when(F.col("significant"), F.col("leader")))
    overall = rows.where(F.col("metric_name") == DECISIVE).select("test_id", F.col("winner").alias("test_winner"))
    return rows.join(overall, "test_id", "left")


def metric_grid(results: DataFrame, tests: DataFrame, groups: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """Every group and tracked metric of every test, zeros where nothing was recorded; results of unknown tests are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("group_name"), F.lit(m).alias("metric_name")) for g in groups for m in metrics]))
    grid = tests.select("test_id", "test_name", cells.alias("c")).select("test_id", "test_name", "c.*")
    v = F.col("metric_value")
    got = results.where(v.isNotNull()).groupBy("test_id", "group_name", "metric_name").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    met = grid.join(got, ["test_id", "group_name", "metric_name"], "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c)
    return met.select("test_id", "test_name", "group_name", "metric_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), zero("mean"), zero("std"), zero("low"), zero("high"))


def created_test(shares: dict[str, float]) -> dict[str, float]:
    """The shares of a new test; they must add up to 1."""
    if not shares or abs(sum(shares.values()) - 1) > 0.001 or min(shares.values()) < 0:
        raise ValueError("the shares of a test must add up to 1")
    return shares


def started(tests: DataFrame, test_id: str, at: Column) -> DataFrame:
    return tests.withColumns({"is_active": F.when(F.col("test_id") == test_id, True).otherwise(F.col("is_active")), "created_at": F.when(F.col("test_id") == test_id, at).otherwise(F.col("created_at"))})


def concluded(tests: DataFrame, test_id: str, at: Column) -> DataFrame:
    return tests.withColumns({"is_active": F.when(F.col("test_id") == test_id, False).otherwise(F.col("is_active")), "deleted_at": F.when(F.col("test_id") == test_id, at).otherwise(F.col("deleted_at"))})


def assigned(key: Column, shares: dict[str, float], size: int = 1_000_000) -> Column:
    """The group of a key: the first whose cumulative share reaches the key's place between 0 and 1, else the first group."""
    place, up, out = bucket(key, size) / size, 0.0, None
    for group, share in created_test(shares).items():
        up = round(up + share, 9)
        hit = place <= up
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise(next(iter(shares)))


def served(model: Column, override: Column, fallback: Column, document_type: Column, trained: bool = True) -> Column:
    """A confidence in service: that of a learned pattern, else the model's by document type, else the rule's."""
    factor = F.lit(1.0)
    for kind, v in TYPE_FACTOR.items():
        factor = F.when(F.lower(document_type) == kind, v).otherwise(factor)
    own = F.coalesce(F.least(F.lit(1.0), model * factor), fallback) if trained else fallback
    return F.coalesce(override, own)


def training_reason(samples: Column, last_training: Column, now: Column, new_samples: Column, accuracy: Column, least: int = 50, hours: float = 24.0, enough: int = 100, drop: float = 0.05) -> Column:
    """Why training is due, or why not, in the order the reasons are asked for."""
    due = now.cast("double") - last_training.cast("double") > hours * 3600
    return (
        F.when(samples < least, "insufficient_samples").when(last_training.isNull(), "initial_training").when(due, "scheduled_training")
        .when(new_samples >= enough, "data_accumulation").when(accuracy < 1 - drop, "performance_degradation").otherwise("no_trigger")
    )


def retrain_due(total: Column, least: int = 100, step: int = 500) -> Column:
    return (total >= least) & (total % step == 0)
