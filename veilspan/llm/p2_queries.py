"""p2: percentiles of durations and processing times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.percentiles import combine_days, day_summaries, percentiles
from veilspan.sources.tables import table

PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
GROUPS = ["measure_name", "source"]


def _values(spark: SparkSession, root: str) -> DataFrame:
    """Both measures as one frame: ``measure_name, source, day, v``."""
    metrics = table(spark, root, "performance_metrics", "ts", "event_name", "duration")
    results = table(spark, root, "detection_results", "ts", "category", "processing_time_ms")
    return metrics.select(F.lit("duration").alias("measure_name"), F.col("event_name").alias("source"), F.to_date(F.timestamp_seconds("ts")).alias("day"), F.col("duration").alias("v")).unionByName(
        results.select(F.lit("processing_time_ms").alias("measure_name"), F.col("category").alias("source"), F.to_date("ts").alias("day"), F.col("processing_time_ms").alias("v"))
    )


def p2_percentiles(spark: SparkSession, root: str) -> DataFrame:
    return percentiles(_values(spark, root).drop("day"), GROUPS, "v", PROBS).withColumn("value", F.round("value", 10))


def p2_day_summaries(spark: SparkSession, root: str) -> DataFrame:
    return day_summaries(_values(spark, root), GROUPS, "day", "v")


def p2_day_knots(spark: SparkSession, root: str) -> DataFrame:
    """The day summaries as a table of one row per kept order statistic."""
    return p2_day_summaries(spark, root).select(*GROUPS, "day", "n", F.inline("knots"))


def p2_combined_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """The same percentiles from the day summaries alone, with the proven rank error."""
    return combine_days(p2_day_summaries(spark, root), GROUPS, PROBS)


QUERIES = {"p2_day_knots": p2_day_knots, "p2_percentiles": p2_percentiles, "p2_day_summaries": p2_day_summaries, "p2_combined_percentiles": p2_combined_percentiles}
_DAYS = """
x AS (
  SELECT 'duration' AS measure_name, event_name AS source, CAST(make_timestamp(CAST(floor(ts * 1000000) AS BIGINT)) AS DATE) AS day, duration AS v FROM performance_metrics
  UNION ALL SELECT 'processing_time_ms', category, CAST(ts AS DATE), processing_time_ms FROM detection_results
), r AS (
  SELECT measure_name, source, day, v, row_number() OVER (PARTITION BY measure_name, source, day ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY measure_name, source, day) AS n FROM x WHERE isfinite(v)
), knots AS (
  SELECT measure_name, source, day, n, k, v FROM r WHERE n = 1 OR ((k * 256 + n - 2) // (n - 1)) * (n - 1) // 256 = k
)"""
ORACLE = {
    "p2_day_knots": f"WITH {_DAYS} SELECT * FROM knots",
    "p2_combined_percentiles": f"""WITH {_DAYS}, c AS (SELECT *, k - coalesce(lag(k) OVER (PARTITION BY measure_name, source, day ORDER BY k), -1) AS c FROM knots),
d AS (SELECT measure_name, source, day, any_value(n) AS n, max(c) - 1 AS slack FROM c GROUP BY ALL),
t AS (SELECT measure_name, source, CAST(sum(n) AS BIGINT) AS n, sum(slack) AS slack FROM d GROUP BY ALL),
w AS (SELECT measure_name, source, v, sum(c) AS c FROM c GROUP BY ALL),
u AS (SELECT *, sum(c) OVER (PARTITION BY measure_name, source ORDER BY v) AS upto FROM w),
p AS (SELECT u.*, n, slack, unnest({PROBS}) AS p FROM u JOIN t ON u.measure_name = t.measure_name AND u.source IS NOT DISTINCT FROM t.source)
SELECT measure_name, source, CAST(p AS DOUBLE) AS p, n, v AS value, CAST((slack + 1) / n AS DOUBLE) AS rank_error FROM p WHERE floor((n - 1) * p) < upto AND floor((n - 1) * p) >= upto - c""",
    "p2_percentiles": f"""
WITH x AS (
  SELECT 'duration' AS measure_name, event_name AS source, duration AS v FROM performance_metrics
  UNION ALL SELECT 'processing_time_ms', category, processing_time_ms FROM detection_results
), q AS (
  SELECT measure_name, source, count(*) AS n, quantile_cont(v, {PROBS}) AS qs FROM x WHERE isfinite(v) GROUP BY ALL
), u AS (
  SELECT measure_name, source, n, unnest({PROBS}) AS p, unnest(qs) AS value FROM q
)
SELECT measure_name, source, CAST(p AS DOUBLE) AS p, n, round(value, 10) AS value FROM u""",
}
