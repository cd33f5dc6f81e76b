"""Queries on the event log and its metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import series as M
from veilspan.sources.tables import table

# Alert thresholds of the example metrics.
THRESHOLDS = [("ocr_page_finished", 1.0, 20.0, 0.5, 10), ("ner_pass_finished", 0.5, 8.0, 0.5, 10), ("cache_lookup", 0.001, 0.004, 0.5, 10)]


def _series(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "performance_metrics", "id", "ts", "event_name", "duration")
    return rows.where(M.finite(F.col("duration")) & F.col("event_name").isNotNull()).select(F.col("event_name").alias("metric"), "ts", "id", F.col("duration").alias("value"))


def events_latest_100(spark, root):
    rows = table(spark, root, "performance_metrics", "id", "ts", "event_name", "duration", "document_id")
    return rows.orderBy(F.desc_nulls_last("ts"), F.desc("id")).limit(100)


def events_page(spark, root):
    return table(spark, root, "performance_metrics", "id", "event_name", "ts").orderBy("id").offset(200).limit(100)


def event_summary(spark, root):
    """The last 500 events in short."""
    rows = table(spark, root, "performance_metrics", "id", "ts", "duration", "cpu_percent", "memory_mb")
    last = rows.orderBy(F.desc_nulls_last("ts"), F.desc("id")).limit(500)
    fine = lambda c: F.when(M.finite(F.col(c)), F.col(c))
    mean = lambda c, k=1.0: F.round(F.avg(fine(c)) * k, 2)
    return last.agg(F.count(F.lit(1)).alias("events"), mean("duration", 1000.0).alias("avg_ms"), mean("cpu_percent").alias("avg_cpu"), mean("memory_mb").alias("avg_memory"), F.max_by("id", F.struct("ts", "id")).alias("latest_id"))


def op_stats(spark, root):
    """Count and mean duration of every operation."""
    return _series(spark, root).groupBy(F.col("metric").alias("operation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("avg_duration"))


def json_details(spark, root):
    """Pages per worker, from the JSON details; details that are no JSON count for nobody."""
    rows = table(spark, root, "performance_metrics", "details").where("details is not null")
    parsed = rows.select(F.from_json("details", "worker string, pages bigint, retry bigint").alias("d")).where("d.worker is not null")
    return parsed.groupBy("d.worker").agg(F.count(F.lit(1)).alias("events"), F.sum("d.pages").alias("pages"))


def zscore_anomalies(spark, root):
    return M.zscores(_series(spark, root)).withColumn("z", F.round("z", 3))


def range_outliers(spark, root):
    return M.range_outliers(_series(spark, root))


def trend_half_split(spark, root):
    return M.trends(_series(spark, root))


def _rolled(spark, root, seconds, most):
    rows = M.rolling(_series(spark, root), seconds, most)
    # Means of few decimals often end in a 5 there; the last bit of a sum must not decide how it is rounded.
    return rows.withColumns({c: F.round(F.col(c) + 1e-13, 9) for c in ("mean", "std")})


def rolling_stats_1min(spark, root):
    return _rolled(spark, root, 60, 60)


def rolling_stats_5min(spark, root):
    return _rolled(spark, root, 300, 300)


def rolling_stats_1hour(spark, root):
    return _rolled(spark, root, 3600, 3600)


def limits(spark, without: tuple[str, ...] = ()):
    """The alert thresholds, less those of metrics that are named."""
    return spark.createDataFrame([t for t in THRESHOLDS if t[0] not in without], "metric string, min_value double, max_value double, change_threshold double, sample_size int")


def threshold_alerts(spark, root):
    return M.threshold_alerts(_series(spark, root), limits(spark))


def anomaly_rollup(spark, root):
    """Anomalies by kind and severity."""
    return M.zscores(_series(spark, root)).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("anomalies"))


def anomaly_top5(spark, root):
    return M.zscores(_series(spark, root)).groupBy("metric").agg(F.count(F.lit(1)).alias("anomalies")).orderBy(F.desc("anomalies"), "metric").limit(5)


def system_health(spark, root):
    """100 less 20 for a critical and 10 for a high anomaly of the last day; any critical one decides the status."""
    rows = table(spark, root, "performance_metrics", "ts")
    edge = rows.agg((F.max("ts") - 86400).alias("edge"))
    recent = M.zscores(_series(spark, root), "medium", "ts").join(F.broadcast(edge)).where("ts >= edge")
    count = lambda s: F.count_if(F.col("severity") == s)
    out = recent.agg(count("critical").alias("critical"), count("high").alias("high"))
    score = F.greatest(F.lit(0), 100 - 20 * F.col("critical") - 10 * F.col("high")).cast("bigint")
    return out.withColumn("score", score).withColumn("status", F.when(F.col("critical") > 0, "critical").when(F.col("score") >= 90, "healthy").when(F.col("score") >= 70, "warning").otherwise("critical"))


def daily_trend(spark, root):
    """Mean duration of each event by day."""
    rows = _series(spark, root).withColumn("day", F.to_date(F.timestamp_seconds("ts")))
    return rows.groupBy("metric", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"))


def retention_by_month(spark, root):
    """Events by month and whether they are older than 14 days before the newest."""
    rows = table(spark, root, "performance_metrics", "ts")
    edge = rows.agg((F.max("ts") - 14 * 86400).alias("edge"))
    return rows.join(F.broadcast(edge)).groupBy(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM").alias("month"), F.coalesce(F.col("ts") < F.col("edge"), F.lit(False)).alias("expired")).agg(F.count(F.lit(1)).alias("events"))


NAMES = ("events_latest_100", "events_page", "event_summary", "op_stats", "json_details", "zscore_anomalies", "range_outliers", "trend_half_split", "rolling_stats_1min", "rolling_stats_5min", "rolling_stats_1hour", "threshold_alerts", "anomaly_rollup", "anomaly_top5", "system_health", "daily_trend", "retention_by_month")
QUERIES = {n: globals()[n] for n in NAMES}

_S = "s AS (SELECT event_name AS metric, ts, id, duration AS value FROM performance_metrics WHERE isfinite(duration) AND event_name IS NOT NULL)"
_Z = f"""{_S}, w AS (
  SELECT *, count(value) OVER h AS n, avg(value) OVER h AS mean, stddev_samp(value) OVER h AS std, min(value) OVER h AS low, max(value) OVER h AS high
  FROM s WINDOW h AS (PARTITION BY metric ORDER BY ts, id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)
), z0 AS (SELECT *, (value - mean) / std AS z FROM w WHERE n >= 10 AND std > 0),
z AS (SELECT metric, id, value, z, CASE WHEN z > 0 THEN 'SPIKE' ELSE 'DROP' END AS kind, CASE WHEN abs(z) > 4 THEN 'critical' WHEN abs(z) > 3 THEN 'high' WHEN abs(z) > 2.5 THEN 'medium' ELSE 'low' END AS severity FROM z0 WHERE abs(z) > 2.5)"""
_T = ", ".join(f"('{m}', {a}, {b}, {c}, {n})" for m, a, b, c, n in THRESHOLDS)


def _rolling_sql(seconds: int, most: int) -> str:
    return f"""WITH {_S}, l AS (
  SELECT *, list(struct_pack(t := ts, v := value)) OVER (PARTITION BY metric ORDER BY ts, id ROWS BETWEEN {most - 1} PRECEDING AND CURRENT ROW) AS l FROM s
), v AS (SELECT *, list_transform(list_filter(l, lambda x: x.t >= ts - {seconds}), lambda x: x.v) AS v FROM l)
SELECT metric, id, CAST(len(v) AS BIGINT) AS n, round(list_avg(v) + 1e-13, 9) AS mean, list_min(v) AS low, list_max(v) AS high, round(coalesce(list_stddev_samp(v), 0.0) + 1e-13, 9) AS std, value AS last FROM v"""


ORACLE = {
    "events_latest_100": "SELECT id, ts, event_name, duration, document_id FROM performance_metrics ORDER BY ts DESC NULLS LAST, id DESC LIMIT 100",
    "events_page": "SELECT id, event_name, ts FROM performance_metrics ORDER BY id LIMIT 100 OFFSET 200",
    "event_summary": """WITH l AS (SELECT * FROM performance_metrics ORDER BY ts DESC NULLS LAST, id DESC LIMIT 500)
SELECT count(*) AS events, round(avg(duration) FILTER (isfinite(duration)) * 1000, 2) AS avg_ms, round(avg(cpu_percent) FILTER (isfinite(cpu_percent)), 2) AS avg_cpu, round(avg(memory_mb) FILTER (isfinite(memory_mb)), 2) AS avg_memory, (SELECT id FROM l ORDER BY ts DESC, id DESC LIMIT 1) AS latest_id FROM l""",
    "op_stats": f"WITH {_S} SELECT metric AS operation, count(*) AS n, round(avg(value), 9) AS avg_duration FROM s GROUP BY ALL",
    "json_details": """SELECT json_extract_string(details, '$.worker') AS worker, count(*) AS events, CAST(sum(CAST(json_extract(details, '$.pages') AS BIGINT)) AS BIGINT) AS pages
FROM performance_metrics WHERE json_valid(details) AND json_extract_string(details, '$.worker') IS NOT NULL GROUP BY ALL""",
    "zscore_anomalies": f"WITH {_Z} SELECT metric, id, value, round(z, 3) AS z, kind, severity FROM z",
    "range_outliers": f"WITH {_Z} SELECT metric, id, value, low, high FROM w WHERE n >= 10 AND (value < 0.5 * low OR value > 1.5 * high)",
    "trend_half_split": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, id DESC) AS r, count(*) OVER (PARTITION BY metric) AS c FROM s), n AS (SELECT *, least(c, 100) AS n FROM r WHERE r <= 100),
g AS (SELECT metric, any_value(n) AS points, avg(value) FILTER (r <= ceil(n / 2.0)) AS l, avg(value) FILTER (r > ceil(n / 2.0)) AS e, stddev_samp(value) AS std FROM n GROUP BY ALL)
SELECT metric, points, CASE WHEN points < 10 THEN 'insufficient' WHEN l - e > 0.5 * std THEN 'increasing' WHEN l - e < -0.5 * std THEN 'decreasing' ELSE 'stable' END AS direction FROM g""",
    "rolling_stats_1min": _rolling_sql(60, 60),
    "rolling_stats_5min": _rolling_sql(300, 300),
    "rolling_stats_1hour": _rolling_sql(3600, 3600),
    "threshold_alerts": f"""WITH {_S}, t(metric, lo, hi, ch, k) AS (VALUES {_T}), p AS (
  SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY ts, id) AS prev, row_number() OVER (PARTITION BY metric ORDER BY ts, id) AS rn FROM s
), a AS (SELECT p.*, t.lo, t.hi, t.ch, CASE WHEN rn < k THEN NULL WHEN value < lo THEN 'min' WHEN value > hi THEN 'max' WHEN prev <> 0 AND abs(value - prev) / abs(prev) > ch THEN 'change' END AS kind FROM p JOIN t USING (metric)),
b AS (SELECT *, CASE kind WHEN 'min' THEN (lo - value) / lo WHEN 'max' THEN (value - hi) / hi ELSE abs(value - prev) / abs(prev) - ch END AS d FROM a WHERE kind IS NOT NULL)
SELECT metric, id, value, kind, CASE WHEN d > 0.5 THEN 'critical' WHEN d > 0.3 THEN 'high' WHEN d > 0.1 THEN 'medium' ELSE 'low' END AS severity FROM b""",
    "anomaly_rollup": f"WITH {_Z} SELECT kind, severity, count(*) AS anomalies FROM z GROUP BY ALL",
    "anomaly_top5": f"WITH {_Z} SELECT metric, count(*) AS anomalies FROM z GROUP BY ALL ORDER BY anomalies DESC, metric LIMIT 5",
    "system_health": f"""WITH {_Z}, c AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM z JOIN performance_metrics USING (id) WHERE ts >= (SELECT max(ts) - 86400 FROM performance_metrics)),
h AS (SELECT CAST(critical AS BIGINT) AS critical, CAST(high AS BIGINT) AS high, CAST(greatest(0, 100 - 20 * critical - 10 * high) AS BIGINT) AS score FROM c)
SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN score >= 90 THEN 'healthy' WHEN score >= 70 THEN 'warning' ELSE 'critical' END AS status FROM h""",
    "daily_trend": f"WITH {_S} SELECT metric, CAST(make_timestamp(CAST(floor(ts) AS BIGINT) * 1000000) AS DATE) AS day, count(*) AS n, round(avg(value), 9) AS mean FROM s GROUP BY ALL",
    "retention_by_month": """SELECT strftime(make_timestamp(CAST(floor(ts) AS BIGINT) * 1000000), '%Y-%m') AS month, coalesce(ts < (SELECT max(ts) - 14 * 86400 FROM performance_metrics), FALSE) AS expired, count(*) AS events FROM performance_metrics GROUP BY ALL""",
}
