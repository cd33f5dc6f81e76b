"""Queries that train or stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.operators import model as M
from veilspan.operators.quality import confusion
from veilspan.session import materialize
from veilspan.sources.stores import migrated
from veilspan.sources.tables import table
from veilspan.streaming import monitor as S


def confidence_model(spark, root):
    """Held-out confusion of a model trained on the examples, at a confidence of 0.5."""
    rows = table(spark, root, "training_examples", "id", "detection_text", "context", "is_true_positive").where("is_true_positive is not null and detection_text is not null")
    rows, names = M.with_features(rows.withColumn("label", F.col("is_true_positive").cast("double")), "detection_text", "context")
    learn, test = M.split(rows, "id")
    scored = materialize(M.score(test, *M.train(learn, names, "label")).select("confidence", "label", "is_true_positive"), "scored")
    return confusion(scored, "confidence", "is_true_positive").withColumn("auc", F.lit(M.area(scored, "label")))


def stream_rolling_stats(spark, root):
    """Five-minute windows every minute, from a stream over the event files."""
    stream = S.rolling_stats(S.metric_stream(S.stream_table(spark, root, "performance_metrics")))
    out = S.run_available(stream, ["metric", "begin", "finish"])
    return out.select("metric", F.unix_micros("begin").alias("begin"), F.unix_micros("finish").alias("finish"), "n", F.round("mean", 9).alias("mean"), "low", "high")


def stream_daily_stats(spark, root):
    """Days of each metric, from a stream over the event files."""
    out = S.run_available(S.daily_stats(S.metric_stream(S.stream_table(spark, root, "performance_metrics"))), ["metric", "begin", "finish"])
    return out.select("metric", F.unix_micros("begin").alias("begin"), "n", F.round("mean", 9).alias("mean"), "low", "high")


def stream_sessions(spark, root):
    """Sessions of each metric: events less than 30 minutes apart."""
    out = S.run_available(S.sessions(S.metric_stream(S.stream_table(spark, root, "performance_metrics"))), mode="complete")
    return out.select("metric", F.unix_micros("begin").alias("begin"), F.unix_micros("finish").alias("finish"), "n")


def stream_anomalies(spark, root):
    """Points far from the 100 before them, with that history as state."""
    out = S.run_available(S.anomalies(S.metric_stream(S.stream_table(spark, root, "performance_metrics"))), mode="append")
    return out.select("metric", "id", "value", F.round("z", 3).alias("z"))


def migrated_reports(spark, root):
    """Documents whose error message is JSON and those where it is not."""
    rows = migrated(table(spark, root, "pdf_documents", "document_id", "status", "error_message"))
    return rows.groupBy("status").agg(F.count("redaction_report").alias("reports"), F.count("error_message").alias("errors"))


NAMES = ("confidence_model", "stream_rolling_stats", "stream_daily_stats", "stream_sessions", "stream_anomalies", "migrated_reports")
QUERIES = {n: globals()[n] for n in NAMES}
_EVENTS = "s AS (SELECT event_name AS metric, id, CAST(floor(ts * 1000000) AS BIGINT) AS us, duration AS v FROM performance_metrics WHERE isfinite(duration) AND event_name IS NOT NULL AND ts IS NOT NULL)"
ORACLE = {
    "stream_daily_stats": f"WITH {_EVENTS} SELECT metric, us // 86400000000 * 86400000000 AS begin, count(*) AS n, round(avg(v), 9) AS mean, min(v) AS low, max(v) AS high FROM s GROUP BY ALL",
    "stream_sessions": f"""WITH {_EVENTS}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY metric ORDER BY us, id) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM s),
w AS (SELECT *, sum(fresh) OVER (PARTITION BY metric ORDER BY us, id) AS k FROM g) SELECT metric, min(us) AS begin, max(us) + 1800000000 AS finish, count(*) AS n FROM w GROUP BY metric, k""",
    "stream_anomalies": f"""WITH {_EVENTS}, w AS (SELECT *, count(*) OVER h AS n, avg(v) OVER h AS mean, stddev_samp(v) OVER h AS std FROM s WINDOW h AS (PARTITION BY metric ORDER BY us, id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
SELECT metric, id, v AS value, round((v - mean) / std, 3) AS z FROM w WHERE n >= 10 AND std > 0 AND abs((v - mean) / std) > 2.5""",
    "stream_rolling_stats": """WITH s AS (SELECT event_name AS metric, CAST(floor(ts * 1000000) AS BIGINT) AS us, duration AS v FROM performance_metrics WHERE isfinite(duration) AND event_name IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT metric, (us // 60000000 - k) * 60000000 AS begin, v FROM s, range(5) t(k))
SELECT metric, begin, begin + 300000000 AS finish, count(*) AS n, round(avg(v), 9) AS mean, min(v) AS low, max(v) AS high FROM w GROUP BY ALL""",
    "migrated_reports": """SELECT status, count(*) FILTER (lower(status) = 'completed' AND json_valid(error_message)) AS reports, count(error_message) FILTER (NOT coalesce(lower(status) = 'completed' AND json_valid(error_message), FALSE)) AS errors FROM pdf_documents GROUP BY ALL""",
}
