"""Queries on implausible readings (p1) and dangling references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators.orphans import find_orphans, utc_micros
from veilspan.operators.spikes import confirmed, flag_faults
from veilspan.session import materialize
from veilspan.sources.tables import table


def _faults(spark: SparkSession, root: str) -> DataFrame:
    return confirmed(flag_faults(table(spark, root, "performance_metrics", "id", "ts", "event_name", "duration", "cpu_percent", "memory_mb"), "event_name", "ts", "id"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _faults(spark, root).select("id", "measure_name")


def p1_fault_report(spark: SparkSession, root: str) -> DataFrame:
    """Faulty readings by event, measure and kind of fault."""
    return _faults(spark, root).groupBy(F.col("src").alias("event_name"), "measure_name", "fault").agg(F.count(F.lit(1)).alias("readings"))


def p1_ellipsoid_flags(spark: SparkSession, root: str) -> DataFrame:
    """By event and measure what the ellipsoids flag by themselves, and how much of it lies beyond the stated tolerance."""
    faults = flag_faults(table(spark, root, "performance_metrics", "id", "ts", "event_name", "duration", "cpu_percent", "memory_mb"), "event_name", "ts", "id").where("fault = 'spike'")
    faults = materialize(faults, "spikes")
    both = faults.withColumn("beyond", F.lit(0)).unionByName(confirmed(faults).withColumn("beyond", F.lit(1)))
    return both.groupBy(F.col("src").alias("event_name"), "measure_name").agg(F.count_if(F.col("beyond") == 0).alias("flagged"), F.count_if(F.col("beyond") == 1).alias("beyond_tolerance"))


def _references(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    def child(name: str, key: str, at):
        return table(spark, root, name, "id", key, at[0]).select(F.lit(name).alias("record_table"), F.col("id").alias("record_id"), F.col(key).alias("ref"), at[1].alias("at"))

    stamp = lambda c: (c, F.unix_micros(F.col(c).cast("timestamp")))
    docs = (
        child("user_feedback", "document_id", stamp("ts"))
        .unionByName(child("detection_results", "document_id", stamp("ts")))
        .unionByName(child("performance_metrics", "document_id", ("ts", F.round(F.col("ts") * 1e6).cast("bigint"))))
    )
    tests = child("ab_test_results", "test_id", ("recorded_at", utc_micros(F.col("recorded_at"))))
    return docs, tests


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    def parent(name: str, key: str):
        t = table(spark, root, name, key, "created_at", "deleted_at")
        return t.select(F.col(key).alias("key"), *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("created_at", "deleted_at")])

    docs, tests = _references(spark, root)
    return find_orphans(docs, "ref", "at", parent("pdf_documents", "document_id"), "key", "created_at", "deleted_at").unionByName(
        find_orphans(tests, "ref", "at", parent("ab_tests", "test_id"), "key", "created_at", "deleted_at")
    )


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("record_table", "record_id")


def p6_orphan_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphans per table, month of the child and reason."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return _orphans(spark, root).groupBy("record_table", month.alias("period"), "reason").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref").alias("missing_keys"))


QUERIES = {"p1_found": p1_found, "p1_fault_report": p1_fault_report, "p1_ellipsoid_flags": p1_ellipsoid_flags, "p6_found": p6_found, "p6_orphan_report": p6_orphan_report}

_READINGS = """
r AS (
  SELECT id, ts, event_name, 'duration' AS measure_name, duration AS v FROM performance_metrics WHERE duration IS NOT NULL
  UNION ALL SELECT id, ts, event_name, 'cpu_percent', cpu_percent FROM performance_metrics WHERE cpu_percent IS NOT NULL
  UNION ALL SELECT id, ts, event_name, 'memory_mb', memory_mb FROM performance_metrics WHERE memory_mb IS NOT NULL
), b AS (
  SELECT *, isnan(v) OR isinf(v) OR CASE measure_name WHEN 'duration' THEN v < 0 WHEN 'cpu_percent' THEN v < 0 OR v > 100 ELSE v <= 0 OR v > 10000000 END AS bad FROM r
), med AS (
  SELECT event_name, measure_name, median(v) AS med FROM b WHERE NOT bad GROUP BY ALL
), mad AS (
  SELECT b.event_name, b.measure_name, any_value(med) AS med, median(abs(v - med)) AS mad
  FROM b JOIN med ON b.measure_name = med.measure_name AND b.event_name IS NOT DISTINCT FROM med.event_name WHERE NOT bad GROUP BY ALL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY event_name, measure_name ORDER BY ts, id) - row_number() OVER (PARTITION BY event_name, measure_name, v ORDER BY ts, id) AS g FROM b
), s AS (
  SELECT *, count(*) OVER (PARTITION BY event_name, measure_name, v, g) >= 10 AS stuck FROM n
), f AS (
  SELECT s.*, CASE WHEN bad THEN 'impossible' WHEN stuck THEN 'stuck'
    WHEN CASE s.measure_name WHEN 'duration' THEN v > 4 * med OR v < med / 4 ELSE abs(v - med) > 10 * mad END THEN 'spike' END AS fault
  FROM s LEFT JOIN mad ON s.measure_name = mad.measure_name AND s.event_name IS NOT DISTINCT FROM mad.event_name
)"""

_ORPHANS = """
c AS (
  SELECT 'user_feedback' AS record_table, id AS record_id, document_id AS ref, epoch_us(ts) AS seen FROM user_feedback
  UNION ALL SELECT 'detection_results', id, document_id, epoch_us(ts) FROM detection_results
  UNION ALL SELECT 'performance_metrics', id, document_id, CAST(round(ts * 1e6) AS BIGINT) FROM performance_metrics
  UNION ALL SELECT 'ab_test_results', id, test_id, epoch_us(CAST(replace(replace(recorded_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) FROM ab_test_results
), p AS (
  SELECT document_id AS k, epoch_us(created_at) AS born, epoch_us(deleted_at) AS died, TRUE AS doc FROM pdf_documents
  UNION ALL SELECT test_id, epoch_us(created_at), epoch_us(deleted_at), FALSE FROM ab_tests
), o AS (
  SELECT c.*, CASE WHEN k IS NULL THEN 'absent' WHEN born > seen THEN 'younger' WHEN died <= seen THEN 'deleted' END AS reason
  FROM c LEFT JOIN p ON c.ref = p.k AND p.doc = (c.record_table <> 'ab_test_results') WHERE ref IS NOT NULL
)"""

ORACLE = {
    "p1_found": f"WITH {_READINGS} SELECT id, measure_name FROM f WHERE fault IS NOT NULL",
    "p1_fault_report": f"WITH {_READINGS} SELECT event_name, measure_name, fault, count(*) AS readings FROM f WHERE fault IS NOT NULL GROUP BY ALL",
    "p6_found": f"WITH {_ORPHANS} SELECT record_table, record_id FROM o WHERE reason IS NOT NULL",
    "p6_orphan_report": f"""WITH {_ORPHANS} SELECT record_table, strftime(make_timestamp(seen), '%Y-%m') AS period, reason, count(*) AS orphans, count(DISTINCT ref) AS missing_keys
FROM o WHERE reason IS NOT NULL GROUP BY ALL""",
}
