"""Queries on experiments, health, scores in service, scans with predicates, and unions of branches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veilspan.functions import text as T
from veilspan.operators import decide as D
from veilspan.operators import quality as Q
from veilspan.operators import series as M
from veilspan.operators.skew import split_join
from veilspan.plans import analytics, language, monitoring
from veilspan.sources.stores import deactivated, long_metrics, scan, valid_feedback
from veilspan.sources.tables import columns, table

GROUPS, METRICS = ("control", "variant"), ("accuracy", "recall", "f1_score", "latency_ms")
SHARES = {"control": 0.5, "small": 0.2, "large": 0.3}
TABLES = ("ab_test_results", "ab_tests", "adaptive_patterns", "detection_results", "documents", "mix_targets", "pack_capacities", "pdf_documents", "performance_metrics", "sample_targets", "training_examples", "user_feedback")
MEASURES = ("duration", "cpu_percent", "memory_mb")


def training_scan(spark, root):
    """Training examples of one source and category, newest first."""
    rows = table(spark, root, "training_examples", "id", "data_source", "category", "created_at", "detection_text")
    return scan(rows, order="created_at", data_source="priority2", category="emails").select("id", "detection_text")


def events_since(spark, root):
    """Events of the last day, oldest first."""
    rows = table(spark, root, "performance_metrics", "id", "ts", "event_name")
    edge = rows.agg((F.max("ts") - 86400).alias("edge"))
    return rows.join(F.broadcast(edge)).where("ts >= edge").drop("edge").orderBy("ts", "id")


def document_lookup(spark, root):
    return table(spark, root, "pdf_documents", "id", "document_id", "status").where("id = 1")


def catalog_columns(spark, root):
    """The columns of every table, as a catalog lists them."""
    return columns(spark, root, TABLES)


def deactivate_patterns(spark, root):
    """Patterns after those of little precision were switched off, with what the update touched."""
    return deactivated(table(spark, root, "adaptive_patterns", "pattern_id", "regex", "precision_score", "is_active"), F.col("precision_score") < 0.5).select("pattern_id", "regex", "is_active", "changed")


def metrics_long(spark, root):
    return long_metrics(table(spark, root, "performance_metrics", "id", *MEASURES), ["id"], MEASURES)


def feedback_validity(spark, root):
    """Feedback by type, and how much of it can be used."""
    rows = table(spark, root, "user_feedback", "feedback_id", "document_id", "text_segment", "feedback_type")
    return rows.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid_feedback()).alias("valid"))


def ab_grid(spark, root):
    return D.metric_grid(table(spark, root, "ab_test_results", "test_id", "group_name", "metric_name", "metric_value"), table(spark, root, "ab_tests", "test_id", "test_name"), GROUPS, METRICS)


def ab_decision(spark, root):
    """Student's test of every metric of every test, with its p, and the winner of the test."""
    rows = Q.t_tests(table(spark, root, "ab_test_results", "test_id", "group_name", "metric_name", "metric_value"))
    return D.decided(rows).select("test_id", "metric_name", "t", "p", "significant", "winner", "test_winner")


def ab_assign(spark, root):
    rows = table(spark, root, "pdf_documents", "document_id").where("document_id is not null")
    return rows.select("document_id", D.assigned(F.col("document_id"), SHARES).alias("group_name"))


def multi_anomalies(spark, root):
    """Every anomaly of every point: by deviation, by range, by thresholds, in that order; ``stored`` tells whether the point had history enough."""
    series = monitoring._series(spark, root)
    limits = monitoring.limits(spark)
    first = M.zscores(series).select("metric", "id", F.lit(1).alias("method"), F.col("kind"), "severity")
    second = M.range_outliers(series).select("metric", "id", F.lit(2).alias("method"), F.lit("OUTLIER").alias("kind"), F.lit("high").alias("severity"))
    third = M.threshold_alerts(series, limits).select("metric", "id", F.lit(3).alias("method"), F.concat(F.lit("THRESHOLD_"), F.upper("kind")).alias("kind"), "severity")
    return first.unionByName(second).unionByName(third)


def severe_anomalies(spark, root):
    """Critical anomalies of one metric."""
    return M.zscores(monitoring._series(spark, root)).where("severity = 'critical' and metric = 'cache_lookup'").select("metric", "id", "kind")


def confusion_recent(spark, root):
    """Confusion of the last 60 minutes of examples, the newest 1,000 of them; without truth the share of high confidence stands in."""
    rows = table(spark, root, "training_examples", "id", "created_at", "confidence_score", "is_true_positive").where("confidence_score is not null and created_at is not null")
    edge = rows.agg((F.max("created_at") - F.expr("INTERVAL 60 MINUTES")).alias("edge"))
    last = rows.join(F.broadcast(edge)).where("created_at >= edge").orderBy(F.desc("created_at"), F.desc("id")).limit(1000)
    c, y = F.col("confidence_score"), F.col("is_true_positive")
    counted = last.agg(
        F.count(F.lit(1)).alias("n"), F.count(y).alias("known"), F.count_if((c > 0.5) & y).alias("tp"), F.count_if((c > 0.5) & ~y).alias("fp"), F.count_if((c <= 0.5) & ~y).alias("tn"), F.count_if((c <= 0.5) & y).alias("fn"),
        F.avg((c > 0.7).cast("int")).alias("high"), F.stddev_samp(c).alias("std"),
    )
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    or_high = lambda x: F.round(F.when(F.col("known") > 0, x).otherwise(F.col("high")), 9)
    return counted.select("n", "known", or_high(Q.ratio(tp + tn, tp + fp + tn + fn)).alias("accuracy"), or_high(Q.ratio(tp, tp + fp)).alias("precision"), or_high(Q.ratio(tp, tp + fn)).alias("recall"), F.round(1 - F.coalesce("std", F.lit(0.0)), 9).alias("correlation"))


def _ml_score(spark, root):
    rows = table(spark, root, "training_examples", "confidence_score", "is_true_positive")
    q = Q.confusion(rows, "confidence_score", "is_true_positive")
    d = table(spark, root, "detection_results", "processing_time_ms", "fallback_used").agg(F.avg(F.when(M.finite(F.col("processing_time_ms")), F.col("processing_time_ms"))).alias("ms"), F.avg((~F.col("fallback_used")).cast("int")).alias("ratio"))
    time = F.greatest(F.lit(0.0), 100 - F.coalesce("ms", F.lit(0.0)) / 10)
    return q.join(F.broadcast(d)).select(((F.col("accuracy") + F.col("precision") + F.col("recall") + F.coalesce("ratio", F.lit(0.0))) * 100 + time).alias("sum"))


def ml_health(spark, root):
    """The mean of accuracy, precision, recall, speed and share of model detections, each of 100; a ladder of 85, 70 and 50."""
    score = F.col("sum") / 5
    return _ml_score(spark, root).select(F.round(score, 6).alias("score"), F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor").alias("status"))


def overall_status(spark, root):
    """Quality, system and model health, weighed 0.4, 0.3 and 0.3; any critical anomaly decides the status."""
    quality = analytics.overall_quality_health(spark, root).select(F.col("score").alias("q"))
    system = monitoring.system_health(spark, root).select(F.col("score").alias("s"), "critical")
    both = quality.join(F.broadcast(system)).join(F.broadcast(ml_health(spark, root).select(F.col("score").alias("m"))))
    score = F.col("q") * 0.4 + F.col("s") * 0.3 + F.col("m") * 0.3
    status = F.when(F.col("critical") > 0, "critical").when(score >= 85, "healthy").when(score >= 70, "warning").otherwise("degraded")
    return both.select(F.round(score, 6).alias("score"), status.alias("status"))


def trend_narration(spark, root):
    """What the direction of each metric says in words, and how sure it is."""
    rows = M.trends(monitoring._series(spark, root))
    word = F.when(F.col("direction") == "insufficient", "Not enough historical data to determine trend").when(F.col("direction") == "stable", "Metric is stable with minimal variation").otherwise(F.concat(F.lit("Metric is "), F.col("direction")))
    sure = F.when(F.col("direction") == "insufficient", "low").when((F.col("direction") != "stable") & (F.col("points") > 10), "high").otherwise("medium")
    return rows.select("metric", word.alias("interpretation"), sure.alias("confidence"))


def running_average(spark, root):
    """The mean processing time of all detections up to each day; days are summed before they are put in order."""
    rows = table(spark, root, "detection_results", "ts", "processing_time_ms").where(M.finite(F.col("processing_time_ms")) & F.col("ts").isNotNull())
    days = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("processing_time_ms").alias("t"))
    upto = F.expr("sum(n) over (order by day)"), F.expr("sum(t) over (order by day)")
    return days.select("day", upto[0].alias("n"), F.round(upto[1] / upto[0], 6).alias("mean"))


def throughput(spark, root):
    """MB of documents a second, by event; events of the same document meet its size without moving."""
    events = table(spark, root, "performance_metrics", "event_name", "document_id", "duration").where(M.finite(F.col("duration")) & (F.col("duration") > 0) & F.col("document_id").isNotNull())
    sizes = table(spark, root, "pdf_documents", "document_id", "file_size").where("file_size is not null and document_id is not null")
    met = split_join(events, sizes, ["document_id"])
    return met.groupBy("event_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("file_size") / 1048576 / F.col("duration")), 6).alias("mb_per_s"))


def memory_summary(spark, root):
    """Of each event's memory the mean of the last ten readings against the ten before."""
    rows = table(spark, root, "performance_metrics", "id", "ts", "event_name", "memory_mb").where(M.finite(F.col("memory_mb")) & F.col("event_name").isNotNull())
    last = M._newest(rows.select(F.col("event_name").alias("metric"), "ts", "id", F.col("memory_mb").alias("value")), 20)
    out = last.groupBy("metric").agg(F.avg(F.when(F.col("r") <= 10, F.col("value"))).alias("late"), F.avg(F.when(F.col("r") > 10, F.col("value"))).alias("early"))
    return out.select("metric", F.round("late", 6).alias("late"), F.round("early", 6).alias("early"), F.round(F.try_divide((F.col("late") - F.col("early")) * 100, F.col("early")), 6).alias("growth"))


def cache_hit_rates(spark, root):
    """Feedback whose text was detected before counts as a hit, by type."""
    asked = table(spark, root, "user_feedback", "feedback_type", "text_segment").where("text_segment is not null")
    there = table(spark, root, "detection_results", "text").where("text is not null").select(F.col("text").alias("text_segment")).distinct().withColumn("hit", F.lit(1))
    met = split_join(asked, there, ["text_segment"], "left")
    return met.groupBy("feedback_type").agg(F.count("hit").alias("hits"), (F.count(F.lit(1)) - F.count("hit")).alias("misses"), F.round(F.count("hit") / F.count(F.lit(1)), 9).alias("rate"))


def training_sources(spark, root):
    """Stored examples, feedback and detections as one training set, by where they come from."""
    stored = table(spark, root, "training_examples", "category", "is_true_positive").select(F.lit("stored").alias("origin"), "category", "is_true_positive")
    parts = [("feedback", analytics.feedback_to_examples(spark, root)), ("detections", language.detections_to_examples(spark, root))]
    for name, rows in parts:
        stored = stored.unionByName(rows.select(F.lit(name).alias("origin"), "category", "is_true_positive"))
    return stored.groupBy("origin", "category", "is_true_positive").agg(F.count(F.lit(1)).alias("n"))


def feature_names(spark, root):
    """Every feature that some example has."""
    return table(spark, root, "training_examples", "features").select(F.explode(F.map_keys("features")).alias("feature")).distinct()


def detection_truth(spark, root):
    """Detections by category, those whose text is confirmed and those whose text is refuted."""
    found = table(spark, root, "detection_results", "category", "text")
    truth = table(spark, root, "training_examples", "detection_text", "is_true_positive").where("detection_text is not null and is_true_positive is not null")
    truth = truth.groupBy(F.col("detection_text").alias("text")).agg(F.bool_or("is_true_positive").alias("truth"))
    met = split_join(found, truth, ["text"], "left")
    return met.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("truth").alias("confirmed"), F.count_if(~F.col("truth")).alias("refuted"))


def feedback_documents(spark, root):
    """Feedback by the status of the document it speaks of."""
    rows = table(spark, root, "user_feedback", "document_id", "feedback_type")
    docs = table(spark, root, "pdf_documents", "document_id", "status").where("document_id is not null").withColumn("there", F.lit(True))
    met = split_join(rows, docs, ["document_id"], "left")
    return met.groupBy("feedback_type", "status", F.coalesce("there", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("n"))


def text_instances(spark, root):
    """How often a detected text stands in its context: as written, and only where it does not, in any case."""
    rows = table(spark, root, "training_examples", "id", "detection_text", "context").where("context is not null and detection_text is not null and detection_text != ''")
    count = lambda a, b: ((F.length(a) - F.length(F.replace(a, b, F.lit("")))) / F.length(b)).cast("bigint")
    exact = count(F.col("context"), F.col("detection_text"))
    loose = count(F.lower("context"), F.lower("detection_text"))
    return rows.select("id", exact.alias("exact"), F.when(exact == 0, loose).otherwise(F.lit(0)).cast("bigint").alias("loose"))


def routed(spark, root):
    """Which detections of a test go to the model: a tenth of them, by hash, take the rules."""
    b = Q.bucket(F.col("id").cast("string")) / 1_000_000
    return table(spark, root, "detection_results", "id").select("id", F.when(b < 0.9, "ml").otherwise("fallback").alias("route"))


def served_confidence(spark, root):
    """Confidence in service: the best learned pattern of the very text, else the stored score by document type, else 0.5."""
    rows = table(spark, root, "training_examples", "id", "detection_text", "document_type", "confidence_score")
    known = table(spark, root, "adaptive_patterns", "regex", "confidence", "is_active").where("is_active and regex is not null").groupBy(F.col("regex").alias("detection_text")).agg(F.max("confidence").alias("learned"))
    met = split_join(rows, known, ["detection_text"], "left")
    return met.select("id", F.round(D.served(F.col("confidence_score"), F.col("learned"), F.lit(0.5), F.col("document_type")), 9).alias("confidence"))


def training_triggers(spark, root):
    """Whether training is due for each source, as of the newest example; the last training was a week before."""
    rows = table(spark, root, "training_examples", "data_source", "created_at", "confidence_score", "is_true_positive")
    edge = rows.agg(F.max("created_at").alias("now"))
    by = rows.join(F.broadcast(edge)).groupBy("data_source").agg(
        F.count(F.lit(1)).alias("n"), F.first("now").alias("now"), F.count_if(F.col("created_at") >= F.col("now") - F.expr("INTERVAL 12 HOURS")).alias("fresh"), F.avg(((F.col("confidence_score") > 0.5) == F.col("is_true_positive")).cast("int")).alias("accuracy"),
    )
    due = D.training_reason(F.col("n"), F.col("now") - F.expr("INTERVAL 12 HOURS"), F.col("now"), F.col("fresh"), F.col("accuracy"))
    return by.select("data_source", "n", due.alias("reason"), D.retrain_due(F.col("n")).alias("retrain"))


def normalized_texts(spark, root):
    """Texts with accents composed with their letters, by digest."""
    return table(spark, root, "user_feedback", "id", "text_segment").where("text_segment is not null").select("id", F.md5(T.composed(F.col("text_segment"))).alias("digest"))


def language_ids(spark, root):
    """The language that the words of the first 1,000 characters speak for."""
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", T.language(F.col("text")).alias("language"))


NAMES = (
    "training_scan", "events_since", "document_lookup", "catalog_columns", "deactivate_patterns", "metrics_long", "feedback_validity", "ab_grid", "ab_decision", "ab_assign", "multi_anomalies", "severe_anomalies", "confusion_recent", "ml_health", "overall_status", "trend_narration",
    "running_average", "throughput", "memory_summary", "cache_hit_rates", "training_sources", "feature_names", "detection_truth", "feedback_documents", "text_instances", "routed", "served_confidence", "training_triggers", "normalized_texts", "language_ids",
)
QUERIES = {n: globals()[n] for n in NAMES}
_T = analytics.ORACLE
_B = analytics._B
_GAMMA = "sqrt(z) * (1 - 1 / (8 * z) + 1 / (128 * z * z) + 5 / (1024 * z * z * z) - 21 / (32768 * z * z * z * z))" + "".join(f" * (x + {k}) / (x + {k} + 0.5)" for k in range(D.SHIFTS))
_PLACE = f"({_B}) / 1000000"
_LANG = "CASE " + " ".join(f"WHEN best > 0 AND {k} = best THEN '{k}'" for k in T.STOP_WORDS) + " ELSE 'unknown' END"
_Z, _S = monitoring._Z, monitoring._S
_ALERTS = monitoring.ORACLE["threshold_alerts"]
_ML = """c AS (SELECT CAST(count_if(confidence_score > 0.5 AND is_true_positive) AS DOUBLE) AS tp, CAST(count_if(confidence_score > 0.5 AND NOT is_true_positive) AS DOUBLE) AS fp, CAST(count_if(confidence_score <= 0.5 AND NOT is_true_positive) AS DOUBLE) AS tn,
CAST(count_if(confidence_score <= 0.5 AND is_true_positive) AS DOUBLE) AS fn FROM training_examples WHERE confidence_score IS NOT NULL AND is_true_positive IS NOT NULL),
d AS (SELECT avg(processing_time_ms) FILTER (isfinite(processing_time_ms)) AS ms, avg(CAST(NOT fallback_used AS INT)) AS ratio FROM detection_results),
mh AS (SELECT ((round((tp + tn) / (tp + fp + tn + fn), 9) + round(tp / (tp + fp), 9) + round(tp / (tp + fn), 9) + ratio) * 100 + greatest(0.0, 100 - ms / 10)) / 5 AS m FROM c, d)"""
_FACTOR = "CASE lower(document_type) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.TYPE_FACTOR.items()) + " ELSE 1.0 END"
ORACLE = {
    "training_scan": "SELECT id, detection_text FROM training_examples WHERE data_source = 'priority2' AND category = 'emails'",
    "events_since": "SELECT id, ts, event_name FROM performance_metrics WHERE ts >= (SELECT max(ts) - 86400 FROM performance_metrics)",
    "document_lookup": "SELECT id, document_id, status FROM pdf_documents WHERE id = 1",
    "catalog_columns": f"SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS position FROM information_schema.columns WHERE table_name IN ({', '.join(f'{chr(39)}{t}{chr(39)}' for t in TABLES)})",
    "deactivate_patterns": "SELECT pattern_id, regex, CASE WHEN precision_score < 0.5 THEN FALSE ELSE is_active END AS is_active, coalesce(precision_score < 0.5 AND is_active, FALSE) AS changed FROM adaptive_patterns",
    "metrics_long": " UNION ALL ".join(f"SELECT id, '{m}' AS metric_name, {m} AS metric_value FROM performance_metrics WHERE {m} IS NOT NULL" for m in MEASURES),
    "feedback_validity": """SELECT feedback_type, count(*) AS n, CAST(count_if(coalesce(feedback_id <> '' AND document_id <> '' AND text_segment <> '' AND feedback_type IN
('false_positive', 'false_negative', 'category_correction', 'correct_detection', 'confirmed_pii', 'confidence_adjustment'), FALSE)) AS BIGINT) AS valid FROM user_feedback GROUP BY ALL""",
    "ab_grid": """WITH g AS (SELECT test_id, test_name, unnest(['control', 'variant']) AS group_name FROM ab_tests), m AS (SELECT *, unnest(['accuracy', 'recall', 'f1_score', 'latency_ms']) AS metric_name FROM g),
r AS (SELECT test_id, group_name, metric_name, count(*) AS n, avg(metric_value) AS mean, stddev_samp(metric_value) AS std, min(metric_value) AS low, max(metric_value) AS high FROM ab_test_results WHERE metric_value IS NOT NULL GROUP BY ALL)
SELECT m.test_id, test_name, m.group_name, m.metric_name, coalesce(n, 0) AS n, round(coalesce(mean, 0), 9) AS mean, round(coalesce(std, 0), 9) AS std, round(coalesce(low, 0), 9) AS low, round(coalesce(high, 0), 9) AS high
FROM m LEFT JOIN r ON m.test_id = r.test_id AND m.group_name = r.group_name AND m.metric_name = r.metric_name""",
    "ab_decision": f"""WITH tt AS ({_T['ab_t_stat']}), a AS (SELECT *, least(abs(t), {D.FAR}) AS s, CAST(df AS DOUBLE) AS f FROM tt), b AS (SELECT *, atan(s / sqrt(f)) AS w, f / 2 AS x, f / 2 + {D.SHIFTS} AS z FROM a),
i AS (SELECT *, list_sum(list_transform(range({D.INTERVALS} + 1), lambda i: pow(cos(w * i / {D.INTERVALS}), f - 1) * CASE WHEN i = 0 OR i = {D.INTERVALS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) * w / (3 * {D.INTERVALS}) AS area FROM b),
q AS (SELECT test_id, metric_name, t, leader, CASE WHEN f > 0 AND t IS NOT NULL THEN round(CASE WHEN abs(t) >= {D.FAR} THEN 0 ELSE greatest(0, least(1, 1 - 2 * area * {_GAMMA} / {math.sqrt(math.pi)!r})) END, 6) END AS p FROM i),
y AS (SELECT *, coalesce(p < 0.05, FALSE) AS significant, CASE WHEN p < 0.05 THEN leader END AS winner FROM q)
SELECT y.test_id, y.metric_name, y.t, y.p, y.significant, y.winner, o.winner AS test_winner FROM y LEFT JOIN y o ON o.test_id = y.test_id AND o.metric_name = 'accuracy'""",
    "ab_assign": f"SELECT document_id, CASE WHEN {_PLACE} <= 0.5 THEN 'control' WHEN {_PLACE} <= 0.7 THEN 'small' WHEN {_PLACE} <= 1.0 THEN 'large' ELSE 'control' END AS group_name FROM pdf_documents WHERE document_id IS NOT NULL",
    "multi_anomalies": f"""WITH {_Z}, al AS ({_ALERTS}) SELECT metric, id, 1 AS method, kind, severity FROM z UNION ALL SELECT metric, id, 2, 'OUTLIER', 'high' FROM w WHERE n >= 10 AND (value < 0.5 * low OR value > 1.5 * high)
UNION ALL SELECT metric, id, 3, 'THRESHOLD_' || upper(kind), severity FROM al""",
    "severe_anomalies": f"WITH {_Z} SELECT metric, id, kind FROM z WHERE severity = 'critical' AND metric = 'cache_lookup'",
    "confusion_recent": """WITH r AS (SELECT id, created_at, confidence_score AS c, is_true_positive AS y FROM training_examples WHERE confidence_score IS NOT NULL AND created_at IS NOT NULL),
l AS (SELECT * FROM r WHERE created_at >= (SELECT max(created_at) - INTERVAL 60 MINUTE FROM r) ORDER BY created_at DESC, id DESC LIMIT 1000),
k AS (SELECT count(*) AS n, count(y) AS known, count_if(c > 0.5 AND y) AS tp, count_if(c > 0.5 AND NOT y) AS fp, count_if(c <= 0.5 AND NOT y) AS tn, count_if(c <= 0.5 AND y) AS fn, avg(CAST(c > 0.7 AS INT)) AS high, stddev_samp(c) AS s FROM l)
SELECT n, known, round(CASE WHEN known > 0 THEN (tp + tn) / known ELSE high END, 9) AS accuracy, round(CASE WHEN known > 0 THEN coalesce(tp / nullif(tp + fp, 0), 0) ELSE high END, 9) AS precision,
round(CASE WHEN known > 0 THEN coalesce(tp / nullif(tp + fn, 0), 0) ELSE high END, 9) AS recall, round(1 - coalesce(s, 0), 9) AS correlation FROM k""",
    "ml_health": f"WITH {_ML} SELECT round(m, 6) AS score, CASE WHEN m >= 85 THEN 'excellent' WHEN m >= 70 THEN 'good' WHEN m >= 50 THEN 'fair' ELSE 'poor' END AS status FROM mh",
    "overall_status": f"""WITH {_ML}, qh AS ({_T['overall_quality_health']}), sh AS ({monitoring.ORACLE['system_health']}), o AS (SELECT qh.score * 0.4 + sh.score * 0.3 + round(m, 6) * 0.3 AS score, sh.critical FROM qh, sh, mh)
SELECT round(score, 6) AS score, CASE WHEN critical > 0 THEN 'critical' WHEN score >= 85 THEN 'healthy' WHEN score >= 70 THEN 'warning' ELSE 'degraded' END AS status FROM o""",
    "trend_narration": f"""WITH t AS ({monitoring.ORACLE['trend_half_split']}) SELECT metric, CASE direction WHEN 'insufficient' THEN 'Not enough historical data to determine trend' WHEN 'stable' THEN 'Metric is stable with minimal variation' ELSE 'Metric is ' || direction END AS interpretation,
CASE WHEN direction = 'insufficient' THEN 'low' WHEN direction <> 'stable' AND points > 10 THEN 'high' ELSE 'medium' END AS confidence FROM t""",
    "running_average": "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(processing_time_ms) AS t FROM detection_results WHERE isfinite(processing_time_ms) AND ts IS NOT NULL GROUP BY ALL) SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS n, round(sum(t) OVER (ORDER BY day) / sum(n) OVER (ORDER BY day), 6) AS mean FROM d",
    "throughput": "SELECT event_name, count(*) AS n, round(avg(file_size / 1048576 / duration), 6) AS mb_per_s FROM performance_metrics p JOIN pdf_documents d ON p.document_id = d.document_id WHERE isfinite(duration) AND duration > 0 AND file_size IS NOT NULL GROUP BY ALL",
    "memory_summary": """WITH r AS (SELECT event_name AS metric, memory_mb AS v, row_number() OVER (PARTITION BY event_name ORDER BY ts DESC, id DESC) AS r FROM performance_metrics WHERE isfinite(memory_mb) AND event_name IS NOT NULL),
a AS (SELECT metric, avg(v) FILTER (r <= 10) AS late, avg(v) FILTER (r > 10) AS early FROM r WHERE r <= 20 GROUP BY ALL) SELECT metric, round(late, 6) AS late, round(early, 6) AS early, round((late - early) * 100 / nullif(early, 0), 6) AS growth FROM a""",
    "cache_hit_rates": "WITH t AS (SELECT DISTINCT text FROM detection_results WHERE text IS NOT NULL) SELECT feedback_type, count(t.text) AS hits, count(*) - count(t.text) AS misses, round(count(t.text) / count(*), 9) AS rate FROM user_feedback f LEFT JOIN t ON t.text = f.text_segment WHERE text_segment IS NOT NULL GROUP BY ALL",
    "training_sources": f"""WITH f AS ({_T['feedback_to_examples']}), d AS ({language.ORACLE['detections_to_examples']}), u AS (SELECT 'stored' AS origin, category, is_true_positive FROM training_examples UNION ALL SELECT 'feedback', category, is_true_positive FROM f UNION ALL SELECT 'detections', category, is_true_positive FROM d)
SELECT *, count(*) AS n FROM u GROUP BY ALL""",
    "feature_names": "SELECT DISTINCT unnest(map_keys(features)) AS feature FROM training_examples",
    "detection_truth": """WITH t AS (SELECT detection_text, bool_or(is_true_positive) AS truth FROM training_examples WHERE detection_text IS NOT NULL AND is_true_positive IS NOT NULL GROUP BY ALL)
SELECT category, count(*) AS n, count(*) FILTER (truth) AS confirmed, count(*) FILTER (NOT truth) AS refuted FROM detection_results LEFT JOIN t ON text = detection_text GROUP BY ALL""",
    "feedback_documents": "SELECT feedback_type, status, d.document_id IS NOT NULL AS known, count(*) AS n FROM user_feedback f LEFT JOIN pdf_documents d ON f.document_id = d.document_id GROUP BY ALL",
    "text_instances": """WITH c AS (SELECT id, CAST((len(context) - len(replace(context, detection_text, ''))) // len(detection_text) AS BIGINT) AS exact, CAST((len(lower(context)) - len(replace(lower(context), lower(detection_text), ''))) // len(lower(detection_text)) AS BIGINT) AS l
FROM training_examples WHERE context IS NOT NULL AND detection_text <> '') SELECT id, exact, CASE WHEN exact = 0 THEN l ELSE 0 END AS loose FROM c""",
    "routed": f"SELECT id, CASE WHEN {_PLACE.replace('md5(document_id)', 'md5(CAST(id AS VARCHAR))')} < 0.9 THEN 'ml' ELSE 'fallback' END AS route FROM detection_results",
    "served_confidence": f"""WITH k AS (SELECT regex, max(confidence) AS learned FROM adaptive_patterns WHERE is_active AND regex IS NOT NULL GROUP BY ALL)
SELECT id, round(coalesce(learned, least(1.0, confidence_score * {_FACTOR}), 0.5), 9) AS confidence FROM (SELECT id, learned, confidence_score, coalesce(document_type, '') AS document_type FROM training_examples LEFT JOIN k ON regex = detection_text)""",
    "training_triggers": """WITH b AS (SELECT data_source, count(*) AS n, count_if(created_at >= (SELECT max(created_at) FROM training_examples) - INTERVAL 12 HOUR) AS fresh, avg(CAST((confidence_score > 0.5) = is_true_positive AS INT)) AS accuracy FROM training_examples GROUP BY ALL)
SELECT data_source, n, CASE WHEN n < 50 THEN 'insufficient_samples' WHEN fresh >= 100 THEN 'data_accumulation' WHEN accuracy < 0.95 THEN 'performance_degradation' ELSE 'no_trigger' END AS reason, n >= 100 AND n % 500 = 0 AS retrain FROM b""",
    "normalized_texts": "SELECT id, md5(nfc_normalize(text_segment)) AS digest FROM user_feedback WHERE text_segment IS NOT NULL",
    "language_ids": f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(substr(text, 1, 1000)), '\\p{{L}}+') AS w FROM documents), s AS (SELECT doc_id, {', '.join(f"coalesce(len(list_filter(w, lambda x: x IN ({', '.join(chr(39) + v + chr(39) for v in ws)}))), 0) AS {k}" for k, ws in T.STOP_WORDS.items())} FROM w),
b AS (SELECT *, greatest({', '.join(T.STOP_WORDS)}) AS best FROM s) SELECT doc_id, {_LANG} AS language FROM b""",
}
