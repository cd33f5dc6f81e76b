"""Queries on detection quality, experiments, feedback and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions.patterns import CATEGORY_SPECIFICITY, DEFAULT_SPECIFICITY
from veilspan.operators import quality as Q
from veilspan.operators.spans import base_confidence
from veilspan.plans import monitoring
from veilspan.sources.tables import table


def _detections(spark, root):
    return table(spark, root, "detection_results", "id", "document_id", "ts", "category", "text", "ml_confidence", "processing_time_ms", "fallback_used", "pattern_type")


def quality_by_category(spark, root):
    return Q.quality_by(_detections(spark, root), "category")


def quality_cube(spark, root):
    """Detections by category and pattern type with all subtotals."""
    rows = _detections(spark, root).cube("category", "pattern_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


def category_distribution(spark, root):
    return _detections(spark, root).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def low_confidence_insights(spark, root, below: float = 0.75):
    rows = _detections(spark, root).groupBy("category").agg(F.avg("ml_confidence").alias("avg")).where((F.col("avg") < below) & F.col("category").isNotNull())
    return rows.select("category", F.format_string("Low confidence for %s: %.2f", "category", "avg").alias("insight"))


def overall_quality_health(spark, root):
    """Mean confidence, precision and recall over the categories in percent, less 5 for each high or critical anomaly of the last day; a ladder of 85, 70 and 50."""
    per = Q.quality_by(_detections(spark, root), "category").agg(F.avg((F.col("avg_confidence") + F.col("precision") + F.col("recall")) / 3).alias("m"))
    found = monitoring.system_health(spark, root).select((F.col("critical") + F.col("high")).alias("grave"))
    score = F.round(F.greatest(F.lit(0.0), F.col("m") * 100 - 5 * F.col("grave")), 6)
    return per.join(F.broadcast(found)).select(score.alias("score"), F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor").alias("status"))


def ml_ratio(spark, root):
    """Share of detections by the model, with mean times."""
    return _detections(spark, root).agg(F.count_if(~F.col("fallback_used")).alias("ml"), F.count_if("fallback_used").alias("fallback"), F.round(F.avg(F.when(F.col("fallback_used").isNotNull(), (~F.col("fallback_used")).cast("int"))), 9).alias("ratio"))


def upsert_latest(spark, root):
    """The last result stored under each test, group and metric."""
    rows = table(spark, root, "ab_test_results", "id", "test_id", "group_name", "metric_name", "metric_value").where("test_id is not null")
    rows = rows.withColumn("key", F.concat_ws("|", "test_id", "group_name", "metric_name"))
    return Q.latest(rows, "key", "id").drop("key")


def feedback_unique(spark, root):
    """Feedback sent more than once counts once: the first row of each feedback_id."""
    rows = table(spark, root, "user_feedback", "id", "feedback_id", "feedback_type", "severity").where("feedback_id is not null")
    return rows.groupBy("feedback_id").agg(F.min_by(F.struct("id", "feedback_type", "severity"), "id").alias("f")).select("feedback_id", "f.*")


def confusion_metrics(spark, root):
    """Confidence against confirmed truth of the training examples, by category."""
    return Q.confusion(table(spark, root, "training_examples", "category", "confidence_score", "is_true_positive"), "confidence_score", "is_true_positive", "category")


def confidence_proxy_metrics(spark, root):
    """Without truth: the share of confidences above 0.7, and 1 less their deviation, of the last day."""
    rows = _detections(spark, root).where("ml_confidence is not null")
    edge = rows.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("edge"))
    recent = rows.join(F.broadcast(edge)).where("ts >= edge")
    return recent.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ml_confidence") > 0.7).cast("int")), 9).alias("share"), F.round(1 - F.coalesce(F.stddev_samp("ml_confidence"), F.lit(0.0)), 9).alias("correlation"))


def ml_rule_corr(spark, root):
    """Correlation of the model's and the rules' confidence over the last 100 detections that needed no fallback."""
    rows = _detections(spark, root).where("ml_confidence is not null and not fallback_used")
    known = F.create_map(*[F.lit(x) for kv in CATEGORY_SPECIFICITY.items() for x in kv])
    rule = base_confidence(F.coalesce(F.try_element_at(known, F.coalesce("category", F.lit(""))), F.lit(DEFAULT_SPECIFICITY)))
    last = rows.orderBy(F.desc("id")).limit(100).select("ml_confidence", rule.alias("rule"))
    return last.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("ml_confidence", "rule"), 6).alias("correlation"))


def model_evaluation(spark, root, baseline: float = 0.7):
    """Accuracy at 0.5 and the spread of confidence, with the deployment gate: accurate, tested, and better than the baseline by a point."""
    rows = table(spark, root, "training_examples", "confidence_score", "is_true_positive").where("confidence_score is not null and is_true_positive is not null")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("confidence_score") > 0.5) == F.col("is_true_positive")).cast("int")).alias("a"), F.avg("confidence_score").alias("c"), F.stddev_pop("confidence_score").alias("s"))
    gate = F.when((F.col("a") >= 0.7) & (F.col("n") >= 20) & (F.col("a") >= baseline + 0.01), "deploy").otherwise("hold")
    return out.select("n", F.round("a", 9).alias("accuracy"), F.round("c", 9).alias("avg_confidence"), F.round("s", 9).alias("std_confidence"), gate.alias("decision"))


def ab_bucket_md5(spark, root):
    """Documents in the control or variant half by their hash."""
    b = Q.bucket(F.col("document_id"))
    rows = table(spark, root, "pdf_documents", "document_id").where("document_id is not null")
    return rows.select("document_id", b.alias("bucket"), F.when(b / 1_000_000 <= 0.5, "control").otherwise("variant").alias("group_name"))


def ab_variant_summary(spark, root):
    return Q.variant_summary(table(spark, root, "ab_test_results", "test_id", "group_name", "metric_name", "metric_value"))


def ab_t_stat(spark, root):
    return Q.t_tests(table(spark, root, "ab_test_results", "test_id", "group_name", "metric_name", "metric_value"))


def ab_active_tests(spark, root):
    """Tests that run as of the newest one: active, begun and not ended."""
    rows = table(spark, root, "ab_tests", "test_id", "test_name", "traffic_split_ratio", "is_active", "created_at", "deleted_at")
    now = rows.agg(F.max("created_at").alias("now"))
    running = rows.join(F.broadcast(now)).where("is_active and created_at <= now and (deleted_at is null or deleted_at > now)")
    return running.select("test_id", "test_name", "traffic_split_ratio")


def feedback_patterns(spark, root):
    """Feedback of the last week by type and category, ratings without nulls and zeros."""
    rows = table(spark, root, "user_feedback", "ts", "feedback_type", "detected_category", "user_confidence_rating")
    edge = rows.agg((F.max("ts") - F.expr("INTERVAL 168 HOURS")).alias("edge"))
    recent = rows.join(F.broadcast(edge)).where("ts >= edge")
    rating = F.when(F.col("user_confidence_rating") != 0, F.col("user_confidence_rating"))
    return recent.groupBy("feedback_type", "detected_category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(rating), 9).alias("avg_rating"))


def problem_categories(spark, root):
    """Categories with at least five feedbacks of which more than 30 % are false positives."""
    rows = table(spark, root, "user_feedback", "feedback_type", "detected_category").groupBy("detected_category")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("feedback_type") == "false_positive").alias("false_positives"))
    return out.where("n >= 5 and false_positives / n > 0.3")


def feedback_to_examples(spark, root):
    """Feedback turned into training rows: the corrected category, else the detected one, with label and confidence."""
    rows = table(spark, root, "user_feedback", "id", "text_segment", "detected_category", "user_corrected_category", "feedback_type")
    kind = F.col("feedback_type")
    label = F.when(kind == "false_positive", False).when(kind.isin("false_negative", "correct", "category_correction", "confirmed_correct", "category_wrong"), True)
    return rows.where(label.isNotNull()).select("id", F.col("text_segment").alias("detection_text"), F.coalesce("user_corrected_category", "detected_category").alias("category"), label.alias("is_true_positive"), F.when(label, 0.95).otherwise(0.1).alias("confidence"))


def dataset_stats(spark, root):
    """Size, balance and span of the training set."""
    rows = table(spark, root, "training_examples", "is_true_positive", "category", "document_type", "created_at")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_true_positive").alias("positives"), F.countDistinct("category").alias("categories"), F.countDistinct("document_type").alias("document_types"),
        F.round(F.try_divide(F.count_if("is_true_positive"), F.count(F.lit(1))), 9).alias("balance"), F.least(F.lit(1.0), F.count(F.lit(1)) / 1000).alias("quality"), F.unix_micros(F.min("created_at")).alias("first"), F.unix_micros(F.max("created_at")).alias("last"),
    )


def training_validation(spark, root):
    """What speaks against training on the set."""
    rows = table(spark, root, "training_examples", "is_true_positive", "category")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("c"), (F.count_if("is_true_positive") / F.count(F.lit(1))).alias("b"))
    issues = F.array_compact(F.array(F.when((F.col("b") < 0.3) | (F.col("b") > 0.7), "imbalanced"), F.when(F.col("n") < 100, "too few rows"), F.when(F.col("c") < 3, "too few categories")))
    return out.select("n", F.col("c").alias("categories"), F.round("b", 9).alias("balance"), F.array_join(issues, "; ").alias("issues"))


def training_by_source(spark, root):
    return table(spark, root, "training_examples", "data_source", "category", "is_true_positive").groupBy("data_source", "is_true_positive").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("categories"))


def active_patterns(spark, root):
    rows = table(spark, root, "adaptive_patterns", "pattern_id", "regex", "confidence", "is_active").where("is_active")
    return rows.select("pattern_id", "regex", "confidence").orderBy(F.desc_nulls_last("confidence"), "pattern_id")


def pattern_keep_best(spark, root):
    """Patterns upserted by regex: older halves meet newer ones, and only a strictly higher confidence replaces."""
    cols = ["pattern_id", "regex", "pii_category", "confidence", "version_no"]
    rows = table(spark, root, "adaptive_patterns", *cols, "created_at").where("regex is not null and confidence is not null and pattern_id is not null")
    half = lambda hi: rows.where((F.substring("pattern_id", -1, 1) >= "5") if hi else (F.substring("pattern_id", -1, 1) < "5"))
    best = lambda d: d.groupBy("regex").agg(F.max_by(F.struct(*cols), F.struct("confidence", "pattern_id")).alias("b")).select("b.*")
    return Q.keep_best(best(half(False)), best(half(True)), "regex", "confidence")


NAMES = (
    "quality_by_category", "quality_cube", "category_distribution", "low_confidence_insights", "overall_quality_health", "ml_ratio", "upsert_latest", "feedback_unique", "confusion_metrics", "confidence_proxy_metrics", "ml_rule_corr",
    "model_evaluation", "ab_bucket_md5", "ab_variant_summary", "ab_t_stat", "ab_active_tests", "feedback_patterns", "problem_categories", "feedback_to_examples", "dataset_stats", "training_validation", "training_by_source", "active_patterns", "pattern_keep_best",
)
QUERIES = {n: globals()[n] for n in NAMES}
_H = "md5(document_id)"
_P = [f"CAST('0x' || substr({_H}, {8 * k + 1}, 8) AS BIGINT)" for k in range(4)]
_B = f"(((({_P[0]} % 1000000) * 967296 + {_P[1]}) % 1000000 * 967296 + {_P[2]}) % 1000000 * 967296 + {_P[3]}) % 1000000"
ORACLE = {
    "quality_by_category": "SELECT category, count(*) AS n, round(avg(ml_confidence), 9) AS avg_confidence, round(stddev_pop(ml_confidence), 9) AS std_confidence, round(avg(ml_confidence), 9) AS precision, round(avg(ml_confidence), 9) AS recall, round(1 - avg(ml_confidence), 9) AS false_positive_rate, CAST(1 AS DOUBLE) AS pattern_diversity, round(avg(processing_time_ms), 6) AS avg_ms FROM detection_results GROUP BY ALL",
    "quality_cube": "SELECT category, pattern_type, count(*) AS n, CAST(grouping(category, pattern_type) AS BIGINT) AS level FROM detection_results GROUP BY CUBE (category, pattern_type)",
    "category_distribution": "SELECT category, count(*) AS n FROM detection_results GROUP BY ALL",
    "low_confidence_insights": "SELECT category, format('Low confidence for {}: {:.2f}', category, avg(ml_confidence)) AS insight FROM detection_results WHERE category IS NOT NULL GROUP BY category HAVING avg(ml_confidence) < 0.75",
    "overall_quality_health": f"""WITH p AS (SELECT round(avg(ml_confidence), 9) AS a FROM detection_results GROUP BY category), h AS ({monitoring.ORACLE['system_health']}), s AS (SELECT round(greatest(0.0, avg(a) * 100 - 5 * (SELECT critical + high FROM h)), 6) AS score FROM p)
SELECT score, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS status FROM s""",
    "ml_ratio": "SELECT CAST(count_if(NOT fallback_used) AS BIGINT) AS ml, CAST(count_if(fallback_used) AS BIGINT) AS fallback, round(avg(CAST(NOT fallback_used AS INT)), 9) AS ratio FROM detection_results",
    "upsert_latest": "SELECT id, test_id, group_name, metric_name, metric_value FROM (SELECT *, row_number() OVER (PARTITION BY concat_ws('|', test_id, group_name, metric_name) ORDER BY id DESC) AS r FROM ab_test_results WHERE test_id IS NOT NULL) WHERE r = 1",
    "feedback_unique": "SELECT feedback_id, id, feedback_type, severity FROM (SELECT *, row_number() OVER (PARTITION BY feedback_id ORDER BY id) AS r FROM user_feedback WHERE feedback_id IS NOT NULL) WHERE r = 1",
    "confusion_metrics": """WITH c AS (SELECT category, CAST(count_if(confidence_score > 0.5 AND is_true_positive) AS BIGINT) AS tp, CAST(count_if(confidence_score > 0.5 AND NOT is_true_positive) AS BIGINT) AS fp, CAST(count_if(confidence_score <= 0.5 AND NOT is_true_positive) AS BIGINT) AS tn,
CAST(count_if(confidence_score <= 0.5 AND is_true_positive) AS BIGINT) AS fn FROM training_examples WHERE confidence_score IS NOT NULL AND is_true_positive IS NOT NULL GROUP BY ALL),
m AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS a, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM c)
SELECT category, tp, fp, tn, fn, round(a, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM m""",
    "confidence_proxy_metrics": "SELECT count(*) AS n, round(avg(CAST(ml_confidence > 0.7 AS INT)), 9) AS share, round(1 - coalesce(stddev_samp(ml_confidence), 0), 9) AS correlation FROM detection_results WHERE ml_confidence IS NOT NULL AND ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM detection_results WHERE ml_confidence IS NOT NULL)",
    "ml_rule_corr": f"""WITH l AS (SELECT ml_confidence AS m, 0.5 + least(0.4, (CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CATEGORY_SPECIFICITY.items())} ELSE {DEFAULT_SPECIFICITY} END) / 250) AS r
FROM detection_results WHERE ml_confidence IS NOT NULL AND NOT fallback_used ORDER BY id DESC LIMIT 100) SELECT count(*) AS n, round(corr(m, r), 6) AS correlation FROM l""",
    "model_evaluation": """SELECT count(*) AS n, round(avg(CAST((confidence_score > 0.5) = is_true_positive AS INT)), 9) AS accuracy, round(avg(confidence_score), 9) AS avg_confidence, round(stddev_pop(confidence_score), 9) AS std_confidence,
CASE WHEN avg(CAST((confidence_score > 0.5) = is_true_positive AS INT)) >= 0.71 AND count(*) >= 20 THEN 'deploy' ELSE 'hold' END AS decision FROM training_examples WHERE confidence_score IS NOT NULL AND is_true_positive IS NOT NULL""",
    "ab_bucket_md5": f"SELECT document_id, {_B} AS bucket, CASE WHEN {_B} / 1000000 <= 0.5 THEN 'control' ELSE 'variant' END AS group_name FROM pdf_documents WHERE document_id IS NOT NULL",
    "ab_variant_summary": "SELECT test_id, group_name, metric_name, count(*) AS n, round(avg(metric_value), 9) AS mean, round(median(metric_value), 9) AS median, round(coalesce(stddev_samp(metric_value), 0), 9) AS std, min(metric_value) AS low, max(metric_value) AS high FROM ab_test_results WHERE metric_value IS NOT NULL GROUP BY ALL",
    "ab_t_stat": """WITH m AS (SELECT test_id, metric_name, count(*) FILTER (group_name = 'control') AS n_c, count(*) FILTER (group_name = 'variant') AS n_v, avg(metric_value) FILTER (group_name = 'control') AS mean_c, avg(metric_value) FILTER (group_name = 'variant') AS mean_v,
coalesce(var_samp(metric_value) FILTER (group_name = 'control'), 0) AS vc, coalesce(var_samp(metric_value) FILTER (group_name = 'variant'), 0) AS vv FROM ab_test_results WHERE metric_value IS NOT NULL GROUP BY ALL),
p AS (SELECT *, n_c + n_v - 2 AS df, ((n_c - 1) * vc + (n_v - 1) * vv) / nullif(n_c + n_v - 2, 0) AS pooled FROM m WHERE n_c > 0 AND n_v > 0)
SELECT test_id, metric_name, n_c, n_v, round(mean_c, 9) AS mean_c, round(mean_v, 9) AS mean_v, df, round((mean_v - mean_c) / nullif(sqrt(pooled * (1 / n_c + 1 / n_v)), 0), 6) AS t, CASE WHEN mean_v > mean_c THEN 'variant' WHEN mean_v < mean_c THEN 'control' END AS leader FROM p""",
    "ab_active_tests": "WITH n AS (SELECT max(created_at) AS now FROM ab_tests) SELECT test_id, test_name, traffic_split_ratio FROM ab_tests, n WHERE is_active AND created_at <= now AND (deleted_at IS NULL OR deleted_at > now)",
    "feedback_patterns": "SELECT feedback_type, detected_category, count(*) AS n, round(avg(nullif(user_confidence_rating, 0)), 9) AS avg_rating FROM user_feedback WHERE ts >= (SELECT max(ts) - INTERVAL 168 HOUR FROM user_feedback) GROUP BY ALL",
    "problem_categories": "SELECT detected_category, count(*) AS n, CAST(count_if(feedback_type = 'false_positive') AS BIGINT) AS false_positives FROM user_feedback GROUP BY ALL HAVING count(*) >= 5 AND count_if(feedback_type = 'false_positive') / count(*) > 0.3",
    "feedback_to_examples": """SELECT id, text_segment AS detection_text, coalesce(user_corrected_category, detected_category) AS category, feedback_type <> 'false_positive' AS is_true_positive, CAST(CASE WHEN feedback_type = 'false_positive' THEN 0.1 ELSE 0.95 END AS DOUBLE) AS confidence
FROM user_feedback WHERE feedback_type IN ('false_positive', 'false_negative', 'correct', 'category_correction', 'confirmed_correct', 'category_wrong')""",
    "dataset_stats": "SELECT count(*) AS n, CAST(count_if(is_true_positive) AS BIGINT) AS positives, count(DISTINCT category) AS categories, count(DISTINCT document_type) AS document_types, round(count_if(is_true_positive) / count(*), 9) AS balance, CAST(least(1.0, count(*) / 1000) AS DOUBLE) AS quality, epoch_us(min(created_at)) AS first, epoch_us(max(created_at)) AS last FROM training_examples",
    "training_validation": """WITH t AS (SELECT count(*) AS n, count(DISTINCT category) AS categories, count_if(is_true_positive) / count(*) AS b FROM training_examples)
SELECT n, categories, round(b, 9) AS balance, concat_ws('; ', CASE WHEN b < 0.3 OR b > 0.7 THEN 'imbalanced' END, CASE WHEN n < 100 THEN 'too few rows' END, CASE WHEN categories < 3 THEN 'too few categories' END) AS issues FROM t""",
    "training_by_source": "SELECT data_source, is_true_positive, count(*) AS n, count(DISTINCT category) AS categories FROM training_examples GROUP BY ALL",
    "active_patterns": "SELECT pattern_id, regex, confidence FROM adaptive_patterns WHERE is_active",
    "pattern_keep_best": """WITH a AS (SELECT * FROM adaptive_patterns WHERE regex IS NOT NULL AND confidence IS NOT NULL AND pattern_id IS NOT NULL),
b AS (SELECT *, right(pattern_id, 1) >= '5' AS hi, row_number() OVER (PARTITION BY regex, right(pattern_id, 1) >= '5' ORDER BY confidence DESC, pattern_id DESC) AS r FROM a),
o AS (SELECT * FROM b WHERE r = 1 AND NOT hi), n AS (SELECT * FROM b WHERE r = 1 AND hi)
SELECT coalesce(o.pattern_id, n.pattern_id) AS pattern_id, coalesce(o.regex, n.regex) AS regex, CASE WHEN o.regex IS NULL OR n.confidence > o.confidence THEN n.pii_category ELSE o.pii_category END AS pii_category,
CASE WHEN o.regex IS NULL OR n.confidence > o.confidence THEN n.confidence ELSE o.confidence END AS confidence, CASE WHEN o.regex IS NULL THEN 1 ELSE o.version_no + CASE WHEN n.confidence > o.confidence THEN 1 ELSE 0 END END AS version_no
FROM o FULL JOIN n ON o.regex = n.regex""",
}
