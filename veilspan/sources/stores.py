"""Reading settings and raw files, and the sinks of detections and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators.quality import keep_best, latest


def pattern_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, regex) from a YAML file with ``pii_patterns``; expressions that do not compile are left out."""
    import re

    import yaml

    with open(path, encoding="utf-8") as f:
        found = (yaml.safe_load(f) or {}).get("pii_patterns") or {}
    rows = []
    for name, p in found.items():
        p = p.get("regex") if isinstance(p, dict) else p
        try:
            re.compile(p)
        except (re.error, TypeError):
            continue
        rows.append((name, p))
    return spark.createDataFrame(rows, "name string, regex string")


def raw_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files as bytes, one row each: ``path, modificationTime, length, content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def append(df: DataFrame, path: str, *by: str) -> None:
    """Rows added to a table, partitioned where ``by`` is given."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    """Events by month, so that retention drops whole folders."""
    append(df.withColumn("month", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM")), path, "month")


def append_unique(df: DataFrame, path: str, key: str, there: DataFrame | None = None) -> None:
    """Rows whose key is new, each key once."""
    once = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    append(once.join(there.select(key), key, "left_anti") if there is not None else once, path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both together, the greatest order of each key."""
    return latest(old.unionByName(new), key, order)


def upsert_patterns(old: DataFrame, new: DataFrame) -> DataFrame:
    return keep_best(old, new, "regex", "confidence")


def migrated(df: DataFrame) -> DataFrame:
    """Reports that were kept as error messages of completed documents moved to their own column."""
    is_json = (F.lower("status") == "completed") & F.try_parse_json("error_message").isNotNull()
    return df.withColumns({"redaction_report": F.when(is_json, F.col("error_message")), "error_message": F.when(~F.coalesce(is_json, F.lit(False)), F.col("error_message"))})


# The kinds of feedback.
FEEDBACK_TYPES = ("false_positive", "false_negative", "category_correction", "correct_detection", "confirmed_pii", "confidence_adjustment")


def scan(df: DataFrame, order: str, limit: int | None = None, **equal) -> DataFrame:
    """Rows whose columns equal what is given, newest first; None asks for nothing."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value) if value is not None else df
    df = df.orderBy(F.desc_nulls_last(order), F.desc("id"))
    return df.limit(limit) if limit is not None else df


def deactivated(df: DataFrame, hit: Column) -> DataFrame:
    """A conditional update: rows that are hit are no longer active; ``changed`` tells which were before."""
    hit = F.coalesce(hit, F.lit(False))
    return df.withColumns({"changed": F.coalesce(hit & F.col("is_active"), F.lit(False)), "is_active": F.when(hit, False).otherwise(F.col("is_active"))})


def long_metrics(df: DataFrame, ids: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """One row for each recorded value, ready to be appended: ``ids, metric_name, metric_value``."""
    return df.unpivot(ids, list(metrics), "metric_name", "metric_value").where("metric_value is not null")


def valid_feedback() -> Column:
    """Feedback with an id, a document, a text and a known type."""
    filled = F.lit(True)
    for c in ("feedback_id", "document_id", "text_segment"):
        filled = filled & F.col(c).isNotNull() & (F.col(c) != "")
    return F.coalesce(filled & F.col("feedback_type").isin(*FEEDBACK_TYPES), F.lit(False))


def _leaves(value) -> list[str]:
    """Every text in nested lists and maps."""
    if isinstance(value, str):
        return [value]
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [x for p in parts for x in _leaves(p)]


def brand_table(spark: SparkSession, path: str) -> DataFrame:
    """(brand): the distinct names in all lists of a YAML file, its metadata left out."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    names = {b.strip() for k, v in found.items() if k != "metadata" for b in _leaves(v) if b.strip()}
    return spark.createDataFrame([(b,) for b in sorted(names)], "brand string")


def list_table(spark: SparkSession, path: str, key: str, default: tuple[str, ...] = ()) -> DataFrame:
    """(value): a list of texts in a YAML file, the default where the file or the key is missing."""
    import os

    import yaml

    values: list = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            values = _leaves((yaml.safe_load(f) or {}).get(key))
    return spark.createDataFrame([(v,) for v in values or default], "value string")


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """(doc_type, keywords, action, target_category, confidence_threshold): the rules of a YAML file with ``document_types``; none if it is missing or broken."""
    import os

    import yaml

    rows = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            try:
                types = (yaml.safe_load(f) or {}).get("document_types") or []
            except yaml.YAMLError:
                types = []
        for t in types:
            for r in t.get("rules") or [{}]:
                rows.append((t.get("doc_type"), t.get("keywords") or [], r.get("action"), r.get("target_category"), float(r["confidence_threshold"]) if "confidence_threshold" in r else None))
    return spark.createDataFrame(rows, "doc_type string, keywords array<string>, action string, target_category string, confidence_threshold double")


def applied_rules(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Detections (doc_type, category, confidence) with the action of the rules of their document type; without one the action is null."""
    own = rules.where("action is not null").select("doc_type", F.lower("target_category").alias("category"), "action", "confidence_threshold")
    met = spans.withColumn("_c", F.lower("category")).join(own.withColumnRenamed("category", "_c"), ["doc_type", "_c"], "left").drop("_c")
    return met.withColumn("action", F.when(F.col("confidence") >= F.coalesce("confidence_threshold", F.lit(0.0)), F.col("action"))).drop("confidence_threshold")


def config_faults(patterns: dict, thresholds: dict, database: str) -> list[str]:
    """What is wrong with a configuration: expressions that do not compile, shares outside 0 and 1, a database without its ending."""
    import re

    out = []
    for name, p in patterns.items():
        try:
            re.compile(p)
        except (re.error, TypeError) as e:
            out.append(f"pattern {name}: {e}")
    out += [f"threshold {k}: {v}" for k, v in thresholds.items() if not (isinstance(v, (int, float)) and 0 <= v <= 1)]
    return out if database.endswith(".db") else [*out, f"database {database}"]


def save_config(path: str, content: dict, stamp: str) -> str | None:
    """Write a YAML file; what was there is kept beside it under ``stamp``, and its path returned."""
    import os
    import shutil

    import yaml

    kept = f"{path}.{stamp}" if os.path.exists(path) else None
    if kept:
        shutil.copyfile(path, kept)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(content, f, allow_unicode=True, sort_keys=False)
    return kept
