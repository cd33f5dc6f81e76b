"""p4: one record of each finding, whatever its formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.forms import group_copies, plain
from veilspan.sources.tables import table


def _copies(spark: SparkSession, root: str) -> DataFrame:
    examples = table(spark, root, "training_examples", "id", "detection_text", "category")
    results = table(spark, root, "detection_results", "id", "text", "document_id")
    return group_copies(examples, "training_examples", "id", "detection_text", plain(F.col("category"))).unionByName(
        group_copies(results, "detection_results", "id", "text", F.col("document_id"))
    )


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _copies(spark, root).where("id > first_id").select("record_table", "first_id", F.col("id").alias("copy_id"))


def p4_copy_counts(spark: SparkSession, root: str) -> DataFrame:
    """Each record that was stored more than once, with its number of copies."""
    return _copies(spark, root).groupBy("record_table", "first_id").agg(F.count(F.lit(1)).alias("copies"))


QUERIES = {"p4_found": p4_found, "p4_copy_counts": p4_copy_counts}

_FORMS = r"""
f AS (
  SELECT 'training_examples' AS record_table, id, detection_text AS t, coalesce(lower(regexp_replace(category, '[\s\p{Z}\p{P}]+', '', 'g')), chr(3)) AS w FROM training_examples
  UNION ALL SELECT 'detection_results', id, text, coalesce(document_id, chr(3)) FROM detection_results
), p AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[;\n\r|]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS parts FROM f WHERE t IS NOT NULL
), k AS (
  SELECT record_table, id, w, CASE WHEN len(parts) > 0 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '(?s)^[^\p{L}]*\p{L}[^:=]*?[:=]'))) = 0 AND (len(parts) > 1 OR regexp_matches(parts[1], '(?s)^[^\p{L}]*\p{L}[^:=]{0,40}?[:=]'))
    THEN array_to_string(list_sort(list_transform(parts, lambda x: lower(regexp_replace(regexp_extract(x, '(?s)^[^\p{L}]*(\p{L}[^:=]*?)[:=](.*)$', 1), '[\s\p{Z}\p{P}]+', '', 'g'))
      || CASE WHEN len(parts) > 1 THEN chr(1) ELSE '' END || lower(regexp_replace(regexp_extract(x, '(?s)^[^\p{L}]*(\p{L}[^:=]*?)[:=](.*)$', 2), '[\s\p{Z}\p{P}]+', '', 'g')))), chr(2))
    ELSE lower(regexp_replace(t, '[\s\p{Z}\p{P}]+', '', 'g')) END AS form FROM p
), g AS (
  SELECT *, min(id) OVER (PARTITION BY record_table, w, form) AS first_id, count(*) OVER (PARTITION BY record_table, w, form) AS copies FROM k
)"""

ORACLE = {
    "p4_found": f"WITH {_FORMS} SELECT record_table, first_id, id AS copy_id FROM g WHERE id > first_id",
    "p4_copy_counts": f"WITH {_FORMS} SELECT record_table, first_id, count(*) AS copies FROM g WHERE copies > 1 GROUP BY ALL",
}
