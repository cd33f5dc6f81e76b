"""p7: personal information in feedback and training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.masking import find_personal
from veilspan.sources.tables import table

FIELDS = (("user_feedback", "text_segment", "context"), ("training_examples", "detection_text", "context"))


def p7_masked(spark: SparkSession, root: str) -> DataFrame:
    """Every text that holds personal information, with placeholders in its place."""
    found = [find_personal(table(spark, root, name, "id", *fields), F.col("id"), *fields).select(F.lit(name).alias("record_table"), "*") for name, *fields in FIELDS]
    return found[0].unionByName(found[1])


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_masked(spark, root).select("record_table", "record_id", "field_name", F.explode("pii_types").alias("pii_type"))


QUERIES = {"p7_found": p7_found, "p7_masked": p7_masked}
ORACLE: dict[str, str] = {}
