"""p3: records whose text looks plain but is not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.lookalikes import Former, code_point_counts, consistent_forms
from veilspan.sources.tables import table

FIELDS = (("training_examples", "id", "detection_text"), ("user_feedback", "id", "text_segment"), ("adaptive_patterns", "pattern_id", "regex"))


def p3_forms(spark: SparkSession, root: str) -> DataFrame:
    """``record_table, record_key, text, form`` of the records that are not in their consistent form."""
    frames = [(name, table(spark, root, name, key, text), key, text) for name, key, text in FIELDS]
    everything = reduce(DataFrame.unionByName, [df.select(F.col(text).alias("t")) for _, df, _, text in frames])
    former = Former(code_point_counts(everything, "t"))
    return reduce(DataFrame.unionByName, [consistent_forms(df, F.col(key), text, former).select(F.lit(name).alias("record_table"), "*") for name, df, key, text in frames])


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_forms(spark, root).select("record_table", "record_key")


QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms}
ORACLE: dict[str, str] = {}
