"""p10: stretches of documents that occur word for word in others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspan.llm.spans import expand, linked, shared_share
from veilspan.sources.tables import table


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return expand(*linked(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text"))


def p10_shared_share(spark: SparkSession, root: str) -> DataFrame:
    """For each document how much of its text is shared elsewhere."""
    return shared_share(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


QUERIES = {"p10_found": p10_found, "p10_shared_share": p10_shared_share}
ORACLE = {
    "p10_found": """WITH g AS (SELECT doc_id, unnest(list_transform(range(1, len(text) - 198), lambda i: md5_number(substr(text, i, 200)))) AS h FROM documents WHERE len(text) >= 200), d AS (SELECT DISTINCT doc_id, h FROM g)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id""",
}
