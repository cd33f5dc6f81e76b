"""p8: documents in containers of fixed capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.packing import compared, pack
from veilspan.llm.tokens import token_sizes
from veilspan.session import materialize
from veilspan.sources.tables import table


def _sizes(spark: SparkSession, root: str) -> DataFrame:
    return materialize(token_sizes(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text"), "sizes")


def p8_packing(spark: SparkSession, root: str) -> DataFrame:
    return pack(_sizes(spark, root), "doc_id", table(spark, root, "pack_capacities"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """By kind: containers used, those of best fit alone, the fewest possible, and the share of room that is filled."""
    sizes, kinds = _sizes(spark, root), table(spark, root, "pack_capacities")
    by = ["container_kind", "capacity_tokens"]
    used = pack(sizes, "doc_id", kinds).groupBy(*by).agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(compared(sizes, "doc_id", kinds), by).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p8_check(spark: SparkSession, root: str) -> DataFrame:
    """By kind: containers above their capacity, documents whose pieces are not their tokens, and documents cut although they fit; 0 each."""
    sizes, by = _sizes(spark, root), ["container_kind", "capacity_tokens"]
    rows = materialize(pack(sizes, "doc_id", table(spark, root, "pack_capacities")), "packing")
    bins = rows.groupBy(*by, "container_id").agg(F.sum("tokens").alias("t")).groupBy(*by).agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    docs = rows.groupBy(*by, "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("pieces")).join(sizes, "doc_id", "full")
    wrong = docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("t").eqNullSafe(F.col("tokens"))).alias("changed"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("cut_needlessly")
    )
    return wrong.join(bins, by)


QUERIES = {"p8_packing": p8_packing, "p8_fill": p8_fill, "p8_check": p8_check}
ORACLE = {
    "p8_check": """SELECT container_kind, capacity_tokens, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS documents, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS cut_needlessly, CAST(0 AS BIGINT) AS overfull
FROM pack_capacities WHERE capacity_tokens > 0""",
}
