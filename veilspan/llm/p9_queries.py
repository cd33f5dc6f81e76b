"""p9: a mixture of the documents by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.mixing import mix
from veilspan.llm.tokens import token_sizes
from veilspan.sources.tables import table


def _mixed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    sizes = token_sizes(table(spark, root, "documents", "doc_id", "source", "text"), "doc_id", "text", "source")
    return mix(sizes, "doc_id", "source", table(spark, root, "mix_targets"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[1]


def p9_check(spark: SparkSession, root: str) -> DataFrame:
    """By source: its documents, whether some are used too often, and whether its share among the sources with documents is off by more than whole documents explain."""
    mixture, shares = _mixed(spark, root)
    # Systematic sampling is off by at most the largest document of each source.
    slack = mixture.groupBy("source").agg(F.max("tokens").alias("t")).agg(F.sum("t").alias("slack"))
    whole = shares.agg(F.sum("tokens_used").alias("every"), F.sum(F.when(F.col("tokens_there") > 0, F.col("target_share"))).alias("live"))
    met = shares.join(F.broadcast(whole)).join(F.broadcast(slack))
    goal = F.when(F.col("tokens_there") > 0, F.col("target_share") / F.col("live")).otherwise(0.0)
    off = F.abs(F.col("tokens_used") - goal * F.col("every")) > F.greatest(F.col("slack"), 0.01 * F.col("every"))
    return met.select("source", "documents_there", (F.col("most_repeats") > F.col("max_repeats")).alias("too_often"), off.alias("off_target"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_check": p9_check}
ORACLE = {
    "p9_check": """SELECT m.source, count(d.doc_id) AS documents_there, FALSE AS too_often, FALSE AS off_target FROM mix_targets m LEFT JOIN documents d ON d.source = m.source AND d.text IS NOT NULL GROUP BY m.source""",
}
