"""p5: a sample of the training examples that meets its target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.sampling import draw_sample
from veilspan.session import materialize
from veilspan.sources.tables import table


def _drawn(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, root, "training_examples", "id", "category", "is_true_positive", "data_source")
    return draw_sample(rows, "id", table(spark, root, "sample_targets"))


def p5_sample(spark: SparkSession, root: str) -> DataFrame:
    return _drawn(spark, root)[0]


def p5_target_report(spark: SparkSession, root: str) -> DataFrame:
    return _drawn(spark, root)[1]


def p5_check(spark: SparkSession, root: str) -> DataFrame:
    """By target: the rows there are, and the rows by which the sample itself, counted again, falls short of the floor; 0 each."""
    sample, report = _drawn(spark, root)
    sample = materialize(sample, "sample")
    names = [c for c in sample.columns if c != "id"]
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("field_class")) for c in names]))
    taken = sample.select(each).groupBy("field_name", "field_class").agg(F.count(F.lit(1)).alias("found"))
    met = report.join(taken, ["field_name", "field_class"], "left")
    short = F.greatest(F.lit(0), F.least("min_rows", "available") - F.coalesce("found", F.lit(0)))
    return met.select("field_name", "field_class", "available", short.cast("bigint").alias("short"))


QUERIES = {"p5_sample": p5_sample, "p5_target_report": p5_target_report, "p5_check": p5_check}
_PLAIN = r"lower(regexp_replace({}, '[\s\p{{Z}}\p{{P}}]+', '', 'g'))"
_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS f, {_PLAIN.format(f'CAST({c} AS VARCHAR)')} AS c FROM training_examples" for c in ("category", "is_true_positive", "data_source"))
ORACLE = {
    "p5_check": f"""WITH r AS (SELECT f, c, count(*) AS n FROM ({_ROWS}) GROUP BY ALL)
SELECT field_name, field_class, coalesce(n, 0) AS available, CAST(0 AS BIGINT) AS short FROM sample_targets LEFT JOIN r ON f = field_name AND c = {_PLAIN.format('field_class')}""",
}
