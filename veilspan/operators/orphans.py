"""References to records that do not exist: contiguous key runs and an as-of match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.operators.skew import split_join
from veilspan.session import materialize

#: Integer keys in one bucket; runs are cut at bucket borders, so a bucket holds at most WIDTH parents.
WIDTH = 256


def integer_key(key: Column) -> tuple[Column, Column]:
    """A text key as (shape, integer), one to one: the 8 hex digits or the ending number, and the text around them.

    Keys without either are a shape of their own with the integer 0.
    """
    hexed, num = r"(?s)^(.*?)(?<![0-9a-f])([0-9a-f]{8})(?![0-9a-f])(.*)$", r"(?s)^(.*?)(0|[1-9][0-9]{0,17})$"
    is_hex, is_num = key.rlike(hexed), key.rlike(num)
    shape = (
        F.when(is_hex, F.concat(F.lit("h"), F.regexp_extract(key, hexed, 1), F.lit("\0"), F.regexp_extract(key, hexed, 3)))
        .when(is_num, F.concat(F.lit("d"), F.regexp_extract(key, num, 1)))
        .otherwise(F.concat(F.lit("s"), key))
    )
    number = F.when(is_hex, F.conv(F.regexp_extract(key, hexed, 2), 16, 10).cast("bigint")).when(is_num, F.regexp_extract(key, num, 2).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return shape, number


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    shape, number = integer_key(F.col(key))
    return df.where(F.col(key).isNotNull()).withColumn("shape", shape).withColumn("k", number).withColumn("bucket", F.floor(F.col("k") / WIDTH))


def key_runs(parents: DataFrame, key: str, born: str, died: str) -> DataFrame:
    """(shape, bucket, runs): the sorted parent keys compressed into contiguous runs with each key's life time.

    A key with several parent rows lives from the earliest birth to the latest death.
    """
    never = F.max(F.when(F.col(died).isNull(), 1).otherwise(0)) == 1
    lives = parents.groupBy(key).agg(
        F.when(F.max(F.col(born).isNull().cast("int")) == 0, F.min(born)).alias("born"),
        F.when(~never, F.max(died)).alias("died"),
    )
    rows = _bucketed(lives, key)
    island = F.col("k") - F.row_number().over(Window.partitionBy("shape", "bucket").orderBy("k"))
    runs = rows.withColumn("island", island).groupBy("shape", "bucket", "island").agg(
        F.min("k").alias("start"), F.max("k").alias("end"), F.sort_array(F.collect_list(F.struct("k", "born", "died"))).alias("lives")
    )
    return runs.groupBy("shape", "bucket").agg(F.sort_array(F.collect_list(F.struct("start", "end", "lives"))).alias("runs"))


def find_orphans(children: DataFrame, key: str, at: str, parents: DataFrame, parent_key: str, born: str, died: str) -> DataFrame:
    """The rows of ``children`` whose reference has no parent that lives at the row's time, with ``reason``.

    Each reference is matched as of the preceding run start of its bucket; beyond
    that run's end it is ``absent``, within it the parent may be ``younger`` (born
    after the child) or ``deleted`` (dead at or before it).  Null references are
    no references; a null time leaves only ``absent``; a parent without birth or
    death time was always there or never died.  Repeated rows are all reported;
    with no parents every reference is absent.  Rows of hot keys are not shuffled.
    """
    refs = materialize(_bucketed(children, key), "refs")  # keys are taken apart once
    met = split_join(refs, key_runs(parents, parent_key, born, died), ["shape", "bucket"], "left")
    run = F.try_element_at(F.filter("runs", lambda r: r["start"] <= F.col("k")), F.lit(-1))
    met = met.withColumn("run", run)
    life = F.when(F.col("k") <= F.col("run.end"), F.get(F.col("run.lives"), (F.col("k") - F.col("run.start")).cast("int")))
    met = met.withColumn("life", life)
    reason = F.when(F.col("life").isNull(), "absent").when(F.col("life.born") > F.col(at), "younger").when(F.col("life.died") <= F.col(at), "deleted")
    return met.withColumn("reason", reason).where("reason is not null").drop("shape", "k", "bucket", "runs", "run", "life")


def utc_micros(text: Column) -> Column:
    """Microseconds since the epoch of an ISO text with ``T`` or a space, with or without zone (then UTC)."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned))
