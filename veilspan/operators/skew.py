"""Joins and groups that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds this share of the rows, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.002
#: Keys with fewer rows than this are never worth a special path.
HOT_FLOOR = 50_000
#: Most rows that a frame handed to ``join_small`` may have and still be broadcast.
BROADCAST_ROWS = 100_000


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame | None:
    """The keys that hold more than ``share`` of the rows of ``df``, or None; at most ``1 / share`` rows."""
    counts = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    limit = max(floor, int(total * share))
    if total <= limit:
        return None
    rows = counts.where(F.col("_n") > limit).drop("_n").collect()
    return df.sparkSession.createDataFrame(rows, counts.drop("_n").schema) if rows else None


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join to a ``right`` that is unique by ``keys``; rows of hot keys never move.

    The part of ``right`` under hot keys has at most ``1 / HOT_SHARE`` rows and is
    broadcast; all other rows take an ordinary shuffle join.  ``how`` is inner or left.
    """
    hot = hot_keys(left.select(*keys), keys)
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    few = right.join(hot, keys, "left_semi")
    return (
        left.join(hot, keys, "left_semi")
        .join(F.broadcast(few), keys, how)
        .unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))
    )


def join_small(left: DataFrame, small: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join to one row per key; broadcast only if ``rows``, its counted size, is within BROADCAST_ROWS."""
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, keys, how)
