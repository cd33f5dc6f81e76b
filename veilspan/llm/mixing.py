"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.percentiles import PART_BITS, ranked
from veilspan.operators.skew import join_small
from veilspan.session import materialize

#: Most sources in a table of targets.
MOST_SOURCES = 10_000


def expected_copies(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """How often each source's documents are used on average.

    Shares are taken among the sources that have tokens.  Without ``total`` the mixture
    is the largest in which no source needs more than its allowed repeats; with it,
    sources that would need more stop there.
    """
    live = {s: (share, most) for s, (share, most) in targets.items() if tokens.get(s, 0) > 0 and share > 0 and most > 0}
    whole = sum(share for share, _ in live.values())
    if total is None:
        total = min((most * tokens[s] * whole / share for s, (share, most) in live.items()), default=0.0)
    return {s: min(float(most), total * share / whole / tokens[s]) for s, (share, most) in live.items()}


def mix(sizes: DataFrame, key: str, source: str, targets: DataFrame, total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) of documents with ``tokens``.

    Within a source the documents stand in the order of their size, expected copies are
    summed up, one random offset is added, and a document is emitted once for each
    integer that the sum crosses at it; so each is used the same number of times, rounded up or
    down, and drawn sizes follow the source's.  The mixture has ``key, source, tokens,
    copy``; the shares have one row per target, also where the source has no documents.
    Null sources and sources without target are not used.  Repeated rows are documents of
    their own; an empty table gives an empty mixture and shares of 0.
    """
    spark = sizes.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").where("source is not null").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    goals = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows}
    own = sizes.select(F.col(key).alias("key"), F.col(source).alias("source"), "tokens").where(F.col("source").isin(list(goals)))
    own = materialize(own, "sizes")
    sums = {r.source: (r.t, r.n) for r in own.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    rng = random.Random(seed)
    copies = expected_copies({s: t for s, (t, _) in sums.items()}, goals, total)
    # At most MOST_SOURCES rows; each source has one offset of its own.
    each = F.broadcast(spark.createDataFrame([(x, c, rng.random()) for x, c in sorted(copies.items())], "source string, each double, offset double"))
    docs, offsets = ranked(own, ["source"], "tokens", "key")
    spots = offsets.select("source", "part", "first", "before")
    placed = join_small(docs.withColumn("part", F.shiftright("place", PART_BITS)), spots, ["source", "part"], spots.count()).join(each, "source")
    rank = F.col("place") - F.col("first") + F.col("before")
    times = (F.floor((rank + 1) * F.col("each") + F.col("offset")) - F.floor(rank * F.col("each") + F.col("offset"))).cast("int")
    used = placed.withColumn("times", times).where("times > 0")
    mixture = used.select(F.col("key").alias(key), "source", "tokens", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))

    goal = spark.createDataFrame([(s, g, m, *sums.get(s, (0, 0))) for s, (g, m) in sorted(goals.items())], "source string, target_share double, max_repeats int, tokens_there bigint, documents_there bigint")
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("t"), F.count(F.lit(1)).alias("d"), F.max("times").alias("m"))
    every = used.agg(F.sum(F.col("tokens") * F.col("times")).alias("every"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    shares = goal.join(F.broadcast(got), "source", "left").join(F.broadcast(every)).select(
        "source", "target_share", "max_repeats", "tokens_there", "documents_there", zero("t").alias("tokens_used"), zero("d").alias("documents_used"), zero("m").alias("most_repeats"),
        F.coalesce(F.try_divide(F.col("t"), F.col("every")), F.lit(0.0)).alias("actual_share"),
    )
    return mixture, shares
