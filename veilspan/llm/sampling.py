"""A sample that meets target shares of several fields at once, by swap repair on signature counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.forms import plain
from veilspan.session import materialize

#: Share of all rows that a sample takes unless a size is given.
SHARE = 0.1
#: Most target rows that are read to the driver.
MOST_TARGETS = 10_000
#: Most combinations of target classes that are read to the driver.
MOST_SIGNATURES = 100_000
#: Exchanges that are weighed at once.
WEIGHED = 1_000_000
#: Hash ranges that a signature is cut into when its rows are drawn.
RANGES = 4096
#: Sum over fields of the square of a floor's shortfall counts this many times.
FLOOR_WEIGHT = 1_000.0


def _loss(counts: np.ndarray, goal: np.ndarray, floor: np.ndarray) -> np.ndarray:
    return ((counts - goal) ** 2).sum(-1) + FLOOR_WEIGHT * (np.maximum(floor - counts, 0) ** 2).sum(-1)


def swap_repair(available: np.ndarray, member: np.ndarray, goal: np.ndarray, floor: np.ndarray, size: int, seed: int) -> np.ndarray:
    """How many rows of each signature to take.

    ``member[s, c]`` tells whether signature s counts for class c.  Starts from random
    counts, raised where a floor asks for it, then exchanges rows between two signatures
    wherever that lowers the squared deviation, by ever smaller steps down to single
    rows, until no exchange lowers it.
    """
    rng = np.random.default_rng(seed)
    take = rng.multivariate_hypergeometric(available, size, method="marginals") if available.sum() > size else available.copy()
    for c in np.argsort(available @ member):  # the rarest classes first
        own = np.flatnonzero(member[:, c])
        for s in rng.permutation(own):
            short = int(floor[c] - take @ member[:, c])
            if short <= 0:
                break
            take[s] += min(short, available[s] - take[s])
    counts = take @ member
    while take.sum() > size:  # what the floors added leaves where it is least needed
        ok = np.flatnonzero(take > 0)
        s = ok[np.argmin(_loss(counts - member[ok], goal, floor))]
        take[s] -= 1
        counts = counts - member[s]
    step = max(1, size // 4)
    while True:
        now = _loss(counts, goal, floor)
        best, move = now - 1e-9, None
        give, get = np.flatnonzero(take >= step), np.flatnonzero(available - take >= step)
        rows = max(1, WEIGHED // max(1, len(get) * member.shape[1]))
        for k in range(0, len(give) if len(get) else 0, rows):  # in blocks, whatever the number of signatures
            some = give[k : k + rows]
            loss = _loss((counts - step * member[some])[:, None, :] + step * member[get][None, :, :], goal, floor)
            i, j = np.unravel_index(np.argmin(loss), loss.shape)
            if loss[i, j] < best:
                best, move = loss[i, j], (some[i], get[j])
        if move:
            take[move[0]] -= step
            take[move[1]] += step
            counts = take @ member
        elif step == 1:
            return take
        else:
            step //= 2


def _targets(targets: DataFrame) -> list:
    rows = targets.select("field_name", "field_class", "target_share", "min_rows").where("field_name is not null and field_class is not null").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return sorted(rows, key=lambda r: (r.field_name, r.field_class))


def _signed(df: DataFrame, key: str, targets: list) -> tuple[DataFrame, list[str]]:
    """``id`` and the class of each target field: the target class that agrees apart from case, spaces and punctuation, or null."""
    names = sorted({r.field_name for r in targets})
    cols = []
    for name in names:
        own = plain(F.col(f"`{name}`").cast("string"))
        c = None
        for r in (r for r in targets if r.field_name == name):
            hit = own == plain(F.lit(r.field_class))
            c = F.when(hit, r.field_class) if c is None else c.when(hit, r.field_class)
        cols.append(c.alias(name))
    return df.select(F.col(key).alias("id"), *cols), names


def draw_sample(df: DataFrame, key: str, targets: DataFrame, size: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    The sample has ``id`` and one column per target field.  The report has one row
    per target: ``field_name, field_class, target_share, min_rows, available, taken,
    actual_share, met, reason``.  A target is met if the share is within half a
    percentage point and the floor is kept.  ``size`` is by default SHARE of the rows, but
    enough for the floors of any one field.  Rows of no target class in a field count
    against that field's targets and are swapped out first.  Repeated rows are rows of
    their own; an empty table gives an empty sample and a report of unmet targets.
    """
    spark, rows = df.sparkSession, _targets(targets)
    signed, names = _signed(df, key, rows)
    signed = materialize(signed, "signed")
    # At most one row per combination of target classes.
    found = signed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).limit(MOST_SIGNATURES + 1).collect() if names else []
    if len(found) > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} combinations of target classes")
    found = sorted(found, key=lambda r: tuple(str(r[x]) for x in names))
    available = np.array([r["_n"] for r in found], dtype=np.int64)
    member = np.array([[r[t.field_name] == t.field_class for t in rows] for r in found], dtype=np.int64).reshape(len(found), len(rows))
    field = np.array([names.index(t.field_name) for t in rows], dtype=np.int64)
    total, have = int(available.sum()), available @ member
    floor = np.array([t.min_rows or 0 for t in rows], dtype=np.int64)
    reach = np.minimum(floor, have)
    least = max((int(reach[field == f].sum()) for f in range(len(names))), default=0)
    size = min(total, size or max(int(total * SHARE), least))
    goal = np.array([(t.target_share or 0.0) * size for t in rows])
    take = swap_repair(available, member, goal, reach, size, seed) if total else available
    counts = take @ member

    plan = [(*[r[x] for x in names], int(k)) for r, k in zip(found, take)]
    schema = ", ".join(f"`{x}` string" for x in names) + ", _take bigint"
    plan = F.broadcast(spark.createDataFrame(plan, schema))
    on = lambda a, b: [a[x].eqNullSafe(b[x]) for x in names]
    # The take smallest hashes of each signature: whole ranges of hashes, then the smallest of one more range.
    lot = F.xxhash64(F.lit(seed), "id")
    rolled = signed.withColumn("_lot", lot).withColumn("_range", F.pmod("_lot", F.lit(RANGES)))
    w = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = rolled.groupBy(*names, "_range").agg(F.count(F.lit(1)).alias("_c")).withColumn("_to", F.sum("_c").over(w))
    ranges = ranges.join(plan, on(ranges, plan)).select(*[ranges[x] for x in names], "_range", "_c", "_to", "_take").where("_to - _c < _take")
    ranges = materialize(ranges, "ranges")
    small = F.broadcast(ranges) if len(found) * RANGES <= 2_000_000 else ranges
    drawn = rolled.join(small, [*on(rolled, small), rolled["_range"] == small["_range"]]).select("id", *[rolled[x] for x in names], "_lot", "_c", "_to", "_take")
    edge = drawn.where("_to > _take").withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("_lot", "id"))).where("_r <= _take - (_to - _c)")
    sample = drawn.where("_to <= _take").select("id", *names).unionByName(edge.select("id", *names))

    report = []
    for t, got, all_, want in zip(rows, counts, have, goal):
        share = float(got) / size if size else 0.0
        low, off = got < (t.min_rows or 0), abs(share - (t.target_share or 0.0)) > 0.005
        reason = "too few rows of the class" if all_ < max(t.min_rows or 0, round(want)) else "the other targets leave no room" if low or off or not size else None
        report.append((t.field_name, t.field_class, t.target_share, t.min_rows, int(all_), int(got), share, not (low or off) and size > 0, reason if low or off or not size else None))
    kinds = "field_name string, field_class string, target_share double, min_rows int, available bigint, taken bigint, actual_share double, met boolean, reason string"
    return sample, spark.createDataFrame(report, kinds)
