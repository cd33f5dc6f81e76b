"""Filling containers of fixed capacity: a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.percentiles import PART_BITS, ranked
from veilspan.operators.skew import join_small
from veilspan.session import materialize

#: Items of one shard: what a population packs together.
SHARD = 1_500
#: Islands with a population of their own, for each shard.
ISLANDS = 2
#: Times that the islands evolve and send their best on.
EPOCHS = 2
POPULATION = 8
#: Most children of an epoch, and how many in a row without any gain end it sooner.
CHILDREN = 60
PATIENCE = 30
#: Containers filled to this share are handed on whole.
WELL_FILLED = 0.995
#: Containers that a child empties at random, those with room first.
EMPTIED = 4
#: Most loose items that are tried in pairs.
PAIRED = 200
#: Shards of one task.
TASK_SHARDS = 8
#: Most kinds of container.
MOST_KINDS = 10_000

#: A packing: the container of every item, counted from 0.
Labels = np.ndarray


def best_fit(items: list[int], sizes: np.ndarray, capacity: int, labels: Labels) -> Labels:
    """Put ``items`` in turn into the containers of ``labels`` (below 0: in none), each where it leaves the least room, or into a new one."""
    there = labels >= 0
    rooms = sorted((int(capacity - f), k) for k, f in enumerate(np.bincount(labels[there], weights=sizes[there])))
    free = len(rooms)
    for i in items:
        s = int(sizes[i])
        at = bisect_left(rooms, (s, -1))
        if at == len(rooms):
            room, k, free = capacity, free, free + 1
        else:
            room, k = rooms.pop(at)
        labels[i] = k
        insort(rooms, (room - s, k))
    return labels


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer containers: items that fit with none of at least a size stand alone, those above half the capacity apart, and the rest fills what room these leave."""
    s = np.sort(np.asarray(sizes, dtype=np.int64))
    return _fewest(*np.unique(s, return_counts=True), capacity)


def _fewest(size: np.ndarray, count: np.ndarray, capacity: int) -> int:
    half = size * 2 > capacity
    weight = size * count
    best = -(-int(weight.sum()) // capacity)
    counts, weights = (np.concatenate(([0], np.cumsum(x))) for x in (count, weight))
    first_big = int(np.searchsorted(half, True))
    for k in np.flatnonzero(~half):
        alone = int(np.searchsorted(size, capacity - size[k], "right"))  # from here on nothing of size[k] fits beside
        middle = int(counts[alone] - counts[first_big])
        room = middle * capacity - int(weights[alone] - weights[first_big])
        need = int(weights[first_big] - weights[k]) - room
        best = max(best, int(counts[-1] - counts[alone]) + middle + max(0, -(-need // capacity)))
    return best


def fitness(labels: Labels, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer containers, then the mean of squared fills: some full containers beat many half full ones."""
    fill = np.bincount(labels, weights=sizes) / capacity
    return -len(fill), float((fill * fill).mean()) if len(fill) else 0.0


def _numbered(labels: Labels) -> Labels:
    """The same containers, counted from 0 without gaps."""
    there = labels >= 0
    labels[there] = np.unique(labels[there], return_inverse=True)[1]
    return labels


@lru_cache(maxsize=2 * PAIRED)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def exchange(labels: Labels, loose: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Swap none, one or two items of a container against one or two loose ones that fill it better, until none do; what is loose then."""
    while len(loose) and (labels >= 0).any():
        inside = np.flatnonzero(labels >= 0)
        fill = np.bincount(labels[inside], weights=sizes[inside]).astype(np.int64)
        bins = np.flatnonzero(fill < capacity)  # nothing fills a full container better
        inside = inside[fill[labels[inside]] < capacity]
        inside = inside[np.argsort(labels[inside], kind="stable")]
        two = np.flatnonzero(labels[inside][1:] == labels[inside][:-1])
        none, lone = np.full(len(bins), -1), np.full(len(inside), -1)
        out_a, out_b = np.concatenate((none, inside, inside[two])), np.concatenate((none, lone, inside[two + 1]))
        at = np.concatenate((bins, labels[inside], labels[inside[two]]))
        gone = np.where(out_a >= 0, sizes[out_a], 0) + np.where(out_b >= 0, sizes[out_b], 0)
        room = capacity - fill[at] + gone
        few = loose[np.argsort(sizes[loose], kind="stable")]
        i, j = _pairs(min(len(few), PAIRED))
        in_a, in_b = np.concatenate((few, few[i])), np.concatenate((np.full(len(few), -1), few[j]))
        come = sizes[in_a] + np.where(in_b >= 0, sizes[in_b], 0)
        order = np.argsort(come, kind="stable")
        best = np.searchsorted(come[order], room, "right") - 1
        better = np.flatnonzero((best >= 0) & (come[order[best]] > gone))
        pick = order[best[better]]
        rank = np.lexsort((-(come[pick] - gone[better]), room[better] - come[pick]))
        used: set[int] = set()
        for m, q in zip(better[rank].tolist(), pick[rank].tolist()):
            new = [int(x) for x in (in_a[q], in_b[q]) if x >= 0]
            if -1 - int(at[m]) in used or not used.isdisjoint(new):
                continue
            used.add(-1 - int(at[m]))  # one move a container; those have negative names
            used.update(new)
            labels[new] = at[m]
            for x in (out_a[m], out_b[m]):
                if x >= 0:
                    labels[x] = -1
        if not used:
            break
        loose = np.flatnonzero(labels < 0)
    return loose


def crossover(a: Labels, b: Labels, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Labels:
    """Whole well-filled containers of ``a`` go into ``b``; containers with duplicates are emptied, their other items exchanged and best-fitted.

    Some containers of ``b`` are emptied too, so that equal parents can still change.
    """
    fill_a, fill_b = np.bincount(a, weights=sizes), np.bincount(b, weights=sizes)
    good = np.flatnonzero(fill_a >= WELL_FILLED * capacity)
    taken = np.isin(a, good[rng.random(len(good)) < 0.2 * rng.random()])
    empty = np.zeros(len(fill_b), dtype=bool)
    empty[b[taken]] = True
    free = np.flatnonzero(~empty)
    if len(free):
        weight = capacity - fill_b[free] + 1e-3
        empty[rng.choice(free, min(len(free), EMPTIED), replace=False, p=weight / weight.sum())] = True
    child = np.where(empty[b], -1, b).astype(np.int64)
    child[taken] = len(fill_b) + a[taken]
    loose = exchange(_numbered(child), np.flatnonzero(child < 0), sizes, capacity)
    noise = 1 + 0.05 * rng.random() * rng.standard_normal(len(loose))  # a slightly different order finds other fits
    return best_fit(loose[np.argsort(-sizes[loose] * noise, kind="stable")].tolist(), sizes, capacity, _numbered(child))


def packed_in_order(sizes: np.ndarray, capacity: int) -> Labels:
    """Best fit, largest first."""
    return best_fit(np.argsort(-sizes, kind="stable").tolist(), sizes, capacity, np.full(len(sizes), -1, dtype=np.int64))


def evolve(sizes: np.ndarray, capacity: int, population: list[Labels], seed: int) -> list[Labels]:
    """The population after PATIENCE children without gain, CHILDREN at most, best first; no child is born where no packing has fewer containers."""
    rng = np.random.default_rng(seed)
    sizes = np.asarray(sizes, dtype=np.int64)
    least = fewest(sizes, capacity)
    population = [np.asarray(p, dtype=np.int64) for p in population] or [packed_in_order(sizes, capacity)]
    scored = [(fitness(p, sizes, capacity), -k, p) for k, p in enumerate(population)]
    if max(scored)[0][0] < -least:
        while len(scored) < POPULATION:
            order = np.argsort(-sizes * (1 + 0.1 * rng.standard_normal(len(sizes))), kind="stable")
            p = best_fit(order.tolist(), sizes, capacity, np.full(len(sizes), -1, dtype=np.int64))
            scored.append((fitness(p, sizes, capacity), -len(scored), p))
    scored.sort(key=lambda x: x[:2], reverse=True)
    scored, idle = scored[:POPULATION], 0
    for born in range(CHILDREN):
        if idle == PATIENCE or scored[0][0][0] >= -least:
            break
        i, j = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[i][2], scored[j][2], sizes, capacity, rng)
        best = scored[0][0]
        scored.append((fitness(child, sizes, capacity), -POPULATION - born, child))
        scored = sorted(scored, key=lambda x: x[:2], reverse=True)[:POPULATION]
        idle = 0 if scored[0][0] > best else idle + 1
    return [p for _, _, p in scored]


STATE = "container_kind string, capacity int, shard bigint, island int, ids array<bigint>, pieces array<int>, sizes array<int>, population array<array<int>>, containers int, fit double"


def _step(epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                sizes = np.asarray(r.sizes, dtype=np.int64)
                old = [np.asarray(p) for p in r.population]
                if r.guest is not None and len(r.guest):
                    old.append(np.asarray(r.guest))
                new = evolve(sizes, int(r.capacity), old, (int(r.shard) * 1_000_003 + int(r.island) * 101 + epoch) % 2**32)
                n, fit = fitness(new[0], sizes, int(r.capacity))
                row = (r.container_kind, r.capacity, r.shard, r.island, r.ids, r.pieces, r.sizes, [p.astype(np.int32) for p in new], -n, fit)
                yield pd.DataFrame([row], columns=[c.split()[0] for c in STATE.split(", ")])

    return run


def cut_and_dealt(sizes: DataFrame, key: str, kinds: DataFrame, shard_items: int) -> tuple[DataFrame, DataFrame, int]:
    """What ``pack`` puts into containers of its own, the shards of the rest, and how many those are."""
    kinds = kinds.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity")).distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    each = F.array(*[F.struct(F.lit(k.container_kind).alias("container_kind"), F.lit(k.capacity).alias("capacity")) for k in sorted(kinds)]) if kinds else F.array().cast("array<struct<container_kind:string,capacity:int>>")
    items = sizes.where("tokens is not null").select(F.col(key).cast("bigint").alias("id"), F.col("tokens").cast("bigint").alias("tokens"), F.explode(each).alias("k")).select("id", "tokens", "k.*")
    full = items.withColumn("full", F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(0))
    whole = full.where("full > 0").select("container_kind", "capacity", "id", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"), F.col("capacity").cast("bigint").alias("tokens"))
    whole = whole.select("container_kind", "capacity", F.format_string("%s-d%d-%d", "container_kind", "id", "piece").alias("container_id"), "id", "piece", "tokens")
    rest = full.withColumn("rest", F.col("tokens") - F.col("full") * F.col("capacity")).where("full = 0 or rest > 0").select("container_kind", "capacity", "id", "rest", F.col("full").cast("int").alias("piece"))
    # Dealt out in the order of size, so that every shard has the sizes of the whole.
    rows, offsets = ranked(rest, ["container_kind", "capacity"], "rest", "id")
    per = offsets.withColumn("shards", F.ceil(F.col("n") / shard_items))
    placed = rows.withColumn("part", F.shiftright("place", PART_BITS))
    placed = join_small(placed, per.drop("count"), ["container_kind", "capacity", "part"], per.count())
    placed = placed.withColumn("shard", F.pmod(F.col("place") - F.col("first") + F.col("before"), F.col("shards")))
    item = F.struct((-F.col("rest")).cast("int").alias("s"), "id", "piece")
    held = placed.groupBy("container_kind", "capacity", "shard").agg(F.sort_array(F.collect_list(item)).alias("i"))
    held = held.select("container_kind", "capacity", "shard", F.col("i.id").alias("ids"), F.col("i.piece").alias("pieces"), F.transform("i", lambda x: -x["s"]).alias("sizes"))
    shards = per.groupBy("container_kind", "capacity").agg(F.first("shards").alias("s")).agg(F.sum("s")).first()[0] or 0
    return whole, held, int(shards)


def pack(sizes: DataFrame, key: str, kinds: DataFrame, shard_items: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``container_kind, capacity_tokens, container_id, key, piece, tokens``: every item of every kind in one container.

    An item above the capacity is cut into full containers and a remainder; nothing
    else is ever split.  Remainders and all other items are dealt to shards in the order of size; in each
    shard populations of packings evolve on separate islands whose best migrate to the
    next island of the ring.  Items of size 0 find room anywhere; null sizes are left out;
    no items or no kinds give no rows.  Ids are taken as unique integers.
    """
    whole, held, shards = cut_and_dealt(sizes, key, kinds, shard_items)
    state = held.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumns({"population": F.array().cast("array<array<int>>"), "guest": F.array().cast("array<int>")})
    at = ["container_kind", "capacity", "shard"]
    tasks = max(state.sparkSession.sparkContext.defaultParallelism, -(-shards * islands // TASK_SHARDS))
    for epoch in range(epochs):
        if epoch:
            ring = Window.partitionBy(*at).orderBy("island")
            best = F.col("population")[0]
            state = state.withColumn("guest", F.coalesce(F.lag(best).over(ring), F.last(best).over(Window.partitionBy(*at))))
        state = state.repartition(tasks, *at, "island").mapInPandas(_step(epoch), STATE)
    state = materialize(state, "packed")
    first = F.row_number().over(Window.partitionBy(*at).orderBy("containers", F.desc("fit"), "island"))
    won = state.withColumn("r", first).where("r = 1").select("container_kind", "capacity", "shard", F.explode(F.arrays_zip("ids", "pieces", "sizes", F.col("population")[0].alias("bin"))).alias("x"))
    won = won.select("container_kind", "capacity", F.format_string("%s-s%d-%d", "container_kind", "shard", "x.bin").alias("container_id"), F.col("x.ids").alias("id"), F.col("x.pieces").alias("piece"), F.col("x.sizes").cast("bigint").alias("tokens"))
    return whole.unionByName(won).select("container_kind", F.col("capacity").alias("capacity_tokens"), "container_id", F.col("id").alias(key), "piece", "tokens")


def compared(sizes: DataFrame, key: str, kinds: DataFrame, shard_items: int = SHARD) -> DataFrame:
    """By kind: ``best_fit``, the containers that best fit alone takes on the same shards, and ``fewest``, which no packing of all items together can beat."""
    whole, held, _ = cut_and_dealt(sizes, key, kinds, shard_items)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = [int(packed_in_order(np.asarray(s, dtype=np.int64), int(c)).max()) + 1 for s, c in zip(f["sizes"], f["capacity"])]
            yield f[["container_kind", "capacity"]].assign(best_fit=n)

    def least(f: pd.DataFrame) -> pd.DataFrame:
        size, count = f["size"].to_numpy(np.int64), f["count"].to_numpy(np.int64)
        order = np.argsort(size)
        return pd.DataFrame([(f["container_kind"].iloc[0], f["capacity"].iloc[0], _fewest(size[order], count[order], int(f["capacity"].iloc[0])))], columns=["container_kind", "capacity", "fewest"])

    by = ["container_kind", "capacity"]
    fit = held.mapInPandas(run, "container_kind string, capacity int, best_fit bigint").groupBy(*by).agg(F.sum("best_fit").alias("best_fit"))
    # At most one row for each size up to the capacity.
    tally = held.select(*by, F.explode("sizes").alias("size")).groupBy(*by, "size").agg(F.count(F.lit(1)).alias("count"))
    bound = tally.groupBy(*by).applyInPandas(least, "container_kind string, capacity int, fewest bigint")
    full = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("full"))
    out = fit.join(bound, by).join(full, by, "left").withColumn("full", F.coalesce("full", F.lit(0)))
    return out.select("container_kind", F.col("capacity").alias("capacity_tokens"), (F.col("best_fit") + F.col("full")).alias("best_fit"), (F.col("fewest") + F.col("full")).alias("fewest"))
