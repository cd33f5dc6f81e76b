import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import packing as P
from veilspan.llm.percentiles import PART_BITS, percentiles, ranked


def test_evolves_until_no_gain(monkeypatch):
    born = []
    cross = P.crossover
    monkeypatch.setattr(P, "crossover", lambda a, b, s, c, r: born.append(P.fitness(x := cross(a, b, s, c, r), s, c)) or x)
    rng = np.random.default_rng(3)
    sizes = rng.integers(100, 300, 200)
    population = [P.best_fit(rng.permutation(200).tolist(), sizes, 512, np.full(200, -1)) for _ in range(4)]
    start = max(P.fitness(p, sizes, 512) for p in population)
    best, *_ = P.evolve(sizes, 512, population, 1)
    assert born and P.fitness(best, sizes, 512) >= max(start, *born)
    assert len(born) == P.CHILDREN or P.fitness(best, sizes, 512)[0] == -P.fewest(sizes, 512) or all(f <= P.fitness(best, sizes, 512) for f in born[-P.PATIENCE :])
    assert best.min() == 0 and len(np.unique(best)) == best.max() + 1 and np.bincount(best, weights=sizes).max() <= 512


@pytest.mark.parametrize("seed", range(6))
def test_children_beat_a_bad_start(seed):
    """From packings in random order the genetic part gets at least as far as best fit, largest first."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(60, 300, 120)
    start = [P.best_fit(rng.permutation(120).tolist(), sizes, 512, np.full(120, -1)) for _ in range(4)]
    best, *_ = P.evolve(sizes, 512, start, seed)
    assert P.fitness(best, sizes, 512) > max(P.fitness(p, sizes, 512) for p in start)
    assert P.fitness(best, sizes, 512)[0] >= P.fitness(P.packed_in_order(sizes, 512), sizes, 512)[0]


@pytest.mark.parametrize("seed", range(8))
def test_fewest_is_no_more_than_the_optimum(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 11, 7)
    least = min(max(x) + 1 for x in itertools.product(range(7), repeat=7) if len(set(x)) == max(x) + 1 and np.bincount(x, weights=sizes).max() <= 10)
    assert -(-sizes.sum() // 10) <= P.fewest(sizes, 10) <= least


def test_shards_have_the_sizes_of_the_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(t)) for i, t in enumerate(rng.integers(1, 600, 900))]
    kinds = spark.createDataFrame([("s", 512)], "container_kind string, capacity_tokens int")
    df = spark.createDataFrame(rows, "id long, tokens long")
    _, held, shards = P.cut_and_dealt(df, "id", kinds, 100)
    sums = [sum(r.sizes) for r in held.collect()]
    assert shards == len(sums) == 9 and max(sums) - min(sums) <= 512
    got = P.compared(df, "id", kinds, 100).collect()[0]
    used = P.pack(df, "id", kinds, 100).select("container_id").distinct().count()
    assert got.fewest <= used <= got.best_fit


def test_equal_values_are_dealt_out(spark):
    rows = [("g", 1.0)] * 8000 + [("g", float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed, _ = ranked(df, ["g"], "v")
        sizes = [r["count"] for r in placed.groupBy(F.shiftright("place", PART_BITS).alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 5000
    assert {r.p: r.value for r in percentiles(df, ["g"], "v", [0.0, 0.5, 1.0]).collect()} == {0.0: 0.0, 0.5: 1.0, 1.0: 1999.0}
