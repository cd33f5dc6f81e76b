import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from veilspan.operators import orderstats, spikes
from veilspan.operators.orderstats import exact_medians
from veilspan.operators.phase import opened, ordered_pass
from veilspan.operators.spikes import MEASURES, confirmed, flag_faults

SCHEMA = "id bigint, ts double, event_name string, duration double, cpu_percent double, memory_mb double, src string"


def brute(rows):
    out = set()
    for k, name in enumerate(("duration", "cpu_percent", "memory_mb")):
        ok = {"duration": lambda v: v >= 0, "cpu_percent": lambda v: 0 <= v <= 100, "memory_mb": lambda v: 0 < v <= 1e7}[name]
        for source in {r[2] for r in rows}:
            own = sorted((r[1], r[0], r[3 + k]) for r in rows if r[2] == source and r[3 + k] is not None)
            good = [v for _, _, v in own if math.isfinite(v) and ok(v)]
            med = median(good) if good else 0
            mad = median(abs(v - med) for v in good) if good else 0
            for _, i, v in own:
                if not (math.isfinite(v) and ok(v)) or (v > 4 * med or v < med / 4 if name == "duration" else abs(v - med) > 10 * mad):
                    out.add((i, name))
            start = 0
            for j in range(1, len(own) + 1):
                if j == len(own) or own[j][2] != own[start][2]:
                    if j - start >= 10:
                        out |= {(i, name) for _, i, _ in own[start:j]}
                    start = j
    return out


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", None])
        d = rng.lognormvariate(0, 0.2) * (30 if rng.random() < 0.02 else 1)
        c = rng.choice([None, rng.gauss(50, 3), rng.gauss(50, 3), 150.0 if rng.random() < 0.05 else 50.0])
        m = 100.0 if 300 < i < 340 else rng.gauss(500, 10)
        out.append((i, float(i // 3), source, float("nan") if i == 7 else float("inf") if i == 9 else d, c, -1.0 if i == 11 else m, "clash"))
    return out


@pytest.mark.parametrize("block_rows", [500_000, 37])
def test_against_brute_force(spark, block_rows):
    data = rows(900, 3)
    df = spark.createDataFrame(data, SCHEMA)
    got = confirmed(flag_faults(df, "event_name", "ts", "id", block_rows=block_rows)).collect()
    assert {(r.id, r.measure_name) for r in got} == brute(data)
    assert len(got) == len({(r.id, r.measure_name) for r in got})


@pytest.mark.parametrize("block_rows", [500_000, 1, 2, 7, 20])
def test_stuck_run_over_many_cuts(spark, block_rows):
    data = [(i, float(i), "a" if i < 720 else "b", 1.0 + (i % 7) / 10 if not 100 <= i < 700 else 1.05, None, 5.0 if i in (3, 9) or i > 790 else None, "x") for i in range(800)]
    got = confirmed(flag_faults(spark.createDataFrame(data, SCHEMA), "event_name", "ts", "id", block_rows=block_rows)).collect()
    assert {r.id for r in got if r.fault == "stuck"} == set(range(100, 700))


@pytest.mark.parametrize("block_rows", [500_000, 1, 3, 50])
def test_differences_over_cuts(spark, block_rows):
    data = rows(400, 5)
    got = {}
    for r in ordered_pass(spark.createDataFrame(data, SCHEMA), "event_name", "ts", "id", MEASURES, 10, block_rows).collect():
        _, _, _, d1, d2, _ = opened(r, MEASURES[r.m])
        got |= {(r.m, i): tuple(None if math.isnan(x) else x for x in p) for i, *p in zip(r.ids, d1.tolist(), d2.tolist())}
    assert len(got) == sum(v is not None for r in data for v in r[3:6])
    for k, m in enumerate(MEASURES):
        for source in {r[2] for r in data}:
            own = sorted((r[1], r[0], r[3 + k]) for r in data if r[2] == source and r[3 + k] is not None)
            xs = [(i, math.log(v) if m.ratio else v) for _, i, v in own if math.isfinite(v) and m.low <= v <= m.high and v > 0]
            want = {i: None for _, i, _ in own}, {i: None for _, i, _ in own}
            for j, (i, x) in enumerate(xs):
                want[0][i] = x - xs[j - 1][1] if j else None
                want[1][i] = x - 2 * xs[j - 1][1] + xs[j - 2][1] if j > 1 else None
            for at, w in enumerate(want):
                for i, x in w.items():
                    v = got[k, i][at]
                    assert (v is None) == (x is None) and (x is None or abs(v - x) < 1e-4 * max(1, abs(x))), (block_rows, m.name, i, v, x)


def test_nothing_and_nulls(spark):
    assert flag_faults(spark.createDataFrame([], SCHEMA), "event_name", "ts", "id").count() == 0
    assert flag_faults(spark.createDataFrame([(1, 1.0, None, None, None, None, "x")], SCHEMA), "event_name", "ts", "id").count() == 0


def test_ellipsoids_flag_before_the_check(spark):
    data = [(i, float(i), "a", math.exp(math.sin(i) / 10) * (50 if i == 500 else 1), None, None, "x") for i in range(1000)]
    faults = flag_faults(spark.createDataFrame(data, SCHEMA), "event_name", "ts", "id")
    assert 500 in {r.id for r in faults.collect()}
    assert {r.id for r in confirmed(faults).collect()} == {500}
    assert [m.name for m in MEASURES] == ["duration", "cpu_percent", "memory_mb"]


def slow_wave(jumps):
    """Values that swing widely but slowly, with jumps that stay well within the swing."""
    rng = random.Random(7)
    wave = [50 + 30 * math.sin(i / 200) + rng.gauss(0, 0.1) for i in range(2000)]
    return [(i, float(i), "a", None, w + (12 if i in jumps else 0), None, "x") for i, w in enumerate(wave)]


def test_differences_flag_what_values_do_not(spark, monkeypatch):
    jumps = {601, 1250}
    df = spark.createDataFrame(slow_wave(jumps), SCHEMA)
    found = {r.id for r in flag_faults(df, "event_name", "ts", "id").collect()}
    assert jumps <= found <= jumps | {i + k for i in jumps for k in (1, 2)}
    whole = spikes.ordered_pass
    flat = F.transform("d1", lambda _: F.lit(0.0).cast("float"))
    nothing = {"d1": flat, "d2": flat, "mark": F.unhex(F.regexp_replace(F.hex("mark"), "(.).", "$10"))}
    monkeypatch.setattr(spikes, "ordered_pass", lambda *a: whole(*a).withColumns(nothing))
    assert flag_faults(df, "event_name", "ts", "id").count() == 0


def test_later_passes_flag_more_and_keep_the_rest(spark):
    rng = random.Random(4)
    # Bursts of great spikes widen the first scales of the differences, so that small ones show only without them.
    data = [(i, float(i), "a", None, 50 + rng.gauss(0, 1) + (40 if i % 3 == 0 and i < 1200 else 11 if i == 1900 else 0), None, "x") for i in range(2400)]
    df = spark.createDataFrame(data, SCHEMA)
    one, all_ = ({r.id for r in flag_faults(df, "event_name", "ts", "id", iterations=n).collect()} for n in (1, 4))
    assert one < all_


@pytest.mark.parametrize("near", [100_000, 3])
@pytest.mark.parametrize("n", [1, 2, 9, 40_001])
def test_exact_medians(spark, n, near, monkeypatch):
    monkeypatch.setattr(orderstats, "NEAR", near)
    rng = random.Random(n)
    values = [round(rng.gauss(0, 1), 3) for _ in range(n)]
    narrow = [1e6 + v / 1e6 for v in values]
    df = spark.createDataFrame([(g, v) for g, vs in (("g", values), ("narrow", narrow), ("same", [7.0] * n), ("far", [-1e308, 1e308, float("inf")])) for v in vs], "g string, v double")
    out, groups = exact_medians(df, ["g"], "v")
    got = {r.g: r for r in out.collect()}
    assert groups == len(got) == 4 and got["g"].n == n and abs(got["g"].median - median(values)) < 1e-12
    assert abs(got["narrow"].median - median(narrow)) < 1e-9 and got["same"].median == 7.0 and got["far"].median == 1e308
