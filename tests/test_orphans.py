import random

from pyspark.sql import functions as F

import veilspan.operators.skew as skew
from veilspan.operators.orphans import find_orphans, integer_key, key_runs, utc_micros

KIDS, FOLKS = "id bigint, ref string, at bigint, shape string", "key string, born bigint, died bigint"


def brute(kids, folks):
    alive = {k: (b, d) for k, b, d in folks}
    out = {}
    for i, ref, at, _ in kids:
        if ref is None:
            continue
        if ref not in alive:
            out[i] = "absent"
            continue
        b, d = alive[ref]
        if b is not None and at is not None and b > at:
            out[i] = "younger"
        elif d is not None and at is not None and d <= at:
            out[i] = "deleted"
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 20)
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.02, 20))
    rng = random.Random(5)
    name = lambda k: rng.choice([f"doc-{k:08x}", f"doc-{k:08x}-nightly", f"T{k}", f"word{'x' * (k % 5)}"])
    folks = {}
    for k in [*range(100, 400), *range(1000, 4000, 7)]:
        folks[name(k)] = (rng.choice([None, rng.randrange(50)]), rng.choice([None, None, rng.randrange(40, 100)]))
    folks = [(k, *v) for k, v in folks.items()]
    keys = [k for k, _, _ in folks]
    kids = [(i, rng.choice([None, "doc-00000064", "DOC-00000064", "doc-64", "", name(rng.randrange(5000)), rng.choice(keys), keys[0], keys[0]]), rng.choice([None, rng.randrange(100)]), "s") for i in range(3000)]
    kids += [(i + 5000, r, a, s) for i, r, a, s in kids[:50]]
    got = find_orphans(spark.createDataFrame(kids, KIDS).drop("shape"), "ref", "at", spark.createDataFrame(folks, FOLKS), "key", "born", "died").collect()
    assert {r.id: r.reason for r in got} == brute(kids, folks)
    assert len(got) == len(brute(kids, folks))


def test_no_parents_and_no_children(spark):
    kids = spark.createDataFrame([(1, "a", 1, "s"), (2, None, 1, "s")], KIDS)
    none = spark.createDataFrame([], FOLKS)
    assert [(r.id, r.reason) for r in find_orphans(kids, "ref", "at", none, "key", "born", "died").collect()] == [(1, "absent")]
    assert find_orphans(kids.limit(0), "ref", "at", none, "key", "born", "died").count() == 0


def test_runs_are_contiguous(spark):
    folks = spark.createDataFrame([(f"doc-{k:08x}", 0, None) for k in [1, 2, 3, 7, 255, 256]], FOLKS)
    runs = key_runs(folks, "key", "born", "died").select(F.explode("runs").alias("r")).select("r.start", "r.end").collect()
    assert sorted((r.start, r.end) for r in runs) == [(1, 3), (7, 7), (255, 255), (256, 256)]


def test_keys_are_one_to_one(spark):
    keys = ["doc-0000000a", "doc-a", "doc-0000000A", "7", "07", "a7", "x", "", "doc-0000000a-b", "doc-0000000ab"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    shape, number = integer_key(F.col("key"))
    assert df.select(shape.alias("s"), number.alias("n")).distinct().count() == len(keys)


def test_times(spark):
    df = spark.createDataFrame([("2018-01-03T15:39:11.719",), ("2018-01-03 15:39:11.719",), ("2018-01-03T15:39:11.719Z",), ("2018-01-03T17:39:11.719+02:00",), ("never",)], "t string")
    got = [r[0] for r in df.select(utc_micros(F.col("t"))).collect()]
    assert got[4] is None and len(set(got[:4])) == 1 and got[0] == 1514993951719000
