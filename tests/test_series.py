import random
from statistics import mean, stdev

import pytest

from veilspan.operators import series as M
from veilspan.streaming import monitor

SCHEMA = "metric string, ts double, id bigint, value double"


def points(n):
    rng = random.Random(2)
    return [("a" if i % 4 else "b", float(i * 7 % 5 + i), i, rng.gauss(10, 1) * (4 if i % 97 == 0 else 1)) for i in range(n)]


@pytest.mark.parametrize("chunk_rows", [200_000, 300])
def test_anomalies_at_any_chunk(spark, chunk_rows, monkeypatch):
    monkeypatch.setattr(M.chunked, "__defaults__", (0, 0.0, chunk_rows))
    rows = points(2500)
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for name in "ab":
        past = []
        for _, _, i, v in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2])):
            h = past[-100:]
            if len(h) >= 10 and abs((v - mean(h)) / stdev(h)) > 2.5:
                want.add(i)
            past.append(v)
    assert {r.id for r in M.zscores(df).collect()} == want
    rolled = {r.id: r.n for r in M.rolling(df, 60, 60).collect()}
    assert len(rolled) == len(rows) and max(rolled.values()) <= 60


def test_stream_anomalies_equal_batch(spark, data):
    stream = monitor.anomalies(monitor.metric_stream(monitor.stream_table(spark, data, "performance_metrics")))
    got = {r.id for r in monitor.run_available(stream, mode="append").collect()}
    rows = spark.read.parquet(f"{data}/performance_metrics.parquet").where("abs(duration) < double('infinity') and event_name is not null")
    batch = M.zscores(rows.selectExpr("event_name metric", "ts", "id", "duration value"))
    assert got == {r.id for r in batch.collect()}


def test_sessions(spark, data):
    stream = monitor.sessions(monitor.metric_stream(monitor.stream_table(spark, data, "performance_metrics")))
    closed = monitor.run_available(stream, mode="append").collect()
    assert len({(r.metric, r.begin) for r in closed}) == len(closed) and all(r.begin < r.finish for r in closed)


def test_late_rows_in_later_batches(spark, tmp_path):
    import time

    at = str(tmp_path / "performance_metrics.parquet")
    batches = [[(1, 0.0), (2, 30.0)], [(3, 7200.0)], [(5, 7230.0)], [(4, 40.0), (6, 14400.0)]]
    for rows in batches:  # row 4 comes far more than the lateness behind; a batch counts as late what was so a batch before
        spark.createDataFrame([(i, ts, "a", 1.0) for i, ts in rows], "id bigint, ts double, event_name string, duration double").coalesce(1).write.mode("append").parquet(at)
        time.sleep(1.1)
    stream = monitor.metric_stream(monitor.stream_table(spark, str(tmp_path), "performance_metrics", files=1))
    got = {r.begin.timestamp() % 86400: r.n for r in monitor.run_available(monitor.rolling_stats(stream, "1 minute", "1 minute"), ["metric", "begin", "finish"]).collect()}
    assert got == {0.0: 2, 7200.0: 2, 14400.0: 1}


def test_alerts_go_to_the_sink(spark, data):
    limits = spark.createDataFrame([("cache_lookup", 0.002, 0.0022)], "metric string, min_value double, max_value double")
    found = []
    stream = monitor.metric_stream(monitor.stream_table(spark, data, "performance_metrics"))
    monitor.alert_sink(stream, limits, lambda rows, number: found.extend(r.id for r in rows.collect()), once=True).awaitTermination()
    rows = spark.read.parquet(f"{data}/performance_metrics.parquet").where("event_name = 'cache_lookup' and abs(duration) < double('infinity') and (duration < 0.002 or duration > 0.0022)")
    assert sorted(found) == sorted(r.id for r in rows.collect()) and found


@pytest.mark.parametrize(("seconds", "most"), [(60, 7), (5, 300), (10_000, 64), (0, 1)])
def test_rolling_against_brute_force(spark, seconds, most):
    rows = points(700)
    got = {r.id: r for r in M.rolling(spark.createDataFrame(rows, SCHEMA), seconds, most).collect()}
    assert len(got) == len(rows)
    for name in "ab":
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == name)
        for k, (t, i, v) in enumerate(own):
            frame = [x for u, _, x in own[max(0, k - most + 1) : k + 1] if u >= t - seconds]
            r = got[i]
            assert (r.n, r.low, r.high, r["last"]) == (len(frame), min(frame), max(frame), v) and abs(r["mean"] - mean(frame)) < 1e-12
            assert abs(r["std"] - (stdev(frame) if len(frame) > 1 else 0.0)) < 1e-9


@pytest.mark.parametrize("chunk_rows", [200_000, 1000, 13])
def test_alerts_need_samples_of_the_whole_series(spark, chunk_rows, monkeypatch):
    monkeypatch.setattr(M.chunked, "__defaults__", (0, 0.0, chunk_rows))
    rows = [("a", float(i // 2), i, 5.0) for i in range(3000)] + [("b", float(i), 10_000 + i, 5.0) for i in range(40)]
    limits = spark.createDataFrame([("a", 1.0, 4.0, 0.5, 500), ("b", 1.0, 4.0, 0.5, 30)], "metric string, min_value double, max_value double, change_threshold double, sample_size int")
    got = [r.id for r in M.threshold_alerts(spark.createDataFrame(rows, SCHEMA), limits).collect()]
    assert sorted(got) == [*range(499, 3000), *range(10_029, 10_040)]


def test_any_number_of_cuts(spark):
    rows = [("a", float(i), i, 1.0) for i in range(2000)] + [("b", 0.0, 5000, 1.0)]
    placed = M.chunked(spark.createDataFrame(rows, SCHEMA), chunk_rows=5).collect()
    assert max(r.chunk for r in placed) > 300 and len(placed) == 2001
    order = [r.chunk for r in sorted(placed, key=lambda r: r.id) if r.metric == "a"]
    assert order == sorted(order) and max(order.count(c) for c in set(order)) < 30
