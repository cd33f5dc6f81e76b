from pyspark.sql import functions as F

from veilspan.operators.quality import bucket, keep_best, t_tests
from veilspan.sources import stores


def test_append_and_upsert(spark, tmp_path):
    path = str(tmp_path / "e")
    df = spark.createDataFrame([(1, 1514788186.0), (2, 1517270349.0), (2, 1517270349.0)], "id bigint, ts double")
    stores.append_events(df, path)
    assert {r.month for r in spark.read.parquet(path).collect()} == {"2018-01"}
    stores.append_unique(df, str(tmp_path / "u"), "id")
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2
    new = spark.createDataFrame([(2, 9.0), (3, 1.0)], "id bigint, ts double")
    assert {(r.id, r.ts) for r in stores.upsert(df, new, "id", "ts").collect()} == {(1, 1514788186.0), (2, 1517270349.0), (3, 1.0)}


def test_keep_best(spark):
    schema = "pattern_id string, regex string, confidence double, version_no int"
    old = spark.createDataFrame([("p1", "a", 0.5, 1), ("p2", "b", 0.9, 3), ("p3", "c", 0.5, 1)], schema)
    new = spark.createDataFrame([("n1", "a", 0.6, 1), ("n2", "b", 0.9, 1), ("n4", "d", 0.1, 1)], schema)
    got = {r.regex: (r.pattern_id, r.confidence, r.version_no) for r in keep_best(old, new, "regex", "confidence").collect()}
    assert got == {"a": ("p1", 0.6, 2), "b": ("p2", 0.9, 3), "c": ("p3", 0.5, 1), "d": ("n4", 0.1, 1)}


def test_bucket(spark):
    import hashlib

    keys = ["a", "doc-1", "", "ąž"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(bucket(F.col("k"))).collect()] == [int(hashlib.md5(k.encode()).hexdigest(), 16) % 1_000_000 for k in keys]


def test_t_of_constant_groups_is_undefined(spark):
    rows = [("t", g, "m", v) for g, v in (("control", 1.0), ("control", 1.0), ("variant", 2.0), ("variant", 2.0))]
    r = t_tests(spark.createDataFrame(rows, "test_id string, group_name string, metric_name string, metric_value double")).collect()[0]
    assert r.t is None and r.leader == "variant"


def test_settings_and_files(spark, tmp_path):
    p = tmp_path / "p.yaml"
    p.write_text("pii_patterns:\n  good: '\\d+'\n  bad: '('\n  deep: {regex: 'x'}\n", encoding="utf-8")
    assert {r.name for r in stores.pattern_table(spark, str(p)).collect()} == {"good", "deep"}
    (tmp_path / "a.pdf").write_bytes(b"x")
    assert stores.raw_files(spark, str(tmp_path)).count() == 1


def test_settings(spark, tmp_path):
    from veilspan.sources import stores as S

    p = tmp_path / "x.yaml"
    p.write_text("metadata:\n  d: Nothing\ncars:\n  makers: [Bmw, Audi]\n  more: {x: [Bmw, ' Vw ']}\n")
    assert [r.brand for r in S.brand_table(spark, str(p)).collect()] == ["Audi", "Bmw", "Vw"]
    p.write_text("document_types:\n  - doc_type: invoice\n    keywords: [bill]\n    rules:\n      - {action: REDACT, target_category: IBAN, confidence_threshold: 0.7}\n  - doc_type: letter\n")
    rules = S.rule_table(spark, str(p))
    assert [tuple(r) for r in rules.orderBy("doc_type").collect()] == [("invoice", ["bill"], "REDACT", "IBAN", 0.7), ("letter", [], None, None, None)]
    spans = spark.createDataFrame([("invoice", "iban", 0.8), ("invoice", "iban", 0.6), ("letter", "iban", 0.9)], "doc_type string, category string, confidence double")
    assert [r.action for r in S.applied_rules(spans, rules).orderBy("doc_type", "confidence").collect()] == [None, "REDACT", None]
    p.write_text("cities: [Vilnius]\n")
    assert [r.value for r in S.list_table(spark, str(p), "cities").collect()] == ["Vilnius"]
    assert [r.value for r in S.list_table(spark, str(tmp_path / "none"), "cities", ("Kaunas",)).collect()] == ["Kaunas"]
    assert S.rule_table(spark, str(tmp_path / "none")).count() == 0
    assert S.config_faults({"a": "(", "b": "x"}, {"t": 2, "u": 0.5}, "x.sqlite")[0].startswith("pattern a") and len(S.config_faults({"a": "("}, {"t": 2}, "x.sqlite")) == 3
    kept = S.save_config(str(p), {"cities": ["Šiauliai"]}, "20250101")
    assert open(kept, encoding="utf-8").read() == "cities: [Vilnius]\n" and [r.value for r in S.list_table(spark, str(p), "cities").collect()] == ["Šiauliai"]


def test_scan_and_updates(spark):
    from veilspan.sources import stores as S

    df = spark.createDataFrame([(1, 5, "a"), (2, 7, "a"), (3, None, "b")], "id int, at int, k string")
    assert [r.id for r in S.scan(df, "at", k="a").collect()] == [2, 1] and [r.id for r in S.scan(df, "at", 1).collect()] == [2] and S.scan(df, "at", k=None).count() == 3


def test_decisions(spark):
    from pyspark.sql import functions as F

    from veilspan.operators import decide as D

    # Student's t: tabulated two-sided points of 5 and 1 percent.
    known = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.98, 120, 0.05), (1.95996, 10_000_000, 0.05), (0.0, 7, 1.0), (60.0, 5, 0.0), (None, 5, None), (1.0, 0, None)]
    df = spark.createDataFrame([(t, float(f), p) for t, f, p in known], "t double, f double, p double")
    for r in df.select("p", D.p_value(F.col("t"), F.col("f")).alias("q")).collect():
        assert (r.p is None) == (r.q is None) and (r.p is None or abs(r.p - r.q) < 1e-4), r
    tests = spark.createDataFrame([("a", True), ("b", True)], "test_id string, is_active boolean").withColumns({"created_at": F.lit(0), "deleted_at": F.lit(None).cast("int")})
    assert {r.test_id: (r.is_active, r.deleted_at) for r in D.concluded(tests, "a", F.lit(9)).collect()} == {"a": (False, 9), "b": (True, None)}
    assert {r.test_id: r.created_at for r in D.started(tests, "b", F.lit(3)).collect()} == {"a": 0, "b": 3}
    import pytest

    with pytest.raises(ValueError):
        D.created_test({"a": 0.5, "b": 0.4})


def test_model_store(spark, tmp_path):
    from veilspan.operators import model as M

    rows = spark.createDataFrame([(i, float(i % 2), float(i % 2) + 0.1 * (i % 7)) for i in range(300)], "id long, label double, x double")
    assert M.latest(spark, str(tmp_path / "none")) is None
    parts = M.train(rows, ["x"], "label", rounds=2, depth=2)
    M.save(*parts, str(tmp_path), "20250101_000000")
    M.save(*parts, str(tmp_path), "20250102_000000")
    assert M.versions(spark, str(tmp_path)) == ["20250102_000000", "20250101_000000"]
    one, two = (M.score(rows, *p).select("id", "confidence").collect() for p in (parts, M.latest(spark, str(tmp_path))))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and M.area(M.score(rows, *parts), "label") > 0.9
