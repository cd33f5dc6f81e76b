import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.functions.patterns import catalogue
from veilspan.functions.text import base_name, core_place, entity_category, title
from veilspan.operators import spans as S
from veilspan.operators import validate as V
from veilspan.operators.context import section
from veilspan.operators.learning import phrase_hits

TEXT = """Vardas: Jonas Petraitis, asmens kodas: 38901234567, gim. 1989-01-23. El. paštas: jonas.petraitis@example.lt
Tel. nr.: +370 612 34567, Mob.: +370 6 123 4567. Adresas: Paupio g. 50-136, LT-11341 Vilnius.
PVM kodas: LT123456789, sąskaita LT123456789012345678, UAB "Šiaulių Technologijos", valst. nr. ABC 123, Šiauliai.
2024 m. sausio 15 d. Ponia Žaneta Stankevičienė; kortelė 1234-5678-9012-3456; DEUTDEFF; A+ ir AB-."""


def test_spans_equal_python(spark):
    texts = [TEXT, "", "😀 jonas@example.lt 😀 2024-01-15", TEXT[::2] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.pattern, r.full_start, r.full, r.text) for r in S.find_spans(df, "doc_id", "text").collect()}
    want = set()
    for i, t in enumerate(texts):
        for name, _, p, ignore in catalogue():
            for m in re.finditer(p, t, re.IGNORECASE if ignore else 0):
                want.add((i, name, m.start(), m.group(), next((g for g in m.groups() if g), m.group())))
    assert got == want


def test_offsets_point_at_the_text(spark):
    df = spark.createDataFrame([(1, "😀" + TEXT)], "doc_id int, text string")
    for r in S.find_spans(df, "doc_id", "text").collect():
        assert ("😀" + TEXT)[r.start : r.end] == r.text


def spans_frame(spark, rows):
    return spark.createDataFrame([(1, "p", "c", 0, i, "x" * (b - a), a, "x", a, b, 50, 0.5) for i, (a, b) in enumerate(rows)], "doc int, pattern string, category string, ord int, n int, full string, full_start int, text string, start int, end int, specificity int, confidence double")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolution(spark, seed):
    rng = random.Random(seed)
    rows = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(40))]
    frame = spans_frame(spark, rows)
    kept = sorted((r.start, r.end) for r in S.dedupe_sweep(frame, "doc").collect())
    want, last = [], -1
    for a, b in sorted(rows, key=lambda s: (s[0], -s[1])):
        if a >= last:
            want.append((a, b))
            last = b
    assert kept == want
    longest = sorted((r.start, r.end) for r in S.dedupe_longest(frame, "doc").collect())
    taken = []
    for _, (a, b) in sorted(enumerate(rows), key=lambda s: (s[1][0] - s[1][1], s[0])):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
    assert sorted((b - a) for a, b in longest) == sorted((b - a) for a, b in taken)
    assert all(b <= c for (_, b), (c, _) in zip(longest, longest[1:]))
    again = spans_frame(spark, kept)
    assert sorted((r.start, r.end) for r in S.dedupe_sweep(again, "doc").collect()) == kept


def test_redaction(spark):
    df = spark.createDataFrame([("a jonas@example.lt $1 b",), (None,)], "t string")
    assert [r[0] for r in df.select(S.redact(F.col("t"), r"\S+@\S+", False, "$X\\")).collect()] == ["a $X\\ $1 b", None]
    assert df.select(S.redact_words(F.col("t"), ["a", "b"], "#")).collect()[0][0] == "# jon#s@ex#mple.lt $1 #"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aąB'ė 1-", max_size=12), min_size=1, max_size=6))
def test_title(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(title(F.col("t"))).collect()] == [t.title() for t in texts]


def test_validators(spark):
    names = {"Jonas Petraitis": True, "J": False, "Jonas 2": False, "Nr. Penki": False, "Lietuva": True, "Austria": False, "POLICY": False, "GALIOJA IKI": False, "Jonas ir Ona": True, "Jonas ir Policy": False, "BMW Jonas": False, "": False}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert {r.t: r.v for r in df.select("t", V.is_person_name(F.col("t")).alias("v")).collect()} == names
    codes = {"DEUTDEFF": True, "DEUTDEFF500": True, "DEUTDE0F": False, "DEUTDE01": True, "DEUTDE1A": False, "SUTARTIS": False, "DEUT": False, "1EUTDEFF": False}
    df = spark.createDataFrame([(k,) for k in codes], "t string")
    assert {r.t: r.v for r in df.select("t", V.is_swift(F.col("t")).alias("v")).collect()} == codes


def test_document_type(spark):
    texts = {"invoice bill receipt": "invoice", "the patient has symptoms": "medical_record", "nothing": "general_text"}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    kind, _ = V.document_type(F.col("t"))
    assert {r.t: r.k for r in df.select("t", kind.alias("k")).collect()} == texts


def test_words(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).collect()[0][0]
    assert one(base_name, "Tomui") == "Tomas" and one(base_name, "Liuciui") == "Liucius" and one(base_name, "Rutei") == "Rutė" and one(base_name, "ponas") == "ponas"
    assert one(core_place, "Vilniaus mieste") == "Vilniaus" and one(entity_category, "GPE") == "locations" and one(entity_category, "Other") == "other"
    text = "Invoice\nName: Jonas\nend"
    assert one(lambda c: section(c, F.instr(c, "Jonas") - 1), text) == "form_field"


def test_phrases(spark):
    texts = ["UAB „Ąžuolas“ (a.b) ir a.b, xa.b", "a.b", None, "a.b"]
    phrases = ["a.b", "UAB", "ąžuolas", "Ąžuolas", "missing", r"\E", None]
    corpus, wanted = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(p,) for p in phrases], "p string")
    got = {r.phrase: (r.hits, r.texts) for r in phrase_hits(corpus, "t", wanted, "p").collect()}
    assert got == {"a.b": (4, 3), "UAB": (1, 1), "Ąžuolas": (1, 1)}
