from pyspark.sql import functions as F

from veilspan.operators import language as L


def test_salutations(spark):
    texts = [(1, "Gerbiamam Tomui, rašau Jums. Pagarbiai, Jonas"), (2, "Sveiki, Tomai"), (3, ""), (4, None)]
    got = {(r.id, r.base, r.category): r.confidence for r in L.salutations(spark.createDataFrame(texts, "id int, t string"), "id", "t").collect()}
    assert got[1, "Tomas", "formal_address"] == 1.0 and got[1, "Jonas", "closing_patterns"] == 0.95
    assert (2, "Tomas", "greeting_patterns") in got and all(k[0] < 3 for k in got)


def one(spark, c, *values):
    return spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values)))).select(c(*[F.col(f"v{i}") for i in range(len(values))])).collect()[0][0]


def test_effects(spark):
    assert one(spark, L.section, "privalomojo draudimo pažymėjimas") == "insurance_header"
    assert round(one(spark, L.name_effect, "Jonas Petraitis", "Ponas Jonas Petraitis gimęs"), 6) == 0.6
    assert one(spark, L.name_effect, "POLICY", "x") == -0.5
    assert one(spark, L.is_swift_lt, "HABALT22") and not one(spark, L.is_swift_lt, "DEUTDEFF")
    assert one(spark, lambda t: L.keyword_adjusted(F.lit(0.9), t), "Confirmed by") == 1.0 and one(spark, lambda t: L.keyword_adjusted(F.lit(0.9), t), "FORBIDDEN confirmed") == 0.45
    assert one(spark, L.domain, "lithuanian_personal_codes") == "personal" and one(spark, L.domain, "x") == "generic"


def test_context_decides(spark):
    for text, label, near, kept in (("Vilnius", "GPE", "path: /Vilnius", False), ("total", "PERSON", "x", False), ("Total", "PERSON", "x", True), ("Jonas", "PERSON", "Section 2", False), ("Kas", "ORG", "x", False), ("UAB", "ORG", "x", True)):
        assert one(spark, L.kept_in_context, text, label, near) is kept


def test_cities(spark):
    df = spark.createDataFrame([("VILNIUS, Vilniusx Kaunas_ Šiauliai šiauliai.",), (None,)], "t string")
    assert {r.city: r.n for r in L.city_counts(df, "t").collect()} == {"vilnius": 1, "šiauliai": 2}


def test_variants_and_exclusions(spark):
    texts = [(1, "Gerbiamam Tomui, rašau Jums. Pagarbiai, Jonas")]
    names = L.salutations(spark.createDataFrame(texts, "id int, t string"), "id", "t")
    got = {(r.text, r.tag) for r in L.redaction_variants(names, "id").collect()}
    assert {("Tomui", "SALUTATION_DETECTED_CONF_1.00"), ("Tomas", "SALUTATION_BASE_CONF_1.00"), ("Jonas", "SALUTATION_DETECTED_CONF_0.95")} <= got
    assert not any(t == "SALUTATION_BASE_CONF_0.95" for _, t in got)
    df = spark.createDataFrame([("Lietuva", "x"), ("Draudimo", "x"), ("Jonas Petraitis", "Ponas Jonas Petraitis")], "t string, c string")
    assert [round(r[0], 6) for r in df.select(L.name_effect(F.col("t"), F.col("c"))).collect()][2] == 0.4
    kept = spark.createDataFrame([("Jonas Petraitis", "names"), ("Jonas Policy", "names"), ("Jonas Policy", "other")], "t string, c string")
    assert [r[0] for r in kept.select(L.enhanced_kept(F.col("t"), F.col("c"))).collect()] == [True, False, True]


def test_pattern_sets():
    from veilspan.functions.patterns import BASE_PATTERNS, catalogue

    names = {n for n, *_ in catalogue(fallback=True)}
    assert "UNKNOWN_ID" in names and "iban_eu" not in names and len(BASE_PATTERNS) == 41
    assert not any(i for *_, i in catalogue(strict_case=True)) and sum(i for *_, i in catalogue()) == 14


def test_text_mended(spark):
    from veilspan.functions import text as T

    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).collect()[0][0]
    assert one(T.spaced, "yra  ąž") == "yra ąž" and one(T.spaced, "daž\n yti") == "daž yti"
    assert one(T.composed, "zė") == "zė" and one(T.language, "the house and the garden of") == "en" and one(T.language, "123") == "unknown" and one(T.language, None) == "unknown"


def test_marks_in_texts(spark):
    from veilspan.operators import spans as S

    text = "\ue000a jon\ue000as@example.lt\ue001 b"
    rows = S.doc_spans(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t", [("emails", "emails", r"\S+@\S+", False)])
    assert [r.text for r in rows.select(F.inline("spans")).collect()] == ["jon\ue000as@example.lt\ue001"]
    over = S.overlay(F.col("whole"), S.swept(F.col("spans")), lambda s: F.lit("#"))
    assert [r[0] for r in rows.orderBy("id").select(over).collect()] == ["\ue000a # b", None]
