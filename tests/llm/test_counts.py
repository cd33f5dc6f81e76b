from pyspark.sql import functions as F

from veilspan.llm.lookalikes import Former, code_point_counts, consistent_forms


def test_every_text_counts(spark):
    df = spark.createDataFrame([("CEO",), ("CEO",), ("Ąa",), (None,), ("",)], "t string")
    assert code_point_counts(df, "t") == {"C": 2, "E": 2, "O": 2, "Ą": 1, "a": 1}


def test_latin_corpus_gives_latin_words(spark):
    rows = [(i, "CEO of the office") for i in range(50)] + [(98, "СЕО СЕО СЕО"), (99, "СEO")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.record_key: r.form for r in consistent_forms(df, F.col("id"), "t", Former(code_point_counts(df, "t"))).collect()}
    assert got["99"] == "CEO"


def test_last_line_end_is_read(spark):
    df = spark.createDataFrame([(1, "plain\x85"), (2, "plain\n"), (3, "plain")], "id int, t string")
    assert [r.record_key for r in consistent_forms(df, F.col("id"), "t", Former(code_point_counts(df, "t"))).collect()] == ["1"]
