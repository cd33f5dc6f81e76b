"""Learned patterns in texts, against Python's own matcher."""

import json
import random
import re

from veilspan.operators.learning import Searcher, learned_spans, needed
from veilspan.plans.catalogue import QUERIES

EXPRESSIONS = [r"(?i)kodas:?\s*ABĖ/\d{2,4}", r"\bBABEKI-\d{3}\b", r"\b[A-ZĄ][a-ząė]+ BAGOSO\b", r"[0-9]{3}", r"(?:Nr\.|No\.)\s*BIR\d", r"(?i)skis\b", "(ab)+c", "(ab)?c", "x*", "(broken", "a(?=b)b", "İ", r"(?i)ıİ", "(?:ab|ac)d", "(?i:KS)z"]
PIECES = ["Kodas ABĖ/123", "KODAS:abė/12", "BABEKI-123", "xBABEKI-123", "Ona BAGOSO", "Nr. BIR7", "ſKIS", "Kodas ABĖ/99", "ababc", "c", "xx", "abd", "acd", "İ", "i̇", "ıi", "Kſz", "ksz", " ", "12", "😀"]


def test_as_python():
    rng = random.Random(4)
    searcher = Searcher(EXPRESSIONS)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        want = [(k, n, m.span()) for k, x in enumerate(EXPRESSIONS) if x != "(broken" for n, m in enumerate(re.finditer(x, text)) if m.group()]
        assert [(k, n, m.span()) for k, n, m in searcher.found(text)] == want


def test_needed():
    assert [needed(x) for x in (r"\bBABEKI-\d{3}\b", "(ab)?c", "(?:foo|bar)", "a(bc)d")] == ["BABEKI-", "c", "", "abcd"]


PATTERNS = "pattern_id string, regex string, pii_category string, confidence double, is_active boolean"


def test_blocks(spark, monkeypatch):
    from veilspan.operators import learning

    monkeypatch.setattr(learning, "BLOCK", 4)
    docs = spark.createDataFrame([(1, "😀Nr. BIR7 ir BABEKI-123"), (2, None), (3, "")], "doc int, t string")
    rows = [(f"p{k}", x, "c", k / 100, x != "[0-9]{3}") for k, x in enumerate(EXPRESSIONS)]
    got = {(r.doc, r.pattern, r.text, r.start, r.end, r.confidence) for r in learned_spans(docs, "doc", "t", spark.createDataFrame(rows, PATTERNS)).collect()}
    assert got == {(1, "p4", "Nr. BIR7", 1, 9, 0.04), (1, "p1", "BABEKI-123", 13, 23, 0.01)}


def test_final_detections(spark, tmp_path):
    text = "zzz BABEKI-123, jonas@example.lt, numeris"
    spark.createDataFrame([(7, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [("a", r"\bBABEKI-\d{3}\b", "cards", 0.55, True), ("b", "zzz", "other", 0.9, False), ("c", "jonas", "names", 0.99, True), ("d", "(", "x", 0.9, True)]
    spark.createDataFrame(rows, PATTERNS).write.parquet(f"{tmp_path}/adaptive_patterns.parquet")
    (r,) = QUERIES["final_detections"](spark, str(tmp_path)).collect()
    got = json.loads(r.detections)
    assert got["cards"] == [{"text": "BABEKI-123", "tag": "CONTEXT_0.55"}] and got["emails"][0]["text"] == "jonas@example.lt" and "other" not in got and "names" not in got


def test_one_round_of_learning(spark):
    from veilspan.operators.learning import learn_cycle

    feedback = [(1, "Ona B.", "false_negative", "dates", None), (2, "Ona B.", "confirmed_pii", "names", "names"), (3, "Petras", "false_positive", "names", None), (4, "absent", "confirmed_pii", "names", None), (5, None, "confirmed_pii", "names", None), (6, "Kaunas", "category_correction", "names", "locations")]
    df = spark.createDataFrame(feedback, "id int, text_segment string, feedback_type string, detected_category string, user_corrected_category string")
    corpus = spark.createDataFrame([("Ona B. ir Petras, Kaunas",), (None,)], "t string")
    old = spark.createDataFrame([("old", r"\bKaunas\b", "x", 0.5, 3), ("keep", "k", "x", 0.9, 1)], "pattern_id string, regex string, pii_category string, confidence double, version_no int")
    got = {r.regex: (r.pii_category, r.confidence, r.version_no) for r in learn_cycle(df, corpus, "t", old).collect()}
    assert got == {r"\bOna B\.\b": ("dates", 1.0, 1), r"\bKaunas\b": ("locations", 1.0, 4), "k": ("x", 0.9, 1)}
    assert next(r.pattern_id for r in learn_cycle(df, corpus, "t", old).collect() if "Kaunas" in r.regex) == "old"


def test_all_features(spark, data):
    from veilspan.plans.texts import features_all

    row = features_all(spark, data).collect()[0].asDict()
    assert len(row) == 106 and row["text_length"] > 0 and row["noun_ratio"] == 0
