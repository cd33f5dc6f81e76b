"""Queries that search every pattern in force, against Python's own matcher."""

import json
import re
from collections import Counter

import pytest
from test_spans import TEXT

from veilspan.functions.patterns import catalogue
from veilspan.plans.catalogue import QUERIES

TEXTS = {1: TEXT, 2: None, 3: TEXT[::2] * 3, 4: "Vardas: Jonas Petraitis, Confirmed +370 612 34567"}
LANGS = {1: "lt", 2: "lt", 3: "en", 4: None}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, LANGS[i]) for i, t in TEXTS.items()], "doc_id bigint, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return at


def found():
    """(doc, pattern, category, ord, n, text, start, end, whole start, whole end) by Python."""
    out = []
    for i, t in TEXTS.items():
        for k, (name, category, p, ignore) in enumerate(catalogue()):
            for n, m in enumerate(re.finditer(p, t or "", re.IGNORECASE if ignore else 0)):
                text = next((g for g in m.groups() if g), m.group())
                at = m.start() + m.group().index(text)
                out.append((i, name, category, k, n, text, at, at + len(text), m.start(), m.end()))
    return out


def swept(rows, a, b):
    out, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[a], -r[b], r[3], r[4])):
        if r[a] >= last.get(r[0], -1):
            out.append(r)
            last[r[0]] = r[b]
    return out


def test_counts(spark, root):
    rows = found()
    assert {r.category: r.matches for r in QUERIES["pii_category_counts"](spark, root).collect()} == Counter(r[2] for r in rows)
    assert {(r.lang, r.category): r.matches for r in QUERIES["pii_docs_by_lang"](spark, root).collect()} == Counter((LANGS[r[0]], r[2]) for r in rows)
    assert {r.doc_id: r.matches for r in QUERIES["pii_topk_docs"](spark, root).collect()} == {2: None, **Counter(r[0] for r in rows)}


def test_spans(spark, root):
    got = Counter(tuple(r) for r in QUERIES["pii_spans"](spark, root).collect())
    assert got == Counter((i, p, c, n, t, a, b) for i, p, c, _, n, t, a, b, _, _ in found())


def test_resolved(spark, root):
    kept = swept(found(), 6, 7)
    assert sorted((r.doc_id, r.category, r.start, r.end) for r in QUERIES["span_dedupe_sweep"](spark, root).collect()) == sorted((r[0], r[2], r[6], r[7]) for r in kept)
    whole = sorted((r.doc_id, r.full_start, r.full_end) for r in QUERIES["span_dedupe_full_match"](spark, root).collect())
    assert whole == sorted((r[0], r[8], r[9]) for r in swept(found(), 8, 9))
    report = {r.doc_id: (r.total, json.loads(r.by_category)) for r in QUERIES["redaction_report"](spark, root).collect()}
    assert report == {i: (sum(r[0] == i for r in kept), Counter(r[2] for r in kept if r[0] == i)) for i in {r[0] for r in kept}}
    want = dict(TEXTS)
    for r in sorted(kept, key=lambda r: -r[6]):
        want[r[0]] = f"{want[r[0]][: r[6]]}[{r[2].upper()}]{want[r[0]][r[7] :]}"
    assert {r.doc_id: r.redacted for r in QUERIES["redacted_overlay"](spark, root).collect()} == want


def test_longest(spark, root):
    got = [(r.doc_id, r.start, r.end) for r in QUERIES["span_dedupe_longest"](spark, root).collect()]
    rows = found()
    assert set(got) <= {(r[0], r[6], r[7]) for r in rows} and len(set(got)) == len(got)
    clash = lambda x, r: x[0] == r[0] and x[1] < r[7] and r[6] < x[2]
    assert all(any(clash(x, r) and x[2] - x[1] >= r[7] - r[6] for x in got) for r in rows)
    assert not any(a != b and a[0] == b[0] and a[1] < b[2] and b[1] < a[2] for a in got for b in got)


def test_pairs(spark, root):
    rows = found()
    want = Counter(tuple(sorted((a[2], b[2]))) for a in rows for b in rows if a[0] == b[0] and a[3] < b[3] and a[6] < b[7] and b[6] < a[7])
    assert {(r.category_a, r.category_b): r.pairs for r in QUERIES["overlapping_spans"](spark, root).collect()} == want


def test_keywords(spark, root):
    got = Counter()
    for r in QUERIES["keyword_adjusted_confidence"](spark, root).collect():
        got[r.category] += r.n
    assert got == Counter(r[2] for r in found())


def test_all_cities(spark, tmp_path):
    texts = [("Šiauliai, PANEVĖŽYS; Telšiai Telšiai xUtena Klaipėdą",), ("marijampolė_ Marijampolė",), (None,)]
    spark.createDataFrame(texts, "text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.city: r.n for r in QUERIES["city_scan"](spark, str(tmp_path)).collect()} == {"šiauliai": 1, "panevėžys": 1, "telšiai": 2, "marijampolė": 1}


def test_candidates_of_any_length(spark, tmp_path):
    long = "Labai ilgas tekstas " * 4 + "pabaiga"
    rows = [("Ona", "Ona ir Jonas", True), (long, f"čia {long}, Jonas", True), (None, "Jonas be nieko", True), ("", "Jonas", True), ("Jonas", None, True)]
    spark.createDataFrame(rows, "detection_text string, context string, is_true_positive boolean").write.parquet(f"{tmp_path}/training_examples.parquet")
    spark.createDataFrame([("Jonas, Jonas",)], "text_segment string").write.parquet(f"{tmp_path}/user_feedback.parquet")
    got = {r.phrase: (r.hits, r.texts) for r in QUERIES["learn_candidates"](spark, str(tmp_path)).collect()}
    assert got == {"Ona": (1, 1), long: (1, 1), "Jonas": (6, 5)}
    assert {r.phrase: r.positive_matches for r in QUERIES["pattern_precision"](spark, str(tmp_path)).collect()} == {"Ona": 1, long: 1, "Jonas": 6}


def test_one_hour(spark, tmp_path):
    rows = [(i, float(i * 10), "a", float(i % 7)) for i in range(800)]
    spark.createDataFrame(rows, "id bigint, ts double, event_name string, duration double").write.parquet(f"{tmp_path}/performance_metrics.parquet")
    got = {r.id: (r.n, r.high) for r in QUERIES["rolling_stats_1hour"](spark, str(tmp_path)).collect()}
    assert got == {i: (min(i + 1, 361), float(max(x % 7 for x in range(max(0, i - 360), i + 1)))) for i in range(800)}
