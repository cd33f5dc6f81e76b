"""Training-data queries: against SQL where there is some, and for their own guarantees."""

from collections import Counter

import pytest
from compare import same

import __spark_entry__
from veilspan.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, spark, duck, data):
    same(QUERIES[name](spark, data), duck.execute(ORACLE[name]))


def test_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and {f"p{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k[0] == "p" and k[1:2].isdigit()}
    first = {n.split("_")[0]: n for n in reversed(list(names))}
    assert first["p2"] == "p2_day_knots"


def test_sample_meets_what_it_reports(spark, data):
    sample, report = QUERIES["p5_sample"](spark, data).collect(), QUERIES["p5_target_report"](spark, data).collect()
    assert len({r.id for r in sample}) == len(sample)
    for field in ("category", "is_true_positive", "data_source"):
        counts = Counter(r[field] for r in sample)
        for r in (r for r in report if r.field_name == field):
            assert counts[r.field_class] == r.taken and abs(r.actual_share - r.taken / len(sample)) < 1e-9
            assert r.met == (r.taken >= r.min_rows and abs(r.actual_share - r.target_share) <= 0.005) and (r.met or r.reason)


def test_mixture_and_its_shares(spark, data):
    rows, shares = QUERIES["p9_mixture"](spark, data).collect(), {r.source: r for r in QUERIES["p9_shares"](spark, data).collect()}
    assert len(shares) == 8 and shares["fax_gateway"].tokens_used == 0
    used = Counter(r.doc_id for r in rows)
    source = {r.doc_id: r.source for r in rows}
    assert all(n <= shares[source[d]].max_repeats for d, n in used.items())
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.tokens
    assert all(tokens[s] == r.tokens_used for s, r in shares.items())


def test_packing_holds_everything_once(spark, data):
    rows = QUERIES["p8_packing"](spark, data).collect()
    sizes = {r.doc_id: r.tokens for r in __import__("veilspan.llm.tokens", fromlist=["x"]).token_sizes(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text").collect()}
    for kind in {r.container_kind for r in rows}:
        own = [r for r in rows if r.container_kind == kind]
        per_doc, per_bin = Counter(), Counter()
        for r in own:
            per_doc[r.doc_id] += r.tokens
            per_bin[r.container_id] += r.tokens
        assert per_doc == Counter(sizes)
        cap = own[0].capacity_tokens
        assert max(per_bin.values()) <= cap
        pieces = Counter(r.doc_id for r in own)
        assert all(n == 1 for d, n in pieces.items() if sizes[d] <= cap)
        assert sum(per_bin.values()) / (cap * len(per_bin)) > 0.93


def test_combined_percentiles_keep_their_bound(spark, data):
    import bisect

    rows = [(r.event_name, r.duration) for r in spark.read.parquet(f"{data}/performance_metrics.parquet").select("event_name", "duration").collect() if r.duration is not None and abs(r.duration) < float("inf")]
    for r in QUERIES["p2_combined_percentiles"](spark, data).where("measure_name = 'duration'").collect():
        values = sorted(v for e, v in rows if e == r.source)
        want = int((len(values) - 1) * r.p)
        low, high = bisect.bisect_left(values, r.value), bisect.bisect_right(values, r.value) - 1
        assert r.n == len(values) and max(0, low - want, want - high) <= r.rank_error * len(values)


def test_masked_text_keeps_the_rest(spark, data):
    import json

    rows = QUERIES["p7_masked"](spark, data).collect()
    found = {(r.record_table, r.record_id, r.field_name, r.pii_type) for r in QUERIES["p7_found"](spark, data).collect()}
    assert found == {(r.record_table, r.record_id, r.field_name, k) for r in rows for k in r.pii_types}
    for r in rows:
        assert all(f"[{k.upper()}]" in r.masked for k in r.pii_types)
        if r.record_table == "user_feedback" and r.field_name == "context" and r.masked.startswith("{"):
            json.loads(r.masked)
