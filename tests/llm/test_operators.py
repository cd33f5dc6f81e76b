import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.llm import spans as S
from veilspan.llm.forms import group_copies, multiset_hash
from veilspan.llm.lookalikes import Former, code_point_counts, consistent_forms, mixed
from veilspan.llm.masking import find_personal
from veilspan.llm.mixing import expected_copies, mix
from veilspan.llm.packing import best_fit, crossover, evolve, pack
from veilspan.llm.percentiles import combine_days, day_summaries, percentiles
from veilspan.llm.sampling import draw_sample, swap_repair
from veilspan.llm.tagger import TYPES, load, loss_and_gradients, new_weights, spans, tag
from veilspan.llm.tokens import token_sizes

# ---- shared spans


def shares(a, b, n):
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[j : j + n] in grams for j in range(len(b) - n + 1))


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeąžё漢😀") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randint(20, 90)) for _ in range(8)]
    docs = []
    for _ in range(n):
        parts = [text(rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 150))
            parts.insert(1, p[a : a + rng.choice([150, 190, 199, 200, 201, 260, 400])])
        docs.append("".join(parts))
    return docs + docs[:4] + ["", "x" * 500, "y" * 300 + "x" * 250, "ab" * 300, "ba" * 120, None]


@pytest.mark.parametrize(("seed", "hot"), [(1, 200), (2, 3)])
def test_every_pair_is_found(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(S, "HOT_DOCS", hot)
    monkeypatch.setattr(S, "HOT_FLOOR", 50_000 if hot > 3 else 5)
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, doc string")
    got = [tuple(r) for r in S.expand(*S.linked(df, "doc_id", "text")).collect()]
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if docs[i] and docs[j] and shares(docs[i], docs[j], 200)}
    assert len(got) == len(set(got)) and set(got) == want
    share = {r.doc: r for r in S.shared_share(df, "doc_id", "text").collect()}
    assert len(share) == len(docs)
    for i, t in enumerate(docs):
        marks = np.zeros(len(t or ""), bool)
        for j, u in enumerate(docs):
            if i != j and t and u:
                grams = {u[k : k + 200] for k in range(len(u) - 199)}
                for k in range(len(t) - 199):
                    if t[k : k + 200] in grams:
                        marks[k : k + 200] = True
        assert share[i].shared_chars == marks.sum()


def test_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 300)
    monkeypatch.setattr(S, "HOT_DOCS", 4)
    docs = [d for d in corpus(3, 30) if d]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {tuple(r) for r in S.expand(*S.linked(df, "doc_id", "text")).collect()}
    assert got == {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if shares(docs[i], docs[j], 200)}


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.expand(*S.linked(df, "doc_id", "text")).count() == 0 and S.shared_share(df, "doc_id", "text").count() == 0


def test_gear_rolls():
    codes = S.code_points("abcąž😀" * 40)
    whole = S.gear(codes)
    with np.errstate(over="ignore"):
        for i in range(len(codes)):
            h = np.uint64(0)
            for c in codes[max(0, i - S.GEAR + 1) : i + 1]:
                h = (h << np.uint64(1)) + S.gear(np.array([c]))[0]
            assert h == whole[i]


@pytest.mark.parametrize("seed", range(5))
def test_any_span_holds_a_whole_chunk(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(60):
        shared, lengths = word(200), set()
        texts = [word(rng.randrange(300)) + shared + word(rng.randrange(300)) for _ in range(2)]
        some = []
        for t in texts:
            codes = S.code_points(t)
            start, stop = S.chunks(codes, np.arange(len(codes)), np.full(len(codes), len(codes)), 200)
            at = t.index(shared)
            some.append({t[a:b] for a, b in zip(start, stop) if at <= a and b <= at + 200})
            lengths |= set((stop - start).tolist())
        assert some[0] & some[1] and min(lengths) >= S.GEAR + S.least_chunk(200)
    assert len(lengths) > 1


def test_extended_to_both_sides():
    a, b = S.code_points("xxabcdefyy"), S.code_points("abcdefz")
    assert S.met_span(a, b, 4, 2) == 6 and S.met_span(a, b, 2, 0) == 6 and S.met_span(a, b, 0, 0) == 0


# ---- hidden duplicates


def test_copies(spark):
    rows = [
        (1, "Jonas  Petraitis", "names"), (2, "JONAS-PETRAITIS.", " Names"), (3, "Jonas Petraitis", "emails"), (4, "vardas: A; tel: +1", "c"), (5, "TEL = +1 | Vardas:  a", "C"), (6, "vardas: A; tel: 1", "c"),
        (7, "", "n"), (8, " .", "N"), (9, None, "n"), (10, "ė", "n"), (11, "e", "n"), (12, "vardas: A; vardas: A; tel: +1", "c"), (13, "Jonas Petraitis", None), (14, "jonas petraitis", None), (15, "tel: +1\nvardas: A", "c"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, t string, c string, copies int")
    got = {(r.first_id, r.id, r.copies) for r in group_copies(df, "x", "id", "t", F.lower(F.trim("c"))).collect()}
    assert got == {(1, 1, 2), (1, 2, 2), (4, 4, 3), (4, 5, 3), (4, 15, 3), (7, 7, 2), (7, 8, 2), (13, 13, 2), (13, 14, 2)}
    assert group_copies(df.limit(0), "x", "id", "t", F.col("c")).count() == 0


def test_hot_group_of_copies(spark, monkeypatch):
    from veilspan.operators import skew

    monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.01, 10))
    rows = [(i, "Same  text" if i % 3 else f"text {i % 50}", "c") for i in range(600)]
    got = group_copies(spark.createDataFrame(rows, "id long, t string, c string"), "x", "id", "t", F.col("c")).collect()
    assert sum(r.id == r.first_id for r in got) == 51 and max(r.copies for r in got) == 400 and len(got) == 600


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=3), max_size=6))
def test_order_does_not_change_the_hash(spark, items):
    df = spark.createDataFrame([(items, sorted(items), [*items, "z"])], "a array<string>, b array<string>, c array<string>")
    a, b, c = df.select(*[multiset_hash(F.col(x), 1) for x in "abc"]).collect()[0]
    assert a == b and a != c


# ---- look-alikes


@pytest.mark.parametrize(
    ("odd", "plain"),
    [("ＡＢ１＠", "AB1@"), ("Vіliuѕ", "Vilius"), ("ė", "ė"), ("a​b­c", "abc"), ("a b c", "a b c"), ("ﬁlm", "film"), ("K", "K"), ("1‑2", "1-2"), ("Ρeter", "Peter"), ("ｚ̌", "ž"), ("‮abc", "abc")],
)
def test_forms(odd, plain):
    assert Former.everyday().form(odd) == plain


@pytest.mark.parametrize("text", ["", "Привет, мир", "Ελλάδα", "café „x“ “y” ’", "[А-ЯЁ][а-яё]+ KOD", r"\bДом\b", "漢字かな", "عربى", "नमस‍ते", "abc\tdef\n", "H₂O m² …"])
def test_genuine_text_is_left(text):
    former = Former.everyday()
    assert former.form(text) == text and not mixed(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_form_is_stable(text):
    former = FORMER
    assert former.form(former.form(text)) == former.form(text)


FORMER = Former.everyday()


def test_found_records(spark):
    rows = [(1, "plain"), (2, "Vіlnius"), (3, None), (4, ""), (5, "Vіlnius"), (6, "х" * 5), (7, "ok ąž"), (8, "Яz"), (9, "Яa")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, t string, form string")
    got = {r.record_key: r.form for r in consistent_forms(df, F.col("id"), "t", Former(code_point_counts(df, "t"))).collect()}
    assert got == {"2": "Vilnius", "5": "Vilnius", "8": "Яz", "9": "Яа"}


# ---- percentiles


def test_percentiles_and_days(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(5), rng.choice([None, float("nan"), float("inf"), 1.0, rng.gauss(0, 1), rng.gauss(0, 1)])) for _ in range(6000)] + [("one", 0, 5.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, d int, v double")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    values = {}
    for g, _, v in rows:
        if v is not None and np.isfinite(v):
            values.setdefault(g, []).append(v)
    got = {(r.g, r.p): r for r in percentiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {(g, p) for g in values for p in probs}
    for (g, p), r in got.items():
        assert abs(r.value - np.quantile(values[g], p)) < 1e-9 and r.n == len(values[g])
    for r in combine_days(day_summaries(df, ["g"], "d", "v", knots=32), ["g"], probs).collect():
        own = np.sort(values[r.g])
        want = int((len(own) - 1) * r.p)
        assert max(0, np.searchsorted(own, r.value) - want, want - (np.searchsorted(own, r.value, "right") - 1)) <= r.rank_error * len(own)
        assert r.rank_error < 0.06 or len(own) < 100
    assert percentiles(df.limit(0), ["g"], "v", probs).count() == 0


# ---- sample


def test_swap_repair_reaches_what_can_be_reached():
    member = np.array([[1, 0, 1, 0], [1, 0, 0, 1], [0, 1, 1, 0], [0, 1, 0, 1]])
    take = swap_repair(np.array([900, 30, 40, 500]), member, np.array([60.0, 40, 70, 30]), np.array([10, 10, 10, 10]), 100, 1)
    assert take.sum() == 100 and list(take @ member) == [60, 40, 70, 30]


def test_sample_edges(spark):
    targets = spark.createDataFrame([("c", "a", 0.5, 2), ("c", "b", 0.5, 2), ("c", "gone", 0.0, 5)], "field_name string, field_class string, target_share double, min_rows int")
    df = spark.createDataFrame([(i, ["A ", "b", None, "x"][i % 4], i) for i in range(400)], "id long, c string, take int")
    sample, report = draw_sample(df, "id", targets, size=40)
    rows = sample.collect()
    assert len(rows) == 40 and sum(r.c == "a" for r in rows) == 20 and sum(r.c == "b" for r in rows) == 20
    report = {r.field_class: r for r in report.collect()}
    assert report["a"].met and not report["gone"].met and report["gone"].reason == "too few rows of the class"
    sample, report = draw_sample(df.limit(0), "id", targets)
    assert sample.count() == 0 and not any(r.met for r in report.collect())


# ---- mixing


def test_mix(spark):
    rows = [(i, ["big", "mid", "tiny", None, "other"][min(4, i % 7)], 10 + i % 13) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 3), ("empty", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixture, shares = mix(df, "id", "source", targets)
    used = {}
    for r in mixture.collect():
        used[r.id] = max(used.get(r.id, 0), r["copy"])
    assert all(n <= {"big": 1, "mid": 2, "tiny": 3}[rows[i][1]] for i, n in used.items())
    by = {r.source: r for r in shares.collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(by[s].actual_share - share) < 0.01
    assert by["empty"].actual_share == 0
    mixture, shares = mix(df.limit(0), "id", "source", targets)
    assert mixture.count() == 0 and {r.actual_share for r in shares.collect()} == {0.0}
    assert expected_copies({"a": 10}, {"a": (1.0, 2)}, total=1000) == {"a": 2.0}


# ---- packing


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300)
    a, b = (best_fit(rng.permutation(300).tolist(), sizes, 128, np.full(300, -1)) for _ in range(2))
    for child in (crossover(a, b, sizes, 128, rng), evolve(sizes, 128, [a, b], 3)[0]):
        assert len(child) == 300 and child.min() == 0 and np.bincount(child, weights=sizes).max() <= 128


def test_pack_edges(spark):
    kinds = spark.createDataFrame([("s", 10), ("l", 100), ("no", 0)], "container_kind string, capacity_tokens int")
    rows = [(i, t) for i, t in enumerate([0, 1, 10, 11, 25, 100, 101, None, 7, 7, 3])]
    got = pack(spark.createDataFrame(rows, "id long, tokens long"), "id", kinds, shard_items=4).collect()
    for kind, cap in (("s", 10), ("l", 100)):
        own = [r for r in got if r.container_kind == kind]
        for i, t in rows:
            pieces = sorted(r.tokens for r in own if r.id == i)
            assert sum(pieces) == (t or 0) and len(pieces) == (0 if t is None else 1 if t <= cap else -(-t // cap))
        bins = {}
        for r in own:
            bins[r.container_id] = bins.get(r.container_id, 0) + r.tokens
        assert max(bins.values()) <= cap
    assert {r.container_kind for r in got} == {"s", "l"}
    assert pack(spark.createDataFrame([], "id long, tokens long"), "id", kinds).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "one two", "k"), (2, "", "k"), (3, None, "k"), (4, "ą" * 3000, "k")], "id long, text string, tokens string")
    got = {r.id: r.tokens for r in token_sizes(df, "id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] > 500


# ---- tagger


def test_gradients():
    rng = np.random.default_rng(0)
    w = new_weights(3)
    codes, tags = [rng.integers(1, 90, n).astype(np.int32) for n in (5, 3)], [rng.integers(0, 11, n).astype(np.int8) for n in (5, 3)]
    w["T"] = rng.standard_normal(w["T"].shape).astype(np.float32)
    _, grads = loss_and_gradients(w, codes, tags)
    for k in ("T", "O", "Wf", "Ub", "E", "cb"):
        flat = grads[k].reshape(-1)
        i = int(np.argmax(np.abs(flat)))
        near = []
        for d in (1e-2, -1e-2):
            v = {n: x.copy() for n, x in w.items()}
            v[k].reshape(-1)[i] += d
            near.append(loss_and_gradients(v, codes, tags)[0])
        assert abs((near[0] - near[1]) / 2e-2 - flat[i]) < 0.05 * abs(flat[i]) + 1e-3


def test_windows_agree_with_the_whole():
    w = load()
    short = "Susisiekite su Milda Guzotavičiūtė tel. +370 299 36946. "
    kinds = [k for _, _, k in spans(tag(w, [short * 30])[0])]
    assert kinds.count("phone") == 30 and kinds.count("person_name") == 30
    assert tag(w, ["", short])[0].size == 0


def test_held_out_accuracy():
    from veilspan.llm.train_tagger import labelled, scores

    pairs, _ = labelled("/root/testdata/sf0.01", sample=1500, seed=5)
    got = scores([t for t, _ in pairs], [{k for _, _, k in s} for _, s in pairs], load())
    assert set(got) == set(TYPES) and all(min(v) > 0.95 for v in got.values()), str(got)


def test_found_in_fields(spark):
    rows = [
        (1, "El. paštas vardas.pavarde (at) pastas.test", '{"before": "Tel. nr.: \\u002b370 273 86300", "page": 3}'), (2, None, ""), (3, "Bendra Suma be PVM 55962,87 EUR", "IBAN LT953881596260344525"),
        (4, "Ｖilius Žėsuzidys", "x" * 60_000 + " Adresas: Gėvakio pl. 31-4, Kaunas"), (5, "{broken", "[]"),
    ]
    df = spark.createDataFrame(rows, "id long, a string, text string")
    got = {(r.record_id, r.field_name): (r.pii_types, r.masked) for r in find_personal(df, F.col("id"), "a", "text").collect()}
    assert got[1, "a"][0] == ["email"] and got[1, "text"][0] == ["phone"] and '"page": 3' in got[1, "text"][1]
    assert got[4, "a"][0] == ["person_name"] and "street_address" in got[4, "text"][0]
    assert not any(k[0] in (2, 3) for k in got)
    assert find_personal(df.limit(0), F.col("id"), "a").count() == 0


def test_labels_of_any_length(spark):
    long = "labai ilgas laukelio pavadinimas kuris tęsiasi ir tęsiasi"
    rows = [(1, f"{long}: A; tel: 1", "c"), (2, f"tel = 1 | {long} = a", "c"), (3, f"{long} = 5", "c"), (4, f"{long} 5", "c")]
    df = spark.createDataFrame(rows, "id long, t string, c string")
    assert {(r.first_id, r.id) for r in group_copies(df, "x", "id", "t", F.col("c")).collect()} == {(1, 1), (1, 2)}


@pytest.mark.parametrize(("odd", "plain"), [("a\U000e0041\U000e0100b", "ab"), ("Ꮇedis", "Medis"), ("սpė", "upė")])
def test_upper_planes_and_other_alphabets(odd, plain):
    assert FORMER.form(odd) == plain


def test_swap_repair_in_blocks(monkeypatch):
    from veilspan.llm import sampling

    rng = np.random.default_rng(4)
    member = np.concatenate([np.eye(6, dtype=np.int64)[rng.integers(0, 6, 80)], np.eye(5, dtype=np.int64)[rng.integers(0, 5, 80)]], axis=1)
    args = rng.integers(5, 60, 80), member, np.array([50, 30, 20, 40, 30, 30, 60, 60, 40, 20, 20]) * 1.0, np.full(11, 5), 200, 3
    whole = swap_repair(*args)
    monkeypatch.setattr(sampling, "WEIGHED", 700)
    assert (swap_repair(*args) == whole).all() and whole.sum() == 200
