"""Queries on validators, classification, features, learned patterns and text repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import text as T
from veilspan.functions.terms import DOCUMENT_TERMS, GEOGRAPHIC_EXCLUSIONS, LITHUANIAN_COMMON_WORDS
from veilspan.operators import context as C
from veilspan.operators import features as X
from veilspan.operators import validate as V
from veilspan.operators.learning import learn_cycle, learned, phrase_hits
from veilspan.session import spread
from veilspan.sources.tables import table

#: Detections as the scoring of contexts knows them.
KINDS = {"names": "person_name", "organizations": "organization", "emails": "email", "phones": "phone"}


def _results(spark, root):
    return table(spark, root, "detection_results", "id", "category", "text").where("text is not null")


def person_name_valid(spark, root):
    return _results(spark, root).where("category = 'names'").select("id", V.is_person_name(F.col("text")).alias("valid"))


def swift_valid(spark, root):
    words = table(spark, root, "documents", "doc_id", "text").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z0-9]{8,11})")))).alias("word"))
    return words.where(V.is_swift(F.col("word"))).select("doc_id", "word")


def organization_valid(spark, root):
    return _results(spark, root).where("category in ('organizations', 'locations')").select("id", V.is_organization(F.col("text")).alias("valid"))


def brand_filter(spark, root):
    return _results(spark, root).where(V.is_brand(F.col("text"), ("uab", "ab", "mb", *V.BRANDS))).select("id", "text")


def term_anti_join(spark, root):
    """Distinct detected words that are neither places nor document terms."""
    terms = spark.createDataFrame([(t.lower(),) for t in sorted(set(GEOGRAPHIC_EXCLUSIONS) | set(DOCUMENT_TERMS))], "term string").distinct()
    words = _results(spark, root).where("category in ('names', 'locations')").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{3,})"))).alias("term")).distinct()
    return words.join(F.broadcast(terms), "term", "left_anti")


def doc_type_classify(spark, root):
    kind, score = V.document_type(F.col("text"))
    return table(spark, root, "documents", "doc_id", "text").where("text is not null").select("doc_id", kind.alias("kind"), score.alias("score"))


def features_text(spark, root):
    return spread(_results(spark, root)).select("id", *[F.round(c, 9).alias(k) for k, c in X.text_features(F.col("text")).items()])


def features_pattern(spark, root):
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    rows = spread(_results(spark, root)).withColumn("kind", F.try_element_at(kinds, F.col("category")))
    return rows.select("id", *[F.round(c, 9).alias(k) for k, c in X.pattern_features(F.col("text"), F.col("kind")).items()])


def features_document(spark, root):
    rows = table(spark, root, "documents", "doc_id", "doc_type", "lang", "n_chars")
    return rows.select("doc_id", *[c.alias(k) for k, c in X.document_features(F.col("doc_type"), F.col("lang"), F.col("n_chars")).items()])


def features_context(spark, root):
    rows = table(spark, root, "training_examples", "id", "detection_text", "context").where("context is not null and context != ''")
    return rows.select("id", *[F.round(c, 9).alias(k) for k, c in X.context_features(F.col("detection_text"), F.col("context")).items()])


def section_classes(spark, root):
    """Training examples by the section their detection stands in."""
    rows = table(spark, root, "training_examples", "id", "detection_text", "context").where("context is not null")
    at = F.greatest(F.lit(0), F.instr("context", F.col("detection_text")) - 1)
    return rows.select(C.section(F.col("context"), at).alias("section")).groupBy("section").agg(F.count(F.lit(1)).alias("examples"))


def _validated(spark, root):
    """Training examples of the kinds that contexts are scored for, with section and score."""
    rows = table(spark, root, "training_examples", "id", "detection_text", "category", "context").where("context is not null")
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    at = F.greatest(F.lit(0), F.instr("context", F.col("detection_text")) - 1)
    placed = rows.withColumns({"kind": F.try_element_at(kinds, F.col("category")), "section": C.section(F.col("context"), at)}).where("kind is not null")
    return placed.withColumn("score", F.round(C.context_score(F.col("detection_text"), F.col("kind"), F.col("context"), F.col("section")), 6))


def context_scores(spark, root):
    return _validated(spark, root).select("id", "score")


def validation_flags(spark, root):
    """What speaks against each example in its context."""
    found = C.flags(F.col("detection_text"), F.col("kind"), F.col("context"), F.col("section"), F.col("score"))
    return _validated(spark, root).select("id", F.array_join(found, ",").alias("flags"))


def metadata_contexts(spark, root):
    return table(spark, root, "training_examples", "id", "context").where(C.is_metadata(F.col("context"))).select("id")


def learn_candidates(spark, root):
    """Stored detections that occur as whole words in the contexts of all examples and in the feedback."""
    examples = table(spark, root, "training_examples", "detection_text", "context")
    corpus = examples.select(F.col("context").alias("text")).unionByName(table(spark, root, "user_feedback", "text_segment").select(F.col("text_segment").alias("text")))
    return phrase_hits(corpus, "text", examples, "detection_text")


def pattern_precision(spark, root):
    """Learned patterns: stored texts found in the corpus that are confirmed personal data."""
    truth = table(spark, root, "training_examples", "detection_text", "is_true_positive").where("is_true_positive")
    return learned(learn_candidates(spark, root), truth, "detection_text")


def learned_patterns(spark, root):
    """The patterns after one round of learning from the feedback, over the contexts of all examples and the feedback itself."""
    feedback = table(spark, root, "user_feedback", "id", "text_segment", "feedback_type", "detected_category", "user_corrected_category")
    corpus = table(spark, root, "training_examples", F.col("context").alias("text")).unionByName(feedback.select(F.col("text_segment").alias("text")))
    rows = learn_cycle(feedback, corpus, "text", table(spark, root, "adaptive_patterns", "pattern_id", "regex", "pii_category", "confidence", "version_no"))
    return rows.select("regex", "pii_category", "confidence", "version_no")


def features_all(spark, root):
    """All 106 features of the training examples by their mean."""
    rows = table(spark, root, "training_examples", "detection_text", "category", "context", "document_type").where("detection_text is not null")
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    context = F.coalesce("context", F.lit(""))
    cols = X.all_features(F.col("detection_text"), context, F.try_element_at(kinds, F.col("category")), F.col("document_type"), F.lit("lt"), F.length(context))
    return spread(rows).select(*[c.alias(k) for k, c in cols.items()]).agg(*[F.round(F.avg(k), 9).alias(k) for k in cols])


def salutation_base_name(spark, root):
    """Words after a verb of answering, in the nominative."""
    rows = table(spark, root, "user_feedback", "id", "text_segment")
    names = rows.select("id", F.regexp_extract("text_segment", r"(?U)atsakė (\p{Lu}\p{Ll}+)", 1).alias("name")).where("name != ''")
    return names.select("id", "name", T.base_name(F.col("name")).alias("base"))


def repaired_text(spark, root):
    """Documents after their letters were wrongly decoded and put right again."""
    rows = table(spark, root, "documents", "doc_id", "text").where("text is not null")
    return rows.select("doc_id", F.md5(T.repaired(F.replace("text", F.lit("ž"), F.lit("Å¾")))).alias("digest"))


def extraction_scores(spark, root):
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", F.round(T.extraction_score(F.coalesce("text", F.lit(""))), 6).alias("score"))


def title_texts(spark, root):
    return _results(spark, root).where("category = 'names'").select("id", T.title(F.col("text")).alias("titled"))


def balanced_sample(spark, root, seed: int = 42):
    """As many examples of either label, the ones with the least hashes; a threshold on the hash instead of a sorted class."""
    rows = table(spark, root, "training_examples", "id", "is_true_positive").where("is_true_positive is not null")
    rows = rows.withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("-", F.col("id"), F.lit(seed))), 1, 8), 16, 10).cast("bigint"))
    n = rows.groupBy("is_true_positive").agg(F.count(F.lit(1)).alias("n"))
    share = n.agg((F.min("n") / F.max("n")).alias("share"), F.max_by("is_true_positive", "n").alias("more"))
    keep = (F.col("is_true_positive") != F.col("more")) | (F.col("h") < F.col("share") * float(1 << 32))
    return rows.join(F.broadcast(share)).where(keep).select("id", "is_true_positive")


NAMES = (
    "person_name_valid", "swift_valid", "organization_valid", "brand_filter", "term_anti_join", "doc_type_classify", "features_text", "features_pattern", "features_document", "features_context", "section_classes", "context_scores", "validation_flags", "metadata_contexts",
    "learn_candidates", "pattern_precision", "learned_patterns", "features_all", "salutation_base_name", "repaired_text", "extraction_scores", "title_texts", "balanced_sample",
)
QUERIES = {n: globals()[n] for n in NAMES}


def _list(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


_BRANDS = ("uab", "ab", "mb", *V.BRANDS)
_STRIP = r"regexp_replace(regexp_replace(text, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')"
_SCORE = {k: "(" + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in ws) + f") / {len(ws)}" for k, ws in V.DOCUMENT_TYPES.items()}
_CNT = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_SH = lambda p: f"round({_CNT(p)} / nullif(len(text), 0), 9)"
_FL = lambda c: f"CAST(CAST({c} AS INT) AS DOUBLE)"
_WL = r"list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: len(w))"
_TF = {
    "text_length": "CAST(len(text) AS DOUBLE)", "word_count": "CAST(len(wl) AS DOUBLE)", "char_count": "CAST(len(text) AS DOUBLE)", "whitespace_count": f"CAST({_CNT(chr(91) + ' ' + chr(92) + 't' + chr(92) + 'n' + chr(93))} AS DOUBLE)",
    "char_diversity": "round(len(list_distinct(string_split(lower(text), ''))) / len(text), 9)", "unique_char_count": "CAST(len(list_distinct(string_split(lower(text), ''))) AS DOUBLE)",
    "digit_ratio": _SH(r"\p{Nd}"), "alpha_ratio": _SH(r"\p{L}"), "special_char_ratio": _SH(r"[^\p{L}\p{N}\s]"), "uppercase_ratio": _SH(r"\p{Lu}"), "lowercase_ratio": _SH(r"\p{Ll}"), "space_ratio": _SH(r"\s"),
    "has_lithuanian_chars": _FL("regexp_matches(lower(text), '[ąčęėįšųūž]')"), "has_accented_chars": _FL(f"regexp_matches(lower(text), '[{X.ACCENTED}]')"), "has_digits": _FL(r"regexp_matches(text, '\p{Nd}')"), "has_punctuation": _FL("regexp_matches(text, '[[:punct:]]')"),
    "starts_with_capital": _FL(r"regexp_matches(text, '^\p{Lu}')"), "all_caps": _FL(r"regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '\p{Ll}')"), "title_case": _FL(r"regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}')"),
    **{k: _FL(f"regexp_matches(text, '{p}')") for k, p in X.TEXT_PATTERNS.items()},
    "avg_word_length": "round(coalesce(list_avg(wl), 0), 9)", "max_word_length": "CAST(coalesce(list_max(wl), 0) AS DOUBLE)", "min_word_length": "CAST(coalesce(list_min(wl), 0) AS DOUBLE)", "word_length_variance": "round(coalesce(list_var_pop(wl), 0), 9)",
    **{k: f"CAST({v} AS DOUBLE)" for k, v in X.READABILITY.items()},
}
_DF = {f"is_{k}_document": f"coalesce({_FL(f'lower(doc_type) = {chr(39)}{k}{chr(39)}')}, 0.0)" for k in X.DOCUMENT_KINDS} | {f"is_{k}_language": f"coalesce({_FL(f'lang = {chr(39)}{k}{chr(39)}')}, 0.0)" for k in X.LANGUAGES}
_DF |= {"document_length": "CAST(n_chars AS DOUBLE)", "is_short_document": _FL("n_chars < 1000"), "is_medium_document": _FL("n_chars >= 1000 AND n_chars < 10000"), "is_long_document": _FL("n_chars >= 10000")}
def _re2(p: str) -> str:
    """An expression for an engine without classes of all scripts, for texts of which only whether it matches is asked."""
    edge = r"(?:^|$|[^\p{L}\p{N}_])"
    out, inside, k = [], False, 0
    while k < len(p):
        c = p[k]
        if c == "\\" and p[k + 1] in "sdwb":
            name = {"s": r"\s\x85\p{Z}", "d": r"\p{Nd}", "w": r"\p{L}\p{N}_", "b": edge}[p[k + 1]]
            out.append(name if inside or p[k + 1] == "b" else f"[{name}]")
            k += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        k += 1
    return "".join(out).replace("'", "''")


def _hits(text: str, p: str) -> str:
    """SQL that tells whether a pattern of sections fits; what must not follow is asked apart, line by line."""
    if "(?!" not in p:
        return f"regexp_matches({text}, '(?im){_re2(p)}')"
    a, b = p.index("(?!"), p.index("(?!") + 3
    depth = 1
    while depth:
        depth += {"(": 1, ")": -1}.get(p[b], 0) if p[b - 1] != "\\" else 0
        b += 1
    yes, no = p[:a] + p[b:], p[:a] + p[a + 3 : b - 1]
    return f"len(list_filter(string_split({text}, chr(10)), lambda l: regexp_matches(l, '(?im){_re2(yes)}') AND NOT regexp_matches(l, '(?im){_re2(no)}'))) > 0"


_IN_LINE = " ".join(f"WHEN {' OR '.join(_hits('line', p) for p in ps)} THEN '{k}'" for k, ps in C.SECTIONS.items())
_IN_NEAR = " ".join(f"WHEN {' OR '.join(_hits('near', p) for p in ps)} THEN '{k}'" for k, ps in C.SECTIONS.items() if k not in C.ANCHORED)
_BESIDE = lambda before, after: f"regexp_matches(context, '(?i){_re2(before)}' || regexp_escape(t) || '{_re2(after)}')"
_META = " OR ".join(f"regexp_matches(context, '(?i){_re2(p)}')" for p in C.METADATA)
_HEAD = f"(kind = 'person_name' AND lower(t) IN {_list(C.STRUCTURAL)})"
_SIGNS = [(-0.5, f"kind = 'person_name' AND t IN {_list(GEOGRAPHIC_EXCLUSIONS)}"), (-0.4, f"{_HEAD} AND (regexp_matches(context, '(?im){_re2('^[s]*'.replace('[s]', chr(92) + 's'))}' || regexp_escape(t) || '{_re2(chr(92) + 's*' + chr(92) + 'd+')}') OR coalesce(section IN ('header', 'table_header'), FALSE))")]
_SIGNS += [(-0.3, f"kind = '{k}' AND NOT {_HEAD} AND {_BESIDE(f'({w})' + chr(92) + 's+', '')}") for k, ws in C.AGAINST.items() for w in ws]
_SIGNS += [(0.2, f"kind = '{k}' AND {_BESIDE(p, '')}") for k, ps in C.BEFORE.items() for p in ps] + [(0.2, f"kind = '{k}' AND {_BESIDE('', p)}") for k, ps in C.AFTER.items() for p in ps]
_SIGNS += [(v, f"section = '{k}'") for k, v in C.SECTION_EFFECT.items()] + [(-0.4, _META)]
_PLACED = f"""x AS (SELECT id, detection_text AS t, context, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS kind, greatest(0, instr(context, detection_text) - 1) AS pos FROM training_examples WHERE context IS NOT NULL),
l AS (SELECT *, list_last(string_split(substr(context, 1, pos), chr(10))) || string_split(substr(context, pos + 1), chr(10))[1] AS line, substr(context, greatest(1, pos - 99), 200) AS near FROM x),
s AS (SELECT *, CASE {_IN_LINE} {_IN_NEAR} END AS section FROM l),
v AS (SELECT *, round(least(1.0, greatest(0.0, CAST({C.BASE} AS DOUBLE) {' '.join(f'+ CASE WHEN {c} THEN CAST({v} AS DOUBLE) ELSE 0 END' for v, c in _SIGNS)})), 6) AS score FROM s WHERE kind IS NOT NULL)"""
#: Pieces between a phrase's occurrences tell what stands on either side of each.
_LEARN = r"""p AS (SELECT DISTINCT detection_text AS phrase FROM training_examples WHERE regexp_matches(detection_text, '[\p{L}\p{N}_]')), c AS (SELECT context AS t FROM training_examples WHERE context IS NOT NULL UNION ALL SELECT text_segment FROM user_feedback WHERE text_segment IS NOT NULL),
t AS (SELECT t, count(*) AS times FROM c GROUP BY ALL), m AS (SELECT phrase, times, string_split(t, phrase) AS q FROM p JOIN t ON contains(t, phrase)),
h AS (SELECT phrase, times, len(list_filter(range(1, len(q)), lambda i: NOT regexp_matches(CASE WHEN i > 1 THEN phrase ELSE '' END || q[i], '[\p{L}\p{N}_]$') AND NOT regexp_matches(q[i + 1] || CASE WHEN i + 1 < len(q) THEN phrase ELSE '' END, '^[\p{L}\p{N}_]'))) AS n FROM m)"""
ORACLE = {
    "section_classes": f"WITH {_PLACED} SELECT section, count(*) AS examples FROM s GROUP BY ALL",
    "context_scores": f"WITH {_PLACED} SELECT id, score FROM v",
    "validation_flags": f"""WITH {_PLACED} SELECT id, concat_ws(',', CASE WHEN score < 0.4 THEN 'low_confidence' END, CASE WHEN section IN ('header', 'footer', 'table_header') THEN 'structural_element' END, CASE WHEN {_META} THEN 'document_metadata' END,
CASE WHEN kind = 'person_name' AND len(list_filter(regexp_split_to_array(t, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) > 3 THEN 'overly_long_name' END, CASE WHEN kind = 'organization' AND lower(t) IN {_list(C.QUESTIONS)} THEN 'common_word' END) AS flags FROM v""",
    "learn_candidates": f"WITH {_LEARN} SELECT phrase, CAST(sum(n * times) AS BIGINT) AS hits, CAST(sum(times) AS BIGINT) AS texts FROM h WHERE n > 0 GROUP BY ALL",
    "pattern_precision": f"""WITH {_LEARN}, k AS (SELECT phrase, CAST(sum(n * times) AS BIGINT) AS hits FROM h WHERE n > 0 GROUP BY ALL)
SELECT phrase, hits AS positive_matches, CAST(0 AS BIGINT) AS negative_matches, CAST(1 AS DOUBLE) AS precision FROM k WHERE phrase IN (SELECT detection_text FROM training_examples WHERE is_true_positive)""",
    "salutation_base_name": r"""WITH x AS (SELECT id, regexp_extract(text_segment, 'atsakė (\p{Lu}\p{Ll}+)', 1) AS name FROM user_feedback), y AS (SELECT *, lower(name) AS low, len(name) AS n FROM x WHERE name <> ''),
z AS (SELECT *, regexp_matches(low, '^(toma|jona|petra|antana)i$') OR (n >= 5 AND NOT regexp_matches(left(low, n - 2), '(ij|ar|er)$')) AS m FROM y)
SELECT id, name, CASE WHEN ends_with(low, 'iui') THEN left(name, n - 3) || 'ius' WHEN ends_with(low, 'ui') THEN left(name, n - 2) || 'as' WHEN ends_with(low, 'ai') AND NOT m THEN left(name, n - 2) || 'a' WHEN ends_with(low, 'iai') THEN left(name, n - 3) || 'ija'
WHEN ends_with(low, 'ei') THEN left(name, n - 2) || 'ė' WHEN ends_with(low, 'iau') THEN left(name, n - 3) || 'ius' WHEN ends_with(low, 'ai') AND n > 3 THEN left(name, n - 2) || 'as' ELSE name END AS base FROM z""",
    "metadata_contexts": f"SELECT id FROM training_examples WHERE {_META}",
    "title_texts": r"""WITH w AS (SELECT id, text, regexp_extract_all(lower(text), '\p{L}+|[^\p{L}]+') AS p FROM detection_results WHERE category = 'names' AND text IS NOT NULL)
SELECT id, array_to_string(list_transform(p, lambda x: upper(x[1]) || x[2:]), '') AS titled FROM w""",
    "person_name_valid": f"""WITH t AS (SELECT id, text, {_STRIP} AS t FROM detection_results WHERE text IS NOT NULL AND category = 'names')
SELECT id, len(t) BETWEEN 2 AND 100 AND NOT regexp_matches(t, '\\p{{Nd}}') AND NOT lower(t) IN {_list(sorted({*V.listed(GEOGRAPHIC_EXCLUSIONS), *V.listed(DOCUMENT_TERMS)}))} AND NOT text IN {_list(V.COMMON_ALL_CAPS_NON_NAMES)}
AND NOT (starts_with(t, 'Nr.') OR starts_with(t, 'Tel.') OR starts_with(t, 'Ged.') OR starts_with(t, 'Vilniaus g.'))
AND NOT (lower(t) IN {_list(V.BRANDS)} OR len(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda w: w IN {_list(V.BRANDS)})) > 0) AS valid FROM t""",
    "swift_valid": f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z0-9]{{8,11}}'))) AS word FROM documents)
SELECT doc_id, word FROM w WHERE NOT word IN {_list(LITHUANIAN_COMMON_WORDS)} AND regexp_matches(word, '^[A-Z]{{6}}([01][0-9]|[A-Z2-9][A-Z0-9])([A-Z0-9]{{3}})?$')""",
    "organization_valid": f"WITH t AS (SELECT id, {_STRIP} AS t FROM detection_results WHERE text IS NOT NULL AND category IN ('organizations', 'locations')) SELECT id, len(t) > 2 AND NOT lower(t) IN {_list(V.listed(GEOGRAPHIC_EXCLUSIONS))} AS valid FROM t",
    "brand_filter": f"WITH t AS (SELECT id, text, lower({_STRIP}) AS t FROM detection_results WHERE text IS NOT NULL) SELECT id, text FROM t WHERE len(t) >= 2 AND (t IN {_list(_BRANDS)} OR len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w IN {_list(_BRANDS)})) > 0)",
    "term_anti_join": f"SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')) AS term FROM detection_results WHERE text IS NOT NULL AND category IN ('names', 'locations')) WHERE term NOT IN {_list(sorted({t.lower() for t in [*GEOGRAPHIC_EXCLUSIONS, *DOCUMENT_TERMS]}))}",
    "doc_type_classify": f"""WITH l AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in _SCORE.items())} FROM l), b AS (SELECT *, greatest({', '.join(_SCORE)}) AS best FROM s)
SELECT doc_id, CASE WHEN best < 0.1 THEN 'general_text' {' '.join(f"WHEN {k} = best THEN '{k}'" for k in _SCORE)} END AS kind, CASE WHEN best = 0 THEN 0.1 ELSE best END AS score FROM b""",
    "features_text": f"WITH w AS (SELECT *, {_WL} AS wl FROM detection_results WHERE text IS NOT NULL) SELECT id, {', '.join(f'{e} AS {k}' for k, e in _TF.items())} FROM w",
    "features_document": f"SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in _DF.items())} FROM documents",
    "repaired_text": "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
    "extraction_scores": """SELECT doc_id, round(CASE WHEN coalesce(len(text), 0) = 0 THEN 0 ELSE 0.5 + CASE WHEN regexp_matches(text, '[ąęėįšųūžĄĘĖĮŠŲŪŽ]') THEN 0.3 ELSE 0 END + CASE WHEN contains(text, chr(10)) AND contains(text, ' ') THEN 0.1 ELSE 0 END + CASE WHEN len(text) > 100 THEN 0.1 ELSE 0 END END::DOUBLE, 6) AS score FROM documents""",
    "balanced_sample": """WITH h AS (SELECT id, is_true_positive, CAST('0x' || substr(md5(concat_ws('-', id, 42)), 1, 8) AS BIGINT) AS h FROM training_examples WHERE is_true_positive IS NOT NULL), n AS (SELECT is_true_positive AS l, count(*) AS n FROM h GROUP BY ALL)
SELECT id, is_true_positive FROM h WHERE is_true_positive <> (SELECT arg_max(l, n) FROM n) OR h < (SELECT min(n) / max(n) FROM n) * 4294967296.0""",
}
