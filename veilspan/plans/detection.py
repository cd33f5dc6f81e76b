"""Queries on spans in documents, their resolution and redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.patterns import BASE_PATTERNS
from veilspan.operators import spans as S
from veilspan.session import spread
from veilspan.sources.tables import table

#: Patterns whose ends are plain characters, so that other engines find the same: those of the ``plain_`` queries, which SQL twins check.
#: All other queries search every pattern in force.
PLAIN = ("date_yyyy_mm_dd", "date_yyyy_mm_dd_dots", "emails", "lithuanian_iban", "lithuanian_passport", "lithuanian_phone_compact", "lithuanian_postal_code", "lithuanian_vat_code", "lithuanian_personal_codes", "health_insurance_number")
CHOSEN = [(n, n, BASE_PATTERNS[n], False) for n in PLAIN]


def _docs(spark: SparkSession, root: str, *more: str) -> DataFrame:
    return table(spark, root, "documents", "doc_id", "text", *more)


def _found(spark: SparkSession, root: str, patterns: list[tuple[str, str, str, bool]] | None = None) -> DataFrame:
    """``doc_id, whole, spans`` of ``patterns``, else of every pattern in force."""
    return S.doc_spans(_docs(spark, root), "doc_id", "text", patterns)


def _spans(spark: SparkSession, root: str, patterns: list[tuple[str, str, str, bool]] | None = None) -> DataFrame:
    """One row per span."""
    return _found(spark, root, patterns).select("doc_id", S.flat(F.col("spans")))


def pii_category_counts(spark, root):
    return S.category_counts(_docs(spark, root), "text", S.catalogue())


def plain_category_counts(spark, root):
    return S.category_counts(_docs(spark, root), "text", CHOSEN)


def pii_docs_by_lang(spark, root):
    """Matches per language and category."""
    return S.category_counts(_docs(spark, root, "lang"), "text", S.catalogue(), "lang")


def plain_docs_by_lang(spark, root):
    return S.category_counts(_docs(spark, root, "lang"), "text", CHOSEN, "lang")


def _topk(spark, root, patterns):
    n = reduce(lambda a, b: a + b, (S.matches(F.col("text"), p, i) for _, _, p, i in patterns))
    return spread(_docs(spark, root)).select("doc_id", n.cast("bigint").alias("matches")).orderBy(F.desc_nulls_last("matches"), "doc_id").limit(10)


def pii_topk_docs(spark, root):
    """The ten documents with most matches."""
    return _topk(spark, root, S.catalogue())


def plain_topk_docs(spark, root):
    return _topk(spark, root, CHOSEN)


def pii_catalogue_counts(spark, root):
    """Matches of every pattern in force."""
    rows = S.category_counts(_docs(spark, root), "text", [(n, n, p, i) for n, _, p, i in S.catalogue()])
    return rows.withColumnRenamed("category", "pattern")


def pii_spans(spark, root):
    return _spans(spark, root).select("doc_id", "pattern", "category", "n", "text", "start", "end")


def plain_spans(spark, root):
    return _spans(spark, root, CHOSEN).select("doc_id", "category", "n", "text", "start", "end")


def _resolved(spark, root, resolve, *fields, patterns=None):
    return _found(spark, root, patterns).select("doc_id", F.inline(resolve(F.col("spans")))).select("doc_id", "category", *fields)


def span_dedupe_sweep(spark, root):
    return _resolved(spark, root, S.swept, "start", "end")


def plain_dedupe_sweep(spark, root):
    return _resolved(spark, root, S.swept, "start", "end", patterns=CHOSEN)


def span_dedupe_full_match(spark, root):
    return _resolved(spark, root, S.swept_whole, "full_start", "full_end")


def plain_dedupe_full_match(spark, root):
    return _resolved(spark, root, S.swept_whole, "full_start", "full_end", patterns=CHOSEN)


def span_dedupe_longest(spark, root):
    sure = lambda spans: F.transform(spans, lambda s: s.withField("confidence", S.base_confidence(s["specificity"])))
    return _resolved(spark, root, lambda spans: S.longest(sure(spans)), "start", "end")


def text_dedupe_specificity(spark, root):
    rows = table(spark, root, "detection_results", "id", "document_id", "category", "text")
    return S.dedupe_text(rows, "document_id", "id")


def confidence_levels(spark, root):
    level = S.confidence_level(F.col("ml_confidence")).alias("level")
    return table(spark, root, "detection_results", "ml_confidence").where("ml_confidence is not null").groupBy(level).agg(F.count(F.lit(1)).alias("detections"))


def redacted_text_email(spark, root):
    return _docs(spark, root).select("doc_id", S.redact(F.col("text"), BASE_PATTERNS["emails"], False, "[EMAIL]").alias("redacted"))


def redacted_words(spark, root):
    return _docs(spark, root).select("doc_id", S.redact_words(F.col("text"), ["EUR", "PVM", "Vilnius"]).alias("redacted"))


def _overlaid(spark, root, patterns=None):
    over = S.overlay(F.col("whole"), S.swept(F.col("spans")), lambda s: F.concat(F.lit("["), F.upper(s["category"]), F.lit("]")))
    return _found(spark, root, patterns).select("doc_id", over.alias("redacted"))


def redacted_overlay(spark, root):
    """Documents with every resolved span replaced by its category."""
    return _overlaid(spark, root)


def plain_redacted_overlay(spark, root):
    return _overlaid(spark, root, CHOSEN)


def _report(spark, root, patterns=None):
    kinds = F.transform(S.swept(F.col("spans")), lambda s: s["category"])
    found = _found(spark, root, patterns).select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)
    count = lambda x: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(x)), lambda c: F.struct(c, F.size(F.filter(x, lambda y: y == c)).cast("bigint"))))
    return found.select("doc_id", F.size("kinds").cast("bigint").alias("total"), F.to_json(count(F.col("kinds"))).alias("by_category"))


def redaction_report(spark, root):
    """Redactions per document: total, and by category as a map."""
    return _report(spark, root)


def plain_redaction_report(spark, root):
    return _report(spark, root, CHOSEN)


NAMES = (
    "pii_category_counts", "pii_docs_by_lang", "pii_topk_docs", "pii_catalogue_counts", "pii_spans", "span_dedupe_sweep", "span_dedupe_full_match", "span_dedupe_longest", "text_dedupe_specificity", "confidence_levels", "redacted_text_email", "redacted_words", "redacted_overlay", "redaction_report",
    "plain_category_counts", "plain_docs_by_lang", "plain_topk_docs", "plain_spans", "plain_dedupe_sweep", "plain_dedupe_full_match", "plain_redacted_overlay", "plain_redaction_report",
)
QUERIES = {n: globals()[n] for n in NAMES}


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_COUNTS = " UNION ALL ".join(f"SELECT doc_id, lang, {_q(n)} AS category, len(regexp_extract_all(text, {_q(BASE_PATTERNS[n])})) AS m FROM documents WHERE text IS NOT NULL" for n in PLAIN)
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, {_q(n)} AS category, {k} AS ord, regexp_extract_all(text, {_q(BASE_PATTERNS[n])}) AS f, regexp_split_to_array(text, {_q(BASE_PATTERNS[n])}) AS b FROM documents WHERE text IS NOT NULL" for k, n in enumerate(PLAIN)
)
_SPANS = f"""
h AS ({_HITS}), e AS (SELECT doc_id, category, ord, f, b, unnest(range(len(f))) AS n FROM h),
s AS (
  SELECT doc_id, category, ord, CAST(n AS INT) AS n, f[n + 1] AS text,
    CAST(coalesce(list_sum(list_transform(b[1 : n + 1], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(f[1 : n], lambda x: len(x))), 0) AS INT) AS start_ FROM e
), sp AS (SELECT *, start_ + CAST(len(text) AS INT) AS end_, row_number() OVER (PARTITION BY doc_id ORDER BY start_, -len(text), ord, n) AS rn FROM s),
kept AS (
  SELECT doc_id, rn, category, start_, end_ FROM sp WHERE rn = 1
  UNION ALL
  SELECT x.doc_id, x.rn, x.category, x.start_, x.end_ FROM kept k, LATERAL (SELECT * FROM sp WHERE sp.doc_id = k.doc_id AND sp.rn > k.rn AND sp.start_ >= k.end_ ORDER BY sp.rn LIMIT 1) x
)"""
_SCORES = "CASE category " + " ".join(f"WHEN {_q(c)} THEN {n}" for c, n in S.CATEGORY_SPECIFICITY.items()) + f" ELSE {S.DEFAULT_SPECIFICITY} END"
ORACLE = {
    "plain_category_counts": f"SELECT category, CAST(sum(m) AS BIGINT) AS matches FROM ({_COUNTS}) WHERE m > 0 GROUP BY ALL",
    "plain_docs_by_lang": f"SELECT lang, category, CAST(sum(m) AS BIGINT) AS matches FROM ({_COUNTS}) WHERE m > 0 GROUP BY ALL",
    "plain_topk_docs": f"SELECT doc_id, CAST(sum(m) AS BIGINT) AS matches FROM ({_COUNTS}) GROUP BY ALL ORDER BY matches DESC, doc_id LIMIT 10",
    "plain_spans": f"WITH RECURSIVE {_SPANS} SELECT doc_id, category, n, text, start_ AS start, end_ AS \"end\" FROM sp",
    "plain_dedupe_sweep": f"WITH RECURSIVE {_SPANS} SELECT doc_id, category, start_ AS start, end_ AS \"end\" FROM kept",
    "plain_dedupe_full_match": f"WITH RECURSIVE {_SPANS} SELECT doc_id, category, start_ AS full_start, end_ AS full_end FROM kept",
    "plain_redaction_report": f"""WITH RECURSIVE {_SPANS}, c AS (SELECT doc_id, category, count(*) AS n FROM kept GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS by_category FROM c GROUP BY doc_id""",
    "plain_redacted_overlay": f"""WITH RECURSIVE {_SPANS}, k AS (SELECT *, lag(end_, 1, 0) OVER (PARTITION BY doc_id ORDER BY start_) AS before FROM kept),
r AS (SELECT k.doc_id, string_agg(substr(text, before + 1, start_ - before) || '[' || upper(category) || ']', '' ORDER BY start_) AS head, max(end_) AS upto FROM k JOIN documents d ON d.doc_id = k.doc_id GROUP BY ALL)
SELECT d.doc_id, coalesce(head, '') || substr(text, coalesce(upto, 0) + 1) AS redacted FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id""",
    "text_dedupe_specificity": f"""SELECT id, document_id, category, text FROM (SELECT *, row_number() OVER (PARTITION BY document_id, lower(trim(text, ' ')) ORDER BY {_SCORES} DESC, category DESC NULLS LAST, id DESC) AS r
FROM detection_results WHERE text IS NOT NULL) WHERE r = 1""",
    "confidence_levels": """SELECT CASE WHEN ml_confidence >= 0.9 THEN 'VERY_HIGH' WHEN ml_confidence >= 0.8 THEN 'HIGH' WHEN ml_confidence >= 0.6 THEN 'MEDIUM' WHEN ml_confidence >= 0.4 THEN 'LOW' ELSE 'VERY_LOW' END AS level,
count(*) AS detections FROM detection_results WHERE ml_confidence IS NOT NULL GROUP BY ALL""",
    "redacted_text_email": f"SELECT doc_id, regexp_replace(text, {_q(BASE_PATTERNS['emails'])}, '[EMAIL]', 'g') AS redacted FROM documents",
    "redacted_words": "SELECT doc_id, regexp_replace(text, 'Vilnius|EUR|PVM', '[REDACTED]', 'g') AS redacted FROM documents",
}
