"""Queries on salutations, places, sections, and the whole chain from patterns to final detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions.patterns import catalogue
from veilspan.functions.terms import DOCUMENT_TERMS
from veilspan.functions.text import core_place, entity_category
from veilspan.operators import language as L
from veilspan.operators import spans as S
from veilspan.operators.learning import learned_spans
from veilspan.plans.detection import _SPANS, CHOSEN, _found, _spans
from veilspan.sources.tables import table

# Parts of synthetic examples.
FIRST = ("Jonas", "Petras", "Antanas", "Vytautas", "Mindaugas")
LAST = ("Jonaitis", "Petraitis", "Antanaitis", "Kazlauskas", "Vaičiūnas")
STREETS = ("Gedimino", "Vilniaus", "Kauno", "Laisvės", "Taikos")


def salutation_names(spark, root):
    return L.salutations(table(spark, root, "user_feedback", "id", "text_segment"), "id", "text_segment").drop("full")


def enhanced_spans(spark, root):
    """Matches of the language patterns; names with document terms or common words in them are dropped."""
    patterns = [x for x in catalogue() if x[3]]
    rows = S.find_spans(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text", patterns)
    return rows.where(L.enhanced_kept(F.col("text"), F.col("category"))).select("doc_id", "pattern", "category", "start", "end")


def confident_spans(spark, root):
    """Matches of every pattern in force whose confidence, adjusted by the words around, is at least 0.3."""
    rows = _in_context(spark, root)
    return rows.where("confidence >= 0.3").select("doc_id", "pattern", "start", "end", F.round("confidence", 6).alias("confidence"))


def city_scan(spark, root):
    return L.city_counts(table(spark, root, "documents", "text"), "text")


def place_names(spark, root):
    """Detected places without their endings."""
    rows = table(spark, root, "detection_results", "id", "category", "text").where("category = 'locations' and text is not null")
    return rows.select("id", core_place(F.col("text")).alias("place"), entity_category(F.lit("GPE")).alias("category"))


def _overlaps(rows):
    """Pairs of spans that overlap in a document, by the classes of equal 64-character cells."""
    rows = rows.select("doc_id", "category", "ord", "n", "start", "end")
    cells = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))))
    a, b = (cells.select("doc_id", "cell", *[F.col(c).alias(f"{c}_{x}") for c in ("category", "ord", "n", "start", "end")]) for x in "ab")
    met = a.join(b, ["doc_id", "cell"]).where("ord_a < ord_b and start_a < end_b and start_b < end_a")
    return met.where("cell = floor(greatest(start_a, start_b) / 64)")


def plain_overlapping_spans(spark, root):
    """Pairs of categories whose spans overlap in a document, of the plain patterns."""
    return _overlaps(_spans(spark, root, CHOSEN)).groupBy("category_a", "category_b").agg(F.count(F.lit(1)).alias("pairs"))


def overlapping_spans(spark, root):
    """The same of every pattern in force; patterns share categories, so a pair is named in order of the alphabet."""
    pair = F.least("category_a", "category_b").alias("category_a"), F.greatest("category_a", "category_b").alias("category_b")
    return _overlaps(_spans(spark, root)).groupBy(*pair).agg(F.count(F.lit(1)).alias("pairs"))


def _in_context(spark, root, patterns=None):
    """Spans with their confidence after looking for ``forbidden`` and ``confirmed`` within 50 characters; the text is still at hand."""
    rows = _found(spark, root, patterns).select("doc_id", "whole", S.flat(F.col("spans")))
    near = F.substring("whole", F.greatest(F.lit(1), F.col("start") - 49), F.col("end") - F.col("start") + 100)
    return rows.withColumn("confidence", L.keyword_adjusted(S.base_confidence(F.col("specificity")), near)).drop("whole")


def keyword_adjusted_confidence(spark, root):
    """Detections of the documents by category and adjusted confidence."""
    return _in_context(spark, root).groupBy("category", F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def plain_keyword_adjusted(spark, root):
    return _in_context(spark, root, CHOSEN).groupBy("category", F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def final_detections(spark, root):
    """Every pattern in force, resolved by full match and at least 0.8 sure, with the active learned patterns as sure as they are; of all the longest first, as a map of category to texts.

    Document terms that are only somewhat sure are no detections.  Named entities are left out.
    """
    docs, patterns = table(spark, root, "documents", "doc_id", "text"), catalogue()
    single = S.doc_spans(docs, "doc_id", "text", patterns).select("doc_id", F.inline(S.swept_whole(F.col("spans"))))
    sure = single.withColumn("confidence", F.greatest(F.lit(0.8), S.base_confidence(F.col("specificity")))).drop("full_end")
    sure = sure.unionByName(learned_spans(docs, "doc_id", "text", table(spark, root, "adaptive_patterns"), len(patterns)))
    term = F.lower("text").isin(list(DOCUMENT_TERMS)) & S.confidence_level(F.col("confidence")).isin("LOW", "MEDIUM")
    kept = S.dedupe_longest(sure.where(~term), "doc_id")
    tag = F.format_string("CONTEXT_%.2f", "confidence")
    by = kept.groupBy("doc_id", "category").agg(F.sort_array(F.collect_list(F.struct("start", "text", tag.alias("tag")))).alias("found"))
    return by.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", F.transform("found", lambda x: F.struct(x["text"].alias("text"), x["tag"].alias("tag")))))))).alias("detections"))


def language_scores(spark, root):
    """What the language adds to the confidence of stored examples."""
    rows = table(spark, root, "training_examples", "id", "detection_text", "category", "context").where("context is not null and detection_text is not null")
    return rows.select("id", F.round(L.language_effect(F.col("detection_text"), F.col("category"), F.col("context")), 6).alias("effect"))


def swift_lt(spark, root):
    words = table(spark, root, "documents", "doc_id", "text").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z0-9]{8,11})")))).alias("word"))
    return words.where(L.is_swift_lt(F.col("word"))).select("doc_id", "word")


def pattern_domains(spark, root):
    rows = spark.createDataFrame([(n,) for n, *_ in catalogue()], "name string")
    return rows.groupBy(L.domain(F.col("name")).alias("domain")).agg(F.count(F.lit(1)).alias("patterns"))


def detections_to_examples(spark, root):
    """Detections as training rows: labelled true above a confidence of 0.7."""
    rows = table(spark, root, "detection_results", "id", "text", "category", "ml_confidence").where("ml_confidence is not null")
    return rows.select("id", F.col("text").alias("detection_text"), "category", F.col("ml_confidence").alias("confidence_score"), (F.col("ml_confidence") > 0.7).alias("is_true_positive"))


def synthetic_examples(spark, root, count: int = 1000, seed: int = 7):
    """Made-up examples of names and addresses, the same for the same seed, and a tenth without personal data."""
    pick = lambda xs, salt: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    name = F.concat_ws(" ", pick(FIRST, 1), pick(LAST, 2))
    address = F.format_string("%s g. %d", pick(STREETS, 3), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(200)) + 1)
    kind = F.when(F.col("id") % 11 == 10, "none").when(F.col("id") % 2 == 0, "person_name").otherwise("address")
    rows = spark.range(count).withColumn("category", kind)
    text = F.when(F.col("category") == "person_name", name).when(F.col("category") == "address", address).otherwise(F.lit("Dokumento puslapis"))
    return rows.select("id", "category", text.alias("detection_text"), (F.col("category") != "none").alias("is_true_positive"))


def improvement_suggestions(spark, root):
    """What the feedback asks for, by category."""
    rows = table(spark, root, "user_feedback", "feedback_type", "detected_category", "user_confidence_rating").groupBy("detected_category")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("feedback_type") == "false_positive").cast("int")).alias("fp"), F.avg("user_confidence_rating").alias("rating"))
    advice = F.array_compact(F.array(F.when(F.col("fp") > 0.2, "tighten patterns"), F.when(F.col("rating") < 0.6, "review confidence")))
    return out.select("detected_category", "n", F.array_join(advice, "; ").alias("advice"))


NAMES = (
    "salutation_names", "city_scan", "place_names", "overlapping_spans", "plain_overlapping_spans", "keyword_adjusted_confidence", "plain_keyword_adjusted", "enhanced_spans", "confident_spans", "final_detections", "language_scores", "swift_lt", "pattern_domains", "detections_to_examples", "synthetic_examples", "improvement_suggestions",
)
QUERIES = {n: globals()[n] for n in NAMES}
_BY_NAME = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.PATTERN_SPECIFICITY.items()) + f" ELSE {S.DEFAULT_SPECIFICITY} END"
_ALL = "|".join(c.lower() for c in sorted(L.CITIES, key=len, reverse=True))
ORACLE = {
    "city_scan": f"SELECT trim(c, ' ') AS city, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', '  ', 'g') || ' ', '(?:^| )(?:{_ALL}) ')) AS c FROM documents WHERE text IS NOT NULL) GROUP BY ALL",
    "place_names": r"SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '( mieste| miestas| rajone| rajonas| apskrityje| apskritis| seniūnijoje| seniūnija)$', ''), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS place, 'locations' AS category FROM detection_results WHERE category = 'locations' AND text IS NOT NULL",
    "plain_overlapping_spans": f"WITH RECURSIVE {_SPANS} SELECT a.category AS category_a, b.category AS category_b, count(*) AS pairs FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND a.ord < b.ord AND a.start_ < b.end_ AND b.start_ < a.end_ GROUP BY ALL",
    "plain_keyword_adjusted": f"""WITH RECURSIVE {_SPANS}, c AS (SELECT category, lower(substr(d.text, greatest(1, start_ - 49), end_ - start_ + 100)) AS near, {_BY_NAME} AS spec FROM sp JOIN documents d ON d.doc_id = sp.doc_id),
a AS (SELECT category, 0.5 + least(0.4, spec / 250) AS b, near FROM c)
SELECT category, round(CASE WHEN contains(near, 'forbidden') THEN b * 0.5 WHEN contains(near, 'confirmed') THEN least(1.0, b * 1.2) ELSE b END, 6) AS confidence, count(*) AS n FROM a GROUP BY ALL""",
    "pattern_domains": "SELECT domain, count(*) AS patterns FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{w}') THEN '{k}'" for w, k in L.DOMAINS) + " ELSE 'generic' END AS domain FROM (VALUES " + ", ".join(f"('{n}')" for n, *_ in catalogue()) + ") t(name)) GROUP BY ALL",
    "swift_lt": """WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z0-9]{8,11}'))) AS word FROM documents)
SELECT doc_id, word FROM w WHERE regexp_matches(word, '^[A-Z]{4}LT([01][0-9]|[A-Z2-9][A-Z0-9])([A-Z0-9]{3})?$')""",
    "detections_to_examples": "SELECT id, text AS detection_text, category, ml_confidence AS confidence_score, ml_confidence > 0.7 AS is_true_positive FROM detection_results WHERE ml_confidence IS NOT NULL",
    "improvement_suggestions": """SELECT detected_category, count(*) AS n, concat_ws('; ', CASE WHEN avg(CAST(feedback_type = 'false_positive' AS INT)) > 0.2 THEN 'tighten patterns' END, CASE WHEN avg(user_confidence_rating) < 0.6 THEN 'review confidence' END) AS advice FROM user_feedback GROUP BY ALL""",
}
