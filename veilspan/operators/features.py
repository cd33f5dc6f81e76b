"""Features of detections as plain columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.text import LITHUANIAN

# Patterns of the features; all but the first five ignore case.
TEXT_PATTERNS = {
    "has_phone_pattern": r"\+?\d{1,4}[\s\-]?\d{3,4}[\s\-]?\d{3,4}",
    "has_email_pattern": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "has_url_pattern": r"https?://|www\.",
    "has_date_pattern": r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}",
    "has_id_pattern": r"\b\d{11}\b|\b[A-Z]{2}\d{6}\b",
}
TYPE_PATTERNS = {
    "person_name": (r"^[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+\s+[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+$", r"^[A-Z][a-z]+\s+[A-Z][a-z]+$", r"^(Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+"),
    "organization": (r"\b(UAB|AB|VšĮ|MB|IĮ)\b", r"\b(Ltd|LLC|Inc|Corp|GmbH|SA)\b", r"\b[A-Z][a-z]+\s+(Company|Corp|Ltd)\b"),
    "email": (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",),
    "phone": (r"^\+370\s?\d{8}$", r"^\+\d{1,4}\s?\d{6,14}$", r"^\d{8}$"),
    "address": (r"\b(gatvė|g\.|str\.|street|avenue|ave)\b", r"\d+[a-z]?\s+(gatvė|g\.|str\.)", r"LT-\d{5}"),
    "id_number": (r"^\d{11}$", r"^[A-Z]{2}\d{6}$"),
}
LABEL_PATTERN = r"(?:(?:name|vardas|nombre|nome)|(?:address|adresas|dirección|indirizzo)|(?:phone|telefonas|teléfono|telefono)|(?:email|el\.\s*paštas)|(?:company|įmonė|empresa|società)):\s*$"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
DOCUMENT_KINDS = ("insurance", "legal", "financial", "medical", "personal", "other")
LANGUAGES = ("lt", "en", "lv", "et", "pl", "de", "fr")
SECTIONS = {"in_header": "header", "in_footer": "footer", "in_table": "table_header", "in_form": "form_field", "in_legal": "legal_text"}
READABILITY = {"flesch_reading_ease": 50.0, "flesch_kincaid_grade": 10.0, "automated_readability_index": 10.0}


# The linguistic features, which are all 0 where no language model is at hand.
LINGUISTIC = (
    "noun_ratio", "verb_ratio", "adj_ratio", "propn_ratio", "num_ratio", "punct_ratio", "has_person_entity", "has_org_entity", "has_gpe_entity", "has_date_entity", "has_time_entity", "entity_count", "entity_density",
    "has_title_case_token", "has_alpha_token", "has_digit_token", "has_stop_word", "has_compound", "has_root", "has_det", "avg_token_length", "token_length_std", "max_token_length",
)


def _words(t: Column) -> Column:
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def text_features(t: Column) -> dict[str, Column]:
    """The 31 features of a text; an empty one has zeros and the readability constants."""
    n = F.length(t)
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    share = lambda p: F.coalesce(F.try_divide(count(p), n), F.lit(0.0))
    words = _words(t)
    sizes = F.transform(words, lambda w: F.length(w))
    k = F.size(words)
    mean = F.coalesce(F.try_divide(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), k), F.lit(0.0))
    squares = F.coalesce(F.try_divide(F.aggregate(sizes, F.lit(0), lambda a, x: a + x * x), k), F.lit(0.0))
    unique = F.size(F.array_distinct(F.filter(F.split(F.lower(t), ""), lambda c: c != "")))
    out = {
        "text_length": n, "word_count": k, "char_count": n, "whitespace_count": count(r"[ \t\n]"), "char_diversity": F.coalesce(F.try_divide(unique, n), F.lit(0.0)), "unique_char_count": unique,
        "digit_ratio": share(r"\p{Nd}"), "alpha_ratio": share(r"\p{L}"), "special_char_ratio": share(r"(?U)[^\p{L}\p{N}\s]"), "uppercase_ratio": share(r"\p{Lu}"), "lowercase_ratio": share(r"\p{Ll}"), "space_ratio": share(r"(?U)\s"),
        "has_lithuanian_chars": _flag(F.lower(t).rlike(f"[{LITHUANIAN}]")), "has_accented_chars": _flag(F.lower(t).rlike(f"[{ACCENTED}]")), "has_digits": _flag(t.rlike(r"\p{Nd}")), "has_punctuation": _flag(t.rlike(r"[!-/:-@\[-`{-~]")),
        "starts_with_capital": _flag(t.rlike(r"^\p{Lu}")), "all_caps": _flag(t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")), "title_case": _flag(t.rlike(r"\p{Lu}") & ~t.rlike(r"(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}")),
    }
    out |= {k2: _flag(t.rlike(p)) for k2, p in TEXT_PATTERNS.items()}
    out |= {"avg_word_length": mean, "max_word_length": F.coalesce(F.array_max(sizes), F.lit(0)), "min_word_length": F.coalesce(F.array_min(sizes), F.lit(0)), "word_length_variance": F.greatest(F.lit(0.0), squares - mean * mean)}
    out |= {k2: F.lit(v) for k2, v in READABILITY.items()}
    return {k2: c.cast("double") for k2, c in out.items()}


def pattern_features(t: Column, category: Column) -> dict[str, Column]:
    """The 10 features of what a text looks like."""
    fits = {k: reduce(lambda a, b: a | b, [t.rlike("(?iuU)" + p) for p in ps]) for k, ps in TYPE_PATTERNS.items()}
    size = lambda p: F.when(t.rlike("(?iuU)" + p), F.try_divide(F.length(F.regexp_substr(t, F.lit("(?iuU)" + p))), F.length(t))).otherwise(0.0)
    strength = F.lit(0.0)
    for k, ps in TYPE_PATTERNS.items():
        best = F.greatest(*[size(p) for p in ps]) if len(ps) > 1 else size(ps[0])
        strength = F.when(category == k, best).otherwise(strength)
    chars = F.filter(F.split(F.lower(t), ""), lambda c: c != "")
    kinds = F.array_distinct(chars)
    counts = F.transform(kinds, lambda c: F.size(F.filter(chars, lambda d: d == c)))
    n = F.size(chars)
    entropy = -F.aggregate(counts, F.lit(0.0), lambda a, x: a + x / n * F.log2(x / n))
    triples = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    code = lambda i: F.ascii(F.get(chars, i))
    same = lambda i: F.substring(t, i, F.lit(3)).rlike(r"^(\p{Nd}{3}|\p{L}{3})$")
    out = {f"matches_{k}_pattern": _flag(c) for k, c in fits.items()}
    out |= {
        "category_pattern_strength": F.coalesce(strength, F.lit(0.0)),
        "has_repeated_chars": _flag(F.exists(counts, lambda x: x >= 3)),
        "has_sequential_chars": _flag(F.exists(triples, lambda i: same(i) & (code(i) == code(i - 1) + 1) & (code(i + 1) == code(i) + 1))),
        "char_pattern_complexity": F.when(F.size(kinds) > 1, entropy / F.log2(F.size(kinds).cast("double"))).otherwise(F.when(n > 0, entropy).otherwise(0.0)),
    }
    return {k: c.cast("double") for k, c in out.items()}


def document_features(kind: Column, language: Column, length: Column) -> dict[str, Column]:
    """The 17 features of the document."""
    out = {f"is_{k}_document": _flag(F.lower(kind) == k) for k in DOCUMENT_KINDS}
    out |= {f"is_{k}_language": _flag(language == k) for k in LANGUAGES}
    n = length.cast("double")
    return out | {"document_length": n, "is_short_document": _flag(n < 1000), "is_medium_document": _flag((n >= 1000) & (n < 10000)), "is_long_document": _flag(n >= 10000)}


def context_features(t: Column, context: Column, section: Column | None = None, position: Column | None = None) -> dict[str, Column]:
    """The 25 features of what stands around a detection; without section and position their defaults."""
    at, n = F.instr(context, t), F.length(context)
    half = F.floor(n / 2)
    found = (at > 0) & (F.length(t) > 0)
    before = F.when(found, F.substring(context, F.lit(1), at - 1)).otherwise(F.substring(context, F.lit(1), half))
    after = F.when(found, F.substring(context, at + F.length(t), n)).otherwise(F.substring(context, half + 1, n))
    tail = lambda k: F.substring(before, F.greatest(F.lit(1), F.length(before) - k + 1), F.lit(k))
    head = lambda k: F.substring(after, 1, k)
    where = F.coalesce(position, F.lit(0.5)) if position is not None else F.lit(0.5)
    out = {
        "context_before_length": F.length(before), "context_after_length": F.length(after), "context_total_length": n, "context_word_count": F.size(_words(context)),
        "context_sentence_count": F.regexp_count(context, F.lit("[.!?]+")) + 1, "context_paragraph_count": F.regexp_count(context, F.lit("\n\n")) + 1, "words_before": F.size(_words(before)), "words_after": F.size(_words(after)),
        "has_colon_before": _flag(tail(10).contains(":")), "has_comma_before": _flag(tail(5).contains(",")), "has_period_after": _flag(head(5).contains(".")), "has_newline_before": _flag(tail(20).contains("\n")), "has_newline_after": _flag(head(20).contains("\n")),
        "has_field_label": _flag(before.rlike("(?iuU)" + LABEL_PATTERN)),
    }
    out |= {k: _flag(section == v) if section is not None else F.lit(0.0) for k, v in SECTIONS.items()}
    upper = F.coalesce(F.try_divide(F.regexp_count(context, F.lit(r"\p{Lu}")), n), F.lit(0.0))
    out |= {
        "relative_position": where, "in_first_quarter": _flag(where < 0.25) if position is not None else F.lit(0.0), "in_last_quarter": _flag(where > 0.75) if position is not None else F.lit(0.0),
        "context_has_lithuanian": _flag(F.lower(context).rlike(f"[{LITHUANIAN}]")), "context_mixed_case": _flag(context.rlike(r"\p{Lu}") & context.rlike(r"\p{Ll}")), "context_mostly_caps": _flag(upper > 0.5),
    }
    return {k: F.coalesce(c, F.lit(0)).cast("double") for k, c in out.items()}


def linguistic_features() -> dict[str, Column]:
    """The 23 linguistic features without a language model."""
    return {k: F.lit(0.0) for k in LINGUISTIC}


def all_features(t: Column, context: Column, category: Column, kind: Column, language: Column, length: Column) -> dict[str, Column]:
    """All 106 features, of equal names the later kind's; what cannot be computed is 0."""
    merged = text_features(t) | context_features(t, context) | linguistic_features() | pattern_features(t, category) | document_features(kind, language, length)
    return {k: F.coalesce(c, F.lit(0.0)) for k, c in merged.items()}
