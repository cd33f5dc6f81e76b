"""Whether a detection can be what its category says."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.terms import COMMON_ALL_CAPS_NON_NAMES, DOCUMENT_TERMS, GEOGRAPHIC_EXCLUSIONS, LITHUANIAN_COMMON_WORDS
from veilspan.functions.text import strip

# Beginnings that no name has; example brands, the full list being a parameter.
EXCLUDED_PREFIXES = ("Nr.", "Tel.", "Ged.", "Vilniaus g.")
BRANDS = ("nissan", "toyota", "bmw", "mercedes", "audi", "volkswagen", "ford", "opel", "volvo", "honda")
# Keywords of the document types, in the order that decides ties.
DOCUMENT_TYPES = {
    "invoice": ("invoice", "bill", "receipt", "vat", "payment due", "invoice number", "total amount", "bank transfer"),
    "medical_record": ("medical record", "patient", "diagnosis", "symptoms", "prescription", "hospital", "clinic", "doctor"),
    "legal_document": ("agreement", "contract", "court", "affidavit", "plaintiff", "defendant", "legal", "confidential"),
}
DEFAULT_TYPE, LEAST_SCORE = "general_text", 0.1


def listed(terms: Iterable[str]) -> list[str]:
    """In lower case, the terms that a text in title case can equal."""
    return sorted({t.lower() for t in terms if t.title() == t})


def is_brand(text: Column, brands: Iterable[str] = BRANDS) -> Column:
    """The whole text or one of its words is a brand, in any case."""
    low, known = F.lower(strip(text)), list(brands)
    words = F.split(low, r"(?U)\s+")
    return (F.length(low) >= 2) & (low.isin(known) | F.exists(words, lambda w: w.isin(known) & (F.length(w) >= 2)))


def is_person_name(text: Column, brands: Iterable[str] = BRANDS) -> Column:
    """2 to 100 characters, no digit, no excluded beginning, no listed place, document term, phrase or brand; two names joined by ``ir`` are taken apart."""

    def single(raw: Column) -> Column:
        t = strip(raw)
        low = F.lower(t)
        bad = low.isin(listed(GEOGRAPHIC_EXCLUSIONS) + listed(DOCUMENT_TERMS)) | raw.isin(COMMON_ALL_CAPS_NON_NAMES) | is_brand(raw, brands)
        for p in EXCLUDED_PREFIXES:
            bad = bad | t.startswith(p)
        return F.length(t).between(2, 100) & ~t.rlike(r"\p{Nd}") & ~bad

    t = strip(text)
    parts = F.split(t, " ir ", -1)
    fits = F.length(t).between(2, 100) & ~t.rlike(r"\p{Nd}")
    for p in EXCLUDED_PREFIXES:
        fits = fits & ~t.startswith(p)
    double = (F.size(parts) == 2) & F.forall(parts, lambda p: strip(p).rlike(r"^(\p{Lu}|$)"))
    return F.when(double, fits & F.forall(parts, lambda p: single(strip(p)))).otherwise(single(text))


def is_swift(text: Column) -> Column:
    """Four letters, a country of two, a place of two where a leading 0 or 1 asks for a digit, and three more or none."""
    t = F.upper(strip(text))
    return ~t.isin(LITHUANIAN_COMMON_WORDS) & t.rlike(r"^\p{L}{4}\p{L}{2}(?:[01]\p{Nd}|[\p{L}\p{N}&&[^01]][\p{L}\p{N}])(?:[\p{L}\p{N}]{3})?$")


def is_organization(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) > 2) & ~F.lower(t).isin(listed(GEOGRAPHIC_EXCLUSIONS))


def document_type(text: Column) -> tuple[Column, Column]:
    """(type, score): the share of a type's keywords that occur; the first of the best, the default below LEAST_SCORE."""
    low = F.lower(text)
    score = {k: sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int")) / len(words) for k, words in DOCUMENT_TYPES.items()}
    best = F.greatest(*score.values())
    name = F.lit(None).cast("string")
    for k in reversed(list(score)):
        name = F.when(score[k] == best, k).otherwise(name)
    return F.when(best < LEAST_SCORE, DEFAULT_TYPE).otherwise(name), F.when(best == 0, 0.1).otherwise(best)
