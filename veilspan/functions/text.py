"""Text helpers as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Endings of place names in Lithuanian, in the order they are tried.
PLACE_ENDINGS = (" mieste", " miestas", " rajone", " rajonas", " apskrityje", " apskritis", " seniūnijoje", " seniūnija")
# Labels of named entities and their categories.
ENTITY_CATEGORIES = {"PERSON": "names", "LOC": "locations", "GPE": "locations", "ORG": "organizations", "MONEY": "financial", "DATE": "dates", "TIME": "dates", "EMAIL": "emails", "PHONE": "phones", "URL": "urls"}
# Wrongly decoded letters and what they were, in the order they are replaced.
MOJIBAKE = (
    ("Ä…", "ą"), ("Ä™", "ę"), ("Äÿ", "ė"), ("Äš", "į"), ("Å¡", "š"), ("Å³", "ų"), ("Å«", "ū"), ("Å¾", "ž"), ("Ä„", "Ą"), ("Ä˜", "Ę"), ("Ä–", "Ė"), ("Ä®", "Į"), ("Å ", "Š"), ("Å²", "Ų"), ("Åª", "Ū"), ("Å½", "Ž"),
    ("Äƒ", "ą"), ("Ä", "ė"), ("Ã¡", "ą"), ("Ã©", "ę"), ("Ã«", "ė"), ("Ã­", "į"), ("Ã±", "š"), ("Ã³", "ų"), ("Ã»", "ū"), ("â€™", "'"), ("â€œ", '"'), ("â€¦", "..."), ("â€", '"'), ("Â", ""), ("ï¿½", ""), ("�", ""), ("¿", ""),
)
LITHUANIAN = "ąčęėįšųūž"


# Words that are common in one language only.
STOP_WORDS = {
    "lt": ("ir", "yra", "kad", "su", "iš", "dėl", "nuo", "arba", "šis", "pagal", "už", "buvo", "prie", "apie"),
    "en": ("the", "and", "of", "to", "is", "for", "with", "this", "that", "was", "are", "by", "from", "or"),
    "de": ("der", "die", "und", "das", "ist", "den", "mit", "von", "für", "nicht", "ein", "auf", "des", "oder"),
}


def _among(words: tuple[str, ...]):
    return lambda w: w.isin(*words)


def language(c: Column) -> Column:
    """The language with most stop words among the first 1,000 characters, in the order above; ``unknown`` if there are none."""
    words = F.regexp_extract_all(F.lower(F.substring(c, 1, 1000)), F.lit(r"(\p{L}+)"))
    n = {k: F.coalesce(F.size(F.filter(words, _among(ws))), F.lit(0)) for k, ws in STOP_WORDS.items()}
    best = F.greatest(*n.values())
    out = F.lit("unknown")
    for k in reversed(n):
        out = F.when((best > 0) & (n[k] == best), k).otherwise(out)
    return F.when(c.isNull(), "unknown").otherwise(out)


@F.pandas_udf(StringType())
def composed(c: pd.Series) -> pd.Series:
    """Accents composed with their letters (NFC)."""
    return c.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def spaced(c: Column) -> Column:
    """Blanks that a broken extraction set or lost around accented letters, put right in a fixed order."""
    low, any_ = LITHUANIAN.replace("č", ""), "ąęėįšųūžĄĘĖĮŠŲŪŽ"
    c = F.regexp_replace(c, rf"(?U)(\w)\s{{2,}}([{low}])", "$1 $2")
    c = F.regexp_replace(c, rf"(?U)([{low}])\s{{2,}}(\w)", "$1 $2")
    c = F.regexp_replace(c, rf"(?U)([{any_}])\s*\n\s*([a-z{low}])", "$1$2")
    return F.regexp_replace(c, rf"([{any_}])([A-Za-z])", "$1 $2")


def strip(c: Column) -> Column:
    """Without blank ends of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title(c: Column) -> Column:
    """Every letter after something that is no letter in upper case, all others in lower case."""
    parts = F.split(F.lower(c), r"(?U)(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def repaired(c: Column) -> Column:
    """Wrongly decoded letters put right."""
    for wrong, right in MOJIBAKE:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def extraction_score(c: Column) -> Column:
    """How well a text was extracted, from 0 to 1."""
    spoilt = F.regexp_count(c, F.lit("�")) * 2 + F.regexp_count(c, F.lit("ï¿½"))
    score = (
        F.lit(0.3)
        + F.when(c.rlike("[ąęėįšųūžĄĘĖĮŠŲŪŽ]"), 0.3).otherwise(0.0)
        + F.when(spoilt == 0, F.lit(0.2)).otherwise(-F.least(F.lit(0.2), spoilt / F.length(c) * 10))
        + F.when(c.contains("\n") & c.contains(" "), 0.1).otherwise(0.0)
        + F.when(F.length(c) > 100, 0.1).otherwise(0.0)
    )
    return F.when(F.length(c) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).otherwise(0.0)


def core_place(c: Column) -> Column:
    """A place name without the first ending that fits."""
    out = c
    for e in reversed(PLACE_ENDINGS):
        out = F.when(c.endswith(e), F.substring(c, F.lit(1), F.length(c) - len(e))).otherwise(out)
    return strip(out)


def entity_category(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ENTITY_CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lower(c))


def base_name(c: Column) -> Column:
    """The nominative that a name in the dative or vocative suggests, by its ending."""
    n, low, size = c, F.lower(c), F.length(c)
    cut = lambda k, end: F.concat(F.substring(n, F.lit(1), size - k), F.lit(end))
    stem = F.substring(low, F.lit(1), size - 2)
    masculine = low.rlike(r"^(?:toma|jona|petra|antana)i$") | ((F.length(stem) >= 3) & ~stem.rlike("(?:ij|ar|er)$"))
    feminine = low.rlike("(?:a|ė|ija|ana|ina)$")
    titles = ("ponas", "ponia", "p.", "ponai", "ponioms", "daktaras", "daktarė", "dr.", "prof.", "inžinierius", "inžinierė", "ing.", "magistras", "magistrė", "mag.")
    return (
        F.when(low.isin(*titles), n)
        .when(low.endswith("iui"), cut(3, "ius"))
        .when(low.endswith("ui"), cut(2, "as"))
        .when(low.endswith("ai") & ~masculine, cut(2, "a"))
        .when(low.endswith("iai"), cut(3, "ija"))
        .when(low.endswith("ei"), cut(2, "ė"))
        .when(low.endswith("iau"), cut(3, "ius"))
        .when(low.endswith("ai") & (size > 3) & masculine, cut(2, "as"))
        .when(low.endswith("e") & (size > 2) & feminine, cut(1, "a"))
        .otherwise(n)
    )
