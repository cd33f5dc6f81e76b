"""What Lithuanian documents need besides patterns: salutations, places, sections, name endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.terms import DOCUMENT_TERMS, GEOGRAPHIC_EXCLUSIONS, LITHUANIAN_COMMON_WORDS
from veilspan.functions.text import base_name, strip
from veilspan.operators.context import quoted
from veilspan.operators.validate import is_swift, listed

NAME = r"([A-ZĄĘĖĮŠŲŪŽ][a-ząęėįšųūž]+"
# What stands before (or after) a name that is addressed, with the endings of the name; case is ignored.
SALUTATIONS = {
    "formal_address": (
        rf"Gerbiamam\s+{NAME}ui?)", rf"Gerbiamai\s+{NAME}ai?)", rf"Gerbiamam\s+p\.\s*{NAME}ui?)", rf"Gerbiamai\s+p\.\s*{NAME}ai?)", rf"Gerbiamas\s+{NAME}ai?)", rf"Gerbiama\s+{NAME}e)",
        rf"Gerbiamam\s+(?:ponaui?|p\.)\s+{NAME}ui?)", rf"Gerbiamai\s+(?:poniai?|p\.)\s+{NAME}ai?)",
    ),
    "greeting_patterns": (rf"Sveiki,?\s+{NAME}ai?)", rf"Labas,?\s+{NAME}ai?)", rf"Laba\s+diena,?\s+{NAME}ai?)", rf"Sveika,?\s+{NAME}e)", rf"Laba\s+diena,?\s+{NAME}e)"),
    "closing_patterns": (rf"Su\s+pagarba,?\s+{NAME}s)", rf"Pagarbiai,?\s+{NAME}s)", rf"Ačiū,?\s+{NAME}ai?)"),
    "direct_address": (rf"{NAME}ai?),?\s+(?:prašau|galėčiau|norėčiau)", rf"{NAME}e),?\s+(?:prašau|galėčiau|norėčiau)", rf"(?:Prašau|Galėčiau),?\s+{NAME}ai?)"),
}
SALUTATION_BOOST = {"formal_address": 0.3, "greeting_patterns": 0.2, "closing_patterns": 0.2, "direct_address": 0.1}
FORMAL = "gerbiamam|gerbiamai|gerbiamas|gerbiama|su pagarba|pagarbiai"
LEAST_SALUTATION = 0.6
# Sections of insurance documents in the order they are tried, and what they add.
SECTIONS = {
    "insurance_header": ("PRIVALOMOJO.*DRAUDIMO.*PAŽYMĖJIMAS", "DRAUDIMO.*POLISAS", "CIVILINĖS.*ATSAKOMYBĖS.*DRAUDIMAS"),
    "personal_info_section": ("DRAUDĖJO.*DUOMENYS", "ASMENS.*DUOMENYS", "TRANSPORTO.*PRIEMONĖS.*DUOMENYS"),
    "company_info_section": ("ĮMONĖS.*DUOMENYS", "DRAUSTOJAS", "DRAUDIMO.*BENDROVĖ"),
    "legal_section": ("DRAUDIMO.*SĄLYGOS", "TEISĖS.*IR.*PAREIGOS", "ATSAKOMYBĖS.*RIBOJIMAS"),
}
SECTION_EFFECT = {"insurance_header": -0.2, "personal_info_section": 0.3, "company_info_section": 0.2, "legal_section": -0.3}
NAME_ENDINGS = ("as", "is", "ė", "a", "ienė", "aitė", "ytė")
# Cities that are looked for, whatever the case.
CITIES = (
    "Vilnius", "Kaunas", "Klaipėda", "Šiauliai", "Panevėžys", "Alytus", "Marijampolė", "Mažeikiai", "Jonava", "Utena", "Kėdainiai", "Telšiai", "Tauragė", "Ukmergė", "Visaginas", "Plungė", "Kretinga", "Radviliškis",
    "Palanga", "Druskininkai", "Gargždai", "Rokiškis", "Biržai", "Jurbarkas", "Elektrėnai", "Kuršėnai", "Garliava", "Vilkaviškis", "Anykščiai",
)
# Words in a pattern's name and the domain they speak for, in the order they are tried.
DOMAINS = (
    ("personal|passport|driver", "personal"), ("vat|business|entity", "business"), ("address|postal|city", "location"), ("phone|email|mobile", "contact"), ("iban|credit|swift|financial", "financial"),
    ("health|medical|blood", "healthcare"), ("car|plate|automotive", "automotive"), ("legal|entity", "legal"), ("date", "dates"),
)


def salutations(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document and addressed name in the nominative: ``key, base, name, category, confidence``, of several the surest."""
    def hits(kind: str, pattern: str) -> Column:
        p = "(?iumU)" + pattern
        one = lambda m: F.struct(F.regexp_extract(m, p, 1).alias("name"), m.alias("full"), F.instr(F.col(text), m).alias("at"), F.lit(kind).alias("category"))
        return F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), one)

    found = [hits(kind, p) for kind, patterns in SALUTATIONS.items() for p in patterns]
    rows = df.where(F.col(text).isNotNull()).select(key, F.inline(F.concat(*found)))
    n = F.length("name")
    boost = F.lit(0.0)
    for kind, v in SALUTATION_BOOST.items():
        boost = F.when(F.col("category") == kind, v).otherwise(boost)
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    score = 0.5 + boost + plus(F.col("at") <= 500, 0.1) + plus(F.lower("full").rlike(FORMAL), 0.1) + plus(F.col("name").rlike(r"^\p{Lu}"), 0.05) - plus(n < 3, 0.2) - plus(n > 15, 0.1)
    rows = rows.withColumns({"base": base_name(F.col("name")), "confidence": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)}).where(F.col("confidence") >= LEAST_SALUTATION)
    best = F.max_by(F.struct("base", "name", "category", "confidence", "full"), F.struct("confidence", -F.col("at"), "category"))
    return rows.groupBy(key, F.lower("base").alias("_b")).agg(best.alias("b")).select(key, "b.*")


def city_counts(df: DataFrame, text: str, cities: tuple[str, ...] = CITIES) -> DataFrame:
    """Whole-word occurrences of each city in any case: one pass over the text, no join."""
    low = "(?iuU)(?<![\\p{L}\\p{N}_])(" + "|".join(sorted(cities, key=lambda c: (-len(c), c))) + ")(?![\\p{L}\\p{N}_])"
    return df.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(text, F.lit(low), F.lit(1))).alias("c")).groupBy(F.lower("c").alias("city")).agg(F.count(F.lit(1)).alias("n"))


def keyword_adjusted(confidence: Column, near: Column) -> Column:
    """Half the confidence near ``forbidden``, else a fifth more, at most 1, near ``confirmed``."""
    low = F.lower(near)
    return F.when(low.contains("forbidden"), confidence * 0.5).when(low.contains("confirmed"), F.least(F.lit(1.0), confidence * 1.2)).otherwise(confidence)


def section(near: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, ps in reversed(SECTIONS.items()):
        out = F.when(near.rlike("(?iuU)" + "|".join(ps)), k).otherwise(out)
    return out


def name_effect(text: Column, near: Column) -> Column:
    """A tenth for each name ending of each word and two for each title or label beside the name; half a point less for places and document terms."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike(r"^[A-ZĄČĘĖĮŠŲŪŽ]"))
    fits = lambda w: sum((w.rlike(f"^[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+{e}$").cast("int") for e in NAME_ENDINGS[1:]), w.rlike(f"^[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+{NAME_ENDINGS[0]}$").cast("int"))
    endings = F.aggregate(words, F.lit(0), lambda a, w: a + fits(w)) * 0.1
    beside = lambda a, b: F.when(F.rlike(near, F.concat(F.lit("(?iuU)" + a), quoted(text), F.lit(b))), 0.2).otherwise(0.0)
    titles = beside(r"(?:Ponas|Ponia|Daktaras|Dr\.|Profesorius|Prof\.)\s+", "") + beside("", r"\s+(?:gimęs|gimusi|born)") + beside(r"(?:Vardas|Name):\s*", "")
    low = F.lower(strip(text))
    place, term, common = (low.isin(listed(x)) for x in (GEOGRAPHIC_EXCLUSIONS, DOCUMENT_TERMS, LITHUANIAN_COMMON_WORDS))
    return F.when(place | term, -0.5).when(common, -0.3).otherwise(endings + titles)


def redaction_variants(names: DataFrame, key: str) -> DataFrame:
    """What to redact of addressed names (``salutations``): the name as it stands and, where it differs, the nominative, each with its confidence as a tag."""
    tag = lambda kind: F.format_string(f"SALUTATION_{kind}_CONF_%.2f", "confidence")
    each = F.array_compact(F.array(
        F.struct(F.col("name").alias("text"), tag("DETECTED").alias("tag")), F.when(F.col("base") != F.col("name"), F.struct(F.col("base").alias("text"), tag("BASE").alias("tag"))), F.struct(F.col("full").alias("text"), tag("FULL").alias("tag")),
    ))
    return names.select(key, F.inline(each))


def enhanced_kept(text: Column, category: Column) -> Column:
    """Whether a match of a language pattern stands: no name has a document term or a common word in it."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    return (category != "names") | ~F.exists(words, lambda w: w.isin(listed(DOCUMENT_TERMS) + listed(LITHUANIAN_COMMON_WORDS)))


def is_swift_lt(text: Column) -> Column:
    """A bank code of Lithuania; unknown banks are codes too."""
    return is_swift(text) & (F.upper(F.substring(strip(text), 5, 2)) == "LT")


def language_effect(text: Column, category: Column, near: Column) -> Column:
    """What section and name or bank code add to a confidence."""
    out = F.lit(0.0)
    where = section(near)
    for k, v in SECTION_EFFECT.items():
        out = out + F.when(where == k, v).otherwise(0.0)
    return out + F.when(category == "names", name_effect(text, near)).when((category == "swift_bic") & ~is_swift_lt(text), -0.4).otherwise(0.0)


def kept_in_context(text: Column, label: Column, near: Column) -> Column:
    """Whether a named entity stands: no city in a path, no bare ``summary`` or ``total`` as a person, no person among section words, no question word as an organization."""
    low = F.lower(near)
    path = (label == "GPE") & (near.contains("path:") | near.contains("file:") | near.contains("C:\\"))
    bare = (label == "PERSON") & F.lower(text).isin("summary", "total") & ~text.rlike(r"^\p{Lu}\p{Ll}*$")
    words = ("section", "chapter", "article", "paragraph", "clause", "item", "skyrius", "straipsnis", "dalis", "punktas", "papunktis")
    structure = (label == "PERSON") & low.rlike("|".join(words))
    question = (label == "ORG") & F.lower(text).isin("when", "where", "what", "which", "who", "how", "why", "kada", "kur", "kas", "kuris", "kaip", "kodėl")
    return ~(path | bare | structure | question)


def domain(name: Column) -> Column:
    out = F.lit("generic")
    for words, k in reversed(DOMAINS):
        out = F.when(F.lower(name).rlike(words), k).otherwise(out)
    return out
