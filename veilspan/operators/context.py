"""Where in a document a detection stands, and what that says about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.terms import GEOGRAPHIC_EXCLUSIONS

# Patterns of each section in the order they are tried; those of ANCHORED only count on the line itself.
SECTIONS = {
    "form_field": (r"^\s*(Name|Vardas)\s*:\s*", r"^\s*(Address|Adresas)\s*:\s*", r"^\s*(Phone|Telefonas)\s*:\s*", r"^\s*(Email|El\. paštas)\s*:\s*", r"^\s*(Date of Birth|Gimimo data)\s*:\s*", r"^\s*(Personal Code|Asmens kodas)\s*:\s*"),
    "footer": (r"(Page|Puslapis)\s+\d+(?:\s+of\s+\d+)?", r"\b(www\.[\w\.-]+|https?://[\w\.-]+)\b", r"(©|Copyright|Autorių teisės)\s+\d{4}", r"^[\s\-_]*Confidential[\s\-_]*$", r"^[\s\-_]*Internal Use Only[\s\-_]*$"),
    "table_header": (
        r"^\s*(Description|Aprašymas|Item|Prekė|Quantity|Kiekis|Unit Price|Vieneto kaina|Total|Iš viso)(?!\s*:[^\n]*$)", r"^\s*(Date|Data|Time|Laikas|Period|Laikotarpis)(?!\s*:[^\n]*$)",
        r"^\s*(Number|Numeris|Code|Kodas|ID|Reference|Nuoroda)(?!\s*:[^\n]*$)", r"^\s*(Status|Būsena|Action|Veiksmas|Notes|Pastabos)\b",
    ),
    "header": (
        r"^\s*(CERTIFICATE|PAŽYMĖJIMAS|AGREEMENT|SUTARTIS|INVOICE|SĄSKAITA FAKTŪRA)(?:\s+|$)", r"^\s*(INSURANCE|DRAUDIMO|POLICY|POLISAS)(?:\s+|$)",
        r"^\s*(COMPANY|ĮMONĖS|ORGANIZATION|ORGANIZACIJOS)(?:\s+DATA|DUOMENYS)?(?:\s+|$)", r"^\s*(DOCUMENT|DOKUMENTAS)(?!\s+(?:Number|Numeris|No\.|Nr\.))(\s+.*)?$",
    ),
    "legal_text": (r"(Article|Straipsnis)\s+\d+", r"(Section|Skyrius)\s+\d+", r"(Paragraph|Paragrafas)\s+\d+", r"(Clause|Punktas)\s+\d+"),
}
ANCHORED = ("form_field", "table_header")
# What stands before or after a detection and tells against or for it, and what a section adds.
AGAINST = {"person_name": ("Section|Skyrius|Chapter", "Article|Straipsnis", "Paragraph|Paragrafas", r"Figure|Pav\.", "Table|Lentelė", "Appendix|Priedas"), "organization": ("When|Kada", "Where|Kur", "What|Kas", "Which|Kuris", "How|Kaip")}
BEFORE = {
    "person_name": (r"(Mr\.|Mrs\.|Ms\.|Dr\.)\s+", r"(Ponas|Ponia|Daktaras)\s+", r"(Name|Vardas):\s*", r"(Signature|Parašas):\s*"),
    "organization": (r"(Company|Įmonė):\s*", r"(Organization|Organizacija):\s*", r"(Employer|Darbdavys):\s*"),
    "email": (r"(Email|El\. paštas):\s*", r"(Contact|Kontaktai):\s*", r"(Send to|Siųsti)\s+"),
    "phone": (r"(Phone|Telefonas):\s*", r"(Mobile|Mobilus):\s*", r"(Call|Skambinti)\s+"),
}
AFTER = {"person_name": (r"\s+(born|gimęs|gimusi)",), "organization": (r"\s+(Ltd\.|UAB|AB|VšĮ)",)}
SECTION_EFFECT = {"header": -0.1, "footer": -0.2, "table_header": -0.3, "form_field": 0.2, "legal_text": -0.1}
BASE = 0.7
# Words that head a part of a document rather than name a person; what tells that a context is about the document itself.
STRUCTURAL = ("section", "skyrius", "chapter", "article", "straipsnis", "paragraph", "paragrafas", "figure", "pav.", "table", "lentelė", "appendix", "priedas")
METADATA = (
    r"(Document|Dokumentas)\s+(Number|Numeris|Nr\.)", r"(Page|Puslapis)\s+\d+", r"(Version|Versija)\s+\d+", r"(Date|Data):\s*\d", r"(Reference|Nuoroda):\s*[A-Z0-9]", r"(File|Failas):\s*\w+\.(pdf|doc|docx)",
)
QUESTIONS = ("when", "where", "what", "which", "how")


def _any(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike("(?iumU)" + p) for p in patterns])


def line_at(text: Column, position: Column) -> Column:
    """The line that holds a position counted from 0."""
    before = F.element_at(F.split(F.substring(text, F.lit(1), position), "\n", -1), -1)
    return F.concat(before, F.element_at(F.split(F.substring(text, position + 1, F.length(text)), "\n", -1), 1))


def section(text: Column, position: Column, window: int = 100) -> Column:
    """The first section whose pattern fits the line at the position, else what is around it; null if none does."""
    line = line_at(text, position)
    near = F.substring(text, F.greatest(F.lit(1), position + 1 - window), F.lit(2 * window))
    out = F.lit(None).cast("string")
    for k, p in reversed([x for x in SECTIONS.items() if x[0] not in ANCHORED]):
        out = F.when(_any(near, p), k).otherwise(out)
    for k, p in reversed(SECTIONS.items()):
        out = F.when(_any(line, p), k).otherwise(out)
    return out


def quoted(text: Column) -> Column:
    """A text as a literal in an expression."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def is_metadata(context: Column) -> Column:
    return reduce(lambda a, b: a | b, [context.rlike("(?iuU)" + p) for p in METADATA])


def context_score(text: Column, category: Column, context: Column, section_: Column) -> Column:
    """BASE, less for places, headings, misleading words before and metadata, more for titles and labels, within 0 and 1."""
    near = lambda before, after: F.rlike(context, F.concat(F.lit("(?iuU)" + before), quoted(text), F.lit(after)))
    zero = F.lit(0.0)
    heading = (category == "person_name") & F.lower(text).isin(*STRUCTURAL)
    numbered = F.rlike(context, F.concat(F.lit(r"(?iumU)^\s*"), quoted(text), F.lit(r"\s*\d+"))) | F.coalesce(section_.isin("header", "table_header"), F.lit(False))
    total = F.lit(BASE) + F.when((category == "person_name") & text.isin(GEOGRAPHIC_EXCLUSIONS), -0.5).otherwise(zero) + F.when(heading & numbered, -0.4).otherwise(zero)
    for kind, words in AGAINST.items():
        total += F.when((category == kind) & ~heading, sum((F.when(near(f"({w})\\s+", ""), -0.3).otherwise(zero) for w in words), zero)).otherwise(zero)
    for kind in BEFORE:
        signs = [near(p, "") for p in BEFORE[kind]] + [near("", p) for p in AFTER.get(kind, ())]
        total += F.when(category == kind, sum((F.when(s, 0.2).otherwise(zero) for s in signs), zero)).otherwise(zero)
    for k, v in SECTION_EFFECT.items():
        total += F.when(section_ == k, v).otherwise(zero)
    total += F.when(is_metadata(context), -0.4).otherwise(zero)
    return F.least(F.lit(1.0), F.greatest(zero, total))


def flags(text: Column, category: Column, context: Column, section_: Column, score: Column) -> Column:
    """What speaks against a detection, in a fixed order."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.array_compact(F.array(
        F.when(score < 0.4, "low_confidence"), F.when(section_.isin("header", "footer", "table_header"), "structural_element"), F.when(is_metadata(context), "document_metadata"),
        F.when((category == "person_name") & (words > 3), "overly_long_name"), F.when((category == "organization") & F.lower(text).isin(*QUESTIONS), "common_word"),
    ))
