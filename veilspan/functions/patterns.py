"""The catalogue of detection patterns."""

from __future__ import annotations

# Name and expression of the base patterns; the name is also the category.
BASE_PATTERNS = {
    "blood_group": r"(?<!\w)(?:A|B|AB|O)[\+\-](?!\w)",
    "credit_cards": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "credit_card_enhanced": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "date_yyyy_mm_dd": r"\b\d{4}-\d{2}-\d{2}\b",
    "date_yyyy_mm_dd_dots": r"\d{4}\.\d{2}\.\d{2}",
    "eleven_digit_numeric": r"\b\d{11}\b",
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "health_insurance_number": r"\b\d{6,12}\b",
    "iban_eu": r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b",
    "legal_entity_code": r"\b\d{8,9}\b",
    "lithuanian_address_generic": r"\b[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]{2,}\s+(?:g|pr|al)\.\s*\d+[A-Za-z]?(?:-\d+)?(?:,\s*LT-\d{5})?(?:,\s*[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž\s]+)?",
    "lithuanian_address_prefixed": r"Adresas:\s*[^,\n\r]+(?:g|pr|al)\.\s*[^,\n\r]+(?:,\s*LT-\d{5})?(?:,\s*[^\n\r]+)?",
    "lithuanian_business_cert": r"\bAF\d{6}-\d\b",
    "lithuanian_business_cert_alt": r"\b\d{9}\b",
    "lithuanian_car_plate": r"\b[A-Z]{3}[-\s]?\d{3}\b",
    "lithuanian_driver_license": r"\b[A-Z]{1,2}\d{6,7}[A-Z]?\b",
    "lithuanian_iban": r"\bLT\d{18}\b",
    "LITHUANIAN_PHONE_NUMBER": r"(?:\+370|8)[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{3}|\+370[\s-]?\d{3}[\s-]?\d{5}",
    "lithuanian_mobile_prefixed": r"Tel\.\s*(?:nr\.\s*:?\s*)?((?:\+370|8)[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{3}|\+370[\s-]?\d{3}[\s-]?\d{5})\b",
    "lithuanian_passport": r"\b[A-Z]{2}\d{7}\b",
    "lithuanian_personal_codes": r"\b[3-6]\d{10}\b",
    "lithuanian_phone_compact": r"\+370\d{8}\b",
    "lithuanian_phone_generic": r"((?:\+370|8)[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{3}|\+370[\s-]?\d{3}[\s-]?\d{5,})\b",
    "lithuanian_postal_code": r"\bLT-\d{5}\b",
    "lithuanian_vat_code": r"\bLT\d{9,12}\b",
    "lithuanian_vat_code_labeled": r"PVM\s+kodas:?\s*LT\d{9,12}",
    "lithuanian_city_simple": r"\b(Vilnius|Kaunas|Klaipėda|Šiauliai|Panevėžys)(?:o|je|ui|aus)?\b",
    "locations": r"\b(Vilni(?:us|aus|uje|ų)|Kaun(?:as|o|e|ą)|Klaipėd(?:a|os|oje|ą)|Šiauli(?:ai|ų|uose|us)|Panevėž(?:ys|io|yje|į))\b",
    "medical_record_number": r"\b\d{6,10}\b",
    "phone": r"\b(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "phone_international": r"\+\d{1,3}\s+\d{3}\s+\d{5,6}\b",
    "ssns": r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
    "swift_bic": r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
    "lithuanian_car_plate_contextual": r"(?i)[Vv]alst\.?\s*[Nn]r\.?\s*[:\-]?\s*([A-Z]{3}[-\s]?\d{3})\b",
    "lithuanian_name_simple": r"\b([A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+\s[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+(?:ienė|aitė|ytė|utė|ūtė|as|is|ys|us|ius|ė|a)?)\b",
    "lithuanian_name_all_caps": r"\b([A-ZČĘĖĮŠŲŪŽ]{2,}(?:IENĖ|AITĖ|YTĖ|UTĖ|ŪTĖ|AS|IS|YS|US|IUS|Ė|A))\s+([A-ZČĘĖĮŠŲŪŽ]{2,}(?:IENĖ|AITĖ|YTĖ|UTĖ|ŪTĖ|AS|IS|YS|US|IUS|Ė|A))|\b([A-ZČĘĖĮŠŲŪŽ]{2,})\s+([A-ZČĘĖĮŠŲŪŽ]{2,}(?:IENĖ|AITĖ|YTĖ|UTĖ|ŪTĖ|AS|IS|YS|US|IUS|Ė|A))\b",
    "lithuanian_name_contextual": r"(?:Draudėjas|Vardas|Pavardė|Sutartį\s+sudarė)[\s:–-]*([A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+(?:\s+[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+)*(?:ienė|aitė|ytė|utė|ūtė|as|is|ys|us|ius|ė|a))\b",
    "lithuanian_name_contextual_caps": r"(?:Draudėjas|DRAUDĖJAS|Vardas|VARDAS)[\s:–-]*([A-ZČĘĖĮŠŲŪŽ]{3,}\s+[A-ZČĘĖĮŠŲŪŽ]{3,})\b",
    "lithuanian_address_flexible": r"\b([A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]{3,}(?:io|ės)?)\s*(?:g\.|gatvė|pr\.|prospektas|al\.|alėja)?(?:\s*\d+(?:[A-Za-z]?(?:-\d+)?)?)?",
    "lithuanian_personal_code_contextual": r"(?:asmens\s+kodas|asmens/įmonės\s+kodas|A\.K\.)[\s:–-]*(\d{11})\b",
    "lithuanian_car_plate_enhanced": r"(?i)(?:valst\.?\s*nr\.?|automobilio\s+nr\.?|numeris)[\s:–-]*([A-Z]{3}[-\s]?\d{3})\b",
}

# Name, category and expression of the patterns that ignore case and replace base patterns of the same name.
LANGUAGE_PATTERNS = {
    "lithuanian_name_with_title": ("names", r"(?:Ponas|Ponia|Dr\.?|Prof\.?)\s+((?:[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+)(?:\s+[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+)?)"),
    "lithuanian_name_simple": ("names", r"\b(([A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]{3,})\s+([A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]{3,}(?:ienė|aitė|ytė|utė|ūtė|as|is|ys|us|ius|ė|a)))\b(?!\s*\d)"),
    "lithuanian_address_prefixed": ("addresses_prefixed", r"(?:Adresas|Gyv\.\s*vieta|Adresas korespondencijai):\s*([A-ZĄČĘĖĮŠŲŪŽ][^,\n]+?g\.\s*\d+[^,]*)"),
    "lithuanian_city_generic": ("locations", r"\b(Vilni(us|aus|uje|ų)|Kaun(as|o|e|ą)|Klaipėd(a|os|oje|ą)|Šiauli(ai|ų|uose|us)|Panevėž(ys|io|yje|į))\b"),
    "lithuanian_standalone_city": ("locations", r"\b(Vilnius|Kaunas|Klaipėda|Šiauliai|Panevėžys)\b"),
    "lithuanian_address_flexible": ("addresses_street", r"([A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+s?\s+(?:g\.|pr\.|al\.)\s*\d+(?:-\d+)?)"),
    "lithuanian_address_full": ("addresses_full", r"([A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+s?\s+(?:g\.|pr\.|al\.)\s*\d+(?:-\d+)?,\s*LT-\d{5},?\s*[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+)"),
    "lithuanian_company_full": ("organizations", r'(UAB|AB|VšĮ|MB|IV)\s+"([^"]+)"'),
    "lithuanian_personal_code_labeled": ("lithuanian_personal_codes", r"(?:\(?\s*(?:asmens\s+kodas|a\.k\.?|AK)\s*:?\s*)\s*(\d{11})\s*\)?"),
    "lithuanian_phone_formatted": ("lithuanian_phones_generic", r"(?:Tel\.|Telefonas|Mob\.):\s*(\+370\s+\d{1,2}\s+\d{3}\s+\d{4,5})"),
    "lithuanian_email_labeled": ("emails", r"(?:El\.\s*paštas|Elektroninis\s+paštas):\s*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"),
    "lithuanian_bank_account": ("financial_enhanced", r"(?:Banko\s+sąskaita|Sąskaitos\s+numeris):\s*(LT\d{2}\s*\d{4}\s*\d{4}\s*\d{4}\s*\d{4})"),
    "lithuanian_vat_labeled": ("lithuanian_vat_codes", r"(?:PVM\s+kodas|PVM\s+Nr\.):\s*(LT\d{9,12})"),
    "lithuanian_date_full": ("dates_yyyy_mm_dd", r"(\d{4}\s+m\.\s+(?:sausio|vasario|kovo|balandžio|gegužės|birželio|liepos|rugpjūčio|rugsėjo|spalio|lapkričio|gruodžio)\s+\d{1,2}\s+d\.)"),
}

# Specificity of a pattern name in scoring and of a category in text-level duplicates; all others have 50.
PATTERN_SPECIFICITY = {
    "lithuanian_personal_codes": 100, "lithuanian_personal_code_contextual": 95, "lithuanian_vat_codes": 90, "emails": 85, "lithuanian_phones_compact": 80, "lithuanian_phones_generic": 75,
    "phones": 70, "financial_enhanced": 65, "credit_cards": 60, "dates_yyyy_mm_dd": 55, "healthcare_medical": 50, "identity_documents": 45, "automotive": 40, "legal_entities": 35,
    "addresses_prefixed": 30, "locations": 25, "names": 26, "organizations": 20, "eleven_digit_numeric": 10, "ssns": 5,
}
CATEGORY_SPECIFICITY = {
    "lithuanian_personal_codes": 100, "lithuanian_vat_codes": 95, "emails": 90, "lithuanian_phones_compact": 85, "lithuanian_phones_generic": 83, "mobile_phones_prefixed": 80, "phones_international": 75,
    "phones": 70, "financial_enhanced": 65, "credit_cards": 60, "dates_yyyy_mm_dd": 55, "healthcare_medical": 50, "identity_documents": 45, "automotive": 40, "legal_entities": 35,
    "addresses_prefixed": 30, "locations": 25, "names": 26, "organizations": 20, "eleven_digit_numeric": 10, "ssns": 5,
}
DEFAULT_SPECIFICITY = 50


# What the built-in set, used where no settings can be read, has instead of the base patterns; None leaves one out.
FALLBACK = {
    "lithuanian_mobile_prefixed": r"Tel\.\s*(?:nr\.\s*:?\s*)?\+370\s+\d{3}\s+\d{5}\b",
    "lithuanian_phone_generic": r"\+370\s+\d{3}\s+\d{5}\b",
    "lithuanian_iban": r"\bLT\d{2}(?:\s?\d{4}){4}\b",
    "blood_group": r"(?<!\w)(?:A|B|AB|O)[+\-](?!\w)",
    "lithuanian_car_plate_enhanced": r"(?i)(?:valst\.?\s*nr\.?|automobilio\s+nr\.?|numeris)[:–-]*([A-Z]{3}[-\s]?\d{3})\b",
    "lithuanian_name_all_caps": r"\b([A-ZČĘĖĮŠŲŪŽ]{2,}(?:IENĖ|AITĖ|YTĖ|UTĖ|ŪTĖ|AS|IS|YS|US|IUS|Ė|A)\s+[A-ZČĘĖĮŠŲŪŽ]{2,}(?:IENĖ|AITĖ|YTĖ|UTĖ|ŪTĖ|AS|IS|YS|US|IUS|Ė|A))|\b([A-ZČĘĖĮŠŲŪŽ]{2,}\s+[A-ZČĘĖĮŠŲŪŽ]{2,}(?:IENĖ|AITĖ|YTĖ|UTĖ|ŪTĖ|AS|IS|YS|US|IUS|Ė|A))\b",
    "lithuanian_name_contextual": r"(?:Draudėjas|Vardas|Pavardė|Sutartį\s+sudarė)[:–-]?\s*([A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+(?:\s+[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+)*?)(?=\s*\n|\s*$|\s*,|\s*\.|asmens\s+kodas|tel\.|phone|email)",
    "lithuanian_name_simple": r"\b([A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+\s+[A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]+(?:ienė|aitė|ytė|utė|ūtė|as|is|ys|us|ius|ė|a)?)\b",
    "lithuanian_name_contextual_caps": r"(?:Draudėjas|DRAUDĖJAS|Vardas|VARDAS)[:–-]?\s*([A-ZČĘĖĮŠŲŪŽ]{3,}\s+[A-ZČĘĖĮŠŲŪŽ]{3,})\b",
    "lithuanian_address_flexible": r"\b([A-ZĄČĘĖĮŠŲŪŽ][a-ząčęėįšųūž]{3,}(?:io|ės)?\s*(?:g\.|gatvė|pr\.|prospektas|al\.|alėja)?(?:\s*\d+(?:[A-Za-z]?(?:-\d+)?)?))",
    "lithuanian_personal_code_contextual": r"(?:asmens\s+kodas|asmens/įmonės\s+kodas|A\.K\.)[:–-]?\s*(\d{11})\b",
    "ssn": r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "lithuanian_license_plate": r"\b[A-Z]{3}[-\s]?\d{3}\b",
    "UNKNOWN_ID": r"\b[A-Z]{2,5}(?:-|\s)?\d{4,}\b",
    "credit_cards": None, "iban_eu": None, "lithuanian_car_plate": None, "LITHUANIAN_PHONE_NUMBER": None, "lithuanian_city_simple": None, "ssns": None,
}


def catalogue(strict_case: bool = False, fallback: bool = False) -> list[tuple[str, str, str, bool]]:
    """(name, category, expression, ignore case) of the patterns in force, in order.

    With ``strict_case`` the language patterns heed case, so that two common words are no name; ``fallback`` takes the
    built-in base set.
    """
    base = {k: p for k, p in (BASE_PATTERNS | FALLBACK).items() if p is not None and FALLBACK.get(k, p) is not None} if fallback else BASE_PATTERNS
    merged = {k: (k, p, False) for k, p in base.items()}
    merged |= {k: (c, p, not strict_case) for k, (c, p) in LANGUAGE_PATTERNS.items()}
    return [(k, *v) for k, v in merged.items()]


#: Classes as the JVM writes them, outside and inside brackets: of all scripts, without its slow Unicode mode.
CLASSES = {"d": (r"\p{Nd}", r"\p{Nd}"), "s": (r"[\s\x85\p{Z}]", r"\s\x85\p{Z}"), "w": (r"[\p{L}\p{N}_]", r"\p{L}\p{N}_"), "b": (r"(?U:\b)", r"\b")}


def jvm(expression: str, ignore_case: bool = False) -> str:
    """The expression for the JVM with letters, digits, blanks and word ends of all scripts."""
    if expression.startswith("(?i)"):
        expression, ignore_case = expression[4:], True
    out, inside, k = [], False, 0
    while k < len(expression):
        c = expression[k]
        if c == "\\":
            name = expression[k + 1 : k + 2]
            out.append(CLASSES[name][inside] if name in CLASSES else c + name)
            k += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        k += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)
