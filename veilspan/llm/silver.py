"""Labelled spans to train the tagger on: stored detections found in their context, and patterns for what nobody labelled."""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex

from veilspan.llm.tagger import TYPES

#: Type of each category of stored detections; all other categories are outside.
CATEGORY_TYPES = {"names": "person_name", "emails": "email", "phones": "phone", "personalcodes": "identity_number", "ssns": "identity_number", "passports": "identity_number", "addresses": "street_address"}
EDGE = " \t\r\n\"'()[]{}<>.,;:!?-_„“"
UP, LOW = r"\p{Lu}", r"\p{L}"
AT = r"(?:@|\s*[(\[]at[)\]]\s*|\s+at\s+)"
DOT = r"(?:\.|\s*[(\[](?:dot|\.)[)\]]\s*|\s+dot\s+)"
EMAIL = rf"(?i:[\w+\-]+(?:{DOT}[\w+\-]+)*{AT}[\w\-]+(?:{DOT}[\w\-]+)*{DOT}(?:example|test|lt|com|eu|net|org|de))(?!\w)"
PHONE = r"(?<![\w/\-])(?:(?:\+|00)\d{2,3}[\s\d().\-_/]{6,18}\d|\(8-\d{3}\)[\s_]*\d{5}|8[\s_\-]\d{3}[\s_\-]\d{2}[\s_\-]\d{3}|\(\d{3}\)[\s_]*\d{3}-?\d{4})(?!\w)"
IDENTITY = r"(?<![\w/+\-])(?:[1-6]\d{10}|[1-6][\s_\-]\d{6}[\s_\-]\d{4}|[1-6]\d{6}[\s_\-]\d{4}|\d{3}[\-/]\d{2}[\-/]\d{4}|(?!LT|SF)[A-Z]{2}[\s_]?\d{7})(?![\w/]|-\d)"
STREET = rf"{UP}{LOW}+(?:\s+(?:g|pr|al|pl)\.?|\s+gatvė)\s*\d+(?:\s*-\s*\d+|,?\s*but\.?\s*\d+)?|(?<![\d\-/.])\d{{1,3}}[\s_]+{UP}{LOW}+[\s_]+(?:Road|Close|Mews|Avenue|Lane|Street)\b"
CITY = rf"(?:,\s*(?:LT-\d{{5}}\s+)?{UP}\p{{Ll}}+(?![\w]))?"
TITLES = r"(?:p\.|ponas|ponia|Ms|Mr|Mrs|Dr\.)"


def given_names(texts: list[str], least: int = 6) -> list[str]:
    """The words that stand beside many different family names."""
    beside = Counter(w for words in {frozenset(regex.findall(r"\p{L}{3,}", t.title())) for t in texts} for w in words)
    return sorted(w for w, n in beside.items() if n >= least)


class Labeller:
    """Tags by pattern; given names come from stored detections of names."""

    def __init__(self, names: list[str]) -> None:
        stems = sorted({regex.sub(r"(?:as|is|ys|us|a|ė)$", "", n) for n in names if len(n) > 3}, key=len, reverse=True)
        given = rf"(?:{'|'.join(map(regex.escape, stems))})(?:i?as|is|ys|i?us|a|ė|i?ui|čiui|ai|ei)?"
        family = r"\p{L}{5,}(?:-\p{L}{5,})?"
        upper = r"(?-i:\p{Lu})"
        self.names = regex.compile(rf"(?i)(?<![\p{{L}}„])(?:{given}[\s_\-]+{upper}{family}|{upper}{family},?[\s_]+{given}|{upper}\.[\s_]*{upper}{family})(?![\p{{L}}\d])")
        kinds = (("email", EMAIL), ("street_address", f"(?:{UP}\\p{{Ll}}+,\\s*)?(?:{STREET}){CITY}"), ("phone", PHONE), ("identity_number", IDENTITY))
        self.kinds = [(k, regex.compile(p)) for k, p in kinds]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        taken = np.zeros(len(text) + 1, bool)
        out = []
        for kind, p in [*self.kinds, ("person_name", self.names)]:
            for m in p.finditer(text):
                if not taken[m.start() : m.end()].any():
                    taken[m.start() : m.end()] = True
                    out.append((m.start(), m.end(), kind))
        return out


def to_tags(n: int, found: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(n, np.int8)
    for a, b, kind in found:
        k = TYPES.index(kind)
        tags[a:b] = 2 * k + 2
        tags[a] = 2 * k + 1
    return tags


def stored(text: str, detection: str, category: str, labeller: Labeller) -> list[tuple[int, int, str]] | None:
    """The spans of a text that holds a stored detection: what the detection says, and patterns for the rest."""
    core = detection.strip(EDGE)
    at = text.lower().find(core.lower()) if len(core) > 3 else -1
    if at < 0 or len(text.lower()) != len(text):
        return None
    kind = CATEGORY_TYPES.get(category)
    a, b = at, at + len(core)
    rest = [s for s in labeller.spans(text) if s[1] <= a or s[0] >= b]
    if kind == "person_name":
        core = regex.sub(rf"^{TITLES}[\s_]*", "", text[a:b])
        a = b - len(core)
    if kind == "email" and not any(s[2] == kind and s[0] <= a and s[1] >= b for s in labeller.spans(text)):
        return None if "@" not in core else rest + [(a, b, kind)]
    return rest + ([(a, b, kind)] if kind else [s for s in labeller.spans(text) if s[0] < b and s[1] > a] if category == "contactblocks" else [])


def disguised(text: str, found: list[tuple[int, int, str]], rng) -> tuple[str, list[tuple[int, int, str]]]:
    """The text in another spelling, with its spans: addresses spelled out, other case, other blanks."""
    at_sign, dot = rng.choice([("@", "."), (" at ", " dot "), (" (at) ", "."), ("[at]", "."), ("@", "[.]"), (" (at) ", "[.]"), ("(at)", "(dot)"), (" [at] ", " [dot] ")])
    spell = rng.random() < 0.6
    case = rng.choice([str] * 6 + [str.upper, str.lower, str.swapcase, str.title])
    blank = rng.choice([" "] * 8 + ["  ", "\t", "\n", "_", " \t"])
    out, spans, size = [], [], 0
    edges = sorted({0, len(text), *(x for a, b, _ in found for x in (a, b))})
    kinds = {(a, b): k for a, b, k in found}
    for a, b in zip(edges, edges[1:]):
        piece = text[a:b]
        kind = kinds.get((a, b))
        if kind == "email":
            if spell and "@" in piece:
                user, _, host = piece.partition("@")
                piece = user + at_sign + host.replace(".", dot)
        elif blank != " ":
            piece = piece.replace(" ", blank)
        new = case(piece)
        piece = new if len(new) == len(piece) else piece
        out.append(piece)
        if kind:
            spans.append((size, size + len(piece), kind))
        size += len(piece)
    return "".join(out), spans


def joined(parts: list[tuple[str, list[tuple[int, int, str]]]], by: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Several texts in a row."""
    text, spans = "", []
    for k, (t, found) in enumerate(parts):
        text += by if k else ""
        spans += [(a + len(text), b + len(text), kind) for a, b, kind in found]
        text += t
    return text, spans
