"""Personal information in free text: found by the tagger, checked, and replaced by typed placeholders."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.lookalikes import Former
from veilspan.llm.tagger import load, spans, tag
from veilspan.session import spread

#: Texts that are decoded together.
TOGETHER = 4_000
#: Line between the values of one JSON text.
BREAK = "\n"
#: Signs that do not end a word of the type.
INSIDE = {"email": "@._+-", "phone": "+-", "identity_number": "-", "street_address": "-", "person_name": "-_"}
CHECKS = {
    "email": regex.compile(r"(?i)\w@\w|\w\s*[(\[]at[)\]]\s*\w|\w\s+at\s+\w.*(?:dot|[.])"),
    "phone": regex.compile(r"(?:\d\D*){8,15}$"),
    "identity_number": regex.compile(r"^\D{0,3}(?:[1-9]\D?\d{6}\D?\d{4}|\d{3}\D?\d{2}\D?\d{4}|\p{L}{2}\D?\d{7})\D{0,2}$"),
    "street_address": regex.compile(r"(?s)^(?=.*\p{L}{3})(?=.*\d)"),
    "person_name": regex.compile(r"^(?:\D*\p{L}\D*){4,}$"),
}


def strings(value) -> Iterator[str]:
    """Every text value in a decoded JSON value."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, (dict, list)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from strings(v)


def decoded(text: str):
    """The JSON object or list in a text, else None."""
    if text[:1] in "{[":
        try:
            return json.loads(text)
        except ValueError:
            return None
    return None


def as_read(text: str, former: Former) -> str:
    """What a reader sees of one value: entities and percent signs resolved, characters in their everyday form."""
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "%40" in text:
        text = text.replace("%40", "@")
    return former.form(text)


def checked(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Whole words without blank ends, in order and apart, whose characters can be of their type."""
    out, last = [], 0
    for a, b, kind in found:
        a = max(a, last)
        inner = INSIDE[kind]
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a == b:
            continue
        while a > last and (text[a - 1].isalnum() or text[a - 1] in inner) and (text[a].isalnum() or text[a] in inner):
            a -= 1
        while b < len(text) and (text[b].isalnum() and (text[b - 1].isalnum() or text[b - 1] in inner) or text[b] in inner and text[b + 1 : b + 2].isalnum()):
            b += 1
        if CHECKS[kind].search(text[a:b]):
            out.append((a, b, kind))
            last = b
    return out


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def replaced(value, values: Iterator[str]):
    """A decoded JSON value with its text values taken from ``values`` in turn."""
    if isinstance(value, str):
        return next(values)
    if isinstance(value, dict):
        return {k: replaced(v, values) for k, v in value.items()}
    return [replaced(v, values) for v in value] if isinstance(value, list) else value


def find_personal(df: DataFrame, key: Column, *fields: str, weights: dict | None = None) -> DataFrame:
    """One row per text that holds personal information: ``record_id, field_name, pii_types, masked``.

    Each text, of JSON each text value, is read as a reader sees it; the tagger decodes all
    of it, whatever its length; spans that cannot be of their type are dropped.  In
    ``masked`` they are replaced by ``[TYPE]`` in the everyday form of the text, JSON stays
    JSON.  Null and empty texts have none; repeated rows are all reported.
    """
    weights, former = weights or load(), Former.everyday()
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields]))
    texts = df.select(key.cast("bigint").alias("record_id"), long.alias("f")).select("record_id", "f.field_name", "f.text").where("text is not null and text != ''")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), TOGETHER):
                f = whole.iloc[at : at + TOGETHER]
                values = [decoded(t) for t in f["text"]]
                parts = [list(strings(v)) if v is not None else [t] for v, t in zip(values, f["text"])]
                read = [[as_read(p, former) for p in some] for some in parts]
                different = sorted({p for some in read for p in some if p})
                found = {p: checked(p, spans(tags)) for p, tags in zip(different, tag(weights, different))}
                found[""] = []
                kinds = [sorted({k for p in some for _, _, k in found[p]}) for some in read]
                out = []
                for v, some in zip(values, read):
                    new = [masked(p, found[p]) for p in some]
                    out.append(json.dumps(replaced(v, iter(new)), ensure_ascii=False) if v is not None else new[0])
                keep = np.array([bool(k) for k in kinds])
                yield pd.DataFrame({"record_id": f["record_id"], "field_name": f["field_name"], "pii_types": kinds, "masked": out})[keep]

    return spread(texts).mapInPandas(run, "record_id bigint, field_name string, pii_types array<string>, masked string")
