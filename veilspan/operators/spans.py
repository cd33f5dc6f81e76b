"""Spans of patterns in text, their resolution, and redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.patterns import CATEGORY_SPECIFICITY, DEFAULT_SPECIFICITY, PATTERN_SPECIFICITY, catalogue, jvm
from veilspan.operators.learning import needed
from veilspan.session import spread

SPAN = "array<struct<pattern:string,category:string,ord:int,n:int,full:string,full_start:int,text:string,start:int,end:int,specificity:int>>"


#: Marks set around matches; where a text has them, other characters stand in their place.
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ufffd"


def literal(expression: str, ignore_case: bool) -> str:
    """The longest run of characters that every match holds, so that a text without it need not be searched; none where case is ignored."""
    return "" if ignore_case or expression.startswith("(?i)") else needed(expression)


def matches(text: Column, expression: str, ignore_case: bool) -> Column:
    """How often a pattern matches."""
    n = F.regexp_count(text, F.lit(jvm(expression, ignore_case)))
    word = literal(expression, ignore_case)
    return F.when(F.contains(text, F.lit(word)) | text.isNull(), n).otherwise(0) if word else n


def pattern_spans(text: Column, name: str, category: str, expression: str, ignore_case: bool, ord_: int) -> Column:
    """All matches of one pattern as an array of spans, with offsets in characters.

    The pattern runs once: every match is marked, and offsets are the lengths of what
    stands before the marks.  Of a pattern with groups the first group that took part is
    the text, else the match.
    """
    p = jvm(expression, ignore_case)
    groups = re.compile(expression).groups
    score = PATTERN_SPECIFICITY.get(name, DEFAULT_SPECIFICITY)
    marked = F.split(F.regexp_replace(text, p, f"{OPEN}$0{CLOSE}"), OPEN, -1)

    def spans(x: Column) -> Column:
        parts, ends = x["parts"], x["ends"]

        def span(i: Column) -> Column:
            m = F.substring_index(F.get(parts, i), CLOSE, 1)
            # Every part but the first has one mark of its own.
            start = F.get(ends, i - 1) - i + 1
            taken = F.coalesce(*[F.nullif(F.regexp_extract(m, p, g), F.lit("")) for g in range(1, groups + 1)], m) if groups else m
            at = start + F.greatest(F.instr(m, taken), F.lit(1)) - 1
            return F.struct(
                F.lit(name).alias("pattern"), F.lit(category).alias("category"), F.lit(ord_).alias("ord"), (i - 1).cast("int").alias("n"), m.alias("full"), start.cast("int").alias("full_start"),
                taken.alias("text"), at.cast("int").alias("start"), (at + F.length(taken)).cast("int").alias("end"), F.lit(score).alias("specificity"),
            )

        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), span)).otherwise(F.array().cast(SPAN))

    def ends(parts: Column) -> Column:
        zero = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("last"))
        step = lambda a, p: F.struct(F.array_append(a["all"], a["last"] + F.length(p)).alias("all"), (a["last"] + F.length(p)).alias("last"))
        return F.aggregate(parts, zero, step, lambda a: a["all"])

    # Bound once, step by step; inside the function the pattern would run again for every match.
    bound = F.transform(F.array(marked), lambda m: F.struct(m.alias("parts"), ends(m).alias("ends")))
    found = F.flatten(F.transform(bound, spans))
    return F.when(F.contains(text, F.lit(word)), found).otherwise(F.array().cast(SPAN)) if (word := literal(expression, ignore_case)) else found


def once(value: Column, f) -> Column:
    """``f(value)`` where f names its argument more than once: bound as a variable, so that it is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def doc_spans(df: DataFrame, key: str, text: str, patterns: list[tuple[str, str, str, bool]] | None = None) -> DataFrame:
    """``key, whole, spans``: each text with all its matches as one array.  A narrow scan: one pass, no join, no shuffle.

    Where a text has the marks themselves, other characters stand in for them while it is searched; offsets are the
    same, and what is reported is the text's own.  Null texts have null spans.
    """
    patterns = patterns or catalogue()
    spans = F.concat(*[pattern_spans(F.col("_t"), *p, i) for i, p in enumerate(patterns)])
    stood = F.translate(text, OPEN + CLOSE, OTHER + OTHER).alias("_t")
    found = spread(df.select(key, F.col(text).alias("whole"), stood)).select(key, "whole", spans.alias("spans"))
    part = lambda a, n: F.substring("whole", a + 1, n)
    own = lambda x: F.when(
        F.col("whole").rlike(f"[{OPEN}{CLOSE}]"),
        F.transform(x, lambda s: s.withField("full", part(s["full_start"], F.length(s["full"]))).withField("text", part(s["start"], s["end"] - s["start"]))),
    ).otherwise(x)
    return found.select(key, "whole", once(F.col("spans"), own).alias("spans"))


def flat(spans: Column) -> Column:
    """One row per span.  Taken from an expression of its own: of a bare column the optimizer would compute every field apart, each with all the patterns."""
    return F.inline(F.filter(spans, lambda s: s["n"] >= 0))


def find_spans(df: DataFrame, key: str, text: str, patterns: list[tuple[str, str, str, bool]] | None = None) -> DataFrame:
    """One row per match: ``key`` and the fields of the span."""
    return doc_spans(df, key, text, patterns).select(key, flat(F.col("spans")))


def category_counts(df: DataFrame, text: str, patterns: list[tuple[str, str, str, bool]], *by: str) -> DataFrame:
    """Matches per category (and ``by``) without offsets: counts are enough for reports."""
    one = F.array(*[F.struct(F.lit(c).alias("category"), matches(F.col(text), p, i).alias("n")) for _, c, p, i in patterns])
    rows = spread(df.where(F.col(text).isNotNull()).select(*by, text)).select(*by, F.explode(one).alias("x")).where("x.n > 0")
    return rows.groupBy(*by, F.col("x.category").alias("category")).agg(F.sum("x.n").cast("bigint").alias("matches"))


def base_confidence(specificity: Column) -> Column:
    return 0.5 + F.least(F.lit(0.4), specificity / 250.0)


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "VERY_HIGH").when(confidence >= 0.8, "HIGH").when(confidence >= 0.6, "MEDIUM").when(confidence >= 0.4, "LOW").otherwise("VERY_LOW")


def sweep(spans: Column, start: str = "start", end: str = "end") -> Column:
    """Of spans sorted by start and then longest first, each that begins at or after the last kept one's end."""
    def run(x: Column) -> Column:
        zero = F.struct(F.filter(x, lambda _: F.lit(False)).alias("kept"), F.lit(-1).alias("last"))
        step = lambda acc, s: F.when(s[start] >= acc["last"], F.struct(F.concat(acc["kept"], F.array(s)).alias("kept"), s[end].cast("int").alias("last"))).otherwise(acc)
        return F.aggregate(x, zero, step, lambda acc: acc["kept"])

    return once(spans, run)


def swept(spans: Column) -> Column:
    """Overlapping spans of one document: earliest first, longest first among those."""
    return sweep(ordered(spans, lambda s: s["start"], lambda s: -s["end"], lambda s: s["ord"], lambda s: s["n"]))


def swept_whole(spans: Column) -> Column:
    """The same on the whole matches, with their end as ``full_end``; specificity only decides between equal matches."""
    ended = F.transform(spans, lambda s: s.withField("full_end", s["full_start"] + F.length(s["full"])))
    keys = (lambda s: s["full_start"], lambda s: -F.length(s["full"]), lambda s: -s["specificity"], lambda s: s["ord"], lambda s: s["n"])
    return sweep(ordered(ended, *keys), "full_start", "full_end")


def longest(spans: Column, confidence: str = "confidence") -> Column:
    """Longest first, then most confident; kept if it touches nothing kept before."""
    keys = (lambda s: s["start"] - s["end"], lambda s: -s[confidence], lambda s: s["ord"], lambda s: s["n"])
    clash = lambda acc, s: F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    run = lambda x: F.aggregate(x, F.filter(x, lambda _: F.lit(False)), lambda acc, s: F.when(clash(acc, s), acc).otherwise(F.concat(acc, F.array(s))))
    return once(ordered(spans, *keys), run)


def ordered(spans: Column, *keys) -> Column:
    """Sorted by expressions of the span, given as functions; ties keep no order of their own, so end with something unique."""
    return F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(*[k(s).alias(f"k{i}") for i, k in enumerate(keys)], s.alias("s")))), lambda x: x["s"])


def _gathered(df: DataFrame, key: str, resolve) -> DataFrame:
    """Spans that stand in rows, gathered by document and resolved."""
    grouped = df.groupBy(key).agg(F.collect_list(F.struct(*[c for c in df.columns if c != key])).alias("s"))
    return grouped.select(key, F.inline(resolve(F.col("s"))))


def dedupe_sweep(df: DataFrame, key: str) -> DataFrame:
    return _gathered(df, key, swept)


def dedupe_full_match(df: DataFrame, key: str) -> DataFrame:
    return _gathered(df, key, swept_whole)


def dedupe_longest(df: DataFrame, key: str, confidence: str = "confidence") -> DataFrame:
    return _gathered(df, key, lambda s: longest(s, confidence))


def dedupe_text(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per document and text: that of the most specific category; of equals the later one."""
    score = F.lit(DEFAULT_SPECIFICITY)
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_SPECIFICITY.items() for x in kv])
    rows = df.withColumns({"_score": F.coalesce(F.try_element_at(table, F.col("category")), score), "_norm": F.lower(F.trim("text"))})
    best = F.max_by(F.struct(*df.columns), F.struct("_score", "category", order))
    return rows.where("text is not null").groupBy(key, "_norm").agg(best.alias("b")).select("b.*")


def redact(text: Column, expression: str, ignore_case: bool, by: str) -> Column:
    """Every match replaced; ``by`` is taken literally."""
    return F.regexp_replace(text, jvm(expression, ignore_case), by.replace("\\", "\\\\").replace("$", "\\$"))


def redact_words(text: Column, words: list[str], by: str = "[REDACTED]") -> Column:
    """Every word of a list replaced, longer ones first."""
    if not words:
        return text
    return redact(text, "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))), False, by)


def overlay(text: Column, spans: Column, mark) -> Column:
    """The text with disjoint, sorted spans replaced by ``mark(span)``."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark(s)).alias("out"), s["end"].cast("int").alias("at"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
