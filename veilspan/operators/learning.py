"""Patterns learned from feedback and checked against a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _casefix, _constants, _parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.patterns import DEFAULT_SPECIFICITY
from veilspan.operators.quality import keep_best
from veilspan.session import spread

#: A learned pattern is kept at this precision or above.
LEAST_PRECISION = 0.95
#: Learned expressions that are searched together in one pass over the texts.
BLOCK = 20_000
FOUND = "pattern string, category string, ord int, n int, full string, full_start int, text string, start int, end int, specificity int, confidence double"
WORD = r"(?U)[\p{L}\p{N}_]+"


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.lower(w))


def phrase_hits(corpus: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(phrase, hits, texts): whole-word occurrences of phrases in a corpus, by an equi-join.

    A phrase is looked up by its longest word among the words of each text, instead of
    trying every phrase on every text; what meets is then compared in full.  Repeated
    texts are searched once and counted as often as they are there.
    """
    wanted = phrases.select(F.col(phrase).alias("phrase")).where("phrase is not null and phrase != ''").distinct()
    longest = F.array_max(F.transform(_words(F.col("phrase")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    wanted = wanted.withColumn("word", longest["w"]).where("word is not null")
    texts = corpus.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("times"))
    keyed = texts.select("text", "times", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    met = keyed.join(wanted, "word").where(F.col("text").contains(F.col("phrase")))
    quoted = F.concat(F.lit(r"(?U)(?<![\p{L}\p{N}_])\Q"), F.replace("phrase", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    hits = met.withColumn("n", F.regexp_count("text", quoted)).where("n > 0")
    return hits.groupBy("phrase").agg(F.sum(F.col("n") * F.col("times")).cast("bigint").alias("hits"), F.sum("times").alias("texts"))


def learned(hits: DataFrame, truth: DataFrame, phrase: str, least: int = 1) -> DataFrame:
    """Patterns worth keeping: matches that are known personal data over all matches, at least LEAST_PRECISION."""
    known = truth.select(F.col(phrase).alias("phrase")).distinct().withColumn("known", F.lit(True))
    out = hits.join(known, "phrase", "left").withColumns({"positive_matches": F.when(F.col("known"), F.col("hits")).otherwise(0), "negative_matches": F.when(F.col("known"), 0).otherwise(F.col("hits"))})
    precision = F.col("positive_matches") / (F.col("positive_matches") + F.col("negative_matches"))
    return out.withColumn("precision", precision).where((F.col("precision") >= LEAST_PRECISION) & (F.col("positive_matches") >= least)).select("phrase", "positive_matches", "negative_matches", "precision")


#: Kinds of feedback that patterns are learned from.
TEACHING = ("false_negative", "category_correction", "confirmed_pii")


def taught(feedback: DataFrame, least: int = 1) -> DataFrame:
    """(phrase, category, times): what feedback says is personal data, at least ``least`` times; the category is the first one given, corrected before detected."""
    rows = feedback.where(F.col("feedback_type").isin(*TEACHING) & F.col("text_segment").isNotNull() & (F.col("text_segment") != ""))
    first = F.min_by(F.coalesce("user_corrected_category", "detected_category"), "id")
    return rows.groupBy(F.col("text_segment").alias("phrase")).agg(first.alias("category"), F.count(F.lit(1)).alias("times")).where(F.col("times") >= least)


def learn_cycle(feedback: DataFrame, corpus: DataFrame, text: str, patterns: DataFrame, least: int = 1) -> DataFrame:
    """One round of learning: phrases that feedback teaches are looked for in the corpus, and those that hold are upserted into the patterns.

    A pattern is the phrase as a whole word; one that is known is replaced only by a higher confidence.
    """
    known = taught(feedback, least)
    good = learned(phrase_hits(corpus, text, known, "phrase"), known, "phrase", least).join(known.select("phrase", "category"), "phrase")
    regex = F.concat(F.lit(r"\b"), F.regexp_replace("phrase", r"([^\p{L}\p{N}_\s])", r"\\$1"), F.lit(r"\b"))
    new = good.select(F.concat(F.lit("p_"), F.md5(regex)).alias("pattern_id"), regex.alias("regex"), F.col("category").alias("pii_category"), F.col("precision").alias("confidence"), F.lit(1).alias("version_no"))
    old = patterns.where("regex is not null").groupBy("regex").agg(F.max_by(F.struct("pattern_id", "regex", "pii_category", "confidence", "version_no"), F.struct("confidence", "pattern_id")).alias("b")).select("b.*")
    return keep_best(old, new, "regex", "confidence")


class _Folded(dict):
    """Code points by one of those that are equal to them where case is ignored; lengths stay."""

    def __missing__(self, c: int) -> int:
        low = ord(x) if len(x := chr(c).lower()) == 1 else 0x69 if c == 0x130 else c
        self[c] = min(low, *_casefix._EXTRA_CASES.get(low, (low,)))
        return self[c]


def needed(expression: str) -> str:
    """The longest run of characters that every match holds, empty if none is known."""
    best, run = "", []

    def cut() -> None:
        nonlocal best
        best = max(best, "".join(run), key=len)
        run.clear()

    def walk(parsed) -> None:
        for op, av in parsed:
            if op is _constants.LITERAL:
                run.append(chr(av))
            elif op is _constants.SUBPATTERN:
                walk(av[3])
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT):
                cut()
                if av[0]:
                    walk(av[2])
                cut()
            elif op not in (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT):  # those take no characters
                cut()

    walk(_parser.parse(expression))
    cut()
    return best


class Searcher:
    """Matches of many expressions in a text; an expression is tried only where the text holds the characters it needs."""

    def __init__(self, expressions: list[str]):
        self.compiled: dict[int, re.Pattern] = {}
        self.always: list[int] = []
        self.folded = _Folded()
        by: dict[str, list[int]] = {}
        for k, x in enumerate(expressions):
            try:
                self.compiled[k] = re.compile(x)
            except (re.error, OverflowError, RecursionError):  # no expression, so it finds nothing
                continue
            if word := needed(x).translate(self.folded):
                by.setdefault(word, []).append(k)
            else:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for word, ks in by.items():
            self.automaton.add_word(word, ks)
        if by:
            self.automaton.make_automaton()

    def found(self, text: str) -> Iterator[tuple[int, int, re.Match]]:
        tried = set(self.always)
        if len(self.automaton):
            for _, ks in self.automaton.iter(text.translate(self.folded)):
                tried.update(ks)
        for k in sorted(tried):
            for n, m in enumerate(self.compiled[k].finditer(text)):
                if m.end() > m.start():
                    yield k, n, m


def learned_spans(df: DataFrame, key: str, text: str, patterns: DataFrame, first: int = 0) -> DataFrame:
    """One row per match of the active learned patterns, as ``find_spans`` has them, with each pattern's own confidence.

    Patterns (``pattern_id, regex, pii_category, confidence, is_active``) are taken surest first and numbered from
    ``first``; the whole match is the text.  Texts are searched once for every BLOCK of patterns.  What is no
    valid expression finds nothing; without a category it is ``unknown``, without a confidence 0.
    """
    sure = F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0)).alias("confidence")
    active = patterns.where("is_active and regex is not null").select(F.coalesce("pattern_id", F.lit("")).alias("pattern_id"), "regex", F.coalesce("pii_category", F.lit("unknown")).alias("category"), sure)
    rows = sorted((tuple(r) for r in active.collect()), key=lambda r: (-r[3], r[0], r[1], r[2]))
    texts = spread(df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t")))
    kind = df.schema[key].dataType.simpleString()

    def search(block: list[tuple[str, str, str, float]], at: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searcher = Searcher([r[1] for r in block])
            for f in frames:
                out = [
                    (d, block[k][0], block[k][2], at + k, n, m.group(), m.start(), m.group(), m.start(), m.end(), DEFAULT_SPECIFICITY, block[k][3])
                    for d, t in zip(f[key], f["_t"])
                    for k, n, m in searcher.found(t)
                ]
                yield pd.DataFrame(out, columns=[key, *[c.split()[0] for c in FOUND.split(", ")]])

        return texts.mapInPandas(run, f"`{key}` {kind}, {FOUND}")

    out = search(rows[:BLOCK], first)
    for at in range(BLOCK, len(rows), BLOCK):
        out = out.unionByName(search(rows[at : at + BLOCK], first + at))
    return out
