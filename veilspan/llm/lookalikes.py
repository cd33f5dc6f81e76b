"""One consistent form for text that looks the same: look-alike classes and a rewriting automaton."""

from __future__ import annotations

import math
import unicodedata as ud
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.session import spread

#: Texts of these characters alone are in their consistent form.
ORDINARY = r"^[\t\n\r\x20-\x7E]*\z"
#: Most different code points that a corpus can have.
MOST_CODE_POINTS = 1_114_112
#: Compatibility forms that are the same letter, digit, sign or space in another dress.
DRESSES = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Dashes that look like the hyphen; letters of other alphabets and the Latin ones they look like.
HYPHENS = "\u2010\u2011\u2212"
ALIKE = {
    "CYRILLIC": ("абвсԁеһіјкорԛѕтухѵԝАВСЕНІЈКМОРЅТУХԜ", "aбвcdehijkopqsтyxvwABCEHIJKMOPSTYXW"),
    "ARMENIAN": ("հոսցՍ", "hnugU"),
    "CHEROKEE": ("ᎠᎡᎢᎪᎫᎳᎷᎻᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJWMHZVSLCPKB"),
    "GREEK": ("αικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aiĸvoptuxABEZHIKMNOPTYX"),
}
#: Alphabets whose words need joiners.
JOINED = ("ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "GUJARATI", "GURMUKHI", "ORIYA", "SINHALA", "MONGOLIAN", "SYRIAC", "KHMER", "MYANMAR")
EAST_ASIAN = ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC")
#: A letter sequence with its marks; what a backslash escapes is no part of a word.
WORD = regex.compile(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[pP]\{[^}]*\}|.)(*SKIP)(*FAIL)|\p{L}[\p{L}\p{M}]*", regex.DOTALL)


class UnionFind:
    """Classes of strings; joining is transitive."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> Iterable[list[str]]:
        out = defaultdict(list)
        for x in sorted(self.parent):
            out[self.find(x)].append(x)
        return out.values()


_ALPHABETS: dict[str, str] = {}


def alphabet(c: str) -> str:
    """The first word of a letter's name: its alphabet; marks, signs and modifiers have none, and East Asian scripts, which are mixed in any word, are one."""
    if (found := _ALPHABETS.get(c)) is None:
        first, _, rest = ud.name(c, "").partition(" ")
        found = "CJK" if first in EAST_ASIAN else first if "LETTER" in rest and ud.category(c) in ("Ll", "Lu", "Lt", "Lo") else ""
        _ALPHABETS[c] = found
    return found


def invisible(c: str) -> bool:
    return ud.category(c) in ("Cf", "Cc") and c not in "\t\n\r" or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef" or c in "\u034f\u115f\u1160\u3164\uffa0"


def plainer(c: str) -> str | None:
    """What a code point stands for if it is not the everyday one: the same in ordinary dress, '' if nothing can be seen."""
    kind = ud.category(c)
    if kind == "Zs":
        return " " if c != " " else None
    if invisible(c):
        return ""
    if c in HYPHENS:
        return "-"
    tag, _, _ = ud.decomposition(c).partition(" ")
    letters = tag == "<compat>" and (kind[0] == "L" or kind == "Nl")
    if letters or tag in DRESSES or (tag and tag[0] != "<" and len(ud.normalize("NFD", c)) == 1):
        flat = ud.normalize("NFKC", c)
        return flat if flat != c else None
    return None


def _ordinary(s: str) -> bool:
    return all(plainer(c) is None for c in s) and ud.normalize("NFC", s) == s


class Former:
    """Rewrites texts of a corpus into their consistent form.

    ``counts`` has the corpus frequency of each code point.  Code points and strings
    that look the same are joined to classes, the most frequent ordinary member
    represents its class, and an automaton rewrites the leftmost longest member
    again and again until nothing changes.  Look-alikes of different alphabets are
    classes too, but only words that mix alphabets are rewritten by them.
    """

    def __init__(self, counts: dict[str, int]) -> None:
        import ahocorasick

        self.counts = counts
        uf = UnionFind()
        seen = {c for c in counts if c > "\x7f" or invisible(c)}
        for c in sorted(seen):
            flat = plainer(c)
            if flat is not None:
                uf.join(c, flat)
        marks = [c for c in seen if ud.category(c) == "Mn"]
        bases = set(counts) | {x for c in seen for x in ud.normalize("NFKD", c)} | {chr(x) for x in range(65, 123)}
        for m in marks:
            for b in bases:
                whole = ud.normalize("NFC", b + m)
                if len(whole) == 1 and ud.category(b)[0] == "L":
                    uf.join(b + m, whole)
        weight = lambda s: min((counts.get(c, 0) for c in s), default=0)
        self.rewrites: dict[str, str] = {}
        for members in uf.classes():
            if "" in members:
                best = ""
            else:
                best = max((x for x in members if _ordinary(x)), key=lambda x: (weight(x), -len(x), x), default=members[0])
            self.rewrites |= {x: best for x in members if x != best}
        self.automaton = ahocorasick.Automaton()
        for x in self.rewrites:
            if x:
                self.automaton.add_word(x, x)
        if len(self.automaton):
            self.automaton.make_automaton()
        alike = UnionFind()
        for their, latin in ALIKE.values():
            for a, b in zip(their, latin):
                if a != b and ord(b) < 128:
                    alike.join(a, b)
        #: (letter, alphabet) to the most frequent look-alike in that alphabet.
        self.twins: dict[tuple[str, str], str] = {}
        for members in alike.classes():
            for x in members:
                for y in sorted(members, key=lambda s: (counts.get(s, 0), s)):
                    if x != y:
                        self.twins[x, alphabet(y)] = y

    @classmethod
    def everyday(cls) -> Former:
        """One for any text: all of Unicode, with the letters of European languages as the usual ones."""
        # Everything assigned: the lower planes, the compatibility ideographs, and tags and variation selectors.
        planes = (range(0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200))
        counts = {chr(c): 1 for r in planes for c in r if plainer(chr(c)) is not None and not 0xAC00 <= c <= 0xD7A3}
        counts |= {chr(c): 1 for c in range(0x300, 0x370) if ud.category(chr(c)) == "Mn"}
        counts |= {chr(c): 20 for c in [*range(0x391, 0x3CA), *range(0x410, 0x450)]}
        counts |= {chr(c): 50 for c in range(0xC0, 0x180)}
        counts |= {chr(c): 1000 for c in range(0x20, 0x7F)}
        return cls(counts)

    def _pass(self, text: str) -> str:
        out, at = [], 0
        for end, found in self.automaton.iter_long(text):
            start = end - len(found) + 1
            if found in "\u200c\u200d" and any(alphabet(c) in JOINED or ud.category(c) == "So" for c in text[max(0, start - 2) : start] + text[end + 1 : end + 2]):
                continue
            out += [text[at:start], self.rewrites[found]]
            at = end + 1
        return "".join(out) + text[at:]

    def flat(self, text: str) -> str:
        """Everything but mixed words."""
        while len(self.automaton) and (new := self._pass(text)) != text:
            text = new
        return text

    def _to(self, word: str, target: str) -> str:
        out = []
        for c in word:
            if alphabet(c) in ("", target):
                out.append(c)
                continue
            base, rest = (d := ud.normalize("NFD", c))[0], d[1:]
            out.append(self.twins.get((c, target)) or self.twins.get((base, target), base) + rest)
        return ud.normalize("NFC", "".join(out))

    def _word(self, m) -> str:
        word = m.group()
        if word.isascii():
            return word
        kinds = [k for k in map(alphabet, word) if k]
        if len(set(kinds)) < 2:
            return word
        tried = [self._to(word, k) for k in sorted(set(kinds))]
        # Of the ways to write it in one alphabet, the one whose letters the corpus uses most.
        usual = lambda x: sum(math.log1p(self.counts.get(c, 0)) for c in x)
        return max((x for x in tried if not mixed(x)), key=lambda x: (usual(x), x), default=word)

    def form(self, text: str) -> str:
        """The consistent form."""
        if text.isascii() and text.isprintable():
            return text
        while True:
            flat = self.flat(text)
            new = WORD.sub(self._word, flat) if _several(flat) else flat
            if new == text:
                return text
            text = new


def _several(text: str) -> bool:
    """Whether a text has letters of several alphabets, so that a word could mix them."""
    return not text.isascii() and len({k for k in map(alphabet, set(text)) if k}) > 1


def mixed(text: str) -> bool:
    """Whether a word mixes alphabets."""
    return _several(text) and any(len({k for k in map(alphabet, m.group()) if k}) > 1 for m in WORD.finditer(text) if not m.group().isascii())


def code_point_counts(df: DataFrame, *columns: str) -> dict[str, int]:
    """How often each code point occurs in all texts of the columns, counted by batch before anything moves; at most as many entries as Unicode has."""
    texts = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("t")).where("t is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if seen := Counter("".join(f["t"])):
                yield pd.DataFrame({"c": list(seen), "n": list(seen.values())})

    counts = spread(texts).mapInPandas(run, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    return {r.c: r.n for r in counts.limit(MOST_CODE_POINTS).collect()}


def consistent_forms(df: DataFrame, key: Column, text: str, former: Former) -> DataFrame:
    """``record_key, text, form`` of every record whose text is not in its consistent form.

    A word that mixes alphabets and can be written in none of them is reported
    with the word as it was.  Null and empty texts are in order; repeated rows are
    all reported; genuine words of any one alphabet, accents, quotation marks and escapes
    stay as they are.
    """
    odd = df.select(key.cast("string").alias("record_key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & ~F.col("text").rlike(ORDINARY))
    counts = former

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            form = f["text"].map(counts.form)
            off = (form != f["text"]) | form.map(mixed)
            yield f.assign(form=form)[off]

    return spread(odd).mapInPandas(run, "record_key string, text string, form string")
