"""Long exact spans shared between records: content-defined chunks found by a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.operators.skew import BROADCAST_ROWS, HOT_FLOOR, join_small, split_join
from veilspan.session import materialize, spread

#: Characters of a span that must be found.
SPAN = 200
#: Characters that a gear hash covers.
GEAR = 32
#: A chunk begins where the gear hash is least of so many neighbours, and ends at the next place, LEAST further at
#: least, where it is least of so many.
BEGIN, END = 51, 8
#: A digest in more documents than this is joined by the whole spans around it: fewer rows than the pairs, the same result.
HOT_DOCS = 200
#: Characters hashed at once.
BLOCK = 400_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd bases of the two digests.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def least_chunk(span: int) -> int:
    """How far a chunk must reach at least so that every span holds a whole one with both cuts decided inside it."""
    return span - GEAR - BEGIN - 2 * END + 3


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that near inputs give far outputs."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _scattered(codes: np.ndarray) -> np.ndarray:
    return _mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASES[0]))


def gear(codes: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + G[c] of the last GEAR characters at every position, by doubling."""
    h = _scattered(codes)
    width = 1
    while width < GEAR:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint64(width)
        h, width = wider, 2 * width
    return h


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2 to the 64th."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, dtype=np.uint64)
        x[:1] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


def digests(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: int = 0) -> np.ndarray:
    """A digest of the characters from each start up to its stop, from one prefix sum of a polynomial."""
    up, down = _powers(_BASES[which], max(BLOCK, 1 << max(1, len(codes)).bit_length()))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_scattered(codes) * up[: len(codes)], out=sums[1:])
    return _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def _slide(x: np.ndarray, width: int, ahead: bool, pick) -> np.ndarray:
    """The least or greatest of ``width`` values from each position on, or up to it; edges take what there is."""
    step, out = 1, x.copy()

    def over(a: np.ndarray, by: int) -> np.ndarray:
        b = a.copy()
        if by < len(a):
            if ahead:
                b[:-by] = pick(a[:-by], a[by:])
            else:
                b[by:] = pick(a[by:], a[:-by])
        return b

    while 2 * step <= width:
        out, step = over(out, step), 2 * step
    return over(out, width - step) if width > step else out


def cuts(h: np.ndarray, usable: np.ndarray, reach: int) -> np.ndarray:
    """Positions whose hash is the least of some ``reach`` neighbouring ones.

    Any ``reach`` positions hold one, and where ``reach`` positions on either side are equal in two texts, so are the cuts.  All of
    several equal least values are cuts.
    """
    keyed = np.where(usable, _mix(h), _TOP)
    least = _slide(keyed, reach, True, np.minimum)
    # Windows of usable positions only: one with others has a least value too, and adds cuts at worst.
    return np.flatnonzero(usable & (keyed == _slide(least, reach, False, np.maximum)))


def chunks(codes: np.ndarray, inner: np.ndarray, stop: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the variable chunks of texts that stand in a row: ``inner`` is the place in a text, ``stop`` the end of the text."""
    h, usable = gear(codes), inner >= GEAR - 1
    begin, end = cuts(h, usable, BEGIN), cuts(h, usable, END)
    if not len(begin) or not len(end):
        return begin[:0], begin[:0]
    at = np.searchsorted(end, begin + least_chunk(span))
    there = at < len(end)
    begin, last = begin[there], end[at[there]]
    own = last < stop[begin]
    return begin[own] - GEAR + 1, last[own] + 1


def _blocks(frames: Iterator[pd.DataFrame], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, starts, lengths, code points) of texts, about BLOCK characters at a time; a longer text comes in parts that overlap."""
    ids, starts, parts, size = [], [], [], 0

    def block():
        return np.array(ids, dtype=np.int64), np.array(starts), np.array([len(p) for p in parts]), np.concatenate(parts)

    for frame in frames:
        for i, text in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
            codes = code_points(text)
            for start in range(0, max(1, len(codes) - overlap), BLOCK):
                ids.append(i)
                starts.append(start)
                parts.append(codes[start : start + BLOCK + overlap])
                size += len(parts[-1])
                if size >= BLOCK:
                    yield block()
                    ids, starts, parts, size = [], [], [], 0
    if ids:
        yield block()


def _chunk_digests(span: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, begins, lengths, codes in _blocks(frames, span):
            firsts = np.cumsum(lengths) - lengths
            inner = np.arange(len(codes)) - np.repeat(firsts, lengths)
            start, stop = chunks(codes, inner, np.repeat(firsts + lengths, lengths), span)
            if not len(start):
                continue
            d = digests(codes, start, stop).view(np.int64)
            part = np.repeat(np.arange(len(ids)), lengths)[start]
            # A digest that returns inside a text is kept once; pairs that this leaves unproven are compared in full.
            order = np.lexsort((start, d, part))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (d[order][1:] != d[order][:-1]) | (part[order][1:] != part[order][:-1])
            first = order[fresh]
            at = (inner[start] + begins[part])[first]
            yield pd.DataFrame({"digest": d[first], "doc": ids[part[first]], "at": at.astype(np.int32), "size": (stop - start)[first].astype(np.int16)})

    return run


def shared_mask(a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Which characters of ``a`` lie in a stretch of ``span`` or more that occurs in ``b``."""
    mark = np.zeros(len(a) + 1, dtype=np.int64)
    if len(a) >= span and len(b) >= span:
        da, db = (digests(x, np.arange(len(x) - span + 1), np.arange(span, len(x) + 1)) for x in (a, b))
        order = np.argsort(db)
        where = np.minimum(np.searchsorted(db, da, sorter=order), len(db) - 1)
        hit = np.flatnonzero(db[order[where]] == da)
        there = order[where[hit]]
        wa, wb = (np.lib.stride_tricks.sliding_window_view(x, span) for x in (a, b))
        equal = [(wa[hit[k : k + 4096]] == wb[there[k : k + 4096]]).all(axis=1) for k in range(0, len(hit), 4096)]
        hit = hit[np.concatenate(equal)] if equal else hit
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + span, -1)
    return np.cumsum(mark[:-1]) > 0


def met_span(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int) -> int:
    """How many characters around two places are equal, extended to both sides."""
    def equal(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        off = np.flatnonzero(x[:n] != y[:n])
        return int(off[0]) if len(off) else n

    return equal(a[at_a:], b[at_b:]) + equal(a[:at_a][::-1], b[:at_b][::-1])


def exact_copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, first): every document that is a copy, and the smallest id of its text."""
    sums = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.md5(text).alias("sum"), F.length(text).alias("n"))
    sums = materialize(sums, "sums")
    groups = sums.groupBy("sum", "n").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return split_join(sums, groups, ["sum", "n"]).select("doc", "first", "n")


def linked_firsts(docs: DataFrame, copies: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """(a, b, at_a, at_b, sure): pairs of different texts, a before b, that share a chunk at those places; ``sure`` if chunks alone prove ``span``."""
    later = copies.where("doc != first").select(F.col("doc").alias(key))
    if later.count() <= BROADCAST_ROWS:
        later = F.broadcast(later)
    own = docs.where(F.length(text) >= span).select(key, text).join(later, key, "left_anti")
    own = own.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    found = materialize(spread(own).mapInPandas(_chunk_digests(span), "digest bigint, doc bigint, at int, size smallint"), "chunks")
    shared = materialize(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    # Chunks that nothing shares go no further; those of very many documents, a few, are met where they are.
    great = shared.where(F.col("n") > HOT_FLOOR)
    spared = great.count()
    kept = found.join(shared.where(F.col("n") <= HOT_FLOOR) if spared else shared, "digest")
    if spared:
        kept = kept.unionByName(join_small(found, great, ["digest"], spared))
    kept = materialize(kept, "kept")
    known = shared.where(F.col("n") > HOT_DOCS).count()
    cold = kept.where(F.col("n") <= HOT_DOCS)
    a, b = (cold.select("digest", *[F.col(c).alias(f"{c}_{x}") for c in ("doc", "at")], "size") for x in "ab")
    met = a.join(b.drop("size"), "digest").where("doc_a < doc_b").select("doc_a", "doc_b", "at_a", (F.col("at_b") - F.col("at_a")).alias("shift"), (F.col("at_a") + F.col("size")).alias("to"))
    line = Window.partitionBy("doc_a", "doc_b", "shift").orderBy("at_a", "to")
    # Chunks on one diagonal whose characters overlap make one stretch.
    apart = F.col("at_a") > F.coalesce(F.max("to").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    stretch = met.withColumn("s", F.sum(apart.cast("int")).over(line)).groupBy("doc_a", "doc_b", "shift", "s").agg((F.max("to") - F.min("at_a")).alias("n"), F.min("at_a").alias("at_a"))
    longest = F.max(F.struct("n", "at_a", "shift"))
    pairs = stretch.groupBy(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).agg(longest.alias("l"))
    pairs = pairs.select("a", "b", F.col("l.at_a").alias("at_a"), (F.col("l.at_a") + F.col("l.shift")).alias("at_b"), (F.col("l.n") >= span).alias("sure"))
    if not known:
        return pairs
    # Around chunks of many documents the whole spans are compared, by two digests of 64 bits, so that only true pairs meet.
    some = kept.where(F.col("n") > HOT_DOCS).groupBy("doc").agg(F.collect_set("digest").alias("hot"))
    around = materialize(own.join(some, "doc").mapInPandas(_span_digests(span), "d1 bigint, d2 bigint, doc bigint"), "around")
    sets = around.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "doc")).alias("x")).where("n > 1")
    # Spans of the very same documents say the same: one of them stands for all.
    one = sets.groupBy("n", "s", "x").agg(F.min(F.struct("d1", "d2")).alias("d")).select("d.d1", "d.d2")
    met_around = materialize(around.join(one, ["d1", "d2"]), "spans")
    a, b = (met_around.select("d1", "d2", F.col("doc").alias(x)) for x in "ab")
    stock = a.join(b, ["d1", "d2"]).where("a < b").select("a", "b").distinct()
    none = F.lit(None).cast("int")
    stock = stock.select("a", "b", none.alias("at_a"), none.alias("at_b"), F.lit(True).alias("sure"))
    return pairs.unionByName(stock).groupBy("a", "b").agg(F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"), F.max("sure").alias("sure"))


def _span_digests(span: int):
    """Two digests of every span around the chunks whose digests are in ``hot``, once per document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, text, hot in zip(f["doc"], f["text"], f["hot"]):
                out = []
                for _, _, _, codes in _blocks(iter([pd.DataFrame({"doc": [doc], "text": [text]})]), 2 * span):
                    start, stop = chunks(codes, np.arange(len(codes)), np.full(len(codes), len(codes)), span)
                    known = np.isin(digests(codes, start, stop).view(np.int64), np.asarray(hot, dtype=np.int64))
                    mark = np.zeros(len(codes) + 2, dtype=np.int64)
                    np.add.at(mark, np.maximum(stop[known] - span, 0), 1)
                    np.add.at(mark, start[known] + 1, -1)
                    begin = np.flatnonzero(np.cumsum(mark)[: max(0, len(codes) - span + 1)] > 0)
                    out.append(np.stack([digests(codes, begin, begin + span, k).view(np.int64) for k in (0, 1)], axis=1))
                d = np.unique(np.concatenate(out), axis=0)
                yield pd.DataFrame({"d1": d[:, 0], "d2": d[:, 1], "doc": np.full(len(d), doc, dtype=np.int64)})

    return run


def _with_texts(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    side = lambda x: docs.select(F.col(key).alias(x), F.col(text).alias(f"text_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _verify(span: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for x, y, i, j in zip(f["text_a"], f["text_b"], f["at_a"], f["at_b"]):
                a, b = code_points(x), code_points(y)
                keep.append(met_span(a, b, int(i), int(j)) >= span or bool(shared_mask(a, b, span).any()))
            yield f.loc[keep, ["a", "b"]]

    return run


def linked(docs: DataFrame, key: str, text: str, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of different texts with ``span`` equal characters in a row, and the exact copies (doc, first, n).

    A chunk begins and ends where a gear hash is least among its neighbours, so its length varies with the text and
    insertions before it do not move it; chunks are deduplicated by digest.  Any shared span holds a common chunk; what
    chunks alone do not prove is extended to both sides, and compared in full where that is too short.
    Exact copies stand behind their first, see ``expand``.  Texts that are null, empty or
    shorter than ``span`` have no pairs; no rows give no rows; ids are taken as unique integers.
    """
    copies = materialize(exact_copies(docs, key, text), "copies")
    met = materialize(linked_firsts(docs, copies, key, text, span), "met")
    checked = _with_texts(met.where("not sure").drop("sure"), docs, key, text).mapInPandas(_verify(span), "a bigint, b bigint")
    return met.where("sure").select("a", "b").unionByName(checked), copies


def expand(pairs: DataFrame, copies: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_a, doc_b) of all documents: the linked texts with their copies, and the copies among themselves."""
    group = copies.where(F.col("n") >= span).select("first", "doc")
    side = lambda d, x: d.join(group.withColumnRenamed("first", x), x, "left").withColumn(x, F.coalesce("doc", F.col(x))).drop("doc")
    across = side(side(pairs, "a"), "b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
    other = group.withColumnRenamed("doc", "doc_b")
    within = group.withColumnRenamed("doc", "doc_a").join(other, "first").where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.unionByName(within)


def _stretches(span: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for a, b, x, y in zip(f["a"], f["b"], f["text_a"], f["text_b"]):
                cx, cy = code_points(x), code_points(y)
                for doc, one, two in ((a, cx, cy), (b, cy, cx)):
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], shared_mask(one, two, span).astype(np.int8), [0]))))
                    rows += [(doc, int(s), int(e)) for s, e in edges.reshape(-1, 2)]
            yield pd.DataFrame(rows, columns=["doc", "start", "stop"])

    return run


def shared_share(docs: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """One row per document: ``doc``, ``n_chars``, ``stretches``, ``shared_chars`` and ``shared_share`` of its text that occurs elsewhere."""
    pairs, copies = linked(docs, key, text, span)
    spans = _with_texts(pairs, docs, key, text).mapInPandas(_stretches(span), "doc bigint, start int, stop int")
    w = Window.partitionBy("doc").orderBy("start", "stop")
    gap = F.col("start") > F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    merged = spans.withColumn("s", F.sum(gap.cast("int")).over(w)).groupBy("doc", "s").agg((F.max("stop") - F.min("start")).alias("n"))
    own = merged.groupBy("doc").agg(F.count(F.lit(1)).alias("stretches"), F.sum("n").alias("shared_chars"))
    whole = copies.where(F.col("n") >= span).select("doc", F.lit(True).alias("copied"))
    n = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    out = docs.select(F.col(key).alias("doc"), n.alias("n_chars")).join(own, "doc", "left").join(whole, "doc", "left")
    chars = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0)))
    return out.select(
        "doc", "n_chars", F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("stretches", F.lit(0))).cast("bigint").alias("stretches"), chars.cast("bigint").alias("shared_chars"),
        F.coalesce(F.try_divide(chars, F.col("n_chars")), F.lit(0.0)).cast("double").alias("shared_share"),
    )
