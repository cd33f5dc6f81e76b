"""One ordered pass over series of any size: differences, runs, and what must be carried over cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.operators.skew import join_small
from veilspan.session import materialize

#: Rows of a series that are held at once; a cut changes no result.
BLOCK_ROWS = 100_000
#: Bits below a block's partition number.
BLOCK_BITS = 33
#: Bits of a reading's mark.
STUCK, LEADS, TRAILS = 4, 8, 16


def _runs(v: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of readings by segment: the run of each, and by run its first place, length and segment."""
    fresh = np.ones(len(v), dtype=bool)
    fresh[1:] = (seg[1:] != seg[:-1]) | ((v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))
    run = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    return run, first, np.diff(np.append(first, len(v))), seg[first]


def _measured(v: np.ndarray, seg: np.ndarray, last_seg: int, usable: np.ndarray, x: np.ndarray, least: int):
    """(d1, d2, mark) of a block's readings of one measure, and the borders of its first and last segment.

    A mark has the order of a usable reading that begins its segment (1, 2, else 0), STUCK, and LEADS or TRAILS in the
    first or last run of its segment.
    """
    n = len(v)
    d1, d2, mark = np.full(n, np.nan, np.float32), np.full(n, np.nan, np.float32), np.zeros(n, dtype=np.int8)
    run, first, size, of = _runs(v, seg)
    if n:
        leads, trails = np.ones(len(of), dtype=bool), np.ones(len(of), dtype=bool)
        leads[1:] = trails[:-1] = of[1:] != of[:-1]
        mark[:] = ((size >= least) * STUCK + leads * LEADS + trails * TRAILS).astype(np.int8)[run]
    at, sx, ux = np.flatnonzero(usable), seg[usable], x[usable]
    one, same = np.diff(ux), sx[1:] == sx[:-1]
    d1[at[1:]] = np.where(same, one, np.nan)
    d2[at[2:]] = np.where(same[1:] & same[:-1], one[1:] - one[:-1], np.nan)
    begin, second = np.ones(len(sx), dtype=bool), np.zeros(len(sx), dtype=bool)
    begin[1:] = ~same
    second[1:] = begin[:-1] & same
    mark[at] += (begin + 2 * second).astype(np.int8)
    borders = {}
    for s in {0, last_seg}:
        own, some = np.flatnonzero(of == s), ux[sx == s]
        if len(own):
            a, b = own[0], own[-1]
            near = (float(some[-1]) if len(some) else None, float(some[-2]) if len(some) > 1 else None)
            borders[s] = (*near, float(v[first[a]]), int(size[a]), float(v[first[b]]), int(size[b]), bool(a == b))
    return d1, d2, mark, borders


def _pass(measures, least: int, block_rows: int):
    names = [f"v{k}" for k in range(len(measures))]

    def finish(parts: list[pa.RecordBatch], chunk: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        src, ids = t.column("src").combine_chunks(), t.column("id").to_numpy()
        rows = len(src)
        seg = np.zeros(rows, dtype=np.int64)
        if rows > 1:
            seg[1:] = np.cumsum(pc.not_equal(src.slice(1), src.slice(0, rows - 1)).to_numpy(zero_copy_only=False))
        firsts = np.flatnonzero(np.diff(seg, prepend=-1))
        out: dict[str, list] = {f.name: [] for f in SCHEMA}
        for k, m in enumerate(measures):
            c = t.column(names[k]).combine_chunks()
            place = np.flatnonzero(c.is_valid().to_numpy(zero_copy_only=False))
            v, own = c.fill_null(0.0).to_numpy(zero_copy_only=False)[place], seg[place]
            usable, x = m.scaled(v)
            d1, d2, mark, borders = _measured(v, own, int(seg[-1]), usable, x, least)
            edges = np.flatnonzero(np.diff(own, prepend=-1)).tolist() + [len(own)]
            for a, b in zip(edges, edges[1:]):
                s = int(own[a])
                row = (src[int(firsts[s])].as_py(), k, chunk, ids[place[a:b]], v[a:b], d1[a:b], d2[a:b], mark[a:b].tobytes(), *borders.get(s, (None,) * 7))
                for name, value in zip(out, row):
                    out[name].append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in SCHEMA], schema=SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, size, block = [], 0, 0
        for b in batches:
            while len(b):
                piece = b.slice(0, block_rows - size)
                b = b.slice(len(piece))
                held.append(piece)
                size += len(piece)
                if size == block_rows:
                    yield finish(held, (part << BLOCK_BITS) + block)
                    held, size, block = [], 0, block + 1
        if size:
            yield finish(held, (part << BLOCK_BITS) + block)

    return run


BORDER = ["x1", "x2", "lead_v", "lead_n", "trail_v", "trail_n", "whole"]
SCHEMA = pa.schema([
    ("src", pa.string()), ("m", pa.int8()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("v", pa.list_(pa.float64())), ("d1", pa.list_(pa.float32())), ("d2", pa.list_(pa.float32())), ("mark", pa.binary()),
    ("x1", pa.float64()), ("x2", pa.float64()), ("lead_v", pa.float64()), ("lead_n", pa.int64()), ("trail_v", pa.float64()), ("trail_n", pa.int64()), ("whole", pa.bool_()),
])
SEGMENT = "src string, m tinyint, chunk bigint, ids array<bigint>, v array<double>, d1 array<float>, d2 array<float>, mark binary, x1 double, x2 double, lead_v double, lead_n bigint, trail_v double, trail_n bigint, whole boolean"


def _carried(borders: DataFrame, least: int) -> DataFrame:
    """``src, m, chunk, c1, c2, long``: the last two readings before the chunk, and which of its first and last run are long enough with what is beside them.

    Borders are at most two sources a chunk, so the windows are over chunks, not rows.
    """
    w = Window.partitionBy("src", "m").orderBy("chunk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lasting = lambda c: F.last(F.when(F.col("x1").isNotNull(), F.struct(c.alias("c"))), ignorenulls=True).over(before)["c"]
    near = borders.withColumn("c1", lasting(F.col("x1"))).withColumn("c2", lasting(F.coalesce("x2", "c1")))
    side = lambda v, k, at: F.struct(F.col(v).alias("v"), F.col(k).alias("n"), F.lit(at).alias("at"))
    ends = F.when(F.col("whole"), F.array(side("lead_v", "lead_n", LEADS + TRAILS))).otherwise(F.array(side("lead_v", "lead_n", LEADS), side("trail_v", "trail_n", TRAILS)))
    runs = borders.select("src", "m", "chunk", F.inline(ends))
    by = Window.partitionBy("src", "m").orderBy("chunk", "at")
    same = (F.col("v") == F.lag("v").over(by)) & (F.lag("chunk").over(by) != F.col("chunk"))
    islands = runs.withColumn("i", F.sum(F.when(same, 0).otherwise(1)).over(by))
    total = F.sum("n").over(Window.partitionBy("src", "m", "i"))
    long = islands.withColumn("total", total).where(F.col("total") >= least).groupBy("src", "m", "chunk").agg(F.bit_or("at").alias("long"))
    return near.join(long, ["src", "m", "chunk"], "left").select("src", "m", "chunk", "c1", "c2", F.coalesce("long", F.lit(0)).alias("long"))


def ordered_pass(df: DataFrame, source: str, ts: str, key: str, measures, least: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The readings in the order of (source, ts, key), as one row for each measure of a source in a block: ``src, m, ids, v, d1, d2, mark, c1, c2, long``.

    One range sort spreads a source of any size over as many tasks as it needs; each task goes once over its rows and
    keeps a block of at most ``block_rows`` as arrays, so that later passes neither join nor move single readings.
    What the cuts part is put together from their borders (``opened``), so cuts change nothing.
    """
    rows = df.select(
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("\0")).alias("src"), F.col(f"`{ts}`").cast("double").alias("ts"), F.col(f"`{key}`").cast("bigint").alias("id"),
        *[F.col(f"`{m.name}`").cast("double").alias(f"v{k}") for k, m in enumerate(measures)],
    )
    by = ["src", "ts", "id"]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    done = materialize(placed.mapInArrow(_pass(measures, least, block_rows), SEGMENT), "ordered")
    carried = materialize(_carried(done.where("lead_n is not null").select("src", "m", "chunk", *BORDER), least), "borders")
    return join_small(done.drop(*BORDER), carried, ["src", "m", "chunk"], carried.count(), "left").drop("chunk")


def opened(r, measure) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v, usable, x, d1, d2, stuck) of a row of ``ordered_pass``; a difference to nothing is NaN."""
    v, mark = np.asarray(r.v, dtype=np.float64), np.frombuffer(r.mark, dtype=np.int8)
    usable, x = measure.scaled(v)
    d1, d2 = (np.array(d, dtype=np.float64) for d in (r.d1, r.d2))
    c1, c2 = (np.nan if c is None else c for c in (r.c1, r.c2))
    first, second = (np.flatnonzero(mark & 3 == k) for k in (1, 2))
    d1[first] = x[first] - c1
    d2[first] = x[first] - 2 * c1 + c2
    d2[second] = d1[second] - (x[second] - d1[second] - c1)
    joined = 0 if r.long is None or r.long != r.long else int(r.long)
    return v, usable, x, d1, d2, (mark & (STUCK | joined)) > 0
