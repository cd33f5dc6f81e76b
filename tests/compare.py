"""Comparison of a query's rows with those of its SQL twin."""

from collections import Counter


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def same(df, result) -> None:
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
