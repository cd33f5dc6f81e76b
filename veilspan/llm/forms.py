"""Duplicates hidden by formatting: fields hashed one by one and combined without regard to order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.operators.skew import split_join
from veilspan.session import materialize

#: Sums of field hashes are taken modulo this, so that no sum of two overflows.
MODULUS = (1 << 61) - 1
#: Whitespace and punctuation of any script.
NOISE = r"(?U)[\s\p{Z}\p{P}]+"
#: A label and its value: the label begins with a letter. A text of one part alone is a field only if its label is short, as LONE has it.
FIELD = r"(?s)^[^\p{L}]*(\p{L}[^:=]*?)[:=](.*)$"
LONE = r"(?s)^[^\p{L}]*(\p{L}[^:=]{0,40}?)[:=](.*)$"
#: Signs and line ends between fields.
BETWEEN = r"[;\n\r|]+"


def plain(text: Column) -> Column:
    """The text without whitespace and punctuation, in lower case."""
    return F.lower(F.regexp_replace(text, NOISE, ""))


def fields(text: Column) -> Column:
    """The normalized ``label``-``value`` pairs of a text of fields, else the whole text as its one field.

    A text that is one field alone is taken whole, so that its separator counts as punctuation.
    """
    parts = F.filter(F.split(text, BETWEEN), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    pairs = F.transform(parts, lambda p: F.struct(plain(F.regexp_extract(p, FIELD, 1)).alias("a"), plain(F.regexp_extract(p, FIELD, 2)).alias("b")))
    labelled = F.forall(parts, lambda p: p.rlike(FIELD))
    joined = F.transform(pairs, lambda p: F.concat(p["a"], F.lit("\x01"), p["b"]))
    one = F.transform(pairs, lambda p: F.concat(p["a"], p["b"]))
    whole = F.array(plain(text))
    is_fielded = text.rlike("[:=]") & labelled
    short = F.exists(parts, lambda p: p.rlike(LONE))
    return F.when(is_fielded & (F.size(parts) > 1), joined).when(is_fielded & (F.size(parts) == 1) & short, one).otherwise(whole)


def multiset_hash(items: Column, seed: int) -> Column:
    """A hash of the items that no order changes; repeated items count."""
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: F.pmod(acc + F.pmod(F.xxhash64(F.lit(seed), x), F.lit(MODULUS)), F.lit(MODULUS)))


def same_items(a: Column, b: Column) -> Column:
    """Equality as multisets, by counting, without sorting."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: times(a, x) == times(b, x))


def group_copies(df: DataFrame, table: str, key: str, text: str, within: Column) -> DataFrame:
    """One row per record that has copies: ``record_table, first_id, id, copies``.

    Records are copies if their texts agree apart from whitespace, case,
    punctuation and, for texts of labelled fields, field order and separators, and if
    ``within`` agrees.  The first is the one with the smallest id; ``copies`` counts
    the whole group.  A record whose fields turn out to differ from its group's
    first (a hash collision) stays a record of its own.  Null texts are no records;
    empty texts are copies of each other; null in ``within`` equals only null.
    Ids are taken as unique; no rows give no rows.
    """
    items = F.concat(fields(F.col(text)), F.array(F.concat(F.lit("\x02"), F.coalesce(within, F.lit("\x03")))))
    rows = df.where(F.col(text).isNotNull()).select(F.lit(table).alias("record_table"), F.col(key).alias("id"), items.alias("items"))
    rows = materialize(rows.select("*", multiset_hash(F.col("items"), 1).alias("h1"), multiset_hash(F.col("items"), 2).alias("h2")), "forms")
    by = ["h1", "h2"]
    groups = rows.groupBy(*by).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    members = materialize(split_join(rows, groups, by), "members")
    firsts = members.where("id = first_id").select(*by, F.col("items").alias("first_items"))
    members = split_join(members, firsts, by)
    return members.where(same_items(F.col("items"), F.col("first_items"))).select("record_table", "first_id", "id", "copies")
