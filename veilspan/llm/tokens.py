"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.session import spread

#: Rank file of the tokenizer; every executor must see this path.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(ranks: str):
    """The tokenizer of a rank file, read once per worker process and kept with the library."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_veilspan", {})
    if ranks in kept:
        return kept[ranks]
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
    kept[ranks] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return kept[ranks]


def token_sizes(docs: DataFrame, key: str, text: str, *keep: str, ranks: str = RANKS) -> DataFrame:
    """``key``, the columns in ``keep`` and ``tokens``: every whole text's size; 0 if empty, no row if null."""
    kept = docs.where(F.col(text).isNotNull()).select(F.col(key), *keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", tokens bigint"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(ranks).encode_ordinary
        for f in frames:
            n = [len(encode(t)) for t in f["_text"]]
            yield f.drop(columns="_text").assign(tokens=pd.Series(n, index=f.index, dtype="int64"))

    return spread(kept).mapInPandas(run, schema)
