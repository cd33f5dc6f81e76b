"""Train the tagger: ``python -m veilspan.llm.train_tagger TABLES [OUT]``.

Reads at most SAMPLE different texts of each field; nothing else about the data is kept
than the weights.
"""

from __future__ import annotations

import random
import sys

import numpy as np
import pyarrow.parquet as pq
import regex

from veilspan.llm.lookalikes import Former
from veilspan.llm.masking import as_read, decoded, strings
from veilspan.llm.silver import Labeller, disguised, given_names, joined, stored, to_tags
from veilspan.llm.tagger import TYPES, WEIGHTS, spans, tag, train

#: Most different texts of one field that the tagger learns from.
SAMPLE = 8_000


def _plain(category: str | None) -> str:
    return regex.sub(r"[\s\p{P}]", "", category or "").lower()


def labelled(root: str, sample: int = SAMPLE, seed: int = 1) -> tuple[list[tuple[str, list]], Labeller]:
    """(text, spans) of a bounded sample, and the labeller."""
    rng, former = random.Random(seed), Former.everyday()
    some = lambda xs: rng.sample(sorted(xs), min(sample, len(xs)))
    t = pq.read_table(f"{root}/training_examples.parquet", columns=["detection_text", "category", "context", "is_true_positive"]).to_pylist()
    t = [r | {"detection_text": as_read(r["detection_text"] or "", former), "context": as_read(r["context"] or "", former), "category": _plain(r["category"])} for r in rng.sample(t, min(len(t), 4 * sample))]
    sure = [r for r in t if r["is_true_positive"]]
    labeller = Labeller(given_names([r["detection_text"] for r in sure if r["category"] == "names"]))
    out = {}
    for r in t:
        for text in (r["detection_text"], r["context"]):
            found = stored(text, r["detection_text"], r["category"], labeller) if r["is_true_positive"] else None
            out.setdefault(text, labeller.spans(text) if found is None else found)
    out = {x: out[x] for x in some(out)[: 2 * sample]}
    u = pq.read_table(f"{root}/user_feedback.parquet", columns=["text_segment", "context"]).to_pydict()
    seen = {as_read(x, former) for x in u["text_segment"] if x}
    inner = ((x, decoded(x)) for x in u["context"] if x)
    values = {as_read(v, former) for x, d in inner for v in (strings(d) if d is not None else [x])}
    for x in some(seen) + some(values):
        out.setdefault(x, labeller.spans(x))
    return [(x, s) for x, s in out.items() if x], labeller


def scores(texts: list[str], want: list[set[str]], weights: dict) -> dict[str, tuple[float, float]]:
    """(precision, recall) per type, of types present in a text."""
    from veilspan.llm.masking import checked

    got = [{k for _, _, k in checked(t, spans(y))} for t, y in zip(texts, tag(weights, texts))]
    out = {}
    for k in TYPES:
        both = sum(k in a and k in b for a, b in zip(got, want))
        out[k] = (both / max(1, sum(k in a for a in got)), both / max(1, sum(k in b for b in want)))
    return out


def main(root: str, to: str = WEIGHTS) -> None:
    pairs, _ = labelled(root)
    random.Random(2).shuffle(pairs)
    held = len(pairs) // 20
    rng, known = random.Random(3), pairs[held:]
    more = [disguised(*p, rng) for p in known]
    more += [disguised(*p, rng) for p in known if any(k == "email" for _, _, k in p[1])]
    more += [joined(rng.sample(known, rng.choice((2, 2, 3))), rng.choice([". ", " ... ", "; ", " | ", "\n"])) for _ in range(len(known) // 2)]
    learn = known + more
    w = train([t for t, _ in learn], [to_tags(len(t), s) for t, s in learn], epochs=8, batch=192)
    np.savez_compressed(to, **{k: v.astype(np.float16) for k, v in w.items()})
    print(scores([t for t, _ in pairs[:held]], [{k for _, _, k in s} for _, s in pairs[:held]], w))


if __name__ == "__main__":
    main(*sys.argv[1:])
