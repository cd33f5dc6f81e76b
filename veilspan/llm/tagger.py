"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import os
import unicodedata as ud
from collections.abc import Sequence

import numpy as np

TYPES = ("email", "phone", "identity_number", "street_address", "person_name")
#: 0 is outside; type k begins with 2 k + 1 and goes on with 2 k + 2.
TAGS = 2 * len(TYPES) + 1
EMBED, HIDDEN = 24, 40
#: Characters of a window and of the part it shares with the next.
WINDOW, OVERLAP = 160, 64
#: Characters scored at once.
BATCH_CHARS = 30_000
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "tagger_weights.npz")
# Fixed value: the letters and signs with an embedding of their own; all others share one by kind.
LETTERS = " \t\n!\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]_abcdefghijklmnopqrstuvwxyz{|}~ąčęėįšųūžĄČĘĖĮŠŲŪŽäöüßÄÖÜéñç„“”–€"
KINDS = ("Lu", "Ll", "L", "N", "P", "S", "Z", "")
CODES = {c: i + 1 for i, c in enumerate(LETTERS)}
VOCAB = len(LETTERS) + 1 + len(KINDS)


def _code(c: str) -> int:
    if c not in CODES:
        kind = ud.category(c)
        CODES[c] = len(LETTERS) + 1 + next(i for i, k in enumerate(KINDS) if kind.startswith(k))
    return CODES[c]


#: The code of each code point that was met, 0 of all others.
_KNOWN = np.zeros(0x110000, dtype=np.int16)


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _KNOWN[points]
    if not out.all():
        for p in np.unique(points[out == 0]).tolist():
            _KNOWN[p] = _code(chr(p))
        out = _KNOWN[points]
    return out.astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_weights(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"E": rng.standard_normal((VOCAB, EMBED)).astype(np.float32) * 0.3, "O": make(2 * HIDDEN, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fb":
        w |= {f"W{d}": make(EMBED, 4 * HIDDEN), f"U{d}": make(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0  # an open forget gate
    return w


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """Hidden states of one direction; x is (time, batch, EMBED), padding leaves the state as it is."""
    steps, n, _ = x.shape
    pre = (x.reshape(-1, EMBED) @ w + b).reshape(steps, n, -1)
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, gates, cells = np.empty((steps, n, HIDDEN), np.float32), [], []
    full = bool(mask.all())
    for t in range(steps):
        z = pre[t] + h @ u
        s = _sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        c_new = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
        tc = np.tanh(c_new)
        h_new = s[:, 2 * HIDDEN :] * tc
        if keep:
            gates.append((s, g, tc, h))
            cells.append(c)
        if full:
            h, c = h_new, c_new
        else:
            m = mask[t][:, None]
            h, c = np.where(m, h_new, h), np.where(m, c_new, c)
        out[t] = h
    return out, gates, cells


def _lstm_back(dout, x, mask, w, u, gates, cells):
    steps, n, _ = x.shape
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], np.float32)
    dz_all = np.empty((steps, n, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        s, g, tc, h_old = gates[t]
        m = mask[t][:, None]
        dh = dh + dout[t]
        dh_in, dc_in = np.where(m, dh, 0), np.where(m, dc, 0)
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        dcn = dc_in + dh_in * o * (1 - tc * tc)
        dz = np.concatenate((dcn * g * i * (1 - i), dcn * cells[t] * f * (1 - f), dh_in * tc * o * (1 - o), dcn * i * (1 - g * g)), axis=1)
        dz_all[t] = dz
        du += h_old.T @ dz
        dh, dc = np.where(m, dz @ u.T, dh), np.where(m, dcn * f, dc)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    dw += x.reshape(-1, EMBED).T @ flat
    db += flat.sum(0)
    return (flat @ w.T).reshape(x.shape), dw, du, db


def _pad(codes: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch) codes and mask."""
    steps = max(map(len, codes))
    x, mask = np.zeros((steps, len(codes)), np.int32), np.zeros((steps, len(codes)), bool)
    for k, c in enumerate(codes):
        x[: len(c), k], mask[: len(c), k] = c, True
    return x, mask


def _emissions(w: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    e = w["E"][x]
    hf, gf, cf = _lstm(e, mask, w["Wf"], w["Uf"], w["cf"], keep)
    hb, gb, cb = _lstm(e[::-1], mask[::-1], w["Wb"], w["Ub"], w["cb"], keep)
    h = np.concatenate((hf, hb[::-1]), axis=2)
    return h @ w["O"] + w["o"], (e, h, gf, cf, gb, cb)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def loss_and_gradients(w: dict, codes: list[np.ndarray], tags: list[np.ndarray]) -> tuple[float, dict]:
    """The CRF's mean negative log likelihood per text and its gradients."""
    x, mask = _pad(codes)
    y, _ = _pad(tags)
    em, (e, h, gf, cf, gb, cb) = _emissions(w, x, mask, True)
    steps, n = x.shape
    trans = w["T"]
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = em[0]
    for t in range(1, steps):
        a = _logsum(alpha[t - 1][:, :, None] + trans, 1) + em[t]
        alpha[t] = np.where(mask[t][:, None], a, alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        b = _logsum(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(mask[t + 1][:, None], b, 0)
    z = _logsum(alpha[-1], 1)
    prob = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    gold = np.zeros_like(em)
    np.put_along_axis(gold, y[:, :, None].astype(np.int64), 1, axis=2)
    gold *= mask[:, :, None]
    score = (em * gold).sum()
    d_trans = np.zeros_like(trans)
    for t in range(1, steps):
        live = mask[t]
        if not live.any():
            break
        pair = alpha[t - 1][:, :, None] + trans + (em[t] + beta[t])[:, None, :] - z[:, None, None]
        d_trans += (np.exp(pair) * live[:, None, None]).sum(0)
        np.add.at(d_trans, (y[t - 1][live], y[t][live]), -1)
        score += trans[y[t - 1][live], y[t][live]].sum()
    loss = float(z.sum() - score) / n
    d_em = ((prob - gold) / n).astype(np.float32)
    grads = {"T": (d_trans / n).astype(np.float32), "O": h.reshape(-1, 2 * HIDDEN).T @ d_em.reshape(-1, TAGS), "o": d_em.sum((0, 1))}
    dh = d_em @ w["O"].T
    de_f, grads["Wf"], grads["Uf"], grads["cf"] = _lstm_back(dh[:, :, :HIDDEN], e, mask, w["Wf"], w["Uf"], gf, cf)
    de_b, grads["Wb"], grads["Ub"], grads["cb"] = _lstm_back(dh[::-1, :, HIDDEN:], e[::-1], mask[::-1], w["Wb"], w["Ub"], gb, cb)
    grads["E"] = np.zeros_like(w["E"])
    np.add.at(grads["E"], x, de_f + de_b[::-1])
    return loss, grads


def train(texts: list[str], tags: list[np.ndarray], epochs: int = 6, batch: int = 128, rate: float = 4e-3, seed: int = 1, say=print, weights: dict | None = None) -> dict[str, np.ndarray]:
    """Adam on batches of texts of like length; longer texts are cut to windows."""
    rng = np.random.default_rng(seed)
    w = weights or new_weights(seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    codes = [encode(t) for t in texts]
    cut = [(c[i : i + WINDOW], y[i : i + WINDOW]) for c, y in zip(codes, tags) for i in range(0, max(1, len(c) - OVERLAP), WINDOW - OVERLAP) if len(c)]
    step = 0
    total = epochs * -(-len(cut) // batch)
    for epoch in range(epochs):
        order = sorted(range(len(cut)), key=lambda k: len(cut[k][0]) + rng.random() * 12)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(groups)
        sum_ = 0.0
        for g in groups:
            loss, grads = loss_and_gradients(w, [cut[k][0] for k in g], [cut[k][1] for k in g])
            sum_ += loss
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            clip = min(1.0, 5.0 / (norm + 1e-9))
            now = rate * (1 - step / (total + 1)) + 1e-4
            for k, v in grads.items():
                v = v * clip
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                w[k] = (w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        say(f"epoch {epoch}: loss {sum_ / len(groups):.4f}")
    return w


def load(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


class Scorer:
    """The trained network for decoding: gates and states stand as rows, texts as columns, so that every step works on whole rows in place.

    The letters' share of the gates is looked up, and the halves in the gates' sigmoids are in the weights.
    """

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        half = np.concatenate((np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN))).astype(np.float32)
        self.ways = []
        for k, d in enumerate("fb"):
            letters = np.ascontiguousarray(((w["E"] @ w[f"W{d}"] + w[f"c{d}"]) * half).T)
            self.ways.append((letters, np.ascontiguousarray((w[f"U{d}"] * half).T), np.ascontiguousarray(w["O"][k * HIDDEN : (k + 1) * HIDDEN].T)))
        self.bias, self.trans = w["o"], w["T"]

    def emissions(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(steps, TAGS, texts), and how many texts have a character at each step; the texts come longest first."""
        x, _ = _pad(codes)
        steps, n = x.shape
        alive = np.searchsorted([-len(c) for c in codes], -np.arange(steps), "left")
        out = np.empty((steps, TAGS, n), np.float32)
        out[:] = self.bias[:, None]
        for (letters, within, to), order in zip(self.ways, (range(steps), range(steps - 1, -1, -1))):
            h, c = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            for t in order:
                k = int(alive[t])
                z = within @ h[:, :k]
                z += letters[:, x[t, :k]]
                np.tanh(z, out=z)
                gates = z[: 3 * HIDDEN]
                gates *= 0.5
                gates += 0.5
                i, f, o, g = (z[j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
                cell = c[:, :k]
                cell *= f
                i *= g
                cell += i
                np.tanh(cell, out=g)
                np.multiply(o, g, out=h[:, :k])
                out[t, :, :k] += to @ h[:, :k]
        return out, alive

    def decode(self, em: np.ndarray, alive: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
        """The best tags of each text (Viterbi)."""
        steps, _, n = em.shape
        back = np.zeros((steps, TAGS, n), np.int8)
        best = em[0].copy()
        for t in range(1, steps):
            k = int(alive[t])
            top, at = best[0, :k] + self.trans[0][:, None], back[t, :, :k]
            for j in range(1, TAGS):
                other = best[j, :k] + self.trans[j][:, None]
                at[other > top] = j
                np.maximum(top, other, out=top)
            best[:, :k] = top + em[t, :, :k]
        out = np.zeros((steps, n), np.int8)
        at, columns = best.argmax(0), np.arange(n)
        for t in range(steps - 1, -1, -1):
            k = int(alive[t])
            out[t, :k] = at[:k]
            if t:
                at[:k] = back[t, at[:k], columns[:k]]
        return [out[:m, k] for k, m in enumerate(lengths)]


def tag(w: dict, texts: list[str]) -> list[np.ndarray]:
    """The tags of each text: overlapping windows are scored, blended where they overlap, and decoded over the whole text at once."""
    scorer = Scorer(w)
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
    order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: -len(texts[k]))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        group = order[at : at + max(1, BATCH_CHARS // longest)]
        at += len(group)
        codes = [encode(texts[k]) for k in group]
        if longest <= WINDOW:
            em, alive = scorer.emissions(codes)
        else:
            em, alive = _blended(scorer, codes)
        for k, tags in zip(group, scorer.decode(em, alive, [len(c) for c in codes])):
            out[k] = tags
    return out


def _blended(scorer: Scorer, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of texts, longest first, from overlapping windows that fade into each other."""
    longest, some = len(codes[0]), max(1, BATCH_CHARS // WINDOW)
    em, weight = np.zeros((longest, TAGS, len(codes)), np.float32), np.zeros((longest, 1, len(codes)), np.float32)
    ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    starts = [(k, i) for k, c in enumerate(codes) for i in range(0, max(1, len(c) - OVERLAP), WINDOW - OVERLAP)]
    starts.sort(key=lambda s: -min(WINDOW, len(codes[s[0]]) - s[1]))
    for s in range(0, len(starts), some):
        part, _ = scorer.emissions([codes[k][i : i + WINDOW] for k, i in starts[s : s + some]])
        for j, (k, i) in enumerate(starts[s : s + some]):
            n = min(WINDOW, len(codes[k]) - i)
            em[i : i + n, :, k] += part[:n, :, j] * ramp[:n]
            weight[i : i + n, :, k] += ramp[:n]
    em /= np.maximum(weight, 1e-6)
    return em, np.searchsorted([-len(c) for c in codes], -np.arange(longest), "left")


def spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type): a run of one type's tags; a new beginning ends the run before."""
    out, at = [], 0
    kinds = np.where(tags > 0, (tags.astype(np.int16) + 1) // 2, 0)
    edges = np.flatnonzero((np.diff(kinds) != 0) | ((tags[1:] % 2 == 1) & (tags[1:] > 0))) + 1
    for end in [*edges.tolist(), len(tags)]:
        if end > at and kinds[at]:
            out.append((at, end, TYPES[kinds[at] - 1]))
        at = end
    return out
