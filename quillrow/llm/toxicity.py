"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words are runs of letters and digits, folded to lower case.  A word's input is the sum of
a hashed embedding of the word and hashed embeddings of its byte n-grams with both ends marked, so
inflected and unseen forms of a stem share their inputs.  Windows of ``WINDOW`` words, each
overlapping the next by a quarter, cover every word of every text; both directions of a gated
recurrent layer read a window, attention pools the states, and a text's score is that of its
highest window after a two-parameter calibration on the training texts.

Training is on the driver, from a bounded sample of labelled rows: at most ``SAMPLE`` rows of each
label, the first by a hash of the doc_id, of texts up to ``LONGEST`` characters.  The highest window of
each text carries its label from the third pass on; before that, one drawn at random does.

Defined results: a null text or one without words has one window without words, scored like any;
repeated rows each give a row; an empty table gives an empty result; where no label can be learnt
from (no labelled rows in the learning folds), every score is 0.5; extra columns are ignored.

Scale: scoring is a map without a shuffle, over whole texts, in windows batched by slices.  The
sample of ids is broadcast and the network pickled into the tasks: both have fixed sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import ALNUM
from .textbatch import LOWER, Texts, runs, slices, span_hashes

SAMPLE, LONGEST = 2500, 20_000
WINDOW, STEP = 64, 48
BUCKETS, SIZE, HIDDEN, ATTEND = 1 << 15, 12, 8, 8
GRAMS = (4, 5, 6)
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
PASSES, BATCH, RATE = 10, 128, 0.01
_KEEP = ALNUM.copy()
_KEEP[128:] = True


@dataclass
class Tokens:
    """Distinct words of a slice and where each stands."""

    index: np.ndarray  # for every word, its place among the distinct ones
    cuts: np.ndarray
    word: np.ndarray  # bucket of each distinct word
    grams: list[tuple[np.ndarray, np.ndarray]]  # per n: buckets in order of the words, and the words' cuts


def tokenize(texts: Texts) -> Tokens:
    data = LOWER[texts.data]
    if len(data) > 1:  # capital letters of the Latin-1 block, in UTF-8
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 0x20
    w = runs(_KEEP[data], texts.offsets)
    hashes = span_hashes(data, w.start, w.end)
    distinct, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    start, length = w.start[first], (w.end - w.start)[first]
    place = np.cumsum(length + 2) - (length + 2)
    marked = np.full(int(length.sum()) + 2 * len(length), 0x20, dtype=np.uint8)
    total = int(length.sum())
    within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    marked[np.repeat(place + 1, length) + within] = data[np.repeat(start, length) + within]
    grams = []
    for n in GRAMS:
        many = np.maximum(length + 3 - n, 0)
        cuts = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(place - cuts[:-1], many) + np.arange(cuts[-1])
        grams.append(((span_hashes(marked, at, at + n) % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS, cuts))
    return Tokens(index, w.cuts, (distinct % np.uint64(BUCKETS)).astype(np.int64), grams)


def _merged(parts: list[Tokens]) -> Tokens:
    """Several slices as one; words that several hold stay apart, with the same buckets."""
    before = np.cumsum([0, *(len(t.word) for t in parts)])
    ends = lambda cuts: np.concatenate([[0], *(c[1:] + b for c, b in zip(cuts, np.cumsum([0, *(c[-1] for c in cuts)])))])
    return Tokens(
        np.concatenate([t.index + b for t, b in zip(parts, before)]),
        ends([t.cuts for t in parts]),
        np.concatenate([t.word for t in parts]),
        [(np.concatenate([t.grams[k][0] for t in parts]), ends([t.grams[k][1] for t in parts])) for k in range(len(GRAMS))],
    )


def windows(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of overlapping windows that cover every word of every text."""
    n = np.diff(cuts)
    many = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STEP) + 1)
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = np.minimum(k * STEP, np.maximum(n[text] - WINDOW, 0)) + cuts[text]
    return first, np.minimum(n[text], WINDOW), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        make = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": (r.standard_normal((2 * BUCKETS, SIZE)) * 0.05).astype(np.float32)}
        for d in ("f", "b"):
            self.p |= {f"W{d}": make(SIZE, 3 * HIDDEN), f"U{d}": make(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": make(2 * HIDDEN, ATTEND), "v": make(ATTEND), "w": make(2 * HIDDEN), "o": np.full(1, -1, np.float32)}
        self.scale = np.array([1.0, 0.0])

    def inputs(self, t: Tokens) -> np.ndarray:
        """The input vector of each distinct word; a last row of zeros stands for no word."""
        embed = self.p["embed"]
        x = np.zeros((len(t.word) + 1, SIZE), np.float32)
        x[:-1] = embed[t.word]
        for bucket, cuts in t.grams:
            has = np.flatnonzero(np.diff(cuts))
            for at in range(0, len(has), 20_000):
                part = has[at : at + 20_000]
                lo, hi = cuts[part[0]], cuts[part[-1] + 1]
                x[part] += np.add.reduceat(embed[bucket[lo:hi]], cuts[part] - lo, axis=0)
        return x

    def _layer(self, d: str, gates: np.ndarray, index: np.ndarray, live: np.ndarray, keep: bool):
        U = self.p[f"U{d}"]
        T, B = index.shape
        h = np.zeros((B, HIDDEN), np.float32)
        states = np.zeros((T, B, HIDDEN), np.float32)
        saved = []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            g = gates[index[t]]
            u = h @ U
            zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            un = u[:, 2 * HIDDEN :]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * un)
            new = n + z * (h - n)
            m = live[t][:, None]
            if keep:
                saved.append((t, h, z, r, un, n, m))
            h = np.where(m, new, h)
            states[t] = h
        return states, saved

    def forward(self, x: np.ndarray, index: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logits of windows: index[t, b] into x; live[t, b] where there is a word."""
        states, saved = [], {}
        for d in ("f", "b"):
            s, saved[d] = self._layer(d, x @ self.p[f"W{d}"] + self.p[f"c{d}"], index, live, keep)
            states.append(s)
        H = np.concatenate(states, axis=2)
        u = np.tanh(H @ self.p["A"])
        e = np.where(live, u @ self.p["v"], -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, H)
        logit = pooled @ self.p["w"] + self.p["o"]
        return (logit, (H, u, a, pooled, saved)) if keep else logit

    def backward(self, x, index, live, kept, dlogit) -> tuple[dict, np.ndarray]:
        H, u, a, pooled, saved = kept
        p = self.p
        g = {"w": pooled.T @ dlogit, "o": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * p["w"]
        da = np.einsum("bh,tbh->tb", dpool, H)
        dH = a[..., None] * dpool[None]
        de = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tb,tbk->k", de, u)
        du = de[..., None] * p["v"] * (1 - u * u)
        g["A"] = np.einsum("tbh,tbk->hk", H, du, optimize=True)
        dH = dH + du @ p["A"].T
        dx = np.zeros_like(x)
        for k, d in enumerate(("f", "b")):
            U = p[f"U{d}"]
            dU = np.zeros_like(U)
            dgates = np.zeros((index.shape[0], index.shape[1], 3 * HIDDEN), np.float32)
            dh = np.zeros((index.shape[1], HIDDEN), np.float32)
            for t, h, z, r, un, n, m in reversed(saved[d]):
                dh = dh + dH[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dnew = np.where(m, dh, 0)
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du_ = np.concatenate([dz, dr, dn * r], axis=1)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                dU += h.T @ du_
                dh = np.where(m, 0, dh) + dnew * z + du_ @ U.T
            flat = dgates.reshape(-1, 3 * HIDDEN)
            rows = np.zeros((len(x), 3 * HIDDEN), np.float32)
            order = np.argsort(index.ravel(), kind="stable")
            own = index.ravel()[order]
            cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            rows[own[cut]] = np.add.reduceat(flat[order], cut, axis=0)
            g |= {f"U{d}": dU, f"c{d}": flat.sum(0), f"W{d}": x.T @ rows}
            dx += rows @ p[f"W{d}"].T
        return g, dx

    def logits(self, texts: Texts, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The highest window's logit of each text, and its number of windows."""
        t = tokenize(texts)
        x = self.inputs(t)
        first, length, text = windows(t.cuts)
        out = np.empty(len(first), np.float32)
        index = np.append(t.index, len(x) - 1)
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), most):
            part = order[at : at + most]
            out[part] = self.forward(x, *grid(index, first[part], length[part]))
        cut = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        return np.maximum.reduceat(out, cut), np.diff(np.append(cut, len(text)))

    def scores(self, texts: Texts) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.logits(texts)[0].astype(np.float64) + self.scale[1])


def grid(index: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in x of windows' words, time first, and where there is a word.  index ends with no word."""
    steps = np.arange(max(1, int(length.max())))[:, None]
    live = steps < length[None, :]
    return np.where(live, index[np.minimum(first[None, :] + steps, len(index) - 1)], index[-1]), live


def _adam(p: dict, g: dict, state: dict, rate: float) -> None:
    state["t"] = t = state.get("t", 0) + 1
    for k, d in g.items():
        m, v = state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
        m += 0.1 * (d - m)
        v += 0.01 * (d * d - v)
        p[k] -= (rate / (1 - 0.9**t)) * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)


def train(texts: list[str], labels: np.ndarray, passes: int = PASSES, rate: float = RATE, seed: int = 9) -> Network:
    """Fit the network, then the calibration of texts' highest logits."""
    r = np.random.default_rng(seed)
    net = Network()
    column = pa.array(texts, pa.large_string())
    t = _merged([tokenize(part) for part in slices(column)])
    first, length, text = windows(t.cuts)
    index = np.append(t.index, len(t.word))
    label = labels.astype(np.float32)
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    many = np.diff(begin)
    positive = max(1.0, label.sum())
    weight = np.where(label > 0, 0.35 * len(label) / positive, 0.65 * len(label) / max(1.0, len(label) - positive)).astype(np.float32)
    state: dict = {}
    square = np.zeros(len(net.p["embed"]), np.float32)
    for turn in range(passes):
        chosen = begin[:-1] + (r.random(len(texts)) * many).astype(np.int64)
        if turn >= 2:  # the highest window carries the label; of clean texts also one at random
            if turn % 2 == 0:  # found anew in every other pass
                top = _highest(net, t, index, first, length, text)
            chosen = np.where((label > 0) | (r.random(len(texts)) < 0.5), top, chosen)
        for at in np.array_split(r.permutation(len(texts)), max(1, len(texts) // BATCH)):
            win = chosen[at]
            idx, live = grid(index, first[win], length[win])
            used, local = np.unique(idx, return_inverse=True)
            sub = _subset(t, used)
            x = net.inputs(sub)
            local = local.reshape(idx.shape)
            local = np.where(used[local] == len(t.word), len(x) - 1, local)
            logit, kept = net.forward(x, local, live, keep=True)
            delta = (weight[at] * (_sigmoid(logit) - label[at]) / len(at)).astype(np.float32)
            g, dx = net.backward(x, local, live, kept, delta)
            step = rate * (1 - turn / (passes + 1))
            _adam(net.p, g, state, step)
            _embed_step(net.p["embed"], square, sub, dx, 5 * step)
    top = np.concatenate([net.logits(part)[0] for part in slices(column)])
    net.scale = _calibrate(top.astype(np.float64), label)
    return net


def _highest(net: Network, t: Tokens, index, first, length, text) -> np.ndarray:
    x = net.inputs(t)
    out = np.empty(len(first), np.float32)
    for at in range(0, len(first), 2048):
        part = slice(at, at + 2048)
        out[part] = net.forward(x, *grid(index, first[part], length[part]))
    order = np.lexsort((out, text))
    return order[np.flatnonzero(np.append(text[order][1:] != text[order][:-1], True))]


def _subset(t: Tokens, used: np.ndarray) -> Tokens:
    """The distinct words at ``used`` alone (a last place beyond them, for no word, is left out)."""
    used = used[used < len(t.word)]
    grams = []
    for bucket, cuts in t.grams:
        many = np.diff(cuts)[used]
        new = np.concatenate([[0], np.cumsum(many)])
        grams.append((bucket[np.repeat(cuts[used] - new[:-1], many) + np.arange(new[-1])], new))
    return Tokens(np.zeros(0, np.int64), np.zeros(1, np.int64), t.word[used], grams)


def _embed_step(embed: np.ndarray, square: np.ndarray, t: Tokens, dx: np.ndarray, rate: float) -> None:
    """AdaGrad by row on the embeddings of the words and n-grams that were used."""
    bucket = np.concatenate([t.word, *(b for b, _ in t.grams)])
    owner = np.concatenate([np.arange(len(t.word)), *(np.repeat(np.arange(len(t.word)), np.diff(c)) for _, c in t.grams)])
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rows = bucket[cut]
    g = np.add.reduceat(dx[owner], cut, axis=0)
    square[rows] += (g * g).mean(1)
    embed[rows] -= rate * g / (np.sqrt(square[rows])[:, None] + 1e-6)


def _calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Slope and offset of a logistic fit by Newton's method, lightly held to (1, 0)."""
    s = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        p = _sigmoid(design @ s)
        g = design.T @ (p - y) + 0.5 * (s - [1.0, 0.0])
        h = (design * (p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        step = np.linalg.solve(h, g)
        s -= step
        if np.abs(step).max() < 1e-9:
            break
    return s


def fold_of(ids: list) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids), np.int64, len(ids))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, longest: int = LONGEST) -> pa.Table:
    """At most ``most`` texts of each label (0 and 1) from the learning folds, with their labels."""
    learn = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT))
    keyed = learn.select("doc_id", "toxic", F.xxhash64("doc_id").alias("key"))
    ids = keyed.where("toxic = 1").orderBy("key", "doc_id").limit(most).union(keyed.where("toxic = 0").orderBy("key", "doc_id").limit(most))
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= longest).join(F.broadcast(ids.drop("key")), "doc_id")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * most).select("text", "toxic").toArrow()


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    rows = sample(docs, labels)
    y = rows.column("toxic").to_numpy()
    net = train(rows.column("text").to_pylist(), y) if len(y) and 0 < y.sum() < len(y) else None
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                ids = batch.slice(texts.first, texts.n).column("doc_id")
                s = net.scores(texts) if net is not None else np.full(texts.n, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(fold_of(ids.to_pylist()) == HELD_OUT), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
