"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field labels words as outside, or as first or inner word of an email address, an IP address, a
card number, or a phone number.  It is trained on the small labelled table below by
gradient ascent on the regularised log-likelihood (forward-backward in numpy) and decoded by Viterbi
in batches of equally padded sequences.  A word more than ``REACH`` words from any that holds a digit or
an at sign can only be outside (a span has such words, and no gap of that length): a structural zero of
the field.  A text therefore falls into sequences between words that are outside, and decoding each
with one such word on either side gives what decoding the whole text would give.  Words count whole,
whatever their length.

Defined results: null or empty text has no spans; fixed-pattern spans stay, and a labelled span is
added only where it overlaps none of them and could be of its kind (an at sign; four numbers up to 255; 12 to
19 digits that pass Luhn; 9 to 15 digits; neither with letters); repeated rows each give a row; an empty table gives an
empty result; extra columns are ignored.

Scale: a map without a shuffle; the field is trained on the driver from a table of bounded size.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .spans import ALNUM, DIGIT, CodePoints, Scan, byte_class, digest, listing, luhn
from .textbatch import Texts, slices, words

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
REACH = 2
#: Words, padding included, that are labelled at once; a longer sequence is labelled by itself.
BATCH_WORDS = 1 << 19
SENTENCES = 1000  # rows of the labelled table
#: Words that tell what follows.
CUES = {w: k for k, ws in enumerate(("phone tel telephone call fax mobile cell whatsapp ruf telefon appeler llame", "card visa credit debit account mastercard karte carte tarjeta", "ssn isbn order invoice id no nr ref number case ticket")) for w in ws.encode().split()}
_EDGE = ALNUM | byte_class(b"+()@") | byte_class(bytes(range(128, 256)))
_SPECIAL = (DIGIT | byte_class(b"@")).copy()


def labelled(n: int = SENTENCES, seed: int = 5) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label), made from templates: personal data of all four kinds, and the
    numbers that stand in ordinary text (years, prices, versions, dates, counts, hashes)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choices("0123456789", k=k))
    syllables = ["th", "er", "on", "an", "le", "en", "ti", "st", "der", "ung", "que", "os", "ción", "eau"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    junk = lambda w: w + r.choice(["", "", "", "", ".", ",", "%%%", "!!", "###", "***", ";"])
    host = lambda: ".".join([word() + r.choice(["", d(1)]), r.choice(["com", "org", "example.com", "net"])])

    def email() -> list[str]:
        return [f"{word()}{r.choice(['.', '_', ''])}{r.choice([d(2), word()])}@{host()}"]

    def ip() -> list[str]:
        return [".".join(str(r.randint(0, 255)) for _ in range(4))]

    def card() -> list[str]:
        k = r.choice([16, 16, 16, 15, 13, 19])
        return [d(k)] if r.random() < 0.6 else ([d(4) for _ in range(4)] if r.random() < 0.6 else ["-".join(d(4) for _ in range(4))])

    def phone() -> list[str]:
        return r.choice(
            [
                lambda: ["+1", f"({d(3)})", f"{d(3)}-{d(4)}"],
                lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"],
                lambda: [f"+{d(2)}", d(3), d(3), d(4)],
                lambda: [f"{d(3)}-{d(3)}-{d(4)}"],
                lambda: [f"+{d(2)}", f"{d(2)}", f"{d(4)}-{d(4)}"],
                lambda: [f"{d(3)}.{d(3)}.{d(4)}"],
                lambda: [d(3), d(3), d(4)],
                lambda: [f"00{d(2)}", d(2), d(4), d(4)],
                lambda: [f"0{d(2)}", d(8)],
                lambda: [f"(0{d(2)})", d(4), d(4)],
            ]
        )()

    def plain() -> list[str]:
        return r.choice(
            [
                lambda: [d(r.randint(1, 6))],
                lambda: [f"{r.randint(1900, 2030)}"],
                lambda: [f"{d(1)}.{d(1)}"],
                lambda: [f"{d(1)}.{d(1)}.{d(2)}"],
                lambda: [f"${d(3)}.{d(2)}"],
                lambda: [f"20{d(2)}-{d(2)}-{d(2)}"],
                lambda: [f"{d(2)}/{d(2)}/{d(4)}"],
                lambda: [f"{d(2)}:{d(2)}"],
                lambda: [f"{d(1)},{d(3)},{d(3)}"],
                lambda: ["".join(r.choices("0123456789abcdef", k=40))],
                lambda: [word() + d(2)],
                lambda: ["@" + word()],
                lambda: [f"{d(3)}-{d(2)}"],
                lambda: [f"({d(1)})"],
                lambda: [d(3), d(2), d(4)],
                lambda: [f"{d(3)}-{d(2)}-{d(4)}"],
                lambda: [f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"],
                lambda: [d(r.randint(7, 11))],
                lambda: [f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}"],
                lambda: [d(r.randint(1, 3)), d(r.randint(1, 3)), d(r.randint(1, 3))],
                lambda: [d(3), d(3), d(3)],
                lambda: ["version", d(1) + "."],
            ]
        )()

    makers = dict(zip(KINDS, (email, ip, card, phone)))
    cues = [[w.decode() for w, k in CUES.items() if k == n] for n in range(3)]
    rows = []
    for _ in range(n):
        row: list[tuple[str, str]] = [(junk(word()), "O") for _ in range(r.randint(0, 3))]
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                if r.random() < 0.2:
                    row.append((r.choice(cues[2]) + r.choice(["", ":"]), "O"))
                row += [(junk(w), "O") for w in plain()]
            else:
                kind = r.choice(KINDS)
                parts = makers[kind]()
                if kind in ("card", "phone") and r.random() < 0.3:
                    row.append((r.choice(cues[kind == "card"]) + r.choice(["", ":"]), "O"))
                parts[-1] = junk(parts[-1])
                if r.random() < 0.15:
                    parts = [p.upper() for p in parts]
                row += [(w, f"{'B' if i == 0 else 'I'}-{kind}") for i, w in enumerate(parts)]
            row += [(junk(word()), "O") for _ in range(r.randint(1, 3))]
        rows.append(row)
    return rows


#: Features: hashed shape, digit count, and marks, of the word and of its two neighbours.
_BUCKETS, _MARKS = 2048, 12
FEATURES = 3 * (_BUCKETS + 24 + _MARKS)
#: Digits as 9, letters and other characters as a, the rest as it is; equal neighbours once, but for brackets.
_SHAPE = bytes(57 if 48 <= b <= 57 else 97 if ALNUM[b] or b >= 128 else b for b in range(256))
_AGAIN = re.compile(rb"([^(])\1+", re.DOTALL)


def _word_features(word: bytes) -> tuple[int, ...]:
    """Indices of the features that a word has by itself."""
    s, e = 0, len(word)
    while s < e and not _EDGE[word[s]]:
        s += 1
    while e > s and not _EDGE[word[e - 1]] and word[e - 1] != 41:
        e -= 1
    core = word[s:e]
    full = core.translate(_SHAPE)
    n = full.count(b"9")
    marks = _BUCKETS + 24
    found = [zlib.crc32(_AGAIN.sub(rb"\1", full)) % _BUCKETS, _BUCKETS + min(n, 23)]
    if b"@" in core:
        found.append(marks)
    if core[:1] == b"+":
        found.append(marks + 1)
    if core[:1] == b"(" and core[-1:] == b")":
        found.append(marks + 2)
    if core.count(b".") == 3 and n >= 4:
        found.append(marks + 3)
    if n == len(core) and n:
        found.append(marks + 4)
    if not n:
        found.append(marks + 5)
        cue = CUES.get(core.lower().rstrip(b":"))
        if cue is not None:
            found.append(marks + 8 + cue)
    if b"a" in full:
        found.append(marks + 6)
    found.append(marks + 7)
    return tuple(found)


class Field:
    """Emission weights by feature and label, and transition weights between labels."""

    def __init__(self) -> None:
        k = len(LABELS)
        self.emit = np.zeros((FEATURES, k))
        self.move = np.zeros((k + 1, k))  # the last row: from the start
        self.barred = np.zeros((k + 1, k))
        for j, label in enumerate(LABELS):
            if label[0] == "I":  # an inner word follows its own kind only
                self.barred[:, j] = -1e9
                self.barred[[j, j - 1], j] = 0

    def features(self, sequence: list[bytes]) -> list[list[int]]:
        own = [_word_features(w) for w in sequence]
        third = FEATURES // 3
        rows = []
        for i, f in enumerate(own):
            row = list(f)
            if i:
                row += [third + x for x in own[i - 1]]
            if i + 1 < len(own):
                row += [2 * third + x for x in own[i + 1]]
            rows.append(row)
        return rows

    def scores(self, sequences: list[list[bytes]], outside: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list]:
        """Emission scores padded to the longest sequence, lengths, and the features.

        outside: for each sequence, which words can only be outside.
        """
        length = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), int(length.max()), len(LABELS)))
        feats = [self.features(s) for s in sequences]
        for b, rows in enumerate(feats):
            for t, row in enumerate(rows):
                out[b, t] = self.emit[row].sum(0)
            if outside is not None:
                out[b, np.flatnonzero(outside[b]), 1:] = -1e9
        return out, length, feats

    def viterbi(self, scores: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        move = self.move + self.barred
        best = scores[:, 0] + move[-1]
        back = np.zeros(scores.shape, dtype=np.int8)
        for t in range(1, scores.shape[1]):
            step = best[:, :, None] + move[None, :-1]
            back[:, t] = step.argmax(1)
            new = step.max(1) + scores[:, t]
            best = np.where((t < length)[:, None], new, best)
        paths = []
        for b, n in enumerate(length.tolist()):
            at = int(best[b].argmax())
            path = [at]
            for t in range(n - 1, 0, -1):
                at = int(back[b, t, at])
                path.append(at)
            paths.append(np.array(path[::-1]))
        return paths

    def train(self, rows: list[list[tuple[str, str]]], rounds: int = 60, rate: float = 0.3, penalty: float = 1e-4) -> Field:
        """Full-batch AdaGrad on the mean log-likelihood."""
        k = len(LABELS)
        sequences = [[w.encode() for w, _ in row] for row in rows]
        _, length, feats = self.scores(sequences)
        n, longest = len(rows), int(length.max())
        gold = np.zeros((n, longest), dtype=int)
        for b, row in enumerate(rows):
            gold[b, : len(row)] = [LABELS.index(x) for _, x in row]
        mask = np.arange(longest)[None, :] < length[:, None]
        at = [(b * longest + t, f) for b, rs in enumerate(feats) for t, r in enumerate(rs) for f in r]
        cell, feature = np.array(at).T
        order = np.argsort(cell, kind="stable")
        cell, feature = cell[order], feature[order]
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        by_feature = np.argsort(feature, kind="stable")
        feature_starts = np.flatnonzero(np.append(True, np.diff(feature[by_feature]) != 0))
        one = np.eye(k)[gold] * mask[..., None]
        square_e, square_m = np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)
        for _ in range(rounds):
            scores = np.zeros((n * longest, k))
            scores[cell[starts]] = np.add.reduceat(self.emit[feature], starts, axis=0)
            scores = scores.reshape(n, longest, k)
            move = self.move + self.barred
            alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
            alpha[:, 0] = scores[:, 0] + move[-1]
            for t in range(1, longest):
                new = _logsum(alpha[:, t - 1, :, None] + move[None, :-1], 1) + scores[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = _logsum(move[None, :-1] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
            total = _logsum(alpha[:, -1], 1)
            node = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
            delta = (one - node).reshape(n * longest, k)
            grad = np.zeros_like(self.emit)
            grad[feature[by_feature][feature_starts]] = np.add.reduceat(delta[cell[by_feature]], feature_starts, axis=0)
            moved = np.zeros_like(self.move)
            moved[-1] = (one[:, 0] - node[:, 0]).sum(0)
            for t in range(1, longest):
                live = mask[:, t]
                pair = np.exp(alpha[live, t - 1, :, None] + move[None, :-1] + (scores[live, t] + beta[live, t])[:, None, :] - total[live, None, None])
                moved[:-1] += np.einsum("bi,bj->ij", one[live, t - 1], one[live, t]) - pair.sum(0)
            grad, moved = grad / n - penalty * self.emit, moved / n - penalty * self.move
            square_e += grad**2
            square_m += moved**2
            self.emit += rate * grad / np.sqrt(square_e)
            self.move += rate * moved / np.sqrt(square_m)
        return self


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


#: What cards and phone numbers are written with.
_CARD, _NUMBER = re.compile(rb"[0-9\s-]+"), re.compile(rb"[0-9\s+()./-]+")


def _core(word: bytes) -> tuple[int, int]:
    """The word without the marks around it."""
    s, e = 0, len(word)
    while s < e and not _EDGE[word[s]]:
        s += 1
    while e > s and not (ALNUM[word[e - 1]] or word[e - 1] == 41 or word[e - 1] >= 128):
        e -= 1
    return s, e


def _plausible(kind: int, text: bytes) -> bool:
    """What the contract's own kinds can hold at all; labels that contradict it are dropped."""
    n = int(DIGIT[np.frombuffer(text, np.uint8)].sum())
    if kind == 0:
        return b"@" in text
    if kind == 1:
        parts = text.split(b".")
        return len(parts) == 4 and all(p.isdigit() and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= n <= 19 and _CARD.fullmatch(text) is not None and luhn(text)
    return 9 <= n <= 15 and _NUMBER.fullmatch(text) is not None


def tagged(texts: Texts, body: bytes, field: Field, batch: int = BATCH_WORDS) -> list[tuple[int, int, int, int]]:
    """Labelled spans (text, start byte, kind, end byte)."""
    w = words(texts)
    special = np.concatenate([[0], np.cumsum(_SPECIAL[texts.data])])
    near = special[w.end] > special[w.start]
    if not near.any():
        return []
    doc = w.doc
    seeds = np.flatnonzero(near)
    chosen = np.zeros(len(doc), bool)
    for k in range(-REACH, REACH + 1):
        at = seeds + k
        ok = (at >= 0) & (at < len(doc))
        ok[ok] = doc[at[ok]] == doc[seeds[ok]]
        chosen[at[ok]] = True
    index = np.flatnonzero(chosen)
    cut = np.flatnonzero(np.append(True, (np.diff(index) != 1) | (np.diff(doc[index]) != 0)))
    last = np.append(cut[1:], len(index)) - 1
    # each with the words on either side, which are outside
    low = index[cut] - ((index[cut] > 0) & (doc[np.maximum(index[cut] - 1, 0)] == doc[index[cut]]))
    high = index[last] + 1
    high += (high < len(doc)) & (doc[np.minimum(high, len(doc) - 1)] == doc[index[last]])
    pieces = [np.arange(a, b) for a, b in sorted(zip(low.tolist(), high.tolist()), key=lambda x: x[1] - x[0])]
    found, at = [], 0
    while at < len(pieces):
        end = at + 1
        while end < len(pieces) and len(pieces[end]) * (end + 1 - at) <= batch:
            end += 1
        part, at = pieces[at:end], end
        scores, length, _ = field.scores([[body[w.start[i] : w.end[i]] for i in p.tolist()] for p in part], [~chosen[p] for p in part])
        for p, path in zip(part, field.viterbi(scores, length)):
            i = 0
            while i < len(path):
                j = i + 1
                if path[i]:
                    kind = (int(path[i]) - 1) // 2
                    while j < len(path) and path[j] == 2 * kind + 2:
                        j += 1
                    s, e = int(w.start[p[i]]), int(w.end[p[j - 1]])
                    s += _core(body[s : w.end[p[i]]])[0]
                    e = int(w.start[p[j - 1]]) + _core(body[w.start[p[j - 1]] : e])[1]
                    if s < e and _plausible(kind, body[s:e]):
                        found.append((int(doc[p[i]]), s, kind, e))
                i = j
    return found


def find(texts: Texts, field: Field) -> tuple[list[list], list[list]]:
    """For each text: fixed-pattern and labelled spans, as (start, kind, end) in code points."""
    scan = Scan(texts)
    points = CodePoints(texts)
    base: list[list] = [[] for _ in range(texts.n)]
    added: list[list] = [[] for _ in range(texts.n)]
    taken: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for kind, found in enumerate((scan.emails(), scan.ips(), scan.cards(), scan.phones())):
        for t, s, e in found:
            base[t].append((points(t, s), kind, points(t, e)))
            taken[t].append((s, e))
    for t, s, kind, e in tagged(texts, scan.body, field):
        if not any(a < e and s < b for a, b in taken[t]):
            added[t].append((points(t, s), kind, points(t, e)))
    return base, added


_field: Field | None = None


def trained() -> Field:
    global _field
    if _field is None:
        _field = Field().train(labelled())
    return _field


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, counts by fixed kind, n_added, base_sha256, spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                base, added = find(texts, field)
                count = lambda k: pa.array([sum(x[1] == k for x in b) for b in base], pa.int64())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.slice(texts.first, texts.n).column("doc_id"),
                        *map(count, range(4)),
                        pa.array(map(len, added), pa.int64()),
                        pa.array([digest(listing(b, KINDS)) for b in base]),
                        pa.array([listing(b + a, KINDS) for b, a in zip(base, added)]),
                    ],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")
