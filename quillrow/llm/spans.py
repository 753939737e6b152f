"""Spans of fixed patterns in flat text buffers, found from rare anchor bytes.

Every finder gives the leftmost non-overlapping matches of its pattern, as a regular expression
engine does, but in time linear in the text: digit runs and anchors come from vectorised scans, and
only the surroundings of an anchor are looked at in Python.  Offsets are bytes until ``CodePoints``
turns them into code points.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

from .textbatch import Texts, runs


def byte_class(chars: bytes, *ranges: tuple[str, str]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    for a, b in ranges:
        table[ord(a) : ord(b) + 1] = True
    return table


DIGIT = byte_class(b"", ("0", "9"))
ALNUM = byte_class(b"", ("0", "9"), ("A", "Z"), ("a", "z"))
LOCAL = ALNUM | byte_class(b"._%+-")
PHONE = DIGIT | byte_class(b" ().-")
UPPER_DIGIT = byte_class(b"", ("0", "9"), ("A", "Z"))
HEX = byte_class(b"", ("0", "9"), ("a", "f"))
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_KEYWORDS = (b"passw", b"secret", b"token", b"api")

#: One match: (text, start byte, end byte) within the slice.
Found = list[tuple[int, int, int]]


class CodePoints:
    def __init__(self, texts: Texts) -> None:
        self.count = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        self.base = self.count[texts.offsets]

    def __call__(self, text: int, at: int) -> int:
        return int(self.count[at] - self.base[text])


class Scan:
    """One slice of texts with the scans that several finders share."""

    def __init__(self, texts: Texts) -> None:
        self.texts = texts
        self.data = texts.data
        self.body = texts.data.tobytes()
        self.stop = texts.offsets
        self.digits = runs(DIGIT[texts.data], texts.offsets)
        self.digit_doc = self.digits.doc

    def doc_of(self, at) -> np.ndarray:
        return np.searchsorted(self.stop, at, "right") - 1

    def _linked(self, joints: np.ndarray) -> np.ndarray:
        """Whether each digit run is followed by one byte of the class and another run, in its text."""
        d = self.digits
        if len(d.start) < 2:
            return np.zeros(len(d.start), bool)
        near = (d.start[1:] - d.end[:-1] == 1) & (self.digit_doc[1:] == self.digit_doc[:-1])
        return np.append(near & joints[self.data[np.minimum(d.end[:-1], len(self.data) - 1)]], False)

    def _chains(self, joints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First run and number of runs of every maximal chain of linked runs."""
        linked = self._linked(joints)
        first = np.flatnonzero(~np.append(False, linked[:-1])) if len(linked) else np.zeros(0, int)
        return first, np.diff(np.append(first, len(linked)))

    def ips(self) -> Found:
        first, n = self._chains(byte_class(b"."))
        found = []
        d = self.digits
        for f, many in zip(first[n >= 4].tolist(), n[n >= 4].tolist()):
            for k in range(f, f + many - 3, 4):
                parts = [self.body[d.start[j] : d.end[j]].lstrip(b"0") for j in range(k, k + 4)]
                if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
                    found.append((int(self.digit_doc[k]), int(d.start[k]), int(d.end[k + 3])))
        return found

    def cards(self) -> Found:
        first, n = self._chains(byte_class(b" -"))
        d = self.digits
        total = np.concatenate([[0], np.cumsum(d.end - d.start)])
        many = total[first + n] - total[first]
        found = []
        for f, k in zip(first[(many >= 12) & (many <= 19)].tolist(), n[(many >= 12) & (many <= 19)].tolist()):
            s, e = int(d.start[f]), int(d.end[f + k - 1])
            if luhn(self.body[s:e]):
                found.append((int(self.digit_doc[f]), s, e))
        return found

    def phones(self) -> Found:
        plus = np.flatnonzero(self.data == 0x2B)
        if not len(plus) or not len(self.digits.start):
            return []
        stop = self.stop[self.doc_of(plus) + 1]
        ok = (plus + 1 < stop) & DIGIT[self.data[np.minimum(plus + 1, len(self.data) - 1)]]
        plus, stop = plus[ok], stop[ok]
        outside = np.append(np.flatnonzero(~PHONE[self.data]), len(self.data))
        limit = np.minimum(outside[np.searchsorted(outside, plus + 1)], stop)
        total = np.concatenate([[0], np.cumsum(DIGIT[self.data])])
        d = self.digits
        last = np.searchsorted(d.start, limit) - 1  # the last run that begins before the limit
        end = np.minimum(d.end[last], limit)
        many = total[end] - total[plus]
        ok = (end - plus >= 4) & (many >= 9) & (many <= 15)
        return list(zip(self.doc_of(plus[ok]).tolist(), plus[ok].tolist(), end[ok].tolist()))

    def emails(self) -> Found:
        at = np.flatnonzero(self.data == 0x40)
        if not len(at):
            return []
        doc = self.doc_of(at)
        outside = np.concatenate([[-1], np.flatnonzero(~LOCAL[self.data])])
        left = np.maximum(outside[np.searchsorted(outside, at) - 1] + 1, self.stop[doc])
        found, taken = [], 0
        for p, s, t in zip(at.tolist(), left.tolist(), doc.tolist()):
            s = max(s, taken)
            if s < p and (m := _DOMAIN.match(self.body, p + 1, int(self.stop[t + 1]))):
                taken = m.end()
                found.append((t, s, taken))
        return found

    def _anchored(self, text: bytes, word: bytes) -> list[int]:
        at, found = text.find(word), []
        while at >= 0:
            found.append(at)
            at = text.find(word, at + 1)
        return found

    def assigns(self) -> Found:
        low = self.body.lower()
        hits = sorted(h for w in _KEYWORDS for h in self._anchored(low, w))
        docs = self.doc_of(np.array(hits, dtype=np.int64)).tolist() if hits else []
        found, taken = [], 0
        for p, t in zip(hits, docs):
            if p >= taken and (m := _ASSIGN.match(self.body, p, int(self.stop[t + 1]))):
                taken = m.end()
                if m.end(1) - m.start(1) >= 6:
                    found.append((t, p, taken))
        return found

    def accesses(self) -> Found:
        found, taken = [], 0
        hits = self._anchored(self.body, b"AKIA")
        if not hits:
            return found
        outside = np.append(np.flatnonzero(~UPPER_DIGIT[self.data]), len(self.data))
        for p, t in zip(hits, self.doc_of(np.array(hits)).tolist()):
            if p < taken:
                continue
            stop = int(self.stop[t + 1])
            end = min(int(outside[np.searchsorted(outside, p)]), stop)
            if end > p + 4:
                taken = end
                if end - p >= 20:
                    found.append((t, p, end))
        return found

    def hexes(self) -> Found:
        h = runs(HEX[self.data], self.stop)
        long = h.end - h.start >= 24
        return list(zip(h.doc[long].tolist(), h.start[long].tolist(), h.end[long].tolist()))


def luhn(text: bytes) -> bool:
    digits = [b - 48 for b in text if 48 <= b <= 57]
    total = sum(digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return total % 10 == 0


def listing(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas.  spans: (start, kind, end)."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
