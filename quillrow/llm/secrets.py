"""Secret scans: fixed patterns, and formats learnt by grammar inference.

For each format of labelled credentials a prefix tree of character classes is built and its states
merged where their continuations are statistically compatible (Hoeffding bound on end and class
frequencies, folded recursively): first states of one depth, which gathers enough visits to tell
anything, then states of different depths.  A format of fixed length stays a chain, since its states
end at different distances; one of any length becomes a loop.  States also learn the characters of
each class, so that literal prefixes are kept.  Formats of ordinary runs (numbers, dates, versions,
UUIDs, short hashes and codes) are learnt the same way, and a bigram model of letters and of their case from
ordinary words; rows of one character have a model of their own.

Every maximal run of credential characters is a candidate, and so is every sequence of its parts
between separators (/ = . - _ +).  A candidate is scored by the likelihood of its best credential
format against that of its best ordinary format or the bigram model; one whose log ratio reaches the
threshold is a secret of kind ``token``.  A run that is one as a whole counts as a whole; of the parts of
others, and of what fixed patterns leave of a run, those count that don't overlap one that a format, ordinary
or not, fits better (no part of a UUID is a secret).
Candidates that would not reach the threshold if they were the likeliest string of their length (as
ordinary words are) aren't scored further.  Runs of more than ``PIECES`` parts are weighed in passes
which keep for each automaton and state the best start that leads there.

Defined results: null or empty text has no spans; fixed-pattern spans stay and learnt spans that
overlap one are left out; repeated rows each give a row; an empty table gives an empty result; extra
columns are ignored.  Whole texts are scanned whatever their length.

Scale: a map without a shuffle; the automata are learnt on the driver from the bounded table below.
Each distinct candidate of a slice is scored once, all together in numpy.
"""

from __future__ import annotations

import base64
import math
import random
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import ALNUM, CodePoints, Scan, byte_class, digest, listing
from .textbatch import Texts, Words, runs, slices, span_hashes

KINDS = ("assign", "access", "hex", "token")
CREDENTIAL = ALNUM | byte_class(b"+/_.=-")
EXAMPLES, OPEN_EXAMPLES = 120, 300  # labelled rows of each format, and of those of any length
#: What an end or a class that a state has never met counts, as a part of one observation.
RARE = 1e-5
#: Log odds (nats) from which a candidate is a secret.
THRESHOLD = 15.0
#: Parts of a run whose sequences are listed; the sequences of more are weighed by passes.
PIECES = 8
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = "+/_.=-"

#: Ordinary words of four languages, for the bigram model.
WORDS = """the of and to in is that it was for on are with they be at one have this from by hot but some what there we can out
other were all your when up use word how said each she which their time will way about many then them would write like these her long
make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down
side been now find any new work part take get place made live where after back little only round man year came show every good me give
our under name very through just form much great think say help low line before turn cause same mean differ move right boy old too does
tell sentence set three want air well also play small end put home read hand port large spell add even land here must big high such
follow act why ask men change went light kind off need house picture try us again animal point mother world near build self earth father
service example system public private internal config registry package release version image image images index static assets content
download upload account customer order invoice payment report archive backup storage database server client session request response
university international development government information management technology environment organization relationship communication
le la les de des du un une et est en que qui dans pour pas sur au avec il elle nous vous ils ont sont par plus mais comme tout faire
cette bien entre sans deux aussi leur monde temps jamais toujours quand homme femme jour grand petit autre notre travail maison question
der die das und ist nicht ein eine von zu mit den dem sich auf auch als an es werden aus er hat dass sie nach wird bei noch wie einem
zeit welt haus mensch arbeit leben zwischen schon immer gegen seine durch geschichte wirtschaft gesellschaft entwicklung verantwortung
el los las que por con para una del como mas pero sus este entre cuando muy sin sobre ser tiene hasta donde quien desde todo nos durante
mundo tiempo vida trabajo casa hombre mujer ciudad gobierno historia desarrollo administracion organizacion internacional""".split()


def labelled(seed: int = 11) -> dict[str, list[str]]:
    """Synthetic credentials by format; ordinary formats begin with ``plain``, ``plain`` are words."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choices(chars, k=n))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ti", "st", "es", "ou", "ing", "ion", "le", "sch", "ung", "que", "os", "ci", "eau", "pa", "ver"]
    word = lambda: r.choice(WORDS) if r.random() < 0.7 else "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    mixed, hexa = _DIGITS + _LOWER + _UPPER, _DIGITS + "abcdef"
    part = lambda n: base64.urlsafe_b64encode(bytes(r.randrange(256) for _ in range(n))).decode().rstrip("=")
    long = lambda least, mean: least + int(r.expovariate(1 / mean))
    open_ = {"prefixed", "mixed", "lower", "upper", "letters", "plain_code"}
    date = lambda: f"20{some(_DIGITS, 2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
    camel = lambda: "".join(word().title() for _ in range(r.randint(2, 4)))
    makers = {
        "hex_upper": lambda: some(_DIGITS + "ABCDEF", r.choice([32, 40, 64])),
        "base64_key": lambda: some(mixed + "+/", 40),
        "base64_padded": lambda: base64.b64encode(bytes(r.randrange(256) for _ in range(r.choice([16, 32, 64])))).decode(),
        "forge_token": lambda: f"gh{r.choice('pousr')}_{some(mixed, 36)}",
        "chat_token": lambda: f"xox{r.choice('bap')}-{some(_DIGITS, 12)}-{some(_DIGITS, 12)}-{some(mixed, 24)}",
        "payment_key": lambda: f"{r.choice('spr')}k_{r.choice(['live', 'test'])}_{some(mixed, r.choice([24, 24, 34]))}",
        "cloud_key": lambda: "AIza" + some(mixed + "-_", 35),
        "web_token": lambda: ".".join([base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("="), part(30), part(32)]),
        "prefixed": lambda: some(_LOWER, r.randint(2, 5)) + r.choice("_-.") + some(mixed, long(18, 6)),
        "mixed": lambda: some(mixed, long(20, 6)),
        "lower": lambda: some(_DIGITS + _LOWER, long(20, 6)),
        "upper": lambda: some(_DIGITS + _UPPER, long(16, 6)),
        "letters": lambda: some(r.choice([_LOWER, _LOWER, _UPPER, _LOWER + _UPPER]), long(20, 6)),
        "plain_number": lambda: some(_DIGITS, long(1, 8)),
        "plain_grouped": lambda: r.choice("-. _/").strip().join(some(_DIGITS, r.choice([2, 3, 4, 4])) for _ in range(r.randint(2, 5))),
        "plain_uuid": lambda: "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12)),
        "plain_uuid_upper": lambda: "-".join(some(_DIGITS + "ABCDEF", n) for n in (8, 4, 4, 4, 12)),
        "plain_hash": lambda: some(hexa, r.randint(6, 23)),
        "plain_named_hash": lambda: word() + r.choice("-_./=") + some(hexa, r.randint(6, 23)),
        "plain_code": lambda: some(r.choice([_LOWER, _UPPER, mixed, mixed, _DIGITS + _LOWER, _DIGITS + _UPPER]), r.randint(1, 14)),
        "plain_gene": lambda: some(r.choice(["ACGT", "acgt", "ACGU"]), long(6, 20)),
        "plain_time": lambda: date() + r.choice(["", f"T{some('01', 2)}-{some('012345', 2)}-{some('012345', 2)}Z", f"_{some(_DIGITS, 6)}"]),
        "plain_version": lambda: r.choice(["", "v"]) + ".".join(some(_DIGITS, r.choice([1, 1, 2])) for _ in range(r.randint(2, 4))),
    }
    words = [
        word,
        word,
        lambda: word().title(),
        lambda: word().upper(),
        lambda: "".join(word() for _ in range(r.randint(2, 4))),
        lambda: "".join(word() for _ in range(r.randint(2, 3))).upper(),
        lambda: "".join(word() for _ in range(r.randint(1, 4))) + some(_DIGITS, r.randint(1, 4)),
        lambda: r.choice("-_./").join([word() for _ in range(r.randint(2, 5))] + [some(_DIGITS, r.randint(1, 4))] * r.randint(0, 1)),
        lambda: "_".join(word().upper() for _ in range(r.randint(2, 4))),
        lambda: "/".join(["https", "", word() + ".com", word(), some(_DIGITS, r.randint(1, 4)), word().title()]),
        lambda: ".".join([word() + r.choice(["", some(_DIGITS, 1)]), word(), r.choice(["com", "org", "html", "txt", "json", "py"])]),
        lambda: f"{word()}.{word().title()}",
        camel,
        lambda: word() + camel(),
        lambda: f"{word()}-{date()}",
        lambda: f"{word()}={word()}",
    ]
    found = {name: [make() for _ in range(OPEN_EXAMPLES if name in open_ else EXAMPLES)] for name, make in makers.items()}
    return found | {"plain": [*WORDS, *(r.choice(words)() for _ in range(40 * EXAMPLES))]}


#: Character classes: digit, a-f, g-z, A-F, G-Z, and one for each other credential character.
CLASSES = 11
_CLASS = np.full(256, -1, dtype=np.int8)
for _i, _chars in enumerate((_DIGITS, "abcdef", _LOWER[6:], "ABCDEF", _UPPER[6:], *_SIGNS)):
    _CLASS[list(_chars.encode())] = _i
_SIZE = np.bincount(_CLASS[_CLASS >= 0])
#: Credential characters by number, and by number without case.
_CHAR, _FOLDED = np.full(256, -1, dtype=np.int16), np.full(256, -1, dtype=np.int16)
for _i, _c in enumerate(_DIGITS + _LOWER + _UPPER + _SIGNS):
    _CHAR[ord(_c)] = _i
for _i, _c in enumerate(_DIGITS + _LOWER + _SIGNS):
    _FOLDED[ord(_c)] = _FOLDED[ord(_c.upper())] = _i
CHARS, FOLDED = 68, 42
_CLASS_OF = np.zeros(CHARS, np.int8)
_CLASS_OF[_CHAR[_CHAR >= 0]] = _CLASS[_CHAR >= 0]
_PADDING = ord("=")
#: Rules and rows of one character: it stays the same, or is any other.
#: Bytes of text whose candidates are held at once.
SLICE = 1 << 20
#: Lengths with a likeliest string of their own.
_LONGEST = 256
_AGAIN, _OTHER = math.log(0.9), math.log(0.1 / CHARS)
#: No letter, a small one, a capital; the edge of a run comes last.
_CASE = np.zeros(256, dtype=np.int8)
_CASE[list(_LOWER.encode())], _CASE[list(_UPPER.encode())] = 1, 2


class Automaton:
    """A probabilistic automaton learnt by merging compatible states of a prefix tree."""

    def __init__(self, strings: list[str], alpha: float = 0.2) -> None:
        self.visits: list[int] = [0]
        self.ends: list[int] = [0]
        self.next: list[dict[int, int]] = [{}]
        self.chars: list[Counter] = [Counter()]
        for string in strings:
            at = 0
            self.visits[0] += 1
            for b in string.encode():
                c = int(_CLASS[b])
                self.chars[at][int(_CHAR[b])] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.chars.append(Counter())
                at = self.next[at][c]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._layers()
        self._states()
        self._weigh()

    def _used(self, s: int) -> dict[int, int]:
        return {c: self.visits[t] for c, t in self.next[s].items()}

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, a: int, b: int, used) -> bool:
        stack, seen = [(a, b)], {(a, b)}
        while stack:
            p, q = stack.pop()
            n, m = self.visits[p], self.visits[q]
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            own, other = used(p), used(q)
            for c in own.keys() | other.keys():
                if self._differ(own.get(c, 0), n, other.get(c, 0), m):
                    return False
                if c in own and c in other:
                    pair = (self.next[p][c], self.next[q][c])
                    if pair not in seen:
                        seen.add(pair)
                        stack.append(pair)
        return True

    def _layers(self) -> None:
        """Merge compatible states of one depth, from the root down."""
        layer = [0]
        while layer:
            below: list[int] = []
            for s in layer:
                for c in sorted(self.next[s]):
                    q = self.next[s][c]
                    for r in below:
                        if r != q and self._compatible(r, q, self._used):
                            self._fold(r, q)
                            self.next[s][c] = r
                            break
                    else:
                        if q not in below:
                            below.append(q)
            layer = below

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the tree below a."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            self.chars[p].update(self.chars[q])
            for c, t in self.next[q].items():
                if c in self.next[p]:
                    stack.append((self.next[p][c], t))
                else:
                    self.next[p][c] = t

    def _states(self) -> None:
        """Merge compatible states of different depths; arcs then have counts of their own."""
        order, at = [0], 0
        while at < len(order):
            order += [t for t in dict.fromkeys(self.next[order[at]].values()) if t not in set(order)]
            at += 1
        arcs = {s: Counter({c: sum(n for x, n in self.chars[s].items() if _CLASS_OF[x] == c) for c in self.next[s]}) for s in order}
        kept: list[int] = []
        into: dict[int, int] = {}
        for s in order:
            for r in kept:
                if self._compatible(r, s, lambda x: arcs[x]):
                    into[s] = r
                    break
            else:
                kept.append(s)
        # counts of merged states are added where they went; arcs lead to what their ends were merged into
        self.states = kept
        number = {s: k for k, s in enumerate(kept)}
        last = lambda s: number[into.get(s, s)]
        n = len(kept)
        self.to = np.full((n, CLASSES), -1, dtype=np.int32)
        self.count = np.zeros((n, CHARS))
        self.stop = np.zeros(n)
        for s in order:
            k = last(s)
            self.stop[k] += self.ends[s]
            for x, f in self.chars[s].items():
                self.count[k, x] += f
            for c, t in self.next[s].items():
                if self.to[k, c] < 0 or s in number:
                    self.to[k, c] = last(t)

    def _weigh(self) -> None:
        """Logarithms of the smoothed frequencies of ends, classes and characters within a class.

        A state's classes are smoothed by those of the format.  A class that no state has met costs ``RARE`` and
        leaves the state as it is; so does an end where none was met.
        """
        by = np.zeros((len(self.stop), CLASSES))
        np.add.at(by.T, _CLASS_OF, self.count.T)
        format_ = by.sum(0) / by.sum()
        total = (by.sum(1) + self.stop + 1)[:, None]
        self.end = np.log((self.stop + RARE) / total[:, 0])
        within = (self.count + 0.3) / (by + 0.3 * _SIZE)[:, _CLASS_OF]
        self.log = np.log((by + np.maximum(format_, RARE)) / total)[:, _CLASS_OF] + np.log(within)
        self.to = np.where(self.to < 0, np.arange(len(self.to))[:, None], self.to)

    def score(self, text: bytes) -> float:
        at, total = 0, 0.0
        for b in text:
            total += self.log[at, _CHAR[b]]
            at = self.to[at, _CLASS[b]]
        return float(total + self.end[at])


class Grammar:
    """The automata of all formats, and the bigram model of ordinary runs."""

    def __init__(self, examples: dict[str, list[str]]) -> None:
        self.formats = {k: Automaton(v) for k, v in examples.items() if k != "plain"}
        self.credential = np.array([not k.startswith("plain") for k in self.formats])
        sizes = np.cumsum([0, *(len(a.to) for a in self.formats.values())])
        self.begin = sizes[:-1].astype(np.int32)
        self.to = np.concatenate([a.to + s for a, s in zip(self.formats.values(), sizes)]).astype(np.int32)
        self.log = np.concatenate([a.log for a in self.formats.values()]).astype(np.float32)
        self.end = np.concatenate([a.end for a in self.formats.values()]).astype(np.float32)
        # of words: each folded character given the one before, and each letter's case given the one before
        pair, case = np.zeros((FOLDED + 1, FOLDED + 1)), np.full((4, 3), 0.5)
        for x in examples["plain"]:
            b = np.frombuffer(x.encode(), np.uint8)
            f, c = _FOLDED[b], _CASE[b]
            np.add.at(pair, (np.append(FOLDED, f), np.append(f, FOLDED)), 1)
            np.add.at(case, (np.append(3, c[:-1]), c), 1)
        single = pair.sum(0) + 0.5
        single /= single.sum()
        self.pair = np.log((pair + 20 * single) / (pair.sum(1, keepdims=True) + 20)).astype(np.float32)
        case[:, 0] = 0  # whether a character is a letter is the pair's part
        with np.errstate(divide="ignore"):
            self.case = np.log(case / case.sum(1, keepdims=True)).astype(np.float32)
        self.case[:, 0] = 0
        self._greatest: np.ndarray | None = None

    def greatest(self) -> np.ndarray:
        """For each length up to ``_LONGEST``: the greatest log-likelihood that a credential format gives any string."""
        if self._greatest is None:
            within = np.full((len(self.to), CLASSES), -np.inf, np.float32)
            np.maximum.at(within.T, _CLASS_OF, self.log.T)
            at = np.full(len(self.to), -np.inf, np.float32)
            at[self.begin[self.credential]] = 0
            self._greatest = np.zeros(_LONGEST + 1, np.float32)
            for n in range(_LONGEST):
                self._greatest[n] = (at + self.end).max()
                moved = np.full(len(self.to), -np.inf, np.float32)
                np.maximum.at(moved, self.to, at[:, None] + within)
                at = moved
            self._greatest[_LONGEST] = 0  # and any longer one
        return self._greatest

    def ratios(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: float = -np.inf) -> np.ndarray:
        """The log ratio of each span: best credential format against the best ordinary model."""
        return self.weigh(data, start, end, threshold)[0]

    def weigh(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The log ratio of each span, and that of its best format, ordinary or not, against the bigram model.

        Spans that can't reach the threshold, whatever their characters are to the formats, have none (-inf).
        """
        n = end - start
        order = np.argsort(-n, kind="stable")
        s, n = start[order], n[order]
        plain, rule = np.zeros(len(s), np.float32), np.zeros(len(s), np.float32)
        before, case, last = np.full(len(s), FOLDED), np.full(len(s), 3), np.full(len(s), 255, np.uint8)
        for t in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -t))  # the spans longer than t
            b = data[s[:live] + t]
            f, c = _FOLDED[b], _CASE[b]
            plain[:live] += self.pair[before[:live], f] + self.case[case[:live], c]
            rule[:live] += np.where(last[:live] == b, _AGAIN, _OTHER)
            before[:live], case[:live], last[:live] = f, c, b
        plain = np.maximum(plain + self.pair[before, FOLDED], rule)
        may = np.flatnonzero(self.greatest()[np.minimum(n, _LONGEST)] - plain >= threshold)
        s, n = s[may], n[may]
        state = np.repeat(self.begin[None], len(s), 0)
        total = np.zeros(state.shape, np.float32)
        for t in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -t))
            b = data[s[:live] + t]
            total[:live] += self.log[state[:live], _CHAR[b][:, None]]
            state[:live] = self.to[state[:live], _CLASS[b][:, None]]
        total += self.end[state]
        ratio, value = np.full((2, len(order)), -np.inf, np.float32)
        best, other = (total[:, c].max(1, initial=-np.inf) for c in (self.credential, ~self.credential))
        ratio[order[may]] = best - np.maximum(plain[may], other)
        value[order[may]] = np.maximum(best, other) - plain[may]
        return ratio, value

    def ratio(self, text: bytes) -> float:
        return float(self.ratios(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))[0])

    def segments(self, text: bytes, threshold: float) -> list[tuple[int, int]]:
        """The sequences of parts of a run that don't overlap, the greatest ratio first, by passes."""
        data = np.frombuffer(text, np.uint8)
        whole = runs(ALNUM[data], np.array([0, len(data)]))
        starts, ends, tails = whole.start.tolist(), whole.end.tolist(), _tails(data, whole.end).tolist()
        found, open_ = [], [(0, len(starts))]
        while open_:
            first, last = open_.pop()
            if first >= last:
                continue
            lo, hi = starts[first], tails[last - 1]
            best = self._best(threshold, data[lo:hi], [x - lo for x in starts[first:last]], [x - lo for x in ends[first:last]] + [x - lo for x in tails[first:last]])
            if best is not None:
                b, e = best[0] + lo, best[1] + lo
                if best[2]:
                    found.append((b, e))
                open_ += [(first, starts.index(b)), (next((k for k in range(last) if starts[k] >= e), last), last)]
        return sorted(found)

    def _best(self, threshold: float, data: np.ndarray, starts: list[int], ends: list[int]) -> tuple[int, int, bool] | None:
        """The sequence that a format fits best against the bigram model, and whether it is a secret.

        Passes keep for each automaton and state the start that is best; the best of each end are then weighed in full.
        """
        starts, ends = set(starts), set(ends)
        char, cls, f, c = (x.tolist() for x in (_CHAR[data], _CLASS[data], _FOLDED[data], _CASE[data]))
        found = set()
        for begin in self.begin.tolist():
            live: dict[int, tuple[float, int]] = {}
            for i in range(len(char)):
                if live:
                    step = self.pair[f[i - 1], f[i]] + self.case[c[i - 1], c[i]]
                    moved: dict[int, tuple[float, int]] = {}
                    for s, (total, b) in live.items():
                        to, value = int(self.to[s, cls[i]]), (float(total + self.log[s, char[i]] - step), b)
                        if to not in moved or value > moved[to]:
                            moved[to] = value
                    live = moved
                if i in starts:
                    to = int(self.to[begin, cls[i]])
                    value = (float(self.log[begin, char[i]] - self.pair[FOLDED, f[i]] - self.case[3, c[i]]), i)
                    if to not in live or value > live[to]:
                        live[to] = value
                if i + 1 in ends:
                    found |= {(b, i + 1) for s, (total, b) in live.items() if total + self.end[s] - self.pair[f[i], FOLDED] >= threshold}
        if not found:
            return None
        b, e = (np.array(x) for x in zip(*sorted(found)))
        ratio, value = self.weigh(data, b, e)
        if ratio.max() < threshold:
            return None
        k = int(value.argmax())
        return int(b[k]), int(e[k]), bool(ratio[k] >= threshold)


def _apart(spans: list[tuple[float, int, int, bool]]) -> list[tuple[int, int]]:
    """Of spans that overlap, those that a format fits best; the secrets among them."""
    taken: list[tuple[int, int]] = []
    secret: list[tuple[int, int]] = []
    for _, b, e, ok in sorted(spans, key=lambda x: (-x[0], *x[1:])):
        if not any(p < e and b < q for p, q in taken):
            taken.append((b, e))
            secret += [(b, e)] * ok
    return secret


def _tails(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The ends of parts with the padding (one or two =) that follows and ends them."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    one = padded[end] == _PADDING
    two = one & (padded[end + 1] == _PADDING)
    out = end + one + two
    return np.where(ALNUM[padded[out]] | (padded[out] == _PADDING), end, out)


def _sequences(data: np.ndarray, own: Words, start: np.ndarray, end: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and run of each run (first, marked) and of each sequence of its parts, if they aren't more than ``pieces``."""
    of = np.searchsorted(start, own.start, "right") - 1
    inside = (of >= 0) & (own.end <= end[np.maximum(of, 0)])
    s, of, tails = own.start[inside], of[inside], np.minimum(_tails(data, own.end[inside]), end[np.maximum(of[inside], 0)])
    new = np.append(True, of[1:] != of[:-1])[: len(of)]
    cut = np.flatnonzero(new)
    many = np.diff(np.append(cut, len(of)))
    starts, ends, which, whole = [s[cut]], [tails[cut + many - 1]], [of[cut]], [np.ones(len(cut), bool)]
    few = np.repeat((many > 1) & (many <= pieces), many)
    s, tails, of = s[few], tails[few], of[few]
    for d in range(pieces):
        a = np.flatnonzero(of[: len(of) - d] == of[d:]) if len(of) > d else np.zeros(0, np.int64)
        starts.append(s[a])
        ends.append(tails[a + d])
        which.append(of[a])
        whole.append(np.zeros(len(a), bool))
    return tuple(np.concatenate(x) for x in (starts, ends, which, whole))


def find(texts: Texts, grammar: Grammar, threshold: float, pieces: int = PIECES) -> tuple[list[list], list[list]]:
    """For each text: its fixed-pattern spans and its learnt spans, as (start, kind, end) code points."""
    scan = Scan(texts)
    base: list[list] = [[] for _ in range(texts.n)]
    points = CodePoints(texts)
    covered = np.zeros(len(texts.data) + 1, dtype=np.int32)
    for kind, found in enumerate((scan.assigns(), scan.accesses(), scan.hexes())):
        for t, s, e in found:
            base[t].append((points(t, s), kind, points(t, e)))
            covered[s] += 1
            covered[e] -= 1
    added: list[list] = [[] for _ in range(texts.n)]
    free = CREDENTIAL[texts.data] & (np.cumsum(covered)[:-1] == 0)
    r = runs(free, texts.offsets)
    if not len(r.start):
        return base, added
    doc = r.doc
    parts = runs(free & ALNUM[texts.data], texts.offsets)
    s, e, of, whole = _sequences(texts.data, parts, r.start, r.end, pieces)
    _, first, back = np.unique(span_hashes(texts.data, s, e), return_index=True, return_inverse=True)
    ratio, value = (x[back] for x in grammar.weigh(texts.data, s[first], e[first], threshold))
    spans: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero(whole & (ratio >= threshold)).tolist():
        spans[int(of[k])] = [(int(s[k]), int(e[k]))]
    by: dict[int, list[tuple[float, int, int, bool]]] = defaultdict(list)
    asked = np.zeros(len(r.start), bool)
    asked[of[~whole & (ratio >= threshold)]] = True
    asked[list(spans)] = False
    for k in np.flatnonzero(~whole & asked[of] & (value >= threshold)).tolist():
        by[int(of[k])].append((float(value[k]), int(s[k]), int(e[k]), bool(ratio[k] >= threshold)))
    spans |= {k: _apart(x) for k, x in by.items()}
    many = np.searchsorted(parts.start, r.end) - np.searchsorted(parts.start, r.start)
    for k in np.flatnonzero(many > max(pieces, 1)).tolist():
        if k not in spans:
            lo = int(r.start[k])
            spans[k] = [(lo + b, lo + t) for b, t in grammar.segments(scan.body[lo : r.end[k]], threshold)]
    for k, found in spans.items():
        t = int(doc[k])
        added[t] += [(points(t, b), 3, points(t, q)) for b, q in found]
    return base, added


_grammar: Grammar | None = None


def learnt() -> Grammar:
    global _grammar
    if _grammar is None:
        _grammar = Grammar(labelled())
    return _grammar


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, counts by fixed kind, n_token, base_sha256, spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    grammar = learnt()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text"), SLICE):
                base, added = find(texts, grammar, threshold)
                count = lambda k: pa.array([sum(x[1] == k for x in b) for b in base], pa.int64())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.slice(texts.first, texts.n).column("doc_id"),
                        *map(count, range(3)),
                        pa.array(map(len, added), pa.int64()),
                        pa.array([digest(listing(b, KINDS)) for b in base]),
                        pa.array([listing(b + a, KINDS) for b, a in zip(base, added)]),
                    ],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every secret's span replaced by ``mask`` and n_chars counted again.

    Texts without secrets, null ones among them, are returned as they are.
    """
    grammar = learnt()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text"), SLICE):
                rows = batch.slice(texts.first, texts.n)
                base, added = find(texts, grammar, threshold)
                if any(base) or any(added):
                    whole = rows.column("text").to_pylist()
                    for i, (b, a) in enumerate(zip(base, added)):
                        if not (b or a):
                            continue
                        out, at = [], 0
                        for s, _, e in sorted(b + a):
                            if s >= at:
                                out += [whole[i][at:s], mask]
                            at = max(at, e)
                        whole[i] = "".join([*out, whole[i][at:]])
                    columns = [pa.array(whole, rows.schema.field("text").type) if n == "text" else rows.column(n) for n in names]
                    rows = pa.RecordBatch.from_arrays(columns, names)
                yield rows

    clean = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*names)
    return clean
