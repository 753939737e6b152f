"""Plain restatements of the operators' definitions, one text at a time."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeat = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            repeat |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeat),
        "base_failed": len(words) < 50 or 100 * len(repeat) > 50 * len(words),
    }


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text, k=3):
    import xxhash

    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components(ids, prints, radius=3):
    """Component ids by comparing all pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def spans(text, patterns):
    """(start, kind, end) of each kind's matches that pass its test, in code points."""
    found = []
    for kind, (pattern, test) in enumerate(patterns):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if test(m)]
    return sorted(found)


def digits(text):
    return [int(c) for c in text if c in "0123456789"]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


PERSONAL = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
)
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
SECRET = (
    (rf"({_WORDS}|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def base_scores(rows, folds=10):
    """rows: (doc_id, text).  doc_id -> n_tokens, n_known, train_tokens, base_score."""
    import math
    import zlib

    out = lambda i: zlib.crc32(str(i).encode()) % folds == 0
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    count = Counter(w for i, ws in tokens.items() if not out(i) for w in ws)
    total = sum(count.values())
    score = lambda ws: sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in ws)
    return {i: (len(ws), sum(w in count for w in ws), total, score(ws)) for i, ws in tokens.items()}


def repeats(rows, length=100):
    """rows: (doc_id, text).  doc_id -> n_bytes, n_removed, n_spans, kept_sha256."""
    import hashlib

    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for s in range(len(body) - length + 1):
            w = body[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out[i] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


# The pipeline, stage by stage: rows are dicts of documents.


def normal_lines(text):
    """The distinct normalised lines of a text, each with its words."""
    import re as r
    from collections import Counter as C

    own = C()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            folded = "".join("0" if c in "123456789" else c for c in lower(line))
            own[r.sub(r"[^a-z0\x80-\U0010ffff]", "", folded)] += len(WORD.findall(line))
    return own


def quality_kept(rows, min_documents=10, share=0.01, min_left=0.3):
    lines = [normal_lines(r["text"]) for r in rows]
    whole = [frozenset(x) for x in lines]
    hosts, holders = {}, {}
    for r, own, w in zip(rows, lines, whole):
        hosts.setdefault(r["source"], set()).add(w)
        for x in own:
            holders.setdefault((r["source"], x), set()).add(w)
    out = []
    for r, own in zip(rows, lines):
        base = quality(r["text"])
        limit = max(min_documents, share * len(hosts[r["source"]]))
        gone = sum(n for x, n in own.items() if len(holders[r["source"], x]) > limit)
        if not base["base_failed"] and base["n_words"] - gone >= min_left * base["n_words"]:
            out.append(r)
    return out


def near_kept(rows, k=5, similarity=0.8):
    """One row of each group, by comparing all pairs of shingle sets."""
    words = [tuple(WORD.findall(lower(r["text"]))) for r in rows]
    sets = [{w[i : i + k] for i in range(len(w) - k + 1)} for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = words[a] == words[b]
            if not same and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                same = both >= similarity * (len(sets[a]) + len(sets[b]) - both)
            if same:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if least[find(i)] == r["doc_id"]]


def fold(text):
    """Lower case, one blank for each run of what is neither letter nor digit, in bytes."""
    import re as r

    raw = lower(text).encode()
    raw = r.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), raw)
    return r.sub(rb"[^a-z0-9\x80-\xff]+", b" ", raw).strip(b" ")


def least_edits(passage, text):
    """Least edits between the passage and any part of the text: all cells, a row at a time."""
    import numpy as np

    t = np.frombuffer(text, np.uint8)
    j = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, dtype=np.int64)
    for i, c in enumerate(passage, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (t != c)]))
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def clean_kept(rows, items, budget=0.1, q=8):
    passages = [f for t in items if t is not None and (f := fold(t))]
    edits = [min(int(budget * len(p) + 1e-9), max(len(p) - q, 0) // q) for p in passages]
    folded = [fold(r["text"]) for r in rows]
    return [r for r, f in zip(rows, folded) if not any(least_edits(p, f) <= e for p, e in zip(passages, edits))]


def masked(rows, mask="[secret]"):
    out = []
    for r in rows:
        text, at, parts = r["text"] or "", 0, []
        for s, _, e in spans(text, SECRET):
            if s >= at:
                parts += [text[at:s], mask]
            at = max(at, e)
        out.append(r | {"text": "".join([*parts, text[at:]]) if parts else r["text"]})
    return out


def mixed(rows, weights=(5, 2, 1), passes=3):
    """doc_id -> (size, source_size, target, taken)."""
    import hashlib

    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r["doc_id"])
    names = sorted(sources)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(size[i] for i in sources[s]) for s in names}
    target, left, open_ = {}, sum(total.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > passes * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = float(passes * total[s])
            left -= target[s]
        open_ -= full
    out = {}
    for s in names:
        whole, begins = (int(target[s] // total[s]) if total[s] else 0), 0
        rest = int(target[s] + 0.5) - whole * total[s]
        for i in sorted(sources[s], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            out[i] = (size[i], total[s], target[s], whole * size[i] + max(0, min(size[i], rest - begins)))
            begins += size[i]
    return out
