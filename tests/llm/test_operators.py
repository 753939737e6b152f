from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, ODD, SMALL

from quillrow.llm import decontamination, lm, mixing, pii, quality, repeats, secrets, simhash, token_counts, toxicity, workspace
from quillrow.llm.suffix_array import common_prefixes, suffix_array
from quillrow.llm.textbatch import slices
from quillrow.llm.units import unpack


# -- 1: quality rules ---------------------------------------------------------------------------------


def test_quality_base_counts(documents, texts):
    of = dict(texts)
    for r in quality.judge(documents).collect():
        want = brute.quality(of[r.doc_id])
        assert {k: r[k] for k in want} == want


def test_quality_odd_rows(odd, none):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t for i, t, *_ in ODD if i == r.doc_id)
        want = brute.quality(text)
        assert {k: r[k] for k in want} == want
        assert not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0


def test_quality_rejects_what_boilerplate_depletes(spark):
    boiler = "Subscribe to our newsletter today for offers and many more news from our desk"
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731 - digits count as one in normal form
    own = lambda i, n: "\n".join(" ".join(f"w{letters(i)}x{letters(j)}y{letters(k)}" for k in range(12)) for j in range(n))
    rows = [(i, f"{own(i, 6)}\n{boiler}", "h") for i in range(40)]
    rows += [(100 + i, "\n".join([boiler] * 5 + [f"u{letters(i)}"]), "h") for i in range(3)]
    rows += [(200 + i, own(999, 6), "h") for i in range(30)]  # copies of one clean document
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df, min_documents=10, max_repeat_percent=1000, min_words=10).collect()}
    assert all(got[i].kept and got[i].frequent_words > 0 for i in range(40))
    assert not any(got[i].kept for i in range(100, 103))
    assert all(got[200 + i].kept and got[200 + i].frequent_words == 0 for i in range(30))


def test_quality_counts_every_document_of_a_template(spark):
    """Templates of several shared lines with one to three own lines, and copies of one document, in a large host."""
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    line = lambda name, j: " ".join(f"{name}x{letters(j)}y{letters(k)}" for k in range(8))
    own = lambda i, n: [line(f"w{letters(i)}", j) for j in range(n)]
    rows, frequent = [], {}
    for g, (shared, extra, held) in enumerate([(20, 1, 30), (8, 2, 16), (4, 1, 15), (10, 3, 25), (5, 1, 120)]):
        for _ in range(held):
            i = len(rows)
            rows.append((i, "\n".join([line(f"t{letters(g)}", j) for j in range(shared)] + own(i, extra)), "h"))
            frequent[i] = 8 * shared
    for copy in range(40):
        rows.append((len(rows), "\n".join(own(9999, 6)), "h"))
    while len(rows) < 700:
        rows.append((len(rows), "\n".join(own(len(rows), 6)), "h"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df, max_repeat_percent=1000, min_words=1).collect()}
    assert {i: r.frequent_words for i, r in got.items()} == {i: frequent.get(i, 0) for i in got}
    assert all(r.kept == (i not in frequent or frequent[i] <= 0.7 * r.n_words) for i, r in got.items())


def test_quality_verdicts_are_of_rows(spark):
    """A rejected row takes no other row of its doc_id along, nor one without an id the others."""
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "a"), (1, "too short", "a"), (None, good + " x", "a"), (None, "short", "a"), (2, "", None), (3, None, "b"), (4, good + " y", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = quality.without_rejected(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r.text and len(r.text) > 60)


# -- 2: token counts ----------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(documents, odd, none):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(token_counts.vocabulary_path())
    count = lambda t: len(reference.encode(t or "", add_special_tokens=False).ids)
    for df in (documents, odd):
        of = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
        want = sorted((i is None, i or 0, len((t or "").encode()), count(t)) for i, t in of)
        got = sorted({(r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df).collect()})
        assert got == want
    assert token_counts.count_tokens(none).count() == 0
    own = token_counts.counter(token_counts.vocabulary_path())
    for t in ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "it's 12½ 漢字 🙂  \n\n x", "\x1c a\x85b", "aaaa" * 500]:
        assert own(t) == count(t)


# -- 3: suffix arrays ---------------------------------------------------------------------------------


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for n, k in ((0, 1), (1, 1), (50, 1), (200, 2), (300, 4)):
        d = r.integers(97, 97 + k, n).astype(np.uint8)
        b = d.tobytes()
        sa = suffix_array(d, 1 << 20)
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        lcp = common_prefixes(d, sa)
        for i in range(1, n):
            x, y = b[sa[i] :], b[sa[i - 1] :]
            assert lcp[i] == next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize("crowd,unit", [(12_000, 1 << 24), (3, 1 << 14)])
def test_repeats_match_brute_force(documents, texts, crowd, unit):
    want = brute.repeats(texts)
    rows = repeats.remove_repeats(documents, crowd=crowd, unit_bytes=unit, shard_bytes=1 << 14).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want


def test_repeats_work_in_pieces():
    """What a task holds besides a unit or a shard is made for a piece at a time."""
    import tracemalloc

    import zstandard

    def peak(run, *args):
        tracemalloc.start()
        out = run(*args)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, top

    data = np.random.default_rng(3).integers(97, 123, 1 << 21, dtype=np.uint8)
    units = pa.table({"unit": [0], "ids": [[0]], "lengths": [[len(data)]], "body": [zstandard.compress(data.tobytes())]})
    anchors = np.unique(repeats.unit_strips(next(unpack(units)), 100, 40).anchor)
    answers = pa.table({"anchor": anchors.view(np.int64), "parts": pa.array(np.ones(len(anchors)), pa.int32())})
    strips = repeats._strip_rows(100, 40, 1)(units, answers)
    again = strips.set_column(3, "doc_id", pa.array(np.full(strips.num_rows, 7)))
    verdicts, top = peak(repeats.settle, pa.concat_tables([strips, again]), 100)
    size = sum(len(x.as_py()) for x in strips.column("bytes"))
    assert sum(verdicts.column("many").to_pylist()) == size - 99 * strips.num_rows  # every window of text 7
    assert set(verdicts.column("doc_id").to_pylist()) == {7}
    assert top < 8 * size
    packed, top = peak(repeats._strip_rows(100, 40, 1), units, answers)
    assert packed.equals(strips) and top < 14 * size


def test_repeats_odd_rows(spark, odd, none):
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == len(ODD)
    assert [r.n_removed for r in rows if r.doc_id == 2] == [0]
    assert sorted(r.n_removed for r in rows if r.doc_id == 5) == sorted([brute.repeats([(5, LONG)])[5][1], len(LONG)])
    assert [r.n_removed for r in rows if r.doc_id == 9] == [1000 - 1]
    assert repeats.remove_repeats(none).count() == 0
    with pytest.raises(Exception, match="integer doc_ids"):
        repeats.remove_repeats(spark.createDataFrame([("a", "x" * 200)], "doc_id string, text string")).collect()
    periodic = spark.createDataFrame([(1, "ab" * 90), (2, "abc" * 200), (3, "x" * 60 + "ab" * 90)], "doc_id bigint, text string")
    want = brute.repeats([(r.doc_id, r.text) for r in periodic.collect()])
    assert {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(periodic, crowd=1, unit_bytes=256, shard_bytes=256).collect()} == want


# -- 4: toxicity --------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_stems(spark):
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    rows, labels = [], []
    for i in range(600):
        ws = [word() for _ in range(int(r.integers(30, 160)))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                ws[int(r.integers(len(ws)))] = "zzkrat" + word()[:2]
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    held = [i for i in got if got[i].held_out]
    right = sum(got[i].predicted == labels[i][1] for i in held)
    assert len(held) > 100 and right / len(held) > 0.95
    assert all(got[i].held_out == (toxicity.fold_of([i])[0] == 2) for i in got)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, toxic int")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, labels).count() == 0
    assert {r.score for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.5}


def test_windows_cover_every_word():
    n = np.array([0, 1, 63, 64, 65, 112, 113, 500])
    cuts = np.concatenate([[0], np.cumsum(n)])
    first, length, text = toxicity.windows(cuts)
    seen = np.zeros(cuts[-1], int)
    for f, k in zip(first, length):
        seen[f : f + k] += 1
    assert seen.min() >= 1 and set(text) == set(range(len(n)))


def test_network_gradient():
    net = toxicity.Network()
    t = toxicity.tokenize(next(slices(pa.array(["one two three four", "two five"]))))
    x = net.inputs(t).astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    first, length, _ = toxicity.windows(t.cuts)
    index, live = toxicity.grid(np.append(t.index, len(x) - 1), first, length)
    logit, kept = net.forward(x, index, live, keep=True)
    g, dx = net.backward(x, index, live, kept, np.array([1.0, -0.5]))
    loss = lambda: float(net.forward(x, index, live) @ np.array([1.0, -0.5]))
    for name in ("Uf", "Ub", "Wf", "A", "v", "w", "cb"):
        p, at = net.p[name], tuple(0 for _ in net.p[name].shape)
        old = p[at]
        p[at] = old + 1e-4
        up = loss()
        p[at] = old - 1e-4
        assert abs((up - loss()) / 2e-4 - g[name][at]) < 2e-3, name
        p[at] = old


# -- 5: decontamination -------------------------------------------------------------------------------


def _edits(p, r):
    row = [0] * (len(r) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(r, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_leaks_match_brute_force(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()
    index = decontamination.Index([b.item_id for b in bench], [b.text for b in bench], decontamination.BUDGET)
    r = np.random.default_rng(4)
    found = 0
    for k in range(40):
        i = int(r.integers(len(index.texts)))
        p, e = index.texts[i], int(index.edits[i])
        x = list(p)
        for _ in range(int(r.integers(0, 2 * e))):
            j = int(r.integers(len(x)))
            x[j : j + int(r.integers(0, 2))] = [int(c) for c in r.choice(list(b"abcdefg "), int(r.integers(0, 2)))]
        doc = "some other words, " + bytes(x).decode(errors="ignore") + " - and the rest of it"
        data, _, offsets = decontamination.fold(np.frombuffer(doc.encode(), np.uint8), np.array([0, len(doc.encode())]))
        got = [m for m in index.matches(data, offsets) if m[1] in index.ids[i]]
        assert index.matches(data, offsets, hits=20) == index.matches(data, offsets)
        best = _edits(p, decontamination.fold_text(doc))
        assert bool(got) == (best <= e) and (not got or got[0][2] == best)
        found += bool(got)
    assert found > 10


def test_leaks_spans_and_odd_rows(spark, odd, none):
    passage = "The quick brown fox jumps over the lazy dog while seven wizards quietly drink their tea."
    bench = spark.createDataFrame([(1, passage), (2, None), (3, "short"), (4, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(10, "Été: " + passage.upper().replace(" ", "!! ") + " end"), (11, passage[:50]), (12, None), (13, passage), (13, passage)], "doc_id bigint, text string")
    rows = decontamination.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(10, 1), (13, 1), (13, 1)]
    own = next(r for r in rows if r.doc_id == 13)
    assert (own.start, own.end, own.edits) == (0, len(passage) - 1, 0)
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, bench).collect()) == [11, 12]
    assert decontamination.leaks(odd, bench).count() == 0
    assert decontamination.without_leaks(odd, bench).count() == len(ODD)
    assert decontamination.leaks(none, bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0
    for most in (40, 5000):
        parts = [*decontamination.blocks(bench, 0.1, most)]
        assert sorted(i for x in parts for own in [*x.ids, *(o for s in x.short.values() for o in s.values())] for i in own) == [1, 3]
    few = decontamination.leaks(docs, bench, most=2_000_000)
    assert sorted(map(str, decontamination.leaks(docs, bench, most=40).collect())) == sorted(map(str, few.collect()))
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, bench, most=40).collect()) == [11, 12]


def test_leaks_of_short_items_and_every_region(spark):
    passage = "Seven wizards quietly drink their tea while the brown fox jumps over a dog"
    bench = spark.createDataFrame([(1, "cat sat"), (2, "3+4=7"), (3, passage), (4, passage.lower()), (5, "?!"), (6, "é")], "item_id bigint, text string")
    docs = [
        (1, "The cat sat; and 3 + 4 = 7, he said."),
        (2, "the cat satisfied concat sat 13+4=7"),
        (3, f"{passage}. {passage.replace('quietly', 'quiet')}! And {passage.upper()}"),
        (4, "cat"),
        (5, "sat"),
        (6, "É"),
        (7, "café"),
    ]
    rows = decontamination.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    got = sorted((r.doc_id, r.item_id, r.edits, dict(docs)[r.doc_id][r.start : r.end]) for r in rows)
    three = [passage, passage.replace("quietly", "quiet"), passage.upper()]
    want = [(1, 1, 0, "cat sat"), (1, 2, 0, "3 + 4 = 7"), (6, 6, 0, "É")]
    want += [(3, i, 2 * (k == 1), t) for i in (3, 4) for k, t in enumerate(three)]
    assert got == sorted(want)


def test_leaks_in_periodic_texts_and_turns():
    """Texts and passages that repeat themselves: every count of hits at once gives the same regions."""
    index = decontamination.Index([1, 2, 3], ["ab " * 20, "a" * 60, "xyz " * 10 + "a" * 20], 0.1)
    for text in ("ab " * 400, "a" * 900, "a" * 70 + " b " + "ab " * 70, "xyz " * 40 + "a" * 90):
        data, _, offsets = decontamination.fold(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        want = index.matches(data, offsets)
        assert want and all(x[4] <= y[3] for x, y in zip(want, want[1:]) if x[1] == y[1])
        for hits in (10, 1000):
            assert index.matches(data, offsets, hits) == want


# -- 6: language model --------------------------------------------------------------------------------


def test_language_model(documents, texts, odd, none):
    want = brute.base_scores(texts)
    rows = lm.score(documents).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len(lm.score(odd).collect()) == len(ODD)
    assert lm.score(none).count() == 0


def _backoff(seqs, out, order):
    """The smoothed probabilities from all n-grams counted in one place, by definition."""
    from collections import Counter, defaultdict

    count = [Counter() for _ in range(order + 1)]
    for s, o in zip(seqs, out):
        if not o:
            for n in range(1, order + 1):
                x = s if n == 1 else [1, *s]
                count[n].update(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    history, after = Counter(), defaultdict(set)
    for n in range(2, order + 1):
        for g, c in count[n].items():
            history[g[:-1]] += c
            after[g[:-1]].add(g[-1])
    cut = [None, *(lm.discount(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())) for c in count[1:])]
    total = sum(count[1].values())

    def chance(h, w):
        if not h:
            return ((count[1][w,] - cut[1]) if (w,) in count[1] else cut[1] * len(count[1])) / total
        if h not in history:
            return chance(h[1:], w)
        n = len(h) + 1
        return (max(count[n][*h, w] - cut[n], 0) + cut[n] * len(after[h]) * chance(h[1:], w)) / history[h]

    return chance, [w for (w,) in count[1]]


@pytest.mark.parametrize("order,unit_bytes", [(2, 1 << 23), (3, 1 << 16), (4, 1 << 17)])
def test_language_model_is_the_backoff_of_all_ngrams(documents, texts, monkeypatch, order, unit_bytes):
    """Scores of documents in one and in many units are those of all n-grams counted in one place."""
    monkeypatch.setattr(lm, "UNIT", unit_bytes)
    out = lm.held_out(pa.array([i for i, _ in texts]))
    seqs = [[*brute.WORD.findall(brute.lower(t)), 0] for _, t in texts]
    chance, vocabulary = _backoff(seqs, out, order)
    got = {r.doc_id: r.score for r in lm.score(documents, order).collect()}
    for (i, _), s in zip(texts, seqs):
        x = [1, *s]
        want = sum(np.log10(chance(tuple(x[max(0, k - order + 1) : k]), x[k])) for k in range(1, len(x)))
        assert abs(got[i] - want) < 1e-9 * abs(want)
    for h in ((), (1,), (1, seqs[0][0])[-order + 1 :], tuple(seqs[3][:2])[-order + 1 :]):
        assert abs(sum(chance(h, w) for w in [*vocabulary, "never met"]) - 1) < 1e-9


def test_language_model_keeps_no_shuffle_files(spark, documents, monkeypatch):
    """Each level's shuffle files go as it is written, though the driver collects no garbage."""
    import time

    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*")}
    before, left = files(), []

    def look(spark):
        end = time.monotonic() + 3
        while files() - before and time.monotonic() < end:
            time.sleep(0.1)
        left.append(len(files() - before))

    monkeypatch.setattr(lm, "UNIT", 1 << 16)
    monkeypatch.setattr(lm, "release", look)
    setting = spark.conf.get(workspace._CLEANUP, None)
    lm.score(documents)
    assert left == [0] * lm.ORDER
    assert spark.conf.get(workspace._CLEANUP, None) == setting


def test_language_model_without_training_texts(spark):
    ids = [i for i in range(200) if lm.held_out(pa.array([i]))[0]][:3]
    df = spark.createDataFrame([(ids[0], "a b"), (ids[1], None), (ids[2], "b")], "doc_id bigint, text string")
    rows = lm.score(df).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.score) for r in rows] == [(True, 0, 0, 0.0)] * 3
    assert sorted(r.n_tokens for r in rows) == [1, 2, 3]


def test_packed_numbers():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.sort(r.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
        assert lm.unpack_sorted(lm.pack_sorted(x)).tolist() == x.tolist()
        y = r.integers(-5, 1 << 62, n)
        assert lm.unpack_numbers(lm.pack_numbers(y)).tolist() == y.tolist()


# -- 7 and 10: spans ----------------------------------------------------------------------------------


def _spans(text, kinds):
    out = []
    for part in filter(None, text.split(",")):
        kind, s, e = part.split(":")
        out.append((int(s), kinds.index(kind), int(e)))
    return out


@pytest.mark.parametrize("scan,kinds,patterns", [(pii.scan, pii.KINDS, brute.PERSONAL), (secrets.scan, secrets.KINDS, brute.SECRET)])
def test_fixed_spans_are_the_patterns(documents, odd, none, scan, kinds, patterns):
    import hashlib

    for df in (documents, odd):
        of = {r.doc_id: r.text for r in df.collect()}
        for r in scan(df).collect():
            want = brute.spans(of[r.doc_id], patterns)
            joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert set(want) <= set(_spans(r.spans, kinds))
            assert [r[f"n_{kinds[k]}"] for k in range(len(patterns))] == [sum(x[1] == k for x in want) for k in range(len(patterns))]
    assert scan(none).count() == 0


def test_fixed_spans_on_random_text():
    from quillrow.llm.spans import CodePoints, Scan

    r = np.random.default_rng(8)
    bits = ["token", "PASSWORD", "api_key", "Apikey", "AKIA", "192.168.0.1", "1", "22", "300", ".", "4111 1111 1111 1111", "+1 ", "a@b.c", "@", "abcdef0123456789abcdef01", "=", ":", " ", "'", '"', "é", "x", "-", "_", "(", ")", "\n"]
    rows = ["".join(r.choice(bits, int(r.integers(0, 25)))) for _ in range(3000)]
    for part in slices(pa.array(rows)):
        s, points = Scan(part), CodePoints(part)
        for patterns, finders in ((brute.PERSONAL, (s.emails, s.ips, s.cards, s.phones)), (brute.SECRET, (s.assigns, s.accesses, s.hexes))):
            for k, find in enumerate(finders):
                got = sorted((t, points(t, a), points(t, b)) for t, a, b in find())
                want = sorted((t, a, b) for t in range(part.n) for a, kind, b in brute.spans(rows[part.first + t], patterns) if kind == k)
                assert got == want


def test_personal_data_field_holds_out():
    field = pii.trained()
    rows = pii.labelled(200, seed=123)
    scores, length, _ = field.scores([[w.encode() for w, _ in r] for r in rows])
    pairs = [(x, pii.LABELS[y]) for r, p in zip(rows, field.viterbi(scores, length)) for (_, x), y in zip(r, p)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.97


def test_personal_data_in_sequences_is_that_of_whole_texts(texts):
    """Decoding the sequences gives what decoding all words does, where far words can only be outside."""
    field = pii.trained()
    rows = [t for _, t in texts if t][:60] + [" ".join(w for w, _ in r) for r in pii.labelled(60, seed=31)]
    for part in slices(pa.array(rows)):
        body = part.data.tobytes()
        w = pii.words(part)
        got = sorted(pii.tagged(part, body, field))
        want = []
        for t in range(part.n):
            own = [body[w.start[i] : w.end[i]] for i in range(w.cuts[t], w.cuts[t + 1])]
            if not own:
                continue
            near = np.array([any(pii._SPECIAL[b] for b in x) for x in own])
            far = ~np.array([near[max(0, i - pii.REACH) : i + pii.REACH + 1].any() for i in range(len(own))])
            scores, length, _ = field.scores([own], [far])
            path = field.viterbi(scores, length)[0]
            label = [pii.LABELS[x] for x in path]
            want += [(t, int(w.start[w.cuts[t] + i]), label[i][2:]) for i in range(len(own)) if label[i][0] == "B"]
        found = {(t, int(w.start[np.searchsorted(w.start, s, "right") - 1]), pii.KINDS[k]) for t, s, k, _ in got}
        assert found <= set(want) and len(found) > 20
        assert all(x in found for x in want if x[2] in ("email", "phone"))


def test_personal_data_of_long_words_and_odd_numbers():
    assert pii._word_features(b"aaaa-bbbb.cccc_dddd+x@x.com") != pii._word_features(b"aaaa-bbbb.cccc_dddd+x!!!@zz")
    long = b"a-" * 40 + b"b"
    assert pii._word_features(long + b"@x.com") != pii._word_features(long + b".x,com")
    field = pii.trained()
    for text, want in {
        "my ssn 123-45-6789 is mine": [],
        "my card 4111 1111 1111 1112 ok": [],
        "in 2019 we had 300 cows and 400 sheep": [],
        "we met at 2024-01-15 10:30 today": [],
        "key password=5197f409e51a76f6b0 here": [],
        "call 555 123 4567 now": ["phone 555 123 4567"],
        "dial 0044 20 7946 0958 please": ["phone 0044 20 7946 0958"],
        "fax 555.123.4567.": ["phone 555.123.4567"],
    }.items():
        base, added = pii.find(next(slices(pa.array([text]))), field)
        assert [f"{pii.KINDS[k]} {text[s:e]}" for s, k, e in base[0] + added[0]] == want, text


def test_personal_data_of_the_corpus_without_patterns(texts):
    """The field alone finds what the fixed patterns find in the corpus, and little besides."""
    from quillrow.llm.spans import Scan

    field, hit, total, extra = pii.trained(), [0] * 4, [0] * 4, 0
    for part in slices(pa.array([t for _, t in texts])):
        scan = Scan(part)
        own = pii.tagged(part, scan.body, field)
        known = []
        for k, found in enumerate((scan.emails(), scan.ips(), scan.cards(), scan.phones())):
            total[k] += len(found)
            hit[k] += sum(any((d, j) == (t, k) and a <= s and e <= b for d, a, j, b in own) for t, s, e in found)
            known += found
        extra += sum(not any(t == d and a < e and s < b for t, s, e in known) for d, a, _, b in own)
    assert sum(total) > 5 and sum(hit) >= 0.95 * sum(total) and extra <= 0.05 * sum(total) + 1


def test_personal_data_in_long_sequences():
    """A directory's phones are found wherever they stand in a sequence of thousands of words."""
    field = pii.trained()
    for lead in range(4):
        text = "no 1 " * lead + " ".join(f"call (555) {i // 10000 + 201}-{i % 10000:04} then" for i in range(0, 40000, 57))
        part = next(slices(pa.array([text])))
        got = {text[s:e] for s, k, e in pii.find(part, field)[1][0]}
        want = {f"(555) {i // 10000 + 201}-{i % 10000:04}" for i in range(0, 40000, 57)}
        assert want <= got, sorted(want - got)[:3]


def test_secret_grammars_hold_out():
    grammar = secrets.learnt()
    fresh = secrets.labelled(seed=77)
    for name, examples in fresh.items():
        hits = sum(grammar.ratio(x.encode()) >= secrets.THRESHOLD for x in examples) / len(examples)
        assert hits < 0.01 if name.startswith("plain") else hits > 0.9, (name, hits)


def test_secret_formats_keep_their_lengths():
    formats = secrets.learnt().formats
    assert len(formats["base64_key"].to) > 40 and len(formats["forge_token"].to) > 40
    key = "q8Zr+T5vLm0Xk3WbY7cN1dH9sJ4gF6pA2uE/iRoV"
    whole, short = formats["base64_key"].score(key.encode()), formats["base64_key"].score(key[:33].encode())
    assert len(key) == 40 and whole > -40 * np.log(64) - 30 and short < -33 * np.log(64)


def test_secrets_of_formats_never_seen():
    import random
    import string
    import uuid

    r, grammar = random.Random(3), secrets.learnt()
    some = lambda n, chars=string.ascii_letters + string.digits: "".join(r.choices(chars, k=n))
    rate = lambda make: sum(grammar.ratio(make().encode()) >= secrets.THRESHOLD for _ in range(300)) / 300
    for make in (
        lambda: "glpat-" + some(20),
        lambda: "npm_" + some(36),
        lambda: f"SG.{some(22)}.{some(43)}",
        lambda: "hf_" + some(34, string.ascii_letters),
        lambda: "sk-proj-" + some(40),
        lambda: some(32, string.ascii_lowercase),
        lambda: some(32),
    ):
        assert rate(make) > 0.95
    for make in (lambda: str(uuid.UUID(int=r.getrandbits(128))), lambda: some(15, "0123456789abcdef"), lambda: some(16, string.digits), lambda: f"{some(4, string.digits)}-{some(4, string.digits)}-{some(4, string.digits)}-{some(4, string.digits)}"):
        assert rate(make) < 0.01


def test_secret_ratios_are_the_automata():
    import random

    grammar, r = secrets.learnt(), random.Random(9)
    rows = [x for v in secrets.labelled(seed=3).values() for x in r.sample(v, 20)] + ["".join(r.choices("aZ9/_.=-+", k=r.randint(1, 30))) for _ in range(200)]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in rows])
    got = grammar.ratios(data, ends - [len(x) for x in rows], ends)
    for x, g in zip(rows, got.tolist()):
        scores = {k: a.score(x.encode()) for k, a in grammar.formats.items()}
        credential = max(v for k, v in scores.items() if not k.startswith("plain"))
        b = np.frombuffer(x.encode(), np.uint8)
        f, c = secrets._FOLDED[b], secrets._CASE[b]
        plain = grammar.pair[np.append(42, f), np.append(f, 42)].sum() + grammar.case[np.append(3, c[:-1]), c].sum()
        rule = sum(secrets._AGAIN if i and x[i] == x[i - 1] else secrets._OTHER for i in range(len(x)))
        assert abs(g - (credential - max(plain, rule, *(v for k, v in scores.items() if k.startswith("plain"))))) < 1e-2
    bounded = grammar.ratios(data, ends - [len(x) for x in rows], ends, secrets.THRESHOLD)
    over = got >= secrets.THRESHOLD
    assert np.allclose(bounded[over], got[over]) and not (bounded[~over] >= secrets.THRESHOLD).any()


def test_secrets_inside_longer_runs():
    import random

    grammar, r = secrets.learnt(), random.Random(5)
    before = ["hooks.example.com/services/", "https://registry.example.org/v2/team/images/", "config.service.internal.", "user=alice/key=", "services/T00/B00/"]
    for name, examples in secrets.labelled(seed=77).items():
        examples = [x for x in r.sample(examples, 60) if len(x) > 8]
        for after in ("", "/index.html"):
            heads = [r.choice(before) for _ in examples]
            hits = 0
            for part in slices(pa.array([f"see {h}{x}{after} now" for h, x in zip(heads, examples)])):
                for h, x, b, a in zip(heads, examples, *secrets.find(part, grammar, secrets.THRESHOLD)):
                    hits += any(s <= 4 + len(h) and 4 + len(h) + len(x) <= e for s, _, e in b + a) if not name.startswith("plain") else bool(a)
            assert hits <= 0.1 * len(examples) if name == "plain_code" else hits <= 0.02 * len(examples) if name.startswith("plain") else hits / len(examples) > 0.8, (name, after, hits)


def test_secret_sequences_by_passes_are_those_by_listing():
    """Runs of many parts: what is found by passes is what listing all sequences finds."""
    import random

    grammar, r = secrets.learnt(), random.Random(2)
    fresh = secrets.labelled(seed=5)
    rows = []
    for _ in range(40):
        parts = [r.choice(fresh[r.choice(["plain", "forge_token", "mixed", "plain_number"])]) for _ in range(r.randint(1, 4))]
        rows.append(r.choice("/=.") .join(parts))
    for part in slices(pa.array(rows)):
        few, all_ = (secrets.find(part, grammar, secrets.THRESHOLD, pieces)[1] for pieces in (1, 40))
        assert [bool(x) for x in few] == [bool(x) for x in all_]
        assert sum(sorted(a) == sorted(b) for a, b in zip(few, all_)) >= 0.9 * len(rows)
        assert sum(map(len, all_)) > 10


def test_redact(odd, none):
    rows = {(r.doc_id, r.text): r for r in secrets.redact(odd).collect()}
    own = next(r for (i, _), r in rows.items() if i == 6)
    assert "abcdef123456" not in own.text and "[secret]" in own.text and own.n_chars == len(own.text) and own.row == "x"
    assert secrets.redact(none).count() == 0


# -- 8: mixing ----------------------------------------------------------------------------------------


def test_mix(documents, odd, none):
    rows = mixing.mix(documents).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"] and (r.position is None or 0 <= r.position <= 1)
    for k, s in enumerate(sorted(by)):
        assert abs(sum(r.taken for r in by[s]) - by[s][0].target) <= 1
        assert by[s][0].source_size == sum(r["size"] for r in by[s])
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    assert [r.position for r in rows if r.position is not None] == sorted(r.position for r in rows if r.position is not None)
    assert sorted(map(str, mixing.mix(documents).collect())) == sorted(map(str, rows))
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(none).count() == 0


def test_schedule_has_every_pass(documents, odd):
    taken = {r.doc_id: r for r in mixing.mix(documents).collect()}
    rows = mixing.schedule(documents).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {i: sum(r.words for r in rs) for i, rs in by.items()} == {i: r.taken for i, r in taken.items() if r.taken}
    assert all(sorted(r["pass"] for r in rs) == list(range(taken[i].passes)) and min(r.position for r in rs) == taken[i].position for i, rs in by.items())
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 for r in rows)
    assert max(len(rs) for rs in by.values()) > 1
    # a source's demand over time is its schedule: half of a source of constant weight by half of the time
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        k = sorted({r.source for r in rows}).index(source) % 3
        half, total = sum(r.words for r in own if r.position < 0.5), sum(r.words for r in own)
        # but for the document that is read at that time
        assert abs(half - (0.5 - mixing.SLOPES[k] / 4) * total) <= max(r.words for r in own) + 1, source
    assert mixing.schedule(odd).count() > 0


def test_mix_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", False, 1), ("b", False, 100), ("c", False, 100), ("", True, 10)], "src string, src_null boolean, source_size bigint")
    got = {(r.src, r.src_null): r.target for r in mixing.targets(sizes).collect()}
    assert got["a", False] == 3 and got["", True] == 30
    assert abs(got["b", False] - 178 * 2 / 3) < 1e-9 and abs(got["c", False] - 178 / 3) < 1e-9


# -- 9: simhash ---------------------------------------------------------------------------------------


def test_simhash(documents, texts, odd, none):
    for df, rows in ((documents, texts), (odd, None)):
        rows = rows or [(i, t) for i, t, *_ in ODD if i is not None]
        prints = {i: brute.simhash(t) for i, t in rows}
        got = simhash.group(df).collect()
        for r in got:
            if r.doc_id is not None:
                assert int(r.fingerprint, 16) == prints[r.doc_id]
        if df is documents:
            ids = sorted(prints)
            want = brute.components(ids, [prints[i] for i in ids])
            assert {r.doc_id: r.component_id for r in got} == want
            assert sorted(map(str, simhash.group(df, hot=3).collect())) == sorted(map(str, got))
    assert len(simhash.group(odd).collect()) == len(ODD)
    assert simhash.group(none).count() == 0


def test_links_within_three_bits(spark):
    from quillrow.llm.components import connect

    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        at = b
        for _ in range(int(r.integers(0, 6))):  # chains, whose ends are further apart
            for k in r.choice(64, int(r.integers(1, 5)), replace=False):
                at ^= 1 << int(k)
            prints.add(at)
    ids = sorted(prints)
    want = brute.components(ids, ids)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in ids], "bits bigint")
    roots = {x.node % (1 << 64): x.root % (1 << 64) for x in connect(simhash.linked(df)).collect()}
    groups = {}
    for i in ids:
        groups.setdefault(roots.get(i, i), set()).add(i)
    same = {}
    for i in ids:
        same.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))
