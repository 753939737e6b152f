import numpy as np
import pytest
from cases import ODD, SMALL

import corpus_pipeline
from quillrow.llm import near_copies
from quillrow.llm.components import connect


def test_near_copies_and_clean_documents(spark):
    r = np.random.default_rng(6)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), int(r.integers(3, 9))))
    rows, group = [], {}
    for g in range(60):
        base = [word() for _ in range(int(r.integers(120, 400)))]
        for copy in range(1 + g % 4):
            words = list(base)
            if copy:
                words[int(r.integers(len(words)))] = word()  # one word of many: similarity of about 0.9 and more
            i = len(rows)
            rows.append((i, " ".join(words), "s"))
            group[i] = g
    rows += [(1000, rows[5][1].upper(), "s"), (1001, rows[7][1], "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = sorted(x.doc_id for x in near_copies.one_of_each(df).collect())
    want = sorted(min(i for i in group if group[i] == g) for g in range(60))
    assert kept == want


def test_fingerprints_within_three_bits_are_candidates(spark):
    """Without minimum hashes (no pair passes a check of less than none) SimHash alone finds its balls."""
    from quillrow.llm import simhash

    r = np.random.default_rng(8)
    some = lambda n: [f"w{x}" for x in r.integers(0, 1 << 40, n)]
    rows = []
    for g in range(40):
        base = some(600)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base + some(1 if g % 4 else 140)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bits = {x.doc_id: x.bits for x in simhash.fingerprints(df, 5).collect()}
    near = {2 * g + 1 for g in range(40) if ((bits[2 * g] ^ bits[2 * g + 1]) & (1 << 64) - 1).bit_count() <= 3}
    assert 20 < len(near) < 40
    assert {x.doc_id for x in near_copies.one_of_each(df, check_bits=-1).collect()} == {i for i, _ in rows} - near
    assert {x.doc_id for x in near_copies.one_of_each(df).collect()} == {2 * g for g in range(40)}


@pytest.mark.parametrize("block", [2, 5, 256])
def test_large_clusters_in_small_blocks(spark, block):
    """Chains and stars of one cluster: components must be those of comparing all pairs."""
    r = np.random.default_rng(block)
    sets, root = {}, {}
    for c in range(4):
        base = r.integers(0, 1 << 40, 60)
        own = [np.unique(base)]
        for _ in range(40):
            x = own[int(r.integers(len(own)))].copy()
            x[r.choice(len(x), int(r.integers(1, 9)), replace=False)] = r.integers(0, 1 << 40, 1)
            own.append(np.unique(x))
        for x in own:
            sets[len(sets)] = x
            root[len(sets) - 1] = c
    df = spark.createDataFrame([(root[i], i, x.tolist()) for i, x in sets.items()], "root bigint, node bigint, shingles array<bigint>")
    links = near_copies._verified_links(df, 0.8, block)
    got = {x.node: x.root for x in connect(links).collect()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            if root[i] == root[j] and near_copies.alike(sets[i], sets[j], 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in sets}
    assert {i: got.get(i, i) for i in sets} == want
    assert 1 < len(set(want.values())) < len(sets)


def test_texts_that_reach_no_other_are_left_out(spark):
    """Half of a crowd holds too much of its own to be alike; it isn't compared, and no link is lost."""
    r = np.random.default_rng(9)
    base = np.arange(1, 201)
    fresh = iter(range(1000, 1 << 20))
    changed = lambda n: np.unique([*r.choice(base, 200 - n, replace=False), *(next(fresh) for _ in range(n))])
    sets = [changed(int(n)) for n in [*r.integers(0, 30, 150), *r.integers(45, 90, 150)]]
    sets += [np.unique(sets[200][:190]), np.arange(-100, 0)]  # one of them has a copy; one is unlike all
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(sets)], "root bigint, node bigint, shingles array<bigint>")
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if near_copies.alike(sets[i], sets[j], 0.8)}
    left = {x.node for x in near_copies._may_link(df, 0.8).collect()}
    assert {i for pair in alike for i in pair} <= left
    assert 200 in left and not left & {*range(150, 300), 301} - {200}
    got = {x.node: x.root for x in connect(near_copies._verified_links(df, 0.8, 16)).collect()}
    own = {i: i for i in range(len(sets))}
    for _ in own:
        for i, j in alike:
            own[i] = own[j] = min(own[i], own[j])
    assert {i: got.get(i, i) for i in own} == own


def test_links_of_a_block_are_those_of_all_pairs():
    import pyarrow as pa

    r = np.random.default_rng(4)
    for trial in range(40):
        n = int(r.integers(1, 30))
        sets = [np.unique(r.integers(0, 40, int(r.integers(1, 40)))) for _ in range(n)]
        comp, side = r.integers(0, n, n), r.integers(0, 1 + trial % 2, n) + 0
        table = pa.table({"node": np.arange(n), "comp": comp, "side": side, "shingles": pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))})
        links = near_copies._links(0.5)(table).to_pydict()
        across = len(set(side.tolist())) > 1
        pairs = {(i, j) for i in range(n) for j in range(n) if i != j and near_copies.alike(sets[i], sets[j], 0.5) and not (across and side[i] == side[j])}
        assert set(zip(links["a"], links["b"])) <= pairs

        def groups(edges):
            own = comp.copy()
            for _ in range(n):
                for i, j in edges:
                    low, high = sorted((own[i], own[j]))
                    own[own == high] = low
            return own.tolist()

        assert groups(list(zip(links["a"], links["b"]))) == groups(pairs)


def test_chains_of_a_crowd_are_spanned():
    from quillrow.llm.simhash import spanning

    r = np.random.default_rng(1)
    bits = np.unique(np.concatenate([r.integers(0, 1 << 10, 300), (1 << 40) * 1023 + r.integers(0, 1 << 10, 300)]))
    links = list(spanning(bits, 3))
    assert len(links) == len(bits) - 2 and all((a ^ b).bit_count() <= 3 for a, b in links)


def test_near_copies_links_match_brute_force():
    from quillrow.llm.near_copies import alike

    r = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(r.integers(0, 60, int(r.integers(1, 50))))
        b = np.unique(r.integers(0, 60, int(r.integers(1, 50))))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert alike(a, b, 0.5) == (j >= 0.5)


def test_near_copies_odd_rows(odd, none):
    got = near_copies.one_of_each(odd).collect()
    # 1, 2 and 3 have no words; 5 is repeated; 7 and 8 are the same
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (False, 9), (True, 0)]
    assert got[0].row == "x"
    assert near_copies.one_of_each(none).count() == 0
    twice = odd.where("doc_id IS NOT NULL").union(odd.where("doc_id = 7").withColumn("text", odd["lang"]))  # one id, two texts
    assert sorted(r.doc_id for r in near_copies.one_of_each(twice).collect()) == [1, 4, 5, 6, 7, 7, 9]
    distinct = odd.where("doc_id IS NOT NULL AND doc_id <> 5")
    assert sorted(r.doc_id for r in near_copies.one_of_each(distinct).collect()) == [1, 4, 6, 7, 9]


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            assert out.count() <= len(ODD)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < 200
    assert sum(r.taken for r in rows) > 0


def test_every_stage_is_what_brute_force_gives(spark):
    """The whole pipeline over the smallest tables, stage by stage on what the one before kept."""
    import brute

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    steps = [brute.quality_kept, brute.near_kept, lambda rs: brute.clean_kept(rs, items), brute.masked]
    left = []
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps):
        docs, rows = stage(spark, docs, SMALL), step(rows)
        got = sorted((r.doc_id, r.text, r.lang, r.source) for r in docs.collect())
        assert got == sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows), name
        left.append(len(rows))
    assert 200 > left[0] > left[1] > left[2] == left[3] > 50
    want = brute.mixed(rows)
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()}
    assert set(got) == set(want)
    for i, (size, full, target, taken) in want.items():
        assert got[i][:2] == (size, full) and abs(got[i][2] - target) < 1e-6 * max(1, target) and got[i][3] == taken, i


def test_near_copies_of_every_kind_meet(spark):
    """Truncated, appended to, a block put in, words changed: all pairs at or above 0.8 must fall together."""
    r = np.random.default_rng(12)
    some = lambda n: [f"w{x}" for x in r.integers(0, 1 << 40, n)]
    rows, pairs = [], 0
    for g in range(400):
        n = int(r.integers(60, 400))
        base = some(n)
        whole = n - 4  # shingles
        extra = int(whole / 0.8 - whole)
        at = int(r.integers(5, n - 5))
        copy = [
            lambda: base + some(extra),
            lambda: some(extra) + base,
            lambda: base[: n - int(whole * 0.2)],
            lambda: base[:at] + some(int((whole - 4) / 0.8 - whole - 4)) + base[at:],
            lambda: [w if i % 50 else some(1)[0] for i, w in enumerate(base)],
        ][g % 5]()
        a, b = (set(zip(*(x[i:] for i in range(5)))) for x in (base, copy))
        assert 0.8 <= len(a & b) / len(a | b) < 0.9, g
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        pairs += 1
    rows.append((9999, "\n".join(["the same line again and again"] * 300 + [rows[0][1]])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {x.doc_id for x in near_copies.one_of_each(df).collect()}
    assert kept == {2 * g for g in range(pairs)}
