import random

import numpy as np
import pytest

from docmill.llm import minhash as m


def brute(rows, k, percent):
    """All pairs, by union and find."""
    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, []).append(m.shingles(text or "", k))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        ra, rb = find(a), find(b)
                        root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(r.choice([4, 30, 90, 200]))] for _ in range(n)]
    shared = [word() for _ in range(60)]
    rows = []
    for i, w in enumerate(base):
        rows.append(w)
        if i % 6 == 0:
            rows.append(shared + w[:20])
        for _ in range(r.choice([0, 0, 1, 4])):
            w = list(w)
            for _ in range(max(1, len(w) * r.choice([0, 1, 2, 5]) // 100)):
                w[r.randrange(len(w))] = word()
            rows.append(w)
    r.shuffle(rows)
    out = [(3 * i + 1, " ".join(w)) for i, w in enumerate(rows)]
    return out + [(900_001, None), (900_002, ""), (900_003, " \t"), (900_004, "one"), (900_005, "ONE\n"), (900_006, out[0][1].upper()), (5, out[0][1] + " ")]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, rep string")
    want = brute(rows, k, percent)
    got = {r.doc_id: r for r in m.near_duplicates(df, k, percent).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert all(got[d].n_shingles == len(m.shingles(t or "", k)) for d, t in rows)
    kept = m.deduplicate(df, k, percent)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_large_mixed_buckets(spark, monkeypatch):
    monkeypatch.setattr(m, "BIG", 2)
    monkeypatch.setattr(m, "BLOCK", 2)
    monkeypatch.setattr(m, "FEW", 2)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in m.near_duplicates(df, 3, 85).collect()} == brute(rows, 3, 85)


def test_hashes_do_not_depend_on_the_batch():
    batch = [t or "" for _, t in corpus(n=20)]
    for k in (3, 5):
        for text, got in zip(batch, m.hashed_sets(batch, k), strict=True):
            assert got.tolist() == m.hashed_sets([text], k)[0].tolist() and len(got) == len(m.shingles(text, k))


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    for n in (1, 5, 300, 5000):
        both = r.integers(0, 2**63, n).astype(np.uint64)
        a, b = (np.unique(np.r_[both, r.integers(0, 2**63, n // 4).astype(np.uint64)]) for _ in range(2))
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((m.sketch(a, 252) == m.sketch(b, 252)).mean() - want) < 0.15


def test_components_of_chains(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in m.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100, 102: 100}


def test_empty(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = m.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, False), (1, 1, True), (1, 1, True)]


def test_rows_that_repeat_and_rows_without_an_id(spark):
    rows = [(None, "a b c d e f"), (None, "x"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other words stand here now"), (2, "A b c d e f"), (3, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    got = m.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == [(0, "a b c d e f"), (0, "x"), (1, "a b c d e f"), (1, "other words stand here now"), (3, "")]
    assert m.deduplicate(df.limit(0)).count() == 0


def test_one_doc_id_with_two_texts(spark):
    """Rows of one doc_id stay or go by their own text, so that no text is lost with a copy of another."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(2, x), (5, x), (5, y), (5, y), (6, y), (7, z), (7, x), (7, None), (8, z + " end"), (None, x)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = m.deduplicate(df).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(2, x), (5, y), (7, z), (7, None), (None, x)], key=repr)
    assert {r.text for r in got} >= {x, y, z}
