import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest

from docmill.llm import toxicity as x


def corpus(n=400, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "th", "er", "on", "in", "es"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.choice([3, 40, 120]))]
        toxic = int(i % 5 == 0)
        if toxic:
            for bad in r.sample(["grobian", "knilch", "zzulpfig"], 2):
                w.insert(r.randrange(len(w)), bad)
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, toxic))
    return rows, labels


def plain(weights, counts):
    """Unit vectors by their definition, as rows of a matrix."""
    names = list(weights)
    v = np.array([[(1 + math.log(c[t])) * weights[t] if c.get(t) else 0.0 for t in names] for c in counts])
    return v / np.maximum(1e-300, np.linalg.norm(v, axis=1))[:, None]


def some_index(n=500, words=40):
    r = np.random.default_rng(1)
    weights = {f"{a}{b}": 1.0 + i % 5 for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "vwxyz")}
    counts = [{t: int(k) for t, k in zip(weights, r.integers(1, 4, len(weights)) * (r.random(len(weights)) < 0.15)) if k} for _ in range(n)]
    counts[1] = counts[2] = counts[5]  # ties
    counts[7] = {}
    return x.Index.build(weights, [10 * i for i in range(n)], r.random(n) < 0.3, counts), weights, counts


def test_neighbours_are_exact():
    index, weights, counts = some_index()
    v = plain(weights, counts)
    texts = [" ".join(t for t, k in c.items() for _ in range(k)) for c in (*counts[:20], {}, {"zz": 3})] + ["av " * 30 + "unknown words", " ".join(weights)]
    for text in texts:
        own = Counter(t for t in text.split() if t in weights)
        all_cos = v @ plain(weights, [own])[0]
        got, cos = index.nearest(*index.vector(text))
        want = [i for i in np.lexsort((np.arange(500), -np.round(all_cos, 12))) if all_cos[i] > 1e-15][: x.NEIGHBOURS]
        assert np.allclose(cos, all_cos[want]) and set(got[cos > cos[-1] + 1e-9] if len(cos) else []) <= set(want)
    for leave in (3, 5):
        got, _ = index.nearest(*index.vector(" ".join(counts[5])), leave=leave)
        assert leave not in got


def test_bounds_hold_and_shut_blocks():
    index, weights, counts = some_index(3000)
    v = plain(weights, counts)
    for c in counts[:30]:
        at, w = index.vector(" ".join(c))
        if len(at):
            bounds, cos = w @ index.tops[at], v[:, at] @ w
            assert all(cos[b * x.BLOCK : (b + 1) * x.BLOCK].max() <= bounds[b] + 1e-5 for b in range(len(bounds)))


def test_votes_and_calibration():
    """Share, steps and score by their definition."""
    index, weights, counts = some_index()
    index.calibrate(counts, (3.0, 1.0))
    v, y = plain(weights, counts), index.toxic
    raw = []
    for i in range(len(y)):
        cos = np.where(np.arange(len(y)) == i, 0, v @ v[i])
        near = [j for j in np.lexsort((np.arange(len(y)), -np.round(cos, 12))) if cos[j] > 1e-15][: x.NEIGHBOURS]
        raw.append(((cos[near] ** 2 * y[near]).sum() + x.PRIOR * y.mean() * 0.1) / ((cos[near] ** 2).sum() + x.PRIOR))
        if i % 50 == 0:
            at, w = index.vector(" ".join(t for t, k in counts[i].items() for _ in range(k)))
            assert index.share(*index.nearest(at, w, leave=i)) == pytest.approx(raw[-1], abs=1e-6)
    # the best monotone fit by weighted least squares, as the largest mean from the left of the least to the right
    raw = np.round(raw, 9)
    xs = sorted(set(raw))
    weight = np.where(y == 1, 1.0, 3.0)
    n, t = (np.array([q[raw == z].sum() for z in xs]) for q in (weight, weight * y))
    fit = [max(min(t[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, len(xs))) for a in range(k + 1)) for k in range(len(xs))]
    means = {}
    for z, f, own_n, own_t in zip(xs, fit, n, t, strict=True):
        held = means.setdefault(round(f, 9), [0, 0, []])
        held[0] += own_t
        held[1] += own_n
        held[2].append(z)
    for own_t, own_n, held in means.values():
        for z in (held[0], held[-1]):
            assert np.interp(z, index.knots[:, 0], index.knots[:, 1]) == pytest.approx((own_t + 0.5) / (own_n + 1), abs=1e-3)


def test_columns_are_those_of_the_terms():
    names = ["idiot", "idio*", "idiot*", "the", "ça", "strasse", "x"]
    column = {t: i for i, t in enumerate(names)}
    known = x.Columns(column)
    for token in ("Idiots!", "IDIOT.", "the,the", "ÇA", "x2x", "İdiot", "idiot²", "_the_", "...", "idio", "straße"):
        assert known.of([token]).tolist() == [column[t] for t in x.terms(token) if t in column], token
    assert known.of([]).tolist() == []


def test_an_example_finds_itself_without_telling_terms():
    counts = [x.term_counts(t) for t in ("plain words of no kind", "other words stand here", "and more of the same")]
    idf = {t: 1.0 for c in counts for t in c if not t.endswith("*")}
    index = x.model([(i, float(i == 0), c) for i, c in enumerate(counts)], {t: 0.0 for t in idf}, idf, (1.0, 1.0))
    places, cosines = index.nearest(*index.vector("Plain words, of no kind."))
    assert index.ids[places[0]] == 0 and cosines[0] == pytest.approx(1)


def test_every_language_is_caught(spark):
    """A language with few examples, whose words the others do not have."""
    rows, labels = corpus()
    r = random.Random(8)
    for i in range(1000, 1120):
        w = ["".join(r.choice("xyzwv") for _ in range(3)) for _ in range(60)]
        if i % 4 == 0:
            w[5:5] = ["vxxyzzy", "wyzzle"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = x.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [r for r in x.scored(docs, index).collect() if r.held_out]
    for part, toxic in ((lambda d: d < 1000, lambda d: d % 5 == 0), (lambda d: d >= 1000, lambda d: d % 4 == 0)):
        mine = [r for r in got if part(r.doc_id)]
        assert np.mean([r.predicted for r in mine if toxic(r.doc_id)]) > 0.9 and np.mean([r.predicted for r in mine if not toxic(r.doc_id)]) < 0.05


def test_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    index = x.fit(docs, labels)
    assert not {f"{i}" for i in index.ids} & {str(r.doc_id) for r in docs.where(x.held_out(docs.doc_id)).collect()}
    got = {r.doc_id: r for r in x.scored(docs, index).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    right = [got[i].predicted == int(i % 5 == 0) for i, _ in rows if got[i].held_out]
    assert np.mean(right) > 0.95
    kept = x.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    again = pickle.loads(pickle.dumps(index))
    assert [again.score(*again.nearest(*again.vector(t))) for _, t in rows[:50]] == [index.score(*index.nearest(*index.vector(t))) for _, t in rows[:50]]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "grobian " * 40000), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in x.scored(docs, x.fit(docs, none)).collect()] == [(0.0, 0)] * 4
    rows, labels = corpus()
    index = x.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 1, None), (0, 1, 1), (10**9, 1, 1)], "doc_id long, quality int, toxic int"))
    got = x.scored(docs, index).collect()
    assert [r.predicted for r in got] == [0, 0, 1, 0]
    assert x.scored(docs.limit(0), index).count() == 0
