import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docmill.llm import maxent as m


def corpus(n=300):
    r = random.Random(2)
    after = {w: [f"{w}{k}" for k in range(3)] for w in "abcdefgh"}
    rows = []
    for i in range(n):
        out, w = [], "a"
        for _ in range(r.choice([1, 20, 80])):
            nxt = r.choice(after[w[0]])
            out.append(nxt if r.random() > 0.1 else f"rare{r.randrange(400)}")
            w = r.choice("abcdefgh") if r.random() < 0.2 else chr(97 + (ord(w[0]) - 96) % 8)
        rows.append((i, " ".join(out).upper() if i % 9 == 0 else " \n".join(out)))
    return rows


def held(doc):
    return zlib.crc32(str(doc).encode()) % 7 == 2


def fitted(spark, rows, vocabulary):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return m.fit(df, m.counted(df), vocabulary)


def test_probabilities_sum_to_one(spark):
    rows = corpus(60)
    model = fitted(spark, rows, 30)
    types = {w for _, t in rows for w in m.words(t)}
    counts = Counter(w for _, t in rows for w in m.words(t))
    before = m.words("a0 b1 never")[:-1]
    rest = sum(c for w, c in counts.items() if w not in model.place), sum(w not in model.place for w in types)
    assert rest == (model.rest_tokens, model.rest_types)
    total = 0.0
    for w in [*types, b"unseen"]:
        got = model.score([[*before, w]])
        prefix = model.score([before])["model_log"][0]
        p = 10 ** (got["model_log"][0] - prefix)
        total += p if w in model.place else p * (counts[w] + 1) / (rest[0] + rest[1] + 1)
    assert total == pytest.approx(1, abs=1e-3)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "VOCABULARY", 30)
    rows = [*corpus(), (1000, None), (1001, ""), (1001, ""), (1002, "a0 " * 30000), (None, "a0 zz")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, words int").repartition(3)
    train = df.where(~m.fold(df.doc_id))
    counts = Counter(w for d, t in rows if d is None or not held(d) for w in m.words(t or ""))
    n, v = sum(counts.values()), len(counts)
    got = m.scores(df, train).collect()
    assert len(got) == len(rows)
    key = lambda d, t: (d is None, d or 0, t)
    want = sorted(key(d, len(m.words(t or ""))) for d, t in rows)
    assert sorted(key(r.doc_id, r.n_tokens) for r in got) == want
    by_doc = {d: m.words(t or "") for d, t in rows}
    for r in got:
        own = by_doc[r.doc_id]
        assert (r.n_known, r.train_tokens) == (sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.score < 0


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = corpus(1200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in m.scores(df, df.where(~m.fold(df.doc_id))).collect() if held(r.doc_id)]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.05 * sum(r.n_tokens for r in got)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = m.scores(df, df.limit(0)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0)
    assert m.scores(df.limit(0), df).count() == 0


def test_most_frequent(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), c) for i, c in enumerate([50_000, 20_001, 20_000, 7, 7, 7, 3, 1, 1])], "word binary, c long")
    for most, want in ((9, 9), (8, 7), (7, 7), (6, 6), (5, 3), (1, 1), (0, 0)):
        got = m.most_frequent(counts, most)
        assert len(got) == want and [c for _, c in got] == sorted([c for _, c in got], reverse=True)


def test_gradient_is_that_of_the_likelihood():
    model = m.Model([(b"a", 5), (b"b", 3), (m.END, 2)], 12, 5)
    batch = [m.words("a b b a"), m.words("b c")]
    like = lambda: model.score(batch)["model_log"].sum()
    before = like()
    for _ in range(30):
        model.train(batch, np.zeros(m.HASHED), np.zeros(m.HASHED, np.float32))
    assert like() > before + 0.5


def test_context_chooses_the_word_within_its_class():
    # 90 words of one count share a class; x0 is always followed by its own of two such words
    frequent = [(f"w{i}".encode(), 5) for i in range(90)]
    model = m.Model(frequent, 450, 90)
    ways = {w: (model.nodes[s], model.branches[s]) for (w, _), s in zip(frequent, model.start, strict=False)}
    u, v = next((a, b) for a in ways for b in ways if a < b and ways[a] == ways[b])
    log = lambda a, b: model.score([[a, b]])["model_log"][0] - model.score([[a]])["model_log"][0]
    assert log(b"w1", u) == pytest.approx(log(b"w1", v), abs=1e-5)
    for _ in range(40):
        model.train([[b"w1", u], [b"w2", v]], np.zeros(m.HASHED), np.zeros(m.HASHED, np.float32))
    assert log(b"w1", u) > log(b"w1", v) + 0.5 and log(b"w2", v) > log(b"w2", u) + 0.5


def test_rows_grow_with_distinct_words(spark):
    assert [m.rows_for(n) for n in (0, 65_536, 65_537, 404_216, 10**9)] == [1 << 14, 1 << 14, 1 << 15, 1 << 17, 1 << 18]
    model = fitted(spark, [(i, f"n{i} m{i} " * 2) for i in range(70)] + [(99, " ".join(f"r{i}" for i in range(70_000)))], 500)
    assert len(model.weights) == 1 << 15


def test_step_against_a_plain_one():
    """One gradient step, worked out choice by choice with a dictionary of rows."""
    r = random.Random(4)
    frequent = [(f"w{i}".encode(), 90 - i) for i in range(60)] + [(m.END, 20)]
    model = m.Model(frequent, sum(n for _, n in frequent) + 30, 80, 1 << 10)
    model.weights[:] = np.random.default_rng(1).normal(0, 0.3, model.weights.shape)
    batch = [[r.choice(frequent)[0] if r.random() < 0.9 else b"zz%d" % r.randrange(9) for _ in range(40)] + [m.END] for _ in range(5)]
    before = model.weights.copy()
    ids, is_token, outside = model.ids(batch)
    assert outside == [Counter(w for w in b if w not in model.place) for b in batch]
    token, rows, node, branch = model.choices(ids, np.flatnonzero(is_token))
    size, tokens = len(node), int(is_token.sum())
    assert len(rows) == 3 * size and not node[:tokens].any() and node[tokens:].all()
    slopes, times = {}, Counter()
    for at, (n, k) in enumerate(zip(node.tolist(), branch.tolist(), strict=True)):
        met = [int(rows[lot * size + at]) for lot in range(3)]
        z = [sum(before[x][i] for x in met) + model.bias[n][i] for i in range(m.CLASSES)]
        total = sum(math.exp(x) for x in z)
        own = np.array([(i == k) - math.exp(x) / total for i, x in enumerate(z)])
        for row in met:
            slopes[row] = slopes.get(row, 0) + own
            times[row] += 1
    seen, energy = np.zeros(1 << 10), np.zeros(1 << 10, np.float32)
    model.train(batch, seen, energy)
    for row in range(1 << 10):
        move = slopes.get(row, np.zeros(m.CLASSES))
        want = before[row] + m.RATE * move / math.sqrt((move * move).sum() + 1)
        assert model.weights[row] == pytest.approx(want, abs=1e-4) and seen[row] == times[row]


def test_words_are_split_as_bytes_are():
    odd = ["", " ", "\n\n", "a", " A  b ", "\tA\x0bB\x0cc\rd\ne\x1cf\x1dg\x1eh\x1fi\x85j\xa0K\x00l m", "ÀÉİ ABC K", "x" * 70_000 + " y"]
    upper = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    want = [[*t.encode().translate(upper).split(), m.END] for t in odd]
    assert m.split(pa.array(odd)).to_pylist() == want == [m.words(t) for t in odd]
    # a part of a longer column, as tasks cut it
    assert m.split(pa.array(["no", *odd, "no"]).slice(1, len(odd))).to_pylist() == want
    model = m.Model([(b"abc", 5), (m.END, 3)], 20, 9)
    for x, y in zip(model.ids(m.split(pa.array(odd))), model.ids(want), strict=True):
        assert list(x) == list(y)


def test_sums_of_groups():
    r = np.random.default_rng(5)
    times = np.array([2, 3, m.LARGE, m.LARGE + 1, 2, 500, m.LARGE - 1, 7])
    e, source = r.normal(size=(40, m.CLASSES)).astype(np.float32), r.integers(0, 40, times.sum() + 3)
    begin = np.cumsum(times) - times
    got = m.summed(e, source, begin, times)
    assert got == pytest.approx(np.array([e[source[a : a + n]].astype(float).sum(0) for a, n in zip(begin, times, strict=True)]), abs=1e-3)


def test_steps_of_many_blocks(monkeypatch):
    """What is worked out at a time does not change what comes out."""
    r = random.Random(7)
    batch = [[f"w{min(r.randrange(300), r.randrange(300))}".encode() for _ in range(400)] + [m.END] for _ in range(6)]
    found = []
    for block, large in ((1 << 20, 1 << 20), (64, 3)):
        monkeypatch.setattr(m, "BLOCK", block)
        monkeypatch.setattr(m, "LARGE", large)
        model = m.Model([(f"w{i}".encode(), 600 - i) for i in range(250)], 200_000, 300, 1 << 12)
        seen, energy = np.zeros(1 << 12), np.zeros(1 << 12, np.float32)
        for _ in range(3):
            model.train(batch, seen, energy)
        found.append((model.weights, seen, energy, model.score(batch)["model_log"]))
    for x, y in zip(*found, strict=True):
        assert x == pytest.approx(y, rel=1e-3, abs=1e-3)
