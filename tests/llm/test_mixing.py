import random
from collections import defaultdict

import pytest

from pyspark.sql import functions

from docmill.llm import mixing as m


def corpus(n=3000):
    r = random.Random(5)
    rows = []
    for i in range(n):
        source = "hot" if r.random() < 0.4 else f"s{r.randrange(6)}"
        text = " ".join("word" for _ in range(r.randrange(1, 60))) + r.choice(["", " | x", " a@b.c", " Licence"])
        rows.append((i, text, r.choice(["en", "en", "en", "de", None]), source))
    return rows


def brute(cells, goals, rakes):
    w = {c: n / sum(cells.values()) for c, n in cells.items()}
    for _ in range(rakes):
        for d in range(3):
            there = defaultdict(float)
            for c, x in w.items():
                there[c[d]] += x
            w = {c: x * goals[d].get(c[d], 0) / there[c[d]] for c, x in w.items()}
    total = sum(w.values())
    return {c: x / total for c, x in w.items()}


def test_raking_matches_brute_force_and_targets(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    cells = m.cell_table(docs)
    counts = {(r.source, r.lang, r.topic): r.n_tokens for r in cells.collect()}
    assert sum(counts.values()) == sum(len(t.split()) for _, t, _, _ in corpus())
    goals = []
    for d in range(3):
        own = defaultdict(float)
        for c, n in counts.items():
            own[c[d]] += n
        p = {v: n**m.TEMPERATURE for v, n in own.items()}
        goals.append({v: x / sum(p.values()) for v, x in p.items()})
    got = {(r.source, r.lang, r.topic): r.weight for r in m.raked(cells).collect()}
    want = brute(counts, goals, m.RAKES)
    assert got == pytest.approx(want, rel=1e-9)
    for d in range(3):
        there = defaultdict(float)
        for c, x in got.items():
            there[c[d]] += x
        assert dict(there) == pytest.approx(goals[d], abs=2 * m.TOLERANCE)
    for r in m.marginals(m.raked(cells)).collect():
        assert r.reached == pytest.approx(r.target, abs=2 * m.TOLERANCE) and r.target == pytest.approx(goals[m.DIMS.index(r.dim)][r.value])


def test_sample_follows_probabilities(spark):
    docs = spark.createDataFrame([(*r, 1.0, "x", "y") for r in corpus()], "doc_id long, text string, lang string, source string, weight double, topic string, _topic string")
    rows = m.mix(docs, share=0.4).collect()
    assert len(rows) == 3000 and all(0 <= r.probability <= 1 for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.4 * total, rel=1e-6)
    assert sum(r.n_tokens for r in rows if r.sampled) == pytest.approx(0.4 * total, rel=0.08)
    taken = m.sample(docs, share=0.4)
    assert taken.columns == docs.columns
    assert {r.doc_id for r in taken.collect()} == {r.doc_id for r in rows if r.sampled}


def test_full_cells_and_own_targets(spark):
    docs = spark.createDataFrame([(i, "a b", "en", "small" if i < 10 else "large") for i in range(1000)], "doc_id long, text string, lang string, source string")
    goal = spark.createDataFrame([("small", 0.5), ("large", 0.4), ("missing", 0.1)], "value string, target double")
    p = {r.source: r.probability for r in m.mix(docs, {"source": goal}, share=0.5).collect()}
    assert p["small"] == 1 and p["large"] == pytest.approx((0.5 * 2000 - 20) / 1980)
    none = spark.createDataFrame([("large", 1.0)], "value string, target double")
    assert {r.probability for r in m.mix(docs, {"source": none}).where("source = 'small'").collect()} == {0.0}


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert m.mix(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "", "en", "s"), (2, "w " * 60000, "en", "s")], schema)
    rows = m.mix(docs, share=1.0).collect()
    assert len(rows) == 4 and sorted(r.n_tokens for r in rows) == [1, 1, 1, 60000] and all(r.sampled for r in rows)
    assert m.sample(docs, share=0.0).count() == 0


def test_raking_goes_on_until_targets_are_met(spark):
    """Marginals that pull at each other: one lot of rounds is not enough, and targets that cannot be met end it."""
    rows = [("a", "x", 1000), ("a", "y", 1), ("b", "x", 1), ("b", "y", 1000)]
    cells = spark.createDataFrame([(s, l, "prose", 1, n) for s, l, n in rows], "source string, lang string, topic string, n_docs long, n_tokens long")
    goals = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, target double"), "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "value string, target double")}
    done = m.raked(cells, goals, rakes=2)
    assert all(r.reached == pytest.approx(r.target, abs=1e-5) for r in m.marginals(done).collect())
    never = m.raked(cells.where("source = lang or (source = 'a' and lang = 'x') or (source = 'b' and lang = 'y')"), goals)
    assert {r.value: r.target for r in m.marginals(never).where("dim = 'source'").collect()} == {"a": 0.9, "b": 0.1}


def test_own_topics_and_many_cells(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(600), "doc_id long, text string, lang string, source string")
    one = lambda text: m.F.when(m.F.length(text) > 100, "much").otherwise("little")
    want = {r.doc_id: (r.topic, round(r.probability, 9)) for r in m.mix(docs, topics=one).collect()}
    assert {t for t, _ in want.values()} == {"much", "little"}
    monkeypatch.setattr(m, "CELLS_SENT", 1)
    assert {r.doc_id: (r.topic, round(r.probability, 9)) for r in m.mix(docs, topics=one).collect()} == want
    assert m.sample(docs, topics=one).count() == m.mix(docs, topics=one).where("sampled").count()


def test_null_topic_loses_no_row(spark):
    rows = [(i, f"word {i}", "s", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    topics = lambda text: functions.when(text.contains("1"), "one")
    got = m.mix(df, topics=topics).collect()
    assert sorted(r.doc_id for r in got) == list(range(40)) and {r.topic for r in got} == {"one", ""}
    drawn = {r.doc_id for r in got if r.sampled}
    assert {r.doc_id for r in m.sample(df, topics=topics).collect()} == drawn
