import math

import numpy as np
import pytest

from docmill.llm import topk


def brute(rows, wanted, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in wanted:
        if q in whole:
            own = min(whole[q])
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, vs in whole.items() if i != q for v in map(list, {tuple(v) for v in vs}))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 100])
def test_against_brute_force(spark, block):
    r = np.random.default_rng(1)
    v = r.normal(0, 0.2, (300, 16))
    v[10:40] = v[50]  # a hot vector
    v[60:80] = np.round(v[60:80], 1)
    rows = [(int(3 * i), [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(1, None), (2, [float("nan")] * 16), (4, [None, *[0.1] * 15]), (5, [float("inf")] * 16), (7, [0.5] * 4), (8, []), (None, [0.1] * 16), (9, rows[3][1])]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    rows = [tuple(x)[:2] for x in df.collect()]
    got = topk.search(df, df.where("vec_id % 15 = 0 or vec_id in (1, 2, 7, 8)"), 5, block, 7 * block)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, [i for i, _ in rows if i is not None and (i % 15 == 0 or i in (1, 2, 7, 8))], 5)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(*[spark.createDataFrame([], schema)] * 2).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert sorted(tuple(r) for r in topk.search(two, two).collect()) == [(1, 1, 2, 256 * 256 * 5), (2, 1, 1, 256 * 256 * 5)]
    one = two.where("vec_id = 1")
    assert topk.search(one, one).count() == 0


def test_one_query_near_everything(spark):
    """All candidates of all queries have about the same bound, so that every one of them must be read."""
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.r_[1.0, r.integers(0, 2, 6) / 256]]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id % 50 = 0"), 5, 4, 100)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, range(0, 600, 50), 5)


def test_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    # products beyond what a floating-point number holds exactly, and below 64 bits
    rows = [(i, [float(5_000_000 + i), float(3_000_000 - 7 * i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(tuple(x) for x in topk.search(df, df.where("vec_id % 5 = 0"), 5).collect()) == brute(rows, range(0, 40, 5), 5)
    for big in (1e12, 1e30):
        df = spark.createDataFrame([(1, [big, 1.0]), (2, [1.0, big])], schema)
        with pytest.raises(ValueError, match="64 bits"):
            topk.search(df, df)


def test_no_components(spark):
    df = spark.createDataFrame([(1, []), (2, []), (3, None)], "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in topk.search(df, df).collect()) == [(1, 1, 2, 0), (2, 1, 1, 0)]


def test_shorter_vectors_end_in_zeros(spark):
    rows = [(i, [0.5 + i / 64] * (2 if i % 7 == 0 else 4)) for i in range(80)] + [(900, [-0.25] * 3), (901, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pad = [(i, v + [0.0] * (4 - len(v))) for i, v in rows]
    assert sorted(tuple(x) for x in topk.search(df, df.where("vec_id % 10 = 0"), 5, 3, 20).collect()) == brute(pad, [i for i, _ in rows if i % 10 == 0], 5)
