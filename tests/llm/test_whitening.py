import math

import numpy as np
import pytest

from docmill.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string"


def brute(vectors, most=32):
    """All covariances in one piece, in the plain way."""
    dims = max(map(len, vectors))
    x = [[math.floor(64 * c) + 1_000_000 for c in (*v, *[0.0] * (dims - len(v)))] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    y = np.array([[float(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return n, deviation, y, values, vectors, values / np.trace(y.T @ y / n)


def check(spark, rows, tile=None, row_block=whitening.ROW_BLOCK):
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], SCHEMA).repartition(3)
    got = whitening.whiten(df, tile=tile, row_block=row_block).collect()
    used = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n, deviation, y, values, vectors, explained = brute([v for _, v in used])
    assert len(got) == len(used) * len(values)
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    for c, own in by.items():
        live = values[c - 1] > 1e-9 * values[0]
        want = y @ vectors[:, c - 1] / math.sqrt(values[c - 1]) if live else None
        have = np.array([own[i].whitened if live else 0.0 for i, _ in used])
        if live:
            assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        else:
            assert all(r.whitened is None for r in own.values())
        assert all(r.explained == pytest.approx(explained[c - 1], abs=1e-12) and r.n == n and r.identity_error < 1e-9 for r in own.values())
        assert [int(own[i].deviation) for i, _ in used] == deviation


def test_against_one_matrix(spark):
    r = np.random.default_rng(4)
    v = r.normal(0, 0.3, (400, 40)) * np.linspace(1, 3, 40)
    v[50:150] = v[7]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (901, [float("nan")] * 40), (902, [None] * 40), (903, [float("inf")] * 40)]
    check(spark, rows)
    check(spark, rows, tile=7, row_block=13)


def test_shift_and_shorter_vectors(spark):
    r = np.random.default_rng(5)
    v = r.normal(0, 1, (60, 5)) * (1, 2, 3, 4, 5)
    check(spark, [(i, [float(x) + 1e6 for x in row]) for i, row in enumerate(v)], tile=2, row_block=8)
    check(spark, [(i, [float(x) for x in row][: 5 if i % 9 else 3]) for i, row in enumerate(v)], tile=2, row_block=8)


def test_components_without_variance(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(a), float(b), float(a + b), 0.5]) for i, (a, b) in enumerate(r.integers(-9, 9, (50, 2)))]
    check(spark, rows, tile=3)
    alike = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], "") for i in range(4)], SCHEMA)).collect()
    assert len(alike) == 8 and all(x.whitened is None and x.explained == 0 and x.deviation == 0 and x.identity_error == 0 for x in alike)


def test_odd_rows(spark):
    frame = lambda rows: spark.createDataFrame([(*x, "") for x in rows], SCHEMA)
    for rows in ([], [(1, None)], [(1, []), (2, [])]):
        assert whitening.whiten(frame(rows)).collect() == []
    twice = whitening.whiten(frame([(1, [0.5]), (1, [0.5]), (None, [-0.5]), (2, [-0.5])])).collect()
    assert len(twice) == 4 and {x.n for x in twice} == {4} and {round(abs(x.whitened), 9) for x in twice} == {1.0}
    with pytest.raises(ValueError, match="scale"):
        whitening.whiten(frame([(1, [1e30]), (2, [0.0])]))


def test_squares_are_exact():
    r = np.random.default_rng(7)
    v = r.integers(-(1 << 56), 1 << 56, (50, 33))
    assert [int(x) for x in whitening.squares(v)] == [sum(int(x) ** 2 for x in row) for row in v]


def test_query(spark):
    got = whitening.op11_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = got.collect()
    x = np.array([r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component))]).reshape(-1, 32)
    assert np.abs(x.T @ x / len(x) - np.eye(32)).max() < 1e-9 and len(x) == rows[0].n
