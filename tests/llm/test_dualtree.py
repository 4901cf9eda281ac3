import hashlib
import math

import duckdb
import numpy as np
import pytest

from docmill.llm import dualtree

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in drawn[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [min((apart(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, to) in zip(kept, near, strict=True) if to == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = [sum(d for d, to in near if to == n) for n in range(len(centroids))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia), name[n]) for (i, _), (d, n) in zip(kept, near, strict=True)), key=repr)


def some(n, dims, seed):
    r = np.random.default_rng(seed)
    v = r.normal(0, 1, (8, dims))[r.integers(0, 8, n)] + r.normal(0, 0.2, (n, dims))
    v[n // 4 : n // 2] = v[0]  # a hot vector
    v[n // 2 : n // 2 + 20] = np.round(v[n // 2 : n // 2 + 20])
    return [(int(i), [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize(("n", "dims", "k", "block"), [(600, 6, 16, 2048), (300, 2, 7, 40), (200, 1, 16, 16), (40, 3, 100, 9)])
def test_against_all_distances(spark, n, dims, k, block):
    rows = some(n, dims, n)
    rows += [(1000, None), (1001, [float("nan")] * dims), (1002, [None] * dims), (1003, [0.1] * (dims + 1)), (None, [0.3] * dims), (5, rows[5][1]), (5, rows[6][1])]
    df = spark.createDataFrame([(*x, "z") for x in rows], SCHEMA).repartition(3)
    got = dualtree.cluster(df, k, 3, dims, block=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, k, 3, dims)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(6) for y in range(6))] * 2
    got = dualtree.cluster(spark.createDataFrame([(*x, "") for x in rows], SCHEMA), 9, 2, 2, block=10).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 9, 2, 2)


def test_tree_covers_and_separates():
    points = np.unique(np.random.default_rng(2).integers(-50, 50, (500, 3)), axis=0)
    tree = dualtree.CoverTree(points)
    assert sorted(tree.order) == list(range(len(points)))
    for node in range(len(tree.centre)):
        own = points[tree.order[tree.start[node] : tree.end[node]]]
        assert (dualtree.apart(own, points[tree.centre[node]]) <= tree.radius[node] ** 2).all()
        kids = range(tree.child[node], tree.child[node] + tree.count[node])
        if tree.count[node]:
            assert tree.centre[kids[0]] == tree.centre[node] and tree.start[kids[0]] == tree.start[node] and tree.end[kids[-1]] == tree.end[node]
            assert all(tree.end[a] == tree.start[a + 1] for a in kids[:-1])
            assert all(4 * ((points[tree.centre[a]] - points[tree.centre[b]]) ** 2).sum() > tree.radius[node] ** 2 * (1 - 1e-9) for a in kids for b in kids if a < b)


def test_pairs_are_pruned():
    """Clusters far from each other: most nodes are assigned whole."""
    r = np.random.default_rng(3)
    middle = r.integers(-10000, 10000, (16, 8))
    points = np.unique(middle[r.integers(0, 16, 2000)] + r.integers(-40, 40, (2000, 8)), axis=0)
    tree = dualtree.CoverTree(points)
    to, work = dualtree.nearest(points, tree, *dualtree.model(middle))
    assert (to == np.argmin(((points[:, None] - middle[None]) ** 2).sum(2), 1)).all()
    assert work < len(points)


def test_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame([(*x, "") for x in rows], SCHEMA)
    assert dualtree.cluster(frame([])).collect() == [] and dualtree.cluster(frame([(1, None), (2, [0.5])])).collect() == []
    one = dualtree.cluster(frame([(7, [0.5, -0.01])]), dims=2).collect()
    assert [tuple(r) for r in one] == [(7, 0, 0, 0, 0, hashlib.sha256(b"32,-1").hexdigest())]
    with pytest.raises(ValueError, match="64 bits"):
        dualtree.cluster(frame([(1, [1e30]), (2, [0.0])]), dims=1)


def test_query_is_the_sql(spark):
    got = dualtree.op13_dualtree(spark, "/root/testdata/sf0.001")
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    want = c.execute(dualtree.SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
